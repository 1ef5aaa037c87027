"""Near duplicates by ProbMinHash, banding and exact verification.

A text is its runs of five words, each weighted by 1 + ln(count). For every run, points
of a Poisson process of the run's weight arrive at random registers; a register keeps
the earliest arrival of all runs, and a run stops as soon as its next arrival would be
later than every register's. Two texts agree in a register with the probability Jaccard
similarity of their weighted runs. The same arrivals with all weights 1 give registers
that agree with the Jaccard similarity of the two sets of runs; a text in which no run
repeats has the same ones either way. Texts that agree in all registers of a band, of
either kind, are candidates; a candidate pair counts if the Jaccard similarity of the two
sets of runs, taken exactly, is high enough. Classes are the connected components of such
pairs.

Texts of the same words are one node from the start. Within a bucket of a band not all
pairs are made: first every node is compared with the most central node it shares a
bucket with (a copied text is in the buckets of all its copies), then with the centre
of each of its buckets that is in another component. Nodes that are left in a bucket with
another component are joined exactly, by the rarest of their runs, so no link between
candidates is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.block_naming import rows_left
from storelake.llm.filter_audit import possible_members
from storelake.llm.text import Hasher, buffers, lowered, mix, powers, slices, spans_of_words
from storelake.session import written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
#: 64-bit words of the bit map that bounds from below how many runs two texts do not share.
ODD_WORDS = 16
#: Odd constants that tell the places of a run, a band or a sequence apart.
PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
SEQUENCES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def runs_of(data: np.ndarray, offsets: np.ndarray, words: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each row (row, hash, count, in order of both) and the rows' nodes.

    A text of fewer words is one run. The node (16 bytes) stands for the sequence of words
    with A to Z in lower case.
    """
    rows = len(offsets) - 1
    begin, end, row = spans_of_words(data, offsets)
    each = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(each)])[:-1]
    hashes = Hasher(lowered(data))(begin, end)
    node = np.zeros((rows, 2), np.uint64)
    for i, base in enumerate(SEQUENCES):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            mix(hashes + PLACES[i]) * powers(len(hashes), base), dtype=np.uint64)])
        back = powers(len(hashes) + 1, pow(base, -1, 1 << 64))
        node[:, i] = mix((sums[first + each] - sums[first]) * back[first]
                         + each.astype(np.uint64) * PLACES[i])
    n = len(hashes) - words + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for j in range(words if n > 0 else 0):
        runs += hashes[j:j + n] * PLACES[j]
    inside = np.flatnonzero(row[:n] == row[words - 1:]) if n > 0 else np.zeros(0, np.int64)
    few = np.flatnonzero((each > 0) & (each < words))
    short = np.zeros(len(few), np.uint64)
    for j in range(words - 1):
        has = each[few] > j
        short[has] += hashes[first[few[has]] + j] * PLACES[j]
    of = np.concatenate([row[inside], few])
    run = mix(np.concatenate([runs[inside], short]))
    order = np.lexsort((run, of))
    of, run = of[order], run[order]
    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (run[1:] != run[:-1]))[:len(of)])
    count = np.diff(np.append(new, len(of)))
    return of[new], run[new], count, node.astype(">u8")


def registers(row: np.ndarray, run: np.ndarray, weight: np.ndarray, rows: int, m: int
              ) -> np.ndarray:
    """ProbMinHash: for each row and register the run that arrived first (0: none)."""
    earliest = np.full(rows * m, np.inf)
    winner = np.zeros(rows * m, np.uint64)
    last = np.full(rows, np.inf)
    now, turn = np.zeros(len(run)), 0
    while len(run):
        turns = int(np.clip(20_000 // len(run), 1, 64))
        marks = mix(np.arange(turn + 1, turn + turns + 1, dtype=np.uint64) * PLACES[9])
        draw = mix(run[:, None] ^ marks[None])
        wait = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
        at = now[:, None] + np.cumsum(wait / weight[:, None], axis=1)
        place = (((mix(draw + PLACES[11]) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                 ).astype(np.int64) + (row * m)[:, None]
        live = at < last[row][:, None]
        times, places = at[live], place[live]
        np.minimum.at(earliest, places, times)
        won = earliest[places] == times
        winner[places[won]] = np.broadcast_to(run[:, None], at.shape)[live][won]
        last = earliest.reshape(rows, m).max(1)
        now, turn = at[:, -1], turn + turns
        more = now < last[row]
        row, run, weight, now = row[more], run[more], weight[more], now[more]
    return winner.reshape(rows, m)


def band_keys(signature: np.ndarray, bands: int, size: int) -> np.ndarray:
    parts = signature.reshape(-1, bands, size)
    keys = (mix(parts + PLACES[20]) * PLACES[:size]).sum(2, dtype=np.uint64)
    return mix(keys + np.arange(bands, dtype=np.uint64) * PLACES[30]).astype(np.int64)


def keys_of(row: np.ndarray, run: np.ndarray, count: np.ndarray, rows: int, bands: int,
            size: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of all rows in turn, and where each row's begin (one more entry than rows).

    Keys by sets of runs, then those by weighted runs that are others: pairs are verified by
    their sets, and repeated runs can bring the weighted similarity far below that.
    """
    keys = np.zeros((rows, 2, bands), np.int64)
    use = np.zeros((rows, 2, bands), bool)
    keys[:, 0] = band_keys(registers(row, run, np.ones(len(run)), rows, bands * size),
                           bands, size)
    use[row, 0] = True
    again = np.zeros(rows, bool)
    again[row[count > 1]] = True
    if again.any():
        own = again[row]
        place = np.cumsum(again) - 1
        signature = registers(place[row[own]], run[own], 1 + np.log(count[own]),
                              int(again.sum()), bands * size)
        keys[again, 1] = band_keys(signature, bands, size)
        use[again, 1] = keys[again, 1] != keys[again, 0]
    return keys[use], np.concatenate([[0], np.cumsum(use.sum((1, 2)))])


def signer(words: int, bands: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                row, runs, count, node = runs_of(data[offsets[i]:offsets[j]],
                                                 offsets[i:j + 1] - offsets[i], words)
                keys, ends = keys_of(row, runs, count, j - i, bands, size)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i),
                    batch.column("name").slice(i, j - i),
                    pa.array([x.tobytes() for x in node], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                             pa.array(keys, pa.int64()))],
                    ["doc_id", "name", "node", "bands"])
    return run


def odd_sketch(row: np.ndarray, run: np.ndarray, rows: int) -> np.ndarray:
    """For each row a bit map in which each run turns over one bit."""
    out = np.zeros(rows * ODD_WORDS, np.uint64)
    place = mix(run ^ PLACES[40])
    word = row * ODD_WORDS + (place >> np.uint64(32)).astype(np.int64) % ODD_WORDS
    np.bitwise_xor.at(out, word, np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def run_sets(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                row, runs, _, node = runs_of(data[offsets[i]:offsets[j]],
                                             offsets[i:j + 1] - offsets[i], words)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array([x.tobytes() for x in node], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                             pa.array(runs.astype(np.int64), pa.int64())),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(j - i + 1) * ODD_WORDS, pa.int32()),
                        pa.array(odd_sketch(row, runs, j - i), pa.int64()))],
                    ["node", "runs", "odd"])
    return run


def sets_of(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node, runs and odd of the texts whose doc_id is among the wanted ids.

    Only texts that a sketch of the ids does not clear are shuffled. The join merges, however
    few the ids are: the sketch and the runs would share a stage after a broadcast, and each
    of its tasks would take two Python workers.
    """
    maybe = possible_members(ids.select(F.xxhash64("wanted").alias("hash")))
    some = texts.filter(maybe(F.xxhash64("doc_id"))).join(
        ids.hint("merge"), F.expr("doc_id <=> wanted"), "left_semi").select("text")
    return some.mapInArrow(run_sets(words), "node binary, runs array<bigint>, odd array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets of runs are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("node").alias("b"), F.col("runs").alias("runs_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    m, n = F.size("runs_a"), F.size("runs_b")
    shared = F.size(F.array_intersect("runs_a", "runs_b"))
    return both.filter(F.least(m, n) >= least * F.greatest(m, n)).filter(
        shared >= least * (m + n - shared)).select("a", "b")


def sharing_rare_runs(nodes: DataFrame, least: float) -> DataFrame:
    """All pairs (a < b) of different roots that can have that Jaccard similarity.

    ``nodes``: node, root, runs, odd. Put the runs of each node in one order for all, the rarest
    first. Sets of n runs that are that similar share one of their n - ceil(least * n) + 1
    first ones, and the runs shared there and the fewer of those that come after the last
    such one are enough. Runs that no other node has are never shared. So the nodes of a
    crowd meet by the runs that set them apart and not by those that all have.
    """
    runs = written(nodes.select("node", F.explode("runs").alias("run")), "runs-left")
    nodes = nodes.select("node", "root", F.size("runs").alias("n"), "odd")
    often = runs.groupBy("run").agg(F.count("*").alias("df"))
    order = Window.partitionBy("node").orderBy("df", "run")
    own = F.sum(F.when(F.col("df") == 1, 1).otherwise(0)).over(Window.partitionBy("node"))
    n = F.count("*").over(Window.partitionBy("node"))
    first = runs.join(often, "run").withColumn("at", F.row_number().over(order)).withColumn(
        "own", own).withColumn("n", n).filter(
        F.col("at") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).filter("df > 1")
    first = first.select("node", "run", "at", (F.col("n") - F.col("own")).alias("most"))
    first = written(first.join(nodes, "node"), "rare-runs")

    def side(name: str) -> DataFrame:
        return first.select("run", *[F.col(c).alias(f"{c}_{name}")
                                     for c in ("node", "root", "n", "most", "at", "odd")])

    # Not more is shared than the runs that others have too, nor than what comes before
    # and after a shared one.
    whole = F.least(F.least("at_a", "at_b") + F.least(F.col("n_a") - F.col("at_a"),
                                                      F.col("n_b") - F.col("at_b")),
                    "most_a", "most_b")
    # Every bit in which the maps differ is a run that one of the two has alone.
    bits = [F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i]))
            for i in range(ODD_WORDS)]
    apart = sum(bits[1:], bits[0])
    met = side("a").join(side("b"), "run").filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
        & (whole * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9)
        & (apart * (1 + least) <= (1 - least) * (F.col("n_a") + F.col("n_b")) + 1e-9))
    pairs = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(
        F.count("*").alias("shared"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"),
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    most = F.col("shared") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return pairs.filter(most * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9
                        ).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node) of every linked node but the roots themselves.

    Large and small stars in turn: neighbours hang themselves on the smallest one they
    know of, until nothing changes. Sums and joins on nodes only; takes about as many
    rounds as the logarithm of the longest chain.
    """
    stars = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u != v").distinct(), "links")
    mark = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"),
                                                           F.col("low").alias("v")).distinct()
        large = written(large, "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        stars = written(small.select("u", F.col("low").alias("v")).unionByName(
            small.filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        ).distinct(), "small-stars")
        seen = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def text_name(text: Column) -> Column:
    """SHA-256 of a text, null for a null one."""
    return F.unhex(F.sha2(text, 256))


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS,
            rows: int = ROWS) -> DataFrame:
    """doc_id, name (of the text) and root (of the class) of every row, written."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_name(F.col(text_col)).alias("name"),
                        F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    signed = written(texts.mapInArrow(
        signer(words, bands, rows),
        f"doc_id {id_type}, name binary, node binary, bands array<bigint>"), "signatures")
    members = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"),
                                         F.first("bands").alias("bands"))
    spread = written(members.select("node", F.explode("bands").alias("band")), "band-rows")
    shared = spread.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    spread = written(spread.join(shared, "band"), "buckets")
    central = spread.groupBy("node").agg(F.sum("n").alias("centre"))
    spread = written(spread.join(central, "node"), "centres")

    ids = written(members.select("node", "doc_id").join(central, "node", "left_semi").select(
        F.col("doc_id").alias("wanted")).distinct(), "wanted")
    sets = written(sets_of(texts, ids, words).dropDuplicates(["node"]), "run-sets")

    # Each node with the most central node it shares most buckets with.
    top = spread.groupBy("band").agg(F.max(F.struct("centre", "node")).alias("top"))
    offers = written(spread.join(top, "band").filter("node != top.node").groupBy(
        "node", "top").agg(F.count("*").alias("times")), "offers")
    best = offers.groupBy("node").agg(F.max(F.struct("times", "top"))["top"]["node"].alias("b"))
    tested = written(best.select(F.col("node").alias("a"), "b"), "tested")
    links = written(verified(tested, sets, similarity), "links")
    roots = components(links)

    # Each node with the other centres of its buckets that are not in its component.
    place = roots.select(F.col("node").alias("b"), F.col("root").alias("other"))
    rest = _rooted(offers.select("node", F.col("top.node").alias("b")).distinct(), roots).join(
        place, "b", "left").filter("root != coalesce(other, b)").select(
        F.col("node").alias("a"), "b")
    rest = written(rest.join(tested, ["a", "b"], "left_anti"), "rest")
    tested = tested.unionByName(rest)
    links = links.unionByName(written(verified(rest, sets, similarity), "links"))
    roots = components(links)

    # What is left: nodes of one bucket in different components.
    placed = written(_rooted(spread.select("band", "node"), roots), "placed")
    split = placed.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")
                                       ).filter("r != s").select("band")
    left = placed.join(split, "band", "left_semi").groupBy("node").agg(
        F.first("root").alias("root"))
    pairs = sharing_rare_runs(left.join(sets, "node"), similarity)
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.join(known, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(written(verified(pairs, sets, similarity), "links"))
    roots = written(components(links), "roots")

    labelled = _rooted(signed.select("doc_id", "name", "node"), roots)
    return written(labelled.select("doc_id", "name", "root"), "labelled")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    **options: object) -> DataFrame:
    """doc_id, class_id, class_size and kept of every row.

    class_id is the smallest id in the row's class (null if all are null), and the row
    with that id is the one kept; of rows with equal ids one. Texts without words (null
    ones too) are one class. Rows are told apart by their text, so repeated rows and null
    ids do no harm. Other columns are not read. An empty table gives an empty result.
    Pairs whose sets of runs have similarity s are candidates with a probability of at least
    1 - (1 - s^rows)^bands, however often runs repeat: for 0.8 that is 0.9993, for 0.85
    0.99999. ``options``: words, similarity, bands, rows.
    """
    labelled = classed(docs, id_col, text_col, **options)
    classes = labelled.groupBy("root").agg(F.min("doc_id").alias("class_id"),
                                           F.count("*").alias("class_size"))
    same_id = labelled.groupBy("root", "doc_id").agg(F.count("*").alias("copies"))
    return same_id.join(classes, "root").select(
        "doc_id", "class_id", "class_size", F.explode(F.sequence(F.lit(1), F.col("copies")))
        .alias("copy")).select(
        "doc_id", "class_id", "class_size",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy") == 1)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         **options: object) -> DataFrame:
    """One row of each class, with all its columns: one with the smallest id (null last).

    Rows are known by id and text, so repeated or null ids lose no other text. Of rows
    equal in both the first one in the order of all their columns stays.
    """
    labelled = classed(docs, id_col, text_col, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name"))
    keepers = labelled.groupBy("root").agg(first.alias("first"), F.count("*").alias("n")).filter(
        "n > 1").select("root", "first")
    by_key = written(labelled.join(keepers, "root").groupBy("doc_id", "name").agg(
        F.max(F.expr("doc_id <=> first.doc_id and name <=> first.name")).alias("stays"),
        F.count("*").alias("n")).filter("n > 1 or not stays").select(
        F.struct("doc_id", "name").alias("gone_key"), "stays"), "gone")
    return rows_left(docs, F.struct(
        F.col(id_col).alias("doc_id"), text_name(F.col(text_col)).alias("name")), by_key)
