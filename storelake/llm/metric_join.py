"""Exact similarity join of vectors: cells around pivots, joined independently.

Angles between vectors are a metric. Every vector is at home in the cell of its nearest
pivot. A vector x with home p can be within the angle t of one with home q only if

* angle(x, q) - angle(x, p) <= 2 t (the triangle inequality, used twice),
* x is within t of the plane halfway between p and q, and
* angle(x, q) <= t + radius(q), the largest angle of a vector at home in q,

so x also visits those cells, but only ones numbered below its own: each link is then met
in one cell. Cells never look at each other. A cell of many vectors is dealt out in
blocks, and each pair of blocks is one group, so a crowded cell is bounded work for
many tasks rather than much work for one.

Equal directions are one node with a number of copies. What a group returns is at most
one row for each vector in it: the copies it is linked with and the smallest node that
links inside the group lead to. Pairs are never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.llm.near_dups import components
from storelake.session import written

SIMILARITY = 0.93
#: All pivots together, which every task reads: at most so many, and at most so many bytes.
MOST_PIVOTS, PIVOT_BYTES = 4096, 32 << 20
#: A space of n nodes gets sqrt(n) / ROOT_SHARE pivots: more would make more visits.
ROOT_SHARE = 8
#: Bytes of vectors in one block.
BLOCK_BYTES = 8 << 20
#: Angles are not computed better than this near 0.
SLACK = 1e-6
#: Rows of one strip of a comparison.
STRIP = 512


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and doubles of the vectors of each length; none that is null or has nulls."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    values = column.flatten()
    values = np.asarray(pc.fill_null(values, float("nan")))
    ends = np.cumsum(lengths)
    for length in np.unique(lengths):
        if length:
            rows = np.flatnonzero(lengths == length)
            yield rows, values[(ends[rows] - length)[:, None] + np.arange(length)]


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column as the bytes of doubles of length 1; null if there is no direction."""
    for batch in batches:
        out = [None] * batch.num_rows
        for rows, x in _matrices(batch.column(batch.num_columns - 1)):
            # By powers of two first: no square is out of range and no digit changes.
            most = np.abs(x).max(axis=1)
            good = np.isfinite(most) & (most > 0)
            rows, x = rows[good], x[good]
            x = np.ldexp(x, -np.frexp(most[good])[1][:, None])
            x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0
            for row, vector in zip(rows, x, strict=True):
                out[row] = vector.tobytes()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "unit"])


def choose_pivots(nodes: DataFrame, most: int = MOST_PIVOTS, root_share: float = ROOT_SHARE
                  ) -> dict[tuple, np.ndarray]:
    """Pivots of the largest spaces, picked by a hash of their direction.

    About sqrt(n) / root_share of a space of n nodes, fewer in proportion if all
    together would pass ``most``. A space with none is one cell.
    """
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn(
        "want", F.floor(F.sqrt("n") / root_share)).filter("want > 1")
    total, widest = sizes.agg(F.sum("want"), F.max("dim")).first()
    if not total:
        return {}
    bound = min(most, max(1, PIVOT_BYTES // (8 * widest)))
    share = F.lit(min(1.0, bound / total)) * F.col("want") / F.col("n")
    place = F.pmod(F.xxhash64("unit"), F.lit(1 << 40)) / float(1 << 40)
    # The hash may pick a few more than is wanted; the smallest hashes stay.
    picked = nodes.join(sizes, ["label", "dim"]).filter(place < share).orderBy(
        place / share, "unit").limit(bound).select("label", "dim", "unit").collect()
    spaces: dict[tuple, list] = {}
    for row in picked:
        spaces.setdefault((row["label"], row["dim"]), []).append(np.frombuffer(row["unit"]))
    return {space: np.array(sorted(map(tuple, p))) for space, p in spaces.items()}


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _by_space(pdf) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    for (label, dim), rows in pdf.groupby(["label", "dim"], sort=False).indices.items():
        yield (label, int(dim)), rows, np.frombuffer(
            b"".join(pdf["unit"].iloc[rows]), np.float64).reshape(len(rows), int(dim))


def at_home(shared):
    """Adds cell and angle: the nearest pivot and how far it is (-1 without pivots)."""
    def add(frames):
        pivots = shared.value
        for pdf in frames:
            cell, angle = np.zeros(len(pdf), np.int32), np.full(len(pdf), -1.0)
            for space, rows, x in _by_space(pdf):
                if space in pivots:
                    turned = _angles(x, pivots[space])
                    cell[rows] = turned.argmin(axis=1)
                    angle[rows] = turned.min(axis=1)
            yield pdf.assign(cell=cell, angle=angle)

    return add


def visits(shared, radii, similarity: float):
    """The cells each vector has to visit besides its own, as rows with that cell."""
    t = float(np.arccos(similarity)) + SLACK

    def send(frames):
        pivots = shared.value
        for pdf in frames:
            for space, rows, x in _by_space(pdf):
                if space not in pivots:
                    continue
                p = pivots[space]
                radius = np.array([radii.value.get((*space, k), -np.inf) for k in range(len(p))])
                turned = _angles(x, p)
                home = pdf["cell"].to_numpy()[rows]
                own = turned[np.arange(len(rows)), home]
                gap = np.linalg.norm(p[:, None] - p[None], axis=2)[home]
                dots = x @ p.T
                lead = dots[np.arange(len(rows)), home][:, None] - dots
                plane = np.arcsin(np.clip(lead / np.maximum(gap, 1e-300), -1.0, 1.0))
                near = ((turned - own[:, None] <= 2 * t) & (plane <= t)
                        & (turned <= t + radius) & (np.arange(len(p)) < home[:, None]))
                who, where = np.nonzero(near)
                if len(who):
                    yield pdf.iloc[rows[who]].assign(cell=where.astype(np.int32))

    return send


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; root keeps the smallest member of each set."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def linked(similarity: float, strip: int = STRIP):
    """The work of one group: node, links and low of each vector with a link in it."""
    def work(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["node", "other"], kind="stable", ignore_index=True)
        other = pdf["other"].to_numpy()
        x = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        copies, node = pdf["copies"].to_numpy(), pdf["node"].to_numpy()
        own, met = np.flatnonzero(~other), np.flatnonzero(other)
        alone = pdf["i"].iloc[0] == pdf["j"].iloc[0]  # a block with itself
        count, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for first in range(0, len(own), strip):
            rows = own[first:first + strip]
            cols = own[first:] if alone else met
            near = x[rows] @ x[cols].T >= similarity
            if alone:
                near &= np.arange(len(cols)) > np.arange(len(rows))[:, None]
            count[rows] += near @ copies[cols]
            count[cols] += copies[rows] @ near
            i, j = np.nonzero(near)
            if len(i):
                pairs = np.unique(root[rows[i]] * len(pdf) + root[cols[j]])
                join_roots(root, pairs // len(pdf), pairs % len(pdf))
        found = np.flatnonzero(count)
        return pd.DataFrame({"node": node[found], "links": count[found],
                             "low": node[root[found]]})

    return work


def _grouped(homes: DataFrame, guests: DataFrame, block_bytes: int) -> DataFrame:
    """The rows of each pair of blocks of a cell: group is (i, j), other tells the side.

    Blocks 0 to b - 1 are those at home, the ones after them visitors. Block i meets the
    blocks from i on; so each two vectors of a cell of which one is at home meet once.
    """
    both = homes.select("label", "dim", "cell", "node", "unit", "copies",
                        F.lit(False).alias("guest")).unionByName(
        guests.select("label", "dim", "cell", "node", "unit", "copies",
                      F.lit(True).alias("guest")))
    both = written(both, "placed")
    room = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (8 * F.col("dim"))))
    blocks = both.groupBy("label", "dim", "cell").agg(
        F.count_if(~F.col("guest")).alias("b"), F.count_if("guest").alias("g")).withColumns(
        {n: F.ceil(F.col(n) / room) for n in ("b", "g")})
    # A cell with visitors but nobody at home has nothing to join.
    dealt = both.join(blocks.filter("b > 0"), ["label", "dim", "cell"]).withColumn(
        "block", F.when(F.col("guest"), F.col("b") + F.pmod(F.xxhash64("node"), "g"))
        .otherwise(F.pmod(F.xxhash64("node"), "b")))
    last_home = F.least("block", F.col("b") - 1)
    before = F.transform(F.sequence(F.lit(0).cast("long"), last_home), lambda i: F.struct(
        i.alias("i"), F.col("block").alias("j"), (i != F.col("block")).alias("other")))
    after = F.when(F.col("guest") | (F.col("block") + 1 >= F.col("b") + F.col("g")),
                   F.array().cast("array<struct<i:bigint,j:bigint,other:boolean>>")).otherwise(
        F.transform(F.sequence(F.col("block") + 1, F.col("b") + F.col("g") - 1),
                    lambda j: F.struct(F.col("block").alias("i"), j.alias("j"),
                                       F.lit(False).alias("other"))))
    return dealt.select("label", "dim", "cell", "node", "unit", "copies",
                        F.explode(F.concat(before, after)).alias("at")).select(
        "label", "dim", "cell", "at.i", "at.j", "at.other", "node", "unit", "copies")


def link_similar(vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label",
                 most_pivots: int = MOST_PIVOTS, root_share: float = ROOT_SHARE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two rows are linked if their labels are equal and not null, their vectors have the
    same length and a cosine (in double precision) of at least ``similarity`` (above 0).
    Vectors that are null, empty or zero, or hold null or non-finite components, are linked
    with nothing. n_links counts the other rows linked, repeated rows and repeated ids
    included. component_id is the smallest id that links lead to (null if all are), kept is
    whether it is the row's own; repeated ids are all kept, or none. Other columns are
    not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = {n: vectors.schema[c].dataType.simpleString() for n, c in
            (("vec_id", id_col), ("label", label_col))}
    rows = written(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                                  F.col(vector_col).alias("unit")).mapInArrow(
        unit_vectors, f"vec_id {kind['vec_id']}, label {kind['label']}, unit binary"), "vectors")
    fit = F.col("unit").isNotNull() & F.col("label").isNotNull()
    nodes = rows.filter(fit).groupBy("label", "unit").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = written(nodes.select(
        F.monotonically_increasing_id().alias("node"), "label",
        F.expr("cast(octet_length(unit) / 8 as int)").alias("dim"), "unit", "copies", "first_id"),
        "vector-nodes")

    pivots = spark.sparkContext.broadcast(choose_pivots(nodes, most_pivots, root_share))
    columns = f"node bigint, label {kind['label']}, dim int, unit binary, copies bigint"
    narrow = nodes.select("node", "label", "dim", "unit", "copies")
    homes = written(narrow.mapInPandas(at_home(pivots), f"{columns}, cell int, angle double"),
                    "homes")
    # One radius for each pivot at most; spaces without pivots are one cell.
    radii = spark.sparkContext.broadcast({
        (r["label"], r["dim"], r["cell"]): r["radius"] for r in homes.filter("angle >= 0").groupBy(
            "label", "dim", "cell").agg(F.max("angle").alias("radius")).collect()})
    guests = homes.select(*narrow.columns, "cell").mapInPandas(
        visits(pivots, radii, similarity), f"{columns}, cell int")
    found = written(_grouped(homes, guests, block_bytes).groupBy(
        "label", "dim", "cell", "i", "j").applyInPandas(
        linked(similarity), "node bigint, links bigint, low bigint"), "found")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = written(components(found.filter("node != low").select(
        F.col("node").alias("a"), F.col("low").alias("b"))), "vector-roots")
    placed = nodes.select("node", "label", F.sha2("unit", 256).alias("name"), "copies",
                          "first_id").join(counts, "node", "left").join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = placed.join(lowest, "root").select(
        "label", "name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id")
    named = rows.select("vec_id", "label", F.sha2("unit", 256).alias("name"))
    return named.join(known, ["label", "name"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        .alias("component_id")).withColumn("kept", F.expr("vec_id <=> component_id"))
