"""Toxic texts by a convolutional classifier over hashed words.

Every word has two hashed embeddings that are added, of itself and of its first bytes.
Filters of several widths slide over the words, each filter keeps its largest answer in
the whole text, and a logistic layer reads those. The network learns from all labelled
texts in rounds: every task trains a copy on its own texts, and what the copies have
learned is averaged, weighted by the texts that had a say in it. A filter's
answer is a sum over its words of a table entry, so scoring is table look-ups and a
maximum for each text; texts of any length are read whole.

Scores never depend on the language. The decision to reject does: part of the labelled
texts is kept from training, and on all of it each language gets the threshold with the lowest
cost of errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.llm.filter_audit import member_test
from storelake.llm.text import Hasher, buffers, lowered, mix, slices, spans_of_words
from storelake.session import written

BUCKETS = 1 << 14
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
STEM_BYTES = 5
#: Limits of ``sample_rows`` for classifiers that learn from a sample (not this one).
SAMPLE_OF_LABEL = 2000
LONGEST_SAMPLE = 100_000
#: Texts that a task learns from, and those of a step; a step also ends at so many words.
TEXTS_OF_PART, BATCH, WORDS_OF_BATCH = 8000, 32, 1 << 17
ROUNDS = 3
#: Few texts are gone through more often: a task makes about so many steps in all rounds.
LEAST_STEPS = 700
#: Windows that a step looks at together, so that long texts take no more memory.
WINDOWS = 1 << 16
#: Numbers of the network in one row of the averaging, and tasks averaged at a time.
BLOCK, FAN = 1 << 14, 64
#: Texts whose answers are weighed together; the last digits of a score depend on it.
SCORED_BYTES = 1 << 20
#: Steps of the score in which thresholds are sought.
BINS = 4096
#: Rejecting a clean text costs as much as letting so many toxic ones pass.
COST_OF_REJECTING = 3.0
LEAST_FOR_THRESHOLD = 30


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and of its beginning, and the row it is in."""
    begin, end, row = spans_of_words(data, offsets)
    if not len(begin):
        return begin, begin, row
    hashes = Hasher(lowered(data))
    # Punctuation around a word does not count, unless there is nothing else.
    letter = ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | (
        (data >= 97) & (data <= 122)) | (data >= 128)
    place = np.arange(len(data))
    next_letter = np.minimum.accumulate(np.where(letter, place, len(data))[::-1])[::-1]
    last_letter = np.maximum.accumulate(np.where(letter, place, -1))
    first, last = next_letter[begin], last_letter[end - 1] + 1
    plain = first < end
    begin, end = np.where(plain, first, begin), np.where(plain, last, end)
    whole = hashes(begin, end)
    stem = hashes(begin, np.minimum(end, begin + STEM_BYTES)) ^ np.uint64(0x5A5A5A5A)
    bits = np.uint64(BUCKETS - 1)
    return (whole & bits).astype(np.int32), (mix(stem) & bits).astype(np.int32), row


@dataclass
class Network:
    """Tables of each filter's answer to a word (and to a stem) at each place of its width."""

    tables: list[list[np.ndarray]]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def answers(self, words: np.ndarray, stems: np.ndarray, row: np.ndarray, rows: int
                ) -> np.ndarray:
        """Largest answer of every filter in each row, 0 at least."""
        n, found = len(words), []
        for width, (tables, bias) in enumerate(zip(self.tables, self.bias, strict=True), 1):
            best = np.zeros((rows, len(bias)), np.float32)
            if n >= width:
                total = tables[0][words[:n - width + 1]] + tables[0][stems[:n - width + 1]]
                for j in range(1, width):
                    total += tables[j][words[j:n - width + 1 + j]]
                    total += tables[j][stems[j:n - width + 1 + j]]
                inside = np.flatnonzero(row[:n - width + 1] == row[width - 1:])
                if len(inside) < len(total):
                    total = total[inside]
                own = row[inside]
                if len(own):
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    best[own[first]] = np.maximum(
                        np.maximum.reduceat(total, first, axis=0) + bias, 0)
            found.append(best)
        return np.concatenate(found, axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = buffers(column)
        parts = [np.zeros(0)]
        for i, j in slices(offsets, SCORED_BYTES):
            found = []
            for a, b in slices(offsets[i:j + 1]):
                own = offsets[i + a:i + b + 1]
                ids = word_ids(data[own[0]:own[-1]], own - own[0])
                found.append(self.answers(*ids, b - a))
            parts.append(self.logistic(np.concatenate(found)))
        return np.concatenate(parts)

    def scored(self, words: np.ndarray, stems: np.ndarray, row: np.ndarray, rows: int
               ) -> np.ndarray:
        return self.logistic(self.answers(words, stems, row, rows))

    def logistic(self, answers: np.ndarray) -> np.ndarray:
        logit = answers @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class Trainer:
    """Adam on the logistic loss; only the words that won a maximum get a gradient."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {"embedding": rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32),
                  "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
                  "shift": np.zeros(1, np.float32)}
        for width in WIDTHS:
            self.p[f"filter{width}"] = rng.normal(0, 0.3, (width, SIZE, FILTERS)
                                                  ).astype(np.float32)
            self.p[f"bias{width}"] = np.zeros(FILTERS, np.float32)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def step(self, words: np.ndarray, stems: np.ndarray, row: np.ndarray, labels: np.ndarray,
             weight: np.ndarray, rate: float) -> None:
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        rows = len(labels)
        kept = []
        for width in WIDTHS:
            n = len(words) - width + 1
            starts = np.flatnonzero(row[:max(n, 0)] == row[width - 1:]) if n > 0 else []
            best = np.zeros((rows, FILTERS), np.float32)
            at = np.zeros((rows, FILTERS), np.int64)
            for low in range(0, len(starts), WINDOWS):
                some = starts[low:low + WINDOWS]
                inside = slice(some[0], some[-1] + width)
                vec = p["embedding"][words[inside]] + p["embedding"][stems[inside]]
                windows = np.concatenate([vec[some - some[0] + j] for j in range(width)], axis=1)
                answer = windows @ p[f"filter{width}"].reshape(-1, FILTERS) + p[f"bias{width}"]
                own = row[some]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                for a, b in zip(first, np.append(first[1:], len(own)), strict=True):
                    top = answer[a:b].argmax(0)
                    value, r = answer[a:b][top, np.arange(FILTERS)], own[a]
                    at[r] = np.where(value > best[r], some[a + top], at[r])
                    best[r] = np.maximum(value, best[r])
            kept.append((width, best, best > 0, at))
        pooled = np.concatenate([k[1] for k in kept], axis=1)
        logit = np.clip(pooled @ p["out"] + p["shift"][0], -30, 30)
        error = ((1 / (1 + np.exp(-logit)) - labels) * weight / rows).astype(np.float32)
        g["out"] = pooled.T @ error + 1e-4 * p["out"]
        g["shift"][0] = error.sum()
        for k, (width, _, live, at) in enumerate(kept):
            if not live.any():
                continue
            back = error[:, None] * p["out"][None, k * FILTERS:(k + 1) * FILTERS] * live
            g[f"bias{width}"] = back.sum(0)
            for j in range(width):
                place = np.minimum(at + j, len(words) - 1)
                vec = p["embedding"][words[place]] + p["embedding"][stems[place]]
                g[f"filter{width}"][j] = np.einsum("rfs,rf->sf", vec, back)
                push = back[:, :, None] * p[f"filter{width}"][j].T[None]
                flat = push.reshape(-1, SIZE)
                np.add.at(g["embedding"], words[place].ravel(), flat)
                np.add.at(g["embedding"], stems[place].ravel(), flat)
        self.t += 1
        for key, value in p.items():
            self.m[key] += 0.1 * (g[key] - self.m[key])
            self.v[key] += 0.001 * (g[key] ** 2 - self.v[key])
            value -= rate * (self.m[key] / (1 - 0.9 ** self.t)) / (
                np.sqrt(self.v[key] / (1 - 0.999 ** self.t)) + 1e-8)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def put(self, values: np.ndarray) -> Trainer:
        """Take all numbers from one array, as ``flat`` gives them."""
        at = 0
        for k in sorted(self.p):
            self.p[k] = values[at:at + self.p[k].size].reshape(self.p[k].shape).copy()
            at += self.p[k].size
        return self

    def network(self, prior_shift: float = 0.0) -> Network:
        tables = [[self.p["embedding"] @ self.p[f"filter{w}"][j] for j in range(w)]
                  for w in WIDTHS]
        return Network(tables, [self.p[f"bias{w}"] for w in WIDTHS], self.p["out"],
                       float(self.p["shift"][0]) + prior_shift)


def constant(prior: float) -> Network:
    """A network that gives every text the same score."""
    odds = float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    zero = [[np.zeros((BUCKETS, 1), np.float32) for _ in range(w)] for w in WIDTHS]
    return Network(zero, [np.zeros(1, np.float32) for _ in WIDTHS],
                   np.zeros(len(WIDTHS), np.float32), odds)


def threshold_of(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The cut with the lowest cost, half way to the next bin of the score that has texts."""
    order = np.argsort(-bins)
    bins = bins[order]
    cost = np.append(0, np.cumsum(COST_OF_REJECTING * clean[order] - toxic[order]))
    best = int(np.argmin(cost))
    if not best:
        return 1.1
    below = bins[best] + 1 if best < len(bins) else 0
    return float((bins[best - 1] + below) / 2 / BINS)


def ids_of(column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """The ids of the words and of their stems of each text, as 16-bit numbers."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        words, stems, row = word_ids(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        edge = np.searchsorted(row, np.arange(j - i + 1))
        for a, b in zip(edge, edge[1:], strict=False):
            yield words[a:b].astype("<u2").tobytes(), stems[a:b].astype("<u2").tobytes()


def named(maybe: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """The words of those rows whose hash of the id may be that of a labelled one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe(np.asarray(batch.column("hash"))), pa.bool_()))
            ids = list(ids_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"),
                 *[pa.array([t[k] for t in ids], pa.binary()) for k in (0, 1)]],
                ["doc_id", "lang", "words", "stems"])

    return run


def named_texts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, lang, words and stems of the texts that may have a label_id of the known ones."""
    id_type = texts.schema["doc_id"].dataType.simpleString()
    maybe = member_test(known.select(F.xxhash64(F.col("label_id").cast(id_type)).alias("hash")))
    return texts.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("hash")).mapInArrow(
        named(maybe), f"doc_id {id_type}, lang string, words binary, stems binary")


def numbers_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    for words, stems, label in zip(batch.column("words"), batch.column("stems"),
                                   batch.column("label").to_pylist(), strict=True):
        yield (np.frombuffer(words.as_buffer(), "<u2").astype(np.int32),
               np.frombuffer(stems.as_buffer(), "<u2").astype(np.int32), int(label))


def batches_of(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in that order, BATCH of them or WORDS_OF_BATCH words at a time; one at least."""
    first, words = 0, 0
    for k, size in enumerate(sizes[order]):
        if k > first and (k - first == BATCH or words + size > WORDS_OF_BATCH):
            yield order[first:k]
            first, words = k, 0
        words += size
    if len(order):
        yield order[first:]


def learn_part(sent, turn: int, share: float):
    """A copy of the network learns from the texts of a task; what that changes, by blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        texts = [t for batch in batches for t in numbers_of(batch)]
        if not texts:
            return
        start = sent.value
        trainer, rng = Trainer().put(start), np.random.default_rng(turn)
        labels = np.array([t[2] for t in texts])
        # Both labels count the same.
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        sizes = np.array([len(t[0]) for t in texts])
        each = sum(1 for _ in batches_of(np.arange(len(texts)), sizes))
        passes, step = max(1, round(LEAST_STEPS / (ROUNDS * each))), 0
        for _ in range(passes):
            for some in batches_of(rng.permutation(len(texts)), sizes):
                words, stems = (np.concatenate([texts[d][k] for d in some]) for k in (0, 1))
                if len(words):
                    done = (turn + min(1.0, step / (passes * each))) / ROUNDS
                    trainer.step(words, stems, np.repeat(np.arange(len(some)), sizes[some]),
                                 labels[some], weight[some], 0.02 * (1 - done) + 0.0005)
                step += 1
        change = trainer.flat() - start
        say = (change != 0) * np.float32(len(texts))
        task = TaskContext.get().partitionId()
        for block, low in enumerate(range(0, len(change), BLOCK)):
            at = slice(low, low + BLOCK)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int32()), "task": pa.array([task], pa.int32()),
                "change": pa.array([(change[at] * say[at]).astype("<f8").tobytes()], pa.binary()),
                "say": pa.array([say[at].astype("<f8").tobytes()], pa.binary())})

    return run


def add_blocks(pdf):
    """The sum of one block over some tasks, in the order of the tasks."""
    import pandas as pd

    pdf = pdf.sort_values("task")
    change, say = (sum(np.frombuffer(x, "<f8") for x in pdf[c]) for c in ("change", "say"))
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "task": pdf["task"].iloc[:1] // FAN,
                         "change": [change.tobytes()], "say": [say.tobytes()]})


def learned(texts: DataFrame, share: float, seed: int = 7) -> Trainer:
    """The network after ROUNDS rounds over all the texts (label, words, stems).

    The driver gets one averaged network a round, a megabyte, and no text.
    """
    kind = "block int, task int, change binary, say binary"
    state = Trainer(seed).flat()
    for turn in range(ROUNDS):
        sent = texts.sparkSession.sparkContext.broadcast(state)
        parts = written(texts.select("label", "words", "stems").mapInArrow(
            learn_part(sent, turn, share), kind), "learned")
        tasks = parts.agg(F.max("task")).first()[0] or 0
        while True:
            parts = parts.withColumn("of", F.floor(F.col("task") / FAN)).groupBy(
                "block", "of").applyInPandas(lambda pdf: add_blocks(pdf), kind)
            if tasks < FAN:
                break
            parts, tasks = written(parts, "learned"), tasks // FAN
        rows = sorted(parts.collect(), key=lambda r: r["block"])
        change, say = (np.concatenate([np.frombuffer(r[c], "<f8") for r in rows])
                       for c in ("change", "say"))
        state = (state + change / np.maximum(say, 1)).astype(np.float32)
        sent.unpersist()
    return Trainer(seed).put(state)


def thresholds_of(texts: DataFrame, network: Network) -> dict[str | None, float]:
    """Thresholds of all (None) and of each language with enough toxic texts among these."""
    sent = texts.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([float(sent.value.scored(w, s, np.zeros(len(w), np.int64), 1)[0])
                               for w, s, _ in numbers_of(batch)])
            bins = np.minimum((scores * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("label").cast(pa.int32()),
                 pa.array(bins, pa.int32())], ["lang", "label", "bin"])

    def of_lang(pdf):
        import pandas as pd

        found = threshold_of(*(pdf[c].to_numpy() for c in ("bin", "toxic", "clean")))
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "threshold": [found]})

    scored = texts.select("lang", "label", "words", "stems").mapInArrow(
        run, "lang string, label int, bin int")
    sums = (F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    bins = written(scored.groupBy("lang", "bin").agg(*sums), "score-bins")
    whole = bins.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = whole.collect()
    found = {None: threshold_of(*(np.array([r[c] for r in rows])
                                  for c in ("bin", "toxic", "clean")))}
    often = bins.filter("lang is not null").groupBy("lang").agg(F.sum("toxic").alias("n")).filter(
        F.col("n") >= LEAST_FOR_THRESHOLD)
    for r in bins.join(often, "lang", "left_semi").groupBy("lang").applyInPandas(
            of_lang, "lang string, threshold double").collect():
        found[r["lang"]] = r["threshold"]
    return {lang: min(max(x, 0.5), 0.99) for lang, x in sorted(
        found.items(), key=lambda y: (y[0] is not None, y[0]))}


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                label_col: str, learn: Column, most: int, longest: int,
                *more: Column) -> tuple[DataFrame | None, float]:
    """At most ``most`` labelled texts of either label, by hash of the id, and the share of 1."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")
                          ).filter(F.col("label").isin(0, 1)).filter(learn).dropDuplicates(
        ["label_id"])
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not counts:
        return None, 0.5
    order = F.xxhash64("label_id")
    some = None
    for label in sorted(counts):
        part = known.filter(F.col("label") == label).orderBy(order, "label_id").limit(most)
        some = part if some is None else some.unionByName(part)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.filter(F.octet_length(text) <= longest).select(
        F.col(id_col).alias("doc_id"), text.alias("text"), *more).join(
        F.broadcast(some), F.expr("doc_id = label_id")).dropDuplicates(["doc_id"])
    return rows, counts.get(1, 0) / sum(counts.values())


def labelled_sample(docs: DataFrame, labels: DataFrame, *how: object) -> tuple[list[dict], float]:
    """The rows of ``sample_rows`` in the order of their ids, collected."""
    rows, prior = sample_rows(docs, labels, *how)
    found = [] if rows is None else [r.asDict() for r in rows.collect()]
    return sorted(found, key=lambda r: r["doc_id"]), prior


def not_held_out(column: str, parts: int, held: int) -> Column:
    """crc32 of the id as text, modulo parts, is not the held-out remainder."""
    return F.crc32(F.col(column).cast("string")) % parts != held


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", lang_col: str = "lang", learn: Column | None = None) -> Network:
    """A network from all labelled texts that ``learn`` (on label_id) lets through.

    Of ids that come twice one text and the larger label count. A fifth of the texts, by
    hash of the id, is kept for the thresholds. Without texts of both labels all texts get
    the share of label 1 as their score.
    """
    learn = not_held_out("label_id", 5, 0) if learn is None else learn
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    texts = docs.select(F.col(id_col).alias("doc_id"), lang.cast("string").alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = written(labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label"))
                    .filter(F.col("label").isin(0, 1)).filter(learn).groupBy("label_id").agg(
        F.max("label").cast("int").alias("label")), "labels")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not counts:
        return constant(0.5)
    prior = counts.get(1, 0) / sum(counts.values())

    # Only the numbers of the words of labelled texts are shuffled.
    rows = named_texts(texts, known).join(known, F.expr("doc_id = label_id")).groupBy("doc_id").agg(
        F.min(F.struct("lang", "words", "stems", "label")).alias("row"))
    parts = -(-sum(counts.values()) // TEXTS_OF_PART)
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0
    rows = written(rows.select("row.*", held.alias("held"), F.xxhash64("doc_id").alias("place"))
                   .repartition(parts, "place").sortWithinPartitions("place", "words"),
                   "labelled-texts")
    found = {(r[0], r[1]): r[2] for r in rows.groupBy("held", "label").count().collect()}
    if len({label for _, label in found}) < 2:
        return constant(prior)
    apart = any(kept for kept, _ in found) and {(False, 0), (False, 1)} <= set(found)
    own = {label: found.get((False, label), 0) + (0 if apart else found.get((True, label), 0))
           for label in (0, 1)}
    share = own[1] / (own[0] + own[1])
    # The copies learned from both labels alike.
    shift = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    network = learned(rows.filter("not held") if apart else rows, share).network(float(shift))
    if apart:
        network.thresholds = thresholds_of(rows.filter("held"), network)
    return network


def with_scores(docs: DataFrame, text_col: str, scores: Callable[[pa.Array], np.ndarray]
                ) -> DataFrame:
    """row (all given columns) and score; a text goes to the worker once, within its row."""
    rows = docs.select(F.struct("*").alias("row"))
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(scores(row.field(at)), pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def score(docs: DataFrame, network: Network, text_col: str = "text", name: str = "toxicity"
          ) -> DataFrame:
    """The given columns and a score from 0 to 1.

    Null texts are empty; texts without words score as the network's shift says. An input
    column of the same name is replaced. An empty table gives an empty result.
    """
    return with_scores(docs, text_col, network.scores).select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c != name], F.col("score").alias(name))


def rejected(network: Network, score_col: Column, lang: Column) -> Column:
    """Whether a score is over its language's threshold."""
    limit = F.lit(network.thresholds.get(None, 0.5))
    for code, value in network.thresholds.items():
        if code is not None:
            limit = F.when(lang == code, value).otherwise(limit)
    return score_col >= limit


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    network = train(docs, labels, text_col=text_col)
    lang = F.col("row.lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = with_scores(docs, text_col, network.scores)
    return rows.filter(~rejected(network, F.col("score"), lang)).select("row.*")
