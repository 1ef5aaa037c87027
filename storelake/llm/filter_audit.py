"""What each of five filters removes, in every order in which they can be applied.

The costly one, "the text was there before", needs equal texts together. A counting
Bloom filter goes first: every task counts the hashes of its texts in a sketch, the
sketches are added up, and a text one of whose counters is 1 is the only one of its kind.
Only the rest, the possible repeats, are shuffled, by their whole text, for the smallest id.

All else is additive: a row is a mask of the filters it fails, and everything a step of
an order does to a part of the rows is a sum over the 32 masks of that part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.session import written

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
SPACES = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"

#: Counters for each text, as long as they fit, and hash functions.
COUNTERS_PER_TEXT, HASHES = 8, 4
#: Bits of the broadcast sketch: a bit for each counter, set where it is 2 or more. Beyond
#: some 10^8 texts the sketch clears fewer of them; what it does not clear is shuffled.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
#: Counters of one page, the unit in which sketches are added up, so many at a time.
PAGE, FAN = 1 << 16, 64
#: Places a task holds before it passes its sketch on.
HELD_PLACES = 1 << 22


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketch_size(texts: int, most_bits: int = MOST_BITS) -> tuple[int, int]:
    """Counters (a power of two) and hash functions for so many texts."""
    wanted = 1 << math.ceil(math.log2(max(1, texts * COUNTERS_PER_TEXT)))
    bits = max(min(wanted, most_bits), min(LEAST_BITS, most_bits))
    return bits, max(1, min(HASHES, round(math.log(2) * bits / max(1, texts))))


def places(hashes: np.ndarray, bits: int, functions: int) -> Iterator[np.ndarray]:
    """The counter of each hash by each hash function."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(functions):
        x = h + np.uint64(k) * step
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield ((x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def count_hashes(bits: int, functions: int, held: int = HELD_PLACES):
    """The sketch of a task by pages: the places met once, and those met more often."""
    def packed(met: list[np.ndarray], task: int) -> pa.RecordBatch:
        place, times = np.unique(np.concatenate(met), return_counts=True)
        size = min(PAGE, bits)
        page = place // size
        within, numbers = (place % size).astype("<u2"), np.unique(page)
        edges = np.searchsorted(page, [*numbers, bits])
        parts = [[within[a:b][times[a:b] == 1].tobytes() for a, b in zip(edges, edges[1:])],
                 [within[a:b][times[a:b] > 1].tobytes() for a, b in zip(edges, edges[1:])]]
        return pa.RecordBatch.from_pydict({
            "page": pa.array(numbers, pa.int32()),
            "task": pa.array([task] * len(numbers), pa.int32()),
            "once": pa.array(parts[0], pa.binary()), "more": pa.array(parts[1], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, met, waiting = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            for place in places(np.asarray(batch.column(0)), bits, functions):
                met.append(place)
                waiting += len(place)
            if waiting >= held:
                yield packed(met, task)
                met, waiting = [], 0
        if waiting:
            yield packed(met, task)

    return count


def add_pages(pdf):
    """The sum of some pages of one place in the sketch."""
    import pandas as pd

    counters = np.zeros(PAGE, np.uint8)
    for once, more in zip(pdf["once"], pdf["more"], strict=True):
        at = np.frombuffer(once, "<u2")
        counters[at] = np.minimum(counters[at] + 1, 2)
        counters[np.frombuffer(more, "<u2")] = 2
    once, more = (np.flatnonzero(counters == n).astype("<u2").tobytes() for n in (1, 2))
    return pd.DataFrame({"page": pdf["page"].iloc[:1], "task": pdf["task"].iloc[:1] // FAN,
                         "once": [once], "more": [more]})


def repeat_sketch(hashes: DataFrame, bits: int, functions: int, least: int = 2) -> bytes:
    """The merged sketch: bit p (from the left) is set if place p was met ``least`` (1 or 2)
    times or more.

    Sketches are added up FAN tasks at a time, until one is left; what then comes to the
    driver are at most two bytes for each bit that is set.
    """
    kind = "page int, task int, once binary, more binary"
    pages = written(hashes.mapInArrow(count_hashes(bits, functions), kind), "sketches")
    tasks = pages.agg(F.max("task")).first()[0] or 0
    while True:
        pages = pages.withColumn("of", F.floor(F.col("task") / FAN)).groupBy("page", "of")
        pages = pages.applyInPandas(lambda pdf: add_pages(pdf), kind)
        if tasks < FAN:
            break
        pages, tasks = written(pages, "sketches"), tasks // FAN
    size, merged = min(PAGE, bits), np.zeros(bits, bool)
    met = F.concat("once", "more") if least == 1 else F.col("more")
    pages = pages.select("page", met.alias("met")).filter("octet_length(met) > 0")
    for row in pages.toLocalIterator():
        merged[row["page"] * size + np.frombuffer(row["met"], "<u2").astype(np.int64)] = True
    return np.packbits(merged).tobytes()


def possible_repeats(docs: DataFrame, bits: int, functions: int):
    """A column function: whether a hash may be that of two texts (never false for one that is)."""
    hashes = docs.select(text_hash().alias("hash"))
    return as_column(look_up(docs, repeat_sketch(hashes, bits, functions), bits, functions))


def possible_members(hashes: DataFrame, most_bits: int = MOST_BITS):
    """A column function: whether a hash may be one of those given (never false for one that is).

    What it clears needs no join with them. As with repeats, beyond some 10^8 hashes it
    clears fewer.
    """
    return as_column(member_test(hashes, most_bits))


def member_test(hashes: DataFrame, most_bits: int = MOST_BITS):
    """The same for an array of hashes within a task that runs Python anyway.

    A column function before ``mapInArrow`` in one stage takes a second Python worker for
    each task, and both stay.
    """
    bits, functions = sketch_size(hashes.count(), most_bits)
    return look_up(hashes, repeat_sketch(hashes, bits, functions, 1), bits, functions)


def look_up(df: DataFrame, merged: bytes, bits: int, functions: int):
    """A function of an array of hashes: whether all places of each are set in the sketch."""
    sketch = df.sparkSession.sparkContext.broadcast(merged)

    def maybe(hashes: np.ndarray) -> np.ndarray:
        set_bits, out = np.frombuffer(sketch.value, np.uint8), np.ones(len(hashes), bool)
        for place in places(hashes, bits, functions):
            out &= (set_bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        return out

    return maybe


def as_column(test):
    @F.pandas_udf("boolean")
    def maybe(hashes):
        import pandas as pd

        return pd.Series(test(hashes.to_numpy()))

    return maybe


def failed_filters(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, part and the mask of failed filters (bit k: FILTERS[k]) of every row, written.

    E fails where a row with a smaller doc_id has the same text; a null id neither is
    smaller than another nor has a smaller one. A null text is an empty one.
    """
    maybe = possible_repeats(docs, *sketch_size(docs.count(), most_bits))
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("hash"))
    split = text.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    measured = split.select(
        "doc_id", "part", "text", "hash", F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.length("text").cast("long").alias("n_chars"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"))
    fails = [F.col("n_words") < LEAST_WORDS,
             100 * F.col("n_distinct") < LEAST_DISTINCT_PERCENT * F.col("n_words"),
             100 * F.col("n_capitals") > MOST_CAPITALS_PERCENT * F.col("n_chars"),
             F.col("text").rlike(MARKS)]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails[1:], 1)),
               F.when(fails[0], 1).otherwise(0))
    rows = written(measured.select(
        "doc_id", "part", mask.cast("int").alias("mask"), "hash",
        F.when(maybe("hash"), F.col("text")).alias("repeat")), "failed-filters")
    first = rows.filter(F.col("repeat").isNotNull()).groupBy("hash", "repeat").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select(
        F.col("hash").alias("h"), F.col("repeat").alias("t"), "first_id")
    again = rows.join(first, (F.col("hash") == F.col("h")) & (F.col("repeat") == F.col("t")),
                      "left")
    return written(again.select(
        "doc_id", "part",
        (F.col("mask") + F.when(F.col("first_id") < F.col("doc_id"), 1 << 4).otherwise(0))
        .alias("mask")), "failure-masks")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part and mask the rows, and how many of them are good or toxic."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def steps() -> Column:
    """Every step of every order: its filter's bit and the bits of the filters before it."""
    return F.array(*[
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"),
                 F.lit(1 << FILTERS.index(order[k])).alias("bit"),
                 F.lit(sum(1 << FILTERS.index(f) for f in order[:k])).alias("before"))
        for order in permutations(FILTERS) for k in range(len(order))])


def audit(docs: DataFrame, labels: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each part, order of the filters and step.

    ``docs`` has doc_id, source and text, ``labels`` doc_id, quality and toxic (of repeated
    ids the larger value counts); other columns are not read. A part is a source, null the
    empty string. Repeated rows count each; of rows equal in text those with the smallest
    id pass filter E. An empty table has no parts and gives no rows.

    shapley is the sum over all orders of what the filter removes: a row that fails m
    filters is removed by each of them in 120 / m orders.
    """
    counts = mask_counts(failed_filters(docs, most_bits), labels)
    by_part = counts.groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most
    at = by_part.select("part", "counts", F.explode(steps()).alias("s")).select(
        "part", "counts", "s.*")

    def total(value: Column, when) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(
            when(c["mask"]), value(c)).otherwise(F.lit(0).cast("long")))

    def hit(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("bit")) != 0

    def gone(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("before")) != 0

    def here(mask: Column) -> Column:
        return hit(mask) & ~gone(mask)

    n = lambda c: c["n"]
    orders = math.factorial(len(FILTERS))
    return at.select(
        "part", "filter_order", "step",
        total(n, lambda m: ~hit(m) & ~gone(m)).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: hit(m) & gone(m)).alias("redundant"),
        total(n, lambda m: m == F.col("bit")).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        total(lambda c: c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("long"), hit)
        .alias("shapley"))
