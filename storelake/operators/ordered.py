"""Running totals and row numbers that do not need one group in one task.

A plain window sorts each group inside one task, so a key that owns a third of
the rows owns a third of the work. ``in_order`` counts the groups first. While
the largest stays under ``rows_per_chunk`` a plain window is used. Otherwise the
rows are range-partitioned by (keys, order): the chunk number then follows the
order, a hot key is spread over many chunks, and each chunk border cuts at most
one key. Totals are taken per chunk, and the few cut keys (fewer than there are
chunks) get the sum of their earlier chunks added.

The rows are written out with their chunk number, so a lost executor cannot change
which chunk a row belongs to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelake.session import made_from, written

ROWS_PER_CHUNK = 5_000_000
CHUNK = "_chunk"
_PLACE = "_place_in_range"


@dataclass(frozen=True)
class Ordered:
    """Rows with the keys and total order they are to be read in."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool

    @property
    def parts(self) -> tuple[str, ...]:
        return (*self.keys, CHUNK) if self.chunked else self.keys


def in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
    probe: DataFrame | None = None,
) -> Ordered:
    """Decide how to read ``df`` per key in ``order`` (ascending, NULLs first).

    ``probe`` may name rows that are cheaper to count: at least the rows of
    ``df``, with some of the keys. Groups by fewer keys are larger, so what is
    small there is small here. ``rows_per_chunk=None`` skips the count for callers
    that know their groups are small.
    """
    keys, order = tuple(keys), tuple(order)
    if rows_per_chunk is None:
        return Ordered(df, keys, order, False)
    counted = df if probe is None else probe
    sizes = counted.groupBy(*[k for k in keys if k in counted.columns]).agg(
        F.count("*").alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) <= rows_per_chunk:
        return Ordered(df, keys, order, False)
    chunks = ceil(total / rows_per_chunk)
    ranged = df.repartitionByRange(chunks, *keys, *order)
    return Ordered(
        written(ranged.withColumn(CHUNK, F.spark_partition_id())), keys, order, True
    )


def _with_carry(rows: DataFrame, carry: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Left join the carry of the cut keys; all other rows get NULL."""
    renamed = carry.select(
        *[F.col(p).alias(f"_p_{p}") for p in parts],
        *[c for c in carry.columns if c not in parts],
    )
    on = reduce(and_, (F.col(p).eqNullSafe(F.col(f"_p_{p}")) for p in parts))
    return rows.join(renamed, on, "left").drop(*[f"_p_{p}" for p in parts])


def running_sums(o: Ordered, sums: Mapping[str, Column], keep_chunk: bool = False
                 ) -> DataFrame:
    """Add inclusive running sums, one per name, reading each key in order.

    ``keep_chunk`` leaves the chunk number in, for callers that come again with
    the same rows.
    """
    upto = Window.partitionBy(*o.parts).orderBy(*o.order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = o.df.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
    if not o.chunked:
        return out
    totals = o.df.groupBy(*o.parts).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    chunks = Window.partitionBy(*o.keys).orderBy(CHUNK)
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *o.parts,
        F.lag(CHUNK).over(chunks).alias("_from"),
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
    ).filter(F.col("_from").isNotNull()).drop("_from")
    joined = _with_carry(out, carry, o.parts)
    for n in sums:
        joined = joined.withColumn(n, _plus(F.col(n), F.col(f"_c_{n}")))
    return joined.drop(*([] if keep_chunk else [CHUNK]), *[f"_c_{n}" for n in sums])


def _plus(a: Column, b: Column) -> Column:
    """SUM semantics: NULL only if both parts are NULL."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def row_numbers(o: Ordered, name: str) -> DataFrame:
    """Number the rows of each key 1, 2, ... in order."""
    return running_sums(o, {name: F.lit(1).cast("long")})


def previous_values(o: Ordered, values: Mapping[str, str], last: str | None = None
                    ) -> DataFrame:
    """Add the value each column had on the row before, within the key.

    Columns must not be NULL: a NULL before stands for "no row before". ``last`` names a
    column that tells whether a row is the last of its key.
    """
    step = Window.partitionBy(*o.parts).orderBy(*o.order)
    out = o.df.select("*", *[F.lag(c).over(step).alias(n) for n, c in values.items()])
    if last:
        out = out.withColumn(last, F.lead(F.lit(True)).over(step).isNull())
    if not o.chunked:
        return out
    lasts = o.df.groupBy(*o.parts).agg(
        F.max_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]),
                 F.struct(*o.order)).alias("_last")
    )
    chunks = Window.partitionBy(*o.keys).orderBy(CHUNK)
    carry = lasts.select(*o.parts, F.lag("_last").over(chunks).alias("_before"),
                         F.lead(CHUNK).over(chunks).alias("_later"))
    cut = F.col("_before").isNotNull() | F.col("_later").isNotNull()
    joined = _with_carry(out, carry.filter(cut), o.parts)
    for n in values:
        joined = joined.withColumn(n, F.coalesce(F.col(n), F.col("_before")[n]))
    if last:
        joined = joined.withColumn(last, F.col(last) & F.col("_later").isNull())
    return joined.drop(CHUNK, "_before", "_later")


def dense_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
                  without: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Number the rows of each key 1, 2, ... in order; also the rows of each key, as n.

    Two phases at every size, and no task has a whole key: the rows are dealt into ranges
    of (keys, order), sorted and written with their range and place in it; the ranges are
    counted, and a row's number is its place after those of the ranges before. Rows are
    shuffled once, and as they are written, a lost executor cannot change their place.
    NULLs come first and are a key like others. Columns in ``without`` (of the order) are left
    out of the result; :func:`storelake.session.discard` deletes the ranges of the numbered rows.
    """
    keys, order = list(keys), list(order)
    # The id has the range in the bits from 33 on, below them the place.
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranges = written(ranged.withColumn(_PLACE, F.monotonically_increasing_id()).drop(*without),
                     "ranges")
    chunks = ranges.withColumn(CHUNK, F.shiftright(_PLACE, 33))
    sizes = chunks.groupBy(*keys, CHUNK).agg(
        F.count("*").alias("_rows"), F.min(_PLACE).alias("_first"))
    if keys:
        sizes = written(sizes, "range-sizes")
        earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(
            Window.unboundedPreceding, -1)
        before = sizes.select(*keys, CHUNK, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
                                             - F.col("_first")).alias("_before"))
        counts = sizes.groupBy(*keys).agg(F.sum("_rows").alias("n"))
    else:
        # One row for each range: there are as many as the shuffle has partitions. Joined as
        # a broadcast, else the rows themselves may be shuffled to meet them.
        rows = sorted(sizes.collect(), key=lambda r: r[CHUNK])
        sums = [0]
        for r in rows:
            sums.append(sums[-1] + r["_rows"])
        spark = df.sparkSession
        before = F.broadcast(spark.createDataFrame(
            [(r[CHUNK], s - r["_first"]) for r, s in zip(rows, sums)],
            f"{CHUNK} long, _before long"))
        counts = spark.createDataFrame([(sums[-1],)], "n long")
    out = _with_carry(chunks, before, [*keys, CHUNK])
    out = out.withColumn(name, F.col(_PLACE) + 1 + F.col("_before")).drop(
        _PLACE, CHUNK, "_before")
    return made_from(out, ranges), counts


def side_by_side(rows: DataFrame, group: str, order: Sequence[str | Column]) -> DataFrame:
    """Rows of one group follow each other in order in one task, which has many groups.

    For groups of a bounded size that are gone through in Python as one sorted stream: a
    call for each group costs far more than the few rows that most of them have.
    """
    return rows.repartition(group).sortWithinPartitions(group, *order)


def numbered(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    start: int = 0,
    small: bool = False,
    without: Sequence[str] = (),
) -> DataFrame:
    """Number all rows ``start + 1``, ``start + 2``, ... in order.

    ``small`` is for callers whose rows are bounded, such as a report's first ten. See
    :func:`dense_numbers` for ``without`` and for deleting what is written.
    """
    if small:
        return _from_start(row_numbers(Ordered(df, (), tuple(order), False), name), name, start
                           ).drop(*without)
    rows = dense_numbers(df, [], order, name, without)[0]
    return made_from(_from_start(rows, name, start), rows)


def _from_start(rows: DataFrame, name: str, start: int) -> DataFrame:
    return rows.withColumn(name, F.col(name) + F.lit(start).cast("long")) if start else rows
