"""A training order that mixes sources to target weights which change over time.

Each source has a schedule: its share of the demand at equally spaced moments of the
training, linear in between. Integrated from the start, it says how many tokens of the
source have been asked for at any time; inverted, it says when the token at a given
place of the source's own (hashed) order is trained. Documents are sorted by range of
that position. A source that gives more than it has starts anew, up to a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512
REPEATS = 3
#: Demand over time for each weight: light sources fade, heavy ones grow.
CURRICULUM = {1: (1.5, 1.0, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.7, 1.0, 1.3)}


def count_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3),
                   repeats: int = REPEATS) -> DataFrame:
    """Target of every source: source, source_size, weight, target, total.

    ``sizes``: source and source_size, one row per source. By code point, null last,
    the sources take the weights in turn and share the sum of all sizes. What a source
    can't give in ``repeats`` rounds goes to the others by weight: every target is
    min(repeats * size, level * weight), and the level is read off the sources in the
    order in which they run out. The windows see one row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(
        F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    most = F.lit(repeats) * F.col("source_size")
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "runs_out", most / F.col("weight"))
    sooner = Window.orderBy("runs_out", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum(most).over(sooner), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(sooner), F.lit(0)))
    rows = rows.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("runs_out") >= F.col("level"), F.struct(
            "runs_out", "level"))).over(everything)["level"])
    return rows.select("source", "source_size", "weight", F.least(
        most.cast("double"), F.col("level") * F.col("weight")).alias("target"), "total")


def time_of(demand: Column, shares: Column, knots: int) -> Column:
    """When that part (0 to 1) of a source's whole demand has been asked for.

    ``shares``: the demand at ``knots`` equally spaced times, of any sum.
    """
    step = 1.0 / (knots - 1)
    area = [(shares[i] + shares[i + 1]) * (step / 2) for i in range(knots - 1)]
    whole = sum(area[1:], area[0])
    wanted, out = demand * whole, F.lit(None).cast("double")
    before = F.lit(0.0)
    pieces = []
    for i in range(knots - 1):
        left = F.greatest(wanted - before, F.lit(0.0))
        slope = (shares[i + 1] - shares[i]) / step
        root = F.sqrt(F.greatest(shares[i] * shares[i] + 2 * slope * left, F.lit(0.0)))
        passed = F.when(left == 0, 0.0).otherwise(2 * left / (shares[i] + root))
        before = before + area[i]
        pieces.append((before, i * step + F.least(passed, F.lit(step))))
    out = pieces[-1][1]
    for end, moment in reversed(pieces[:-1]):
        out = F.when(wanted < end, moment).otherwise(out)
    return out


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str,
           weights: Sequence[int], repeats: int, curriculum: dict[int, Sequence[float]],
           buckets: int, carry: bool) -> DataFrame:
    order = F.xxhash64(F.col(id_col), F.lit(0))
    rows = docs.select(
        *([F.struct("*").alias("row")] if carry else []), F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"),
        order.alias("place"), F.xxhash64(F.col(text_col)).alias("tie"),
        F.pmod(order, F.lit(buckets)).alias("bucket"))
    # Structs are equal if their fields are, nulls too: the rows are dealt by it once, for the
    # window and the join.
    rows = rows.withColumn("part", F.struct("source", "bucket"))
    # Prefix sums of a source in two steps, so that no task has a whole source.
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    targets = source_targets(parts.groupBy("source").agg(
        F.sum("part_size").alias("source_size")), weights, repeats)
    knots = len(next(iter(curriculum.values())))
    shares = F.array(*[F.lit(0.0)] * knots)
    for weight, values in curriculum.items():
        shares = F.when(F.col("weight") == weight, F.array(*[F.lit(float(v)) for v in values])
                        ).otherwise(shares)
    given = parts.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select(
        F.struct(F.col("p.source").alias("source"), "bucket").alias("its_part"), "offset",
        "source_size", "target", "total", shares.alias("shares"))
    within = Window.partitionBy("part").orderBy("place", "doc_id", "tie", "size"
                                                            ).rowsBetween(
        Window.unboundedPreceding, 0)
    rows = rows.withColumn("own_end", F.sum("size").over(within)).join(
        given, F.expr("part = its_part"))
    middle = F.col("offset") + F.col("own_end") - F.col("size") / 2
    demands = F.filter(F.array(*[middle + F.lit(i) * F.col("source_size")
                                 for i in range(repeats)]), lambda x: x < F.col("target"))
    positions = F.transform(demands, lambda x: F.col("total") * time_of(
        x / F.col("target"), F.col("shares"), knots))
    return rows.withColumn("positions", positions)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: Sequence[int] = (1, 2, 3),
                repeats: int = REPEATS, curriculum: dict[int, Sequence[float]] = CURRICULUM,
                buckets: int = BUCKETS) -> DataFrame:
    """What the mix takes of every document, sorted by first position.

    doc_id, source, size (words), source_size, target, copies, taken (words, copies
    counted), positions (token of the training at which each copy comes; the copy's
    middle), in the order of the training; documents not taken come last. Documents are taken
    whole, when more than half of one lies before its source's target, so a source
    misses its target by half a document at most. Null texts have no words; a document
    without words is taken by its place and takes nothing. Null is a source of its own,
    the last. Equal rows take consecutive places. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = placed(docs, id_col, text_col, source_col, weights, repeats, curriculum, buckets,
                  carry=False)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        F.size("positions").alias("copies"), (F.size("positions") * F.col("size")).cast("long")
        .alias("taken"), "positions", "place").orderBy(
        F.get("positions", F.lit(0)).asc_nulls_last(), "place").drop("place")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source", weights: Sequence[int] = (1, 2, 3),
                   repeats: int = REPEATS,
                   curriculum: dict[int, Sequence[float]] = CURRICULUM,
                   buckets: int = BUCKETS) -> DataFrame:
    """The mix itself: all columns of every copy taken, in the order of the training."""
    rows = placed(docs, id_col, text_col, source_col, weights, repeats, curriculum, buckets,
                  carry=True)
    return rows.select("row", F.explode("positions").alias("position")).orderBy(
        "position").select("row.*")
