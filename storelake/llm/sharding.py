"""Shards of nearly equal bytes, cut where the largest one is as small as possible.

Equal texts are one atomic group. The groups stand in the order of a 64-bit hash of
their text, and each shard is a stretch of that order. The smallest capacity for which
a greedy filling needs no more shards than allowed is found by binary search; the cuts
are those of the greedy filling at that capacity.

The search needs prefix sums only where a cut can fall. It starts from the bytes of
65,536 blocks of the order (by the first hex digits of the hash). A filling that cuts
at block ends alone bounds the capacity from above, one that may cut blocks anywhere
bounds it from below, and the blocks between are split further until both bounds are
the same. The driver sees block sums only: 65,536 rows at first, then 256 for each
block where a cut can fall.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.session import written

FIRST_DIGITS, MORE_DIGITS, ALL_DIGITS = 4, 2, 16
SALTS = 256


class Blocks:
    """Stretches of the order of groups, each with its bytes; some are single groups."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        rows = sorted(rows)
        self.prefixes = [prefix for prefix, _, _ in rows]
        self.single = [groups == 1 for _, groups, _ in rows]
        self.ends = list(accumulate(size for _, _, size in rows))
        self.total = self.ends[-1] if rows else 0

    def fill(self, capacity: int, shards: int, anywhere: bool) -> list[int] | None:
        """Where the greedy filling cuts, or None if it needs more shards.

        ``anywhere``: blocks of more than one group may be cut at any byte.
        """
        cuts, at = [], 0
        for _ in range(shards):
            reach = at + capacity
            if reach >= self.total:
                return cuts
            block = bisect_right(self.ends, reach)
            end = self.ends[block - 1] if block else 0
            if anywhere and not self.single[block]:
                end = reach
            if end <= at:
                return None
            at = end
            cuts.append(at)
        return None

    def smallest(self, shards: int, anywhere: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, anywhere) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def undecided(self, low: int, high: int, shards: int) -> list[str]:
        """Blocks in which a cut of some capacity between the two can fall."""
        found, least, most = set(), 0, 0
        for _ in range(shards - 1):
            first = bisect_right(self.ends, least + low)
            last = bisect_right(self.ends, most + high)
            found.update(range(first, min(last + 1, len(self.ends))))
            if first < len(self.ends):
                least = self.ends[first - 1] if first else 0
            most = min(most + high, self.total)
        return [self.prefixes[i] for i in found if not self.single[i]]


def block_sums(groups: DataFrame, digits: int) -> list[tuple[str, int, int]]:
    rows = groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(
        F.count("*").alias("groups"), F.sum("bytes").alias("bytes")).collect()
    return [(r["prefix"], r["groups"], r["bytes"]) for r in rows]


def cut_keys(groups: DataFrame, shards: int) -> list[str]:
    """First key prefix of every shard but the first, at the smallest capacity.

    ``groups``: key (16 hex digits) and bytes of each group.
    """
    rows = block_sums(groups, FIRST_DIGITS)
    while True:
        blocks = Blocks(rows)
        high, low = blocks.smallest(shards, False), blocks.smallest(shards, True)
        open_blocks = blocks.undecided(low, high, shards) if low < high else []
        if not open_blocks:
            place = {end: i + 1 for i, end in enumerate(blocks.ends)}
            return [blocks.prefixes[place[cut]] for cut in blocks.fill(high, shards, False)]
        for digits in sorted({len(p) for p in open_blocks}):
            chosen = [p for p in open_blocks if len(p) == digits]
            rows = [r for r in rows if r[0] not in set(chosen)] + block_sums(
                groups.filter(F.substring("key", 1, digits).isin(chosen)),
                min(digits + MORE_DIGITS, ALL_DIGITS))


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id",
                   text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 8. A null text counts as empty, and all equal
    texts (null and empty ones too) are in one shard. Slots count from 0 without gaps
    within a shard, in no particular order; rows that are equal in id and text are
    interchangeable. Null ids are kept. Other columns are not read, whatever their
    names. An empty table gives an empty result, and a shard may stay empty when a
    group is larger than its share.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lower(F.lpad(F.hex(F.xxhash64(text)), ALL_DIGITS, "0")).alias("key")), "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    shard = F.lit(0)
    for key in cut_keys(groups, shards):
        shard = shard + (F.col("key") >= key).cast("int")
    # Slots: rows are numbered in salted parts of each shard, after the parts before.
    rows = rows.withColumn("shard", shard).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(salts)))
    parts = rows.groupBy("shard", "salt").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = parts.select("shard", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)
                                                     ).alias("offset"))
    within = Window.partitionBy("shard", "salt").orderBy("doc_id", "key")
    return rows.withColumn("number", F.row_number().over(within)).join(
        parts, ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"))
