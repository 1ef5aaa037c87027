"""Which ids a trail already holds, without reading the trail.

Ids are kept in buckets by hash, in merged segments (see ``segments``). Every bucket of
a segment has a Bloom filter. A batch holds its ids against the filters of their buckets
and reads only the buckets in which a filter has a hit.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelake.streaming.segments import FAN, Segment, SegmentTable

BUCKETS = 64
BITS_PER_ID, HASHES = 16, 6

IDS = "hash long, id string, bucket int"
FILTERS = "level int, first long, last long, bucket int, bits binary"


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each hash, by double hashing."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return [((h + np.uint64(k) * step) >> np.uint64(11)) % np.uint64(bits)
            for k in range(HASHES)]


def bloom_filter(hashes: np.ndarray) -> bytes:
    """16 bits an id (a power of two), of which an absent id hits all six in some 0.1 %."""
    bits = 1 << max(6, math.ceil(math.log2(max(1, len(hashes)) * BITS_PER_ID)))
    out = np.zeros(bits, bool)
    for place in _places(hashes, bits):
        out[place] = True
    return np.packbits(out).tobytes()


def may_hold(filter_bytes: bytes, hashes: np.ndarray) -> np.ndarray:
    """False only where the filter was not made of this hash."""
    data = np.frombuffer(filter_bytes, np.uint8)
    found = np.ones(len(hashes), bool)
    for place in _places(hashes, 8 * len(data)):
        found &= (data[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(
            np.uint8)) & 1 == 1
    return found


def _filters(rows: DataFrame, segment: Segment) -> DataFrame:
    """One filter for each bucket. A bucket's hashes fit in a task: choose enough buckets."""
    def make(pdf):
        import pandas as pd

        return pd.DataFrame({
            "level": [segment.level], "first": [segment.first], "last": [segment.last],
            "bucket": pdf["bucket"].iloc[:1], "bits": [bloom_filter(pdf["hash"].to_numpy())]})

    return rows.select("bucket", "hash").groupBy("bucket").applyInPandas(make, FILTERS)


class IdIndex:
    """The ids that were added to a trail, under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS,
                 fan: int = FAN) -> None:
        self.spark, self.buckets = spark, buckets
        self.ids = SegmentTable(spark, folder, IDS, lambda rows: rows, fan, by=["bucket"],
                                beside=_filters, beside_schema=FILTERS)
        #: The buckets of segments that the last lookup read.
        self.read_buckets: list[tuple[str, int]] = []

    def keyed(self, id_col: Column) -> list[Column]:
        """hash, id as text and bucket."""
        text = id_col.cast("string")
        return [F.xxhash64(text).alias("hash"), text.alias("id"),
                F.pmod(F.xxhash64(text), F.lit(self.buckets)).cast("int").alias("bucket")]

    def known(self, ids: DataFrame, batch: int) -> DataFrame:
        """The rows of ``ids`` (hash, id, bucket) that batches before this one added."""
        self.read_buckets = []
        live = self.ids.live(before=batch)
        if not live:
            return ids.limit(0)
        touched = [r[0] for r in ids.select("bucket").distinct().collect()]
        filters = self.ids.read_beside(live).filter(F.col("bucket").isin(touched))

        def hits(left, right):
            import pandas as pd

            found = [(level, first, last, b) for level, first, last, b, bits in right[
                ["level", "first", "last", "bucket", "bits"]].itertuples(index=False)
                if may_hold(bits, left["hash"].to_numpy()).any()] if len(left) else []
            return pd.DataFrame(found, columns=["level", "first", "last", "bucket"])

        # At most one row for each bucket of each live segment comes to the driver.
        hit = ids.select("bucket", "hash").groupBy("bucket").cogroup(
            filters.groupBy("bucket")).applyInPandas(
            hits, "level int, first long, last long, bucket int").collect()
        places: dict[Segment, list[int]] = {}
        for level, first, last, bucket in sorted(hit):
            places.setdefault(Segment(level, first, last), []).append(bucket)
        self.read_buckets = [(s.name, b) for s, found in places.items() for b in found]
        if not hit:
            return ids.limit(0)
        held = reduce(DataFrame.unionByName, (
            self.ids.read([segment]).filter(F.col("bucket").isin(found))
            for segment, found in places.items()))
        return ids.join(held, ["bucket", "hash", "id"], "left_semi")

    def add(self, ids: DataFrame, batch: int) -> None:
        """Add ids that are not known, as rows of hash, id and bucket."""
        self.ids.add(ids.select("hash", "id", "bucket"), batch)
