"""A table kept by a stream as a few merged segments, with versions.

Every batch adds one segment. As soon as ``fan`` segments of one level are there, they
are merged into one of the next level, so after n batches at most ``fan`` - 1 segments for
each of log(n) levels are live, and each row is rewritten once a level. A version is a
small file that names the live segments; it is written last, in one piece, so a reader
sees all of a batch or nothing of it. Old segments stay for readers of old versions.

Every path follows from the number of the batch, and a batch starts from the version
of the batch before it: one that is run again writes the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FAN = 8


@dataclass(frozen=True)
class Segment:
    """Rows of the batches from ``first`` to ``last``."""

    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"level-{self.level}/batches-{self.first}-{self.last}"


class SegmentTable:
    """Rows in ``folder``; ``merge`` makes one segment's rows of several ones'.

    ``by`` are columns whose values get folders of their own within a segment. ``beside``
    makes what is stored beside each segment, of the schema ``beside_schema``, from its rows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType,
                 merge: Callable[[DataFrame], DataFrame], fan: int = FAN,
                 by: Sequence[str] = (),
                 beside: Callable[[DataFrame, Segment], DataFrame] | None = None,
                 beside_schema: str = "") -> None:
        self.spark, self.folder, self.merge, self.fan = spark, folder.rstrip("/"), merge, fan
        self.schema, self.by = schema, list(by)
        self.beside, self.beside_schema = beside, beside_schema

    def _versions(self) -> list[int]:
        """Numbers of the batches whose version is complete."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place)]
        found = [int(m[1]) for n in names if (m := re.fullmatch(r"batch=(\d+)", n))]
        done = [n for n in found if files.exists(
            jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions/batch={n}/_SUCCESS"))]
        return sorted(done)

    def live(self, before: int | None = None) -> list[Segment]:
        """The segments of the last version, or of the last one before a batch."""
        numbers = [n for n in self._versions() if before is None or n < before]
        if not numbers:
            return []
        rows = self.spark.read.schema("level int, first long, last long").json(
            f"{self.folder}/versions/batch={numbers[-1]}").collect()
        return sorted((Segment(*r) for r in rows), key=lambda s: s.first)

    def read(self, segments: Sequence[Segment] | None = None) -> DataFrame:
        """The rows of these segments, by default of all live ones."""
        segments = self.live() if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/segments/{s.name}" for s in segments]
        reader = self.spark.read.schema(self.schema)
        # Folders of values are found below one path at a time.
        parts = [reader.parquet(p) for p in paths] if self.by else [reader.parquet(*paths)]
        return reduce(DataFrame.unionByName, parts)

    def read_beside(self, segments: Sequence[Segment]) -> DataFrame:
        """What is stored beside these segments, one or more."""
        return self.spark.read.schema(self.beside_schema).parquet(
            *[f"{self.folder}/beside/{s.name}" for s in segments])

    def _write(self, rows: DataFrame, segment: Segment) -> None:
        out = rows.hint("rebalance", *self.by) if self.by else rows
        out.write.mode("overwrite").partitionBy(*self.by).parquet(
            f"{self.folder}/segments/{segment.name}")
        if self.beside:
            self.beside(self.read([segment]), segment).write.mode("overwrite").parquet(
                f"{self.folder}/beside/{segment.name}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add a batch's rows and make them the next version."""
        live = self.live(before=batch)
        live.append(Segment(0, batch, batch))
        self._write(rows, live[-1])
        while True:
            tail = [s for s in live if s.level == live[-1].level]
            if len(tail) < self.fan:
                break
            merged = Segment(tail[0].level + 1, tail[0].first, tail[-1].last)
            self._write(self.merge(self.read(tail)), merged)
            live = live[:-len(tail)] + [merged]
        self.spark.createDataFrame([(s.level, s.first, s.last) for s in live],
                                   "level int, first long, last long").coalesce(1).write.mode(
            "overwrite").json(f"{self.folder}/versions/batch={batch}")
