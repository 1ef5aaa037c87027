"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Names are joined on typed keys, skewed sort-merge joins are split at run time,
# and no join is broadcast except by Spark's own size check.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Sessions of one user are combined before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("storelake")
    options = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        # All tasks share the driver's heap; Spark's 1 GB is not enough for eight with long texts.
        "spark.driver.memory": "4g",
        # Call sites in error messages cost a round trip per expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **settings,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package; done once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_storelake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="storelake-"), "storelake.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(archive)
    context._storelake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    It must be reachable by every executor, so only a local master may go
    without the setting; there a temporary folder is made once per session.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        if folder.startswith("file:") and not context.master.startswith("local"):
            raise RuntimeError("executors of a cluster cannot share a folder of one machine; "
                               "set spark.checkpoint.dir to a shared file system")
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="storelake-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own for one written table under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/storelake/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write the rows to a table of their own in the shared folder and read them back.

    This cuts lineage, and plans over the result start from its true size. The
    rows survive lost executors. (A checkpoint would do the same, but carries the
    constraints of the plan along, which multiply in a loop.) The tables stay
    until the folder is emptied, or until they are given to :func:`discard`.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._storelake_written = (path,)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`written` that nothing is going to read again.

    Other frames are left alone.
    """
    for df in tables:
        for path in getattr(df, "_storelake_written", ()):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(
                place, True)


def made_from(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, such that :func:`discard` deletes the written tables it is read from."""
    df._storelake_written = tuple(p for t in tables for p in getattr(t, "_storelake_written", ()))
    return df


# For jobs of many steps: shuffle files go as soon as the step that wrote them has ended, not
# when the driver's garbage is collected, and tables are packed tighter.
SPARING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """What runs within takes less disk. A frame must not be run twice within: its shuffle
    files would be made again."""
    before = {key: spark.conf.get(key, None) for key in SPARING}
    for key, value in SPARING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
