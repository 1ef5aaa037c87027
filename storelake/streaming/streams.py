"""Structured Streaming forms of the daily totals, audit trail and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storelake.operators.dims import latest_per_key
from storelake.session import written
from storelake.sources.schemas import TOTAL, TS
from storelake.streaming.id_index import BUCKETS, IdIndex
from storelake.streaming.keyed import changed_sessions, rocks_db
from storelake.streaming.segments import SegmentTable

GAP_MINUTES = 60


def stream_daily_sales(sales: DataFrame, lateness: str | None = None) -> DataFrame:
    """Total and number of completed sales per branch and day.

    Without ``lateness`` every sale counts however late it comes; the state is
    one row per branch and day. With it, days are dropped from the state once
    they are that far behind, and so are sales that come later still.
    """
    done = sales.filter(F.col("status") == "completed").withColumn(
        "_day", F.to_date("sale_date").cast("timestamp"))
    if lateness:
        done = done.withWatermark("_day", lateness)
    return done.groupBy("branch_id", "_day").agg(
        F.sum("total_amount").cast(TOTAL).alias("total"), F.count("*").alias("count")
    ).select("branch_id", F.to_date("_day").alias("sale_day"), "total", "count")


DAY_KEY = ["branch_id", "sale_day"]
DAY_TOTALS = (f"branch_id long, sale_day date, total {TOTAL.simpleString()}, `count` long, "
              "batch long")


def _daily_totals(spark: SparkSession, folder: str) -> SegmentTable:
    return SegmentTable(spark, f"{folder}/totals", DAY_TOTALS,
                        lambda rows: latest_per_key(rows, DAY_KEY, ["batch"]))


def start_daily_sales(sales: DataFrame, folder: str, lateness: str | None = None,
                      **trigger) -> StreamingQuery:
    """Keep the daily totals in ``folder``; each batch adds the days it changed.

    The batches' rows are merged as they come, so a reader opens a few segments however
    many batches there were. A batch that is run again writes the same.
    """
    def store(rows: DataFrame, batch: int) -> None:
        _daily_totals(rows.sparkSession, folder).add(
            rows.withColumn("batch", F.lit(batch).cast("long")), batch)

    return stream_daily_sales(sales, lateness).writeStream.outputMode("update").option(
        "checkpointLocation", f"{folder}/progress"
    ).foreachBatch(store).trigger(**(trigger or {"availableNow": True})).start()


def read_daily_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The current daily totals: the last row written for each branch and day."""
    rows = _daily_totals(spark, folder).read()
    return latest_per_key(rows, DAY_KEY, ["batch"]).drop("batch")


def start_audit_ingest(events: DataFrame, folder: str, buckets: int = BUCKETS, **trigger
                       ) -> StreamingQuery:
    """Append audit events to the trail by day, each id once, however late it comes.

    An id that an earlier batch stored, under whatever day, is left out; the trail is not
    read for that but an index of its ids. Of different events of one id in a batch the
    earliest stays (then the smallest by its other columns). Events without id are all
    kept. A batch that is run again writes the same.
    """
    def store(rows: DataFrame, batch: int) -> None:
        rows = written(rows.withColumn("day", F.to_date("created_at")), "audit-batch")
        index = IdIndex(rows.sparkSession, f"{folder}/ids", buckets)
        rest = [c for c in rows.columns if c not in ("id", "created_at")]
        first = F.min(F.struct(F.col("created_at").isNull(), "created_at", *rest))
        named = rows.filter("id is not null").groupBy("id").agg(first.alias("row")).select(
            "id", "row.created_at", *[f"row.{c}" for c in rest])
        ids = written(named.select(F.col("id").alias("own"), *index.keyed(F.col("id"))),
                      "batch-ids")
        known = index.known(ids.select("hash", "id", "bucket"), batch)
        new = written(ids.join(known, ["bucket", "hash", "id"], "left_anti"), "new-ids")
        fresh = named.join(new.select(F.col("own").alias("id")), "id", "left_semi")
        fresh.select(*rows.columns).unionByName(rows.filter("id is null")).write.mode(
            "overwrite").partitionBy("day").parquet(f"{folder}/trail/batch={batch}")
        index.add(new, batch)

    return events.writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(
        store).trigger(**(trigger or {"availableNow": True})).start()


def read_audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    """All audit events stored so far, with their day."""
    return spark.read.parquet(f"{folder}/trail").drop("batch")


def stream_user_sessions(events: DataFrame, gap_minutes: int = GAP_MINUTES,
                         lateness: str = "1 hour") -> DataFrame:
    """Sessions of each user, emitted once they can no longer grow."""
    return events.withColumn("_at", F.col("created_at").cast("timestamp")).withWatermark(
        "_at", lateness
    ).groupBy("user_id", F.session_window("_at", f"{gap_minutes} minutes").alias("w")).agg(
        F.count("*").alias("events"), F.max("_at").cast(TS).alias("session_end")
    ).select("user_id", F.col("w.start").cast(TS).alias("session_start"), "session_end",
             "events")


SESSION_KEY = ["user_id", "session_start"]
SESSIONS = ("user_id long, session_start timestamp_ntz, session_end timestamp_ntz, "
            "events long, removed boolean, version long")


def _sessions(spark: SparkSession, folder: str) -> SegmentTable:
    return SegmentTable(spark, f"{folder}/sessions", SESSIONS,
                        lambda rows: latest_per_key(rows, SESSION_KEY, ["version"]))


def start_user_sessions(events: DataFrame, folder: str, gap_minutes: int = GAP_MINUTES,
                        **trigger) -> StreamingQuery:
    """Keep the sessions of each user in ``folder``, whatever order their events come in.

    A late event extends a session, joins two or makes one of its own. Each batch adds the
    sessions that it changed, and a mark for those that became part of another, with the
    number of the batch as their version. Events of one user are combined in the tasks
    that read them, so a busy user comes to the state as a few rows a task.
    """
    def store(rows: DataFrame, batch: int) -> None:
        _sessions(rows.sparkSession, folder).add(
            rows.withColumn("version", F.lit(batch).cast("long")), batch)

    with rocks_db(events.sparkSession):
        return changed_sessions(events, gap_minutes).writeStream.outputMode("update").option(
            "checkpointLocation", f"{folder}/progress"
        ).foreachBatch(store).trigger(**(trigger or {"availableNow": True})).start()


def read_user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The current sessions: the last version of each that is not part of another."""
    rows = latest_per_key(_sessions(spark, folder).read(), SESSION_KEY, ["version"])
    return rows.filter("not removed").drop("removed", "version")


def user_sessions(events: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Sessions of each user: events at most the gap apart, as in session_window.

    Events in one slot of the gap's length are always in one session, so they are
    combined before the shuffle. A user is then left with at most one row per
    slot, however many events there are.
    """
    gap = gap_minutes * 60 * 1_000_000
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    slots = events.filter(F.col("user_id").isNotNull()).groupBy(
        "user_id", (micros - F.pmod(micros, F.lit(gap))).alias("_slot")
    ).agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"),
          F.count("*").alias("_n"))
    in_time = Window.partitionBy("user_id").orderBy("_slot")
    starts = F.when(F.col("_first") - F.lag("_last").over(in_time) <= gap, 0).otherwise(1)
    marked = slots.withColumn("_starts", starts).withColumn(
        "_session", F.sum("_starts").over(in_time))
    return marked.groupBy("user_id", "_session").agg(
        F.timestamp_micros(F.min("_first")).cast(TS).alias("session_start"),
        F.timestamp_micros(F.max("_last")).cast(TS).alias("session_end"),
        F.sum("_n").alias("events"),
    ).drop("_session")
