"""Stock kept up to date from a stream of stock events.

Each micro-batch is posted as a whole: its events are judged in time order
against the stock left by the batches before it. Events that arrive in a later
batch are judged then, even if they carry an earlier time. An event with a line that
fails whatever the stock is (as in the batch form; the stream carries no prices, notes or
payments to check) is rejected before the others are judged.

The state is a folder, not a keyed store, so a busy branch or product is spread
over tasks like any other rows:

* ``movements/batch=N``: accepted movements with their balances
* ``rejections/batch=N`` and ``alerts/batch=N``
* ``stock/upto=N``: the whole stock after batch N, every ``SNAPSHOT_EVERY`` batches

The stock before a batch is the last snapshot and the movements since. Every
path follows from the batch number, so a batch that is run again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storelake.functions.labels import alert_type
from storelake.operators.admission import (
    ADJUSTMENT, EVENT, PROCUREMENT, SALE, decide, new_inventory, with_balances,
)
from storelake.operators.ordered import ROWS_PER_CHUNK
from storelake.operators.posting import kind_name
from storelake.session import written

SNAPSHOT_EVERY = 20

# What the stream carries: one row per line of an event, sales with a negative
# change. Kinds are those of storelake.operators.admission.
STOCK_LINES = ("branch_id long, posted_at timestamp_ntz, kind int, event_id long, "
               "line_no long, product_id long, change long")
MOVED = (f"{STOCK_LINES}, accepted boolean, quantity_after long, quantity_before long, "
         "had_row boolean")
STOCK = ("branch_id long, product_id long, quantity_available int, "
         "updated_at timestamp_ntz")


def with_bad(lines: DataFrame, products: DataFrame, parity: bool) -> DataFrame:
    """Add ``bad``: whether a line fails whatever the stock is."""
    known = products.select(F.col("id").alias("product_id"), F.lit(True).alias("known")).distinct()
    kind, change = F.col("kind"), F.col("change")
    bad = (F.col("branch_id").isNull() | kind.isNull() | F.col("product_id").isNull()
           | change.isNull() | F.col("known").isNull()
           | ~kind.isin(SALE, PROCUREMENT, ADJUSTMENT)
           | ((kind == PROCUREMENT) & (change == 0)))
    if not parity:
        bad = bad | ((kind == SALE) & (change >= 0))
    return lines.join(known, "product_id", "left").withColumn("bad", bad).select(
        *lines.columns, "bad")


class StockStream:
    """Posts batches of stock lines into ``folder``."""

    def __init__(self, folder: str, opening: DataFrame, products: DataFrame,
                 snapshot_every: int = SNAPSHOT_EVERY, parity: bool = False,
                 rows_per_chunk: int = ROWS_PER_CHUNK):
        self.folder, self.opening, self.products = folder, opening, products
        self.every, self.parity, self.rows_per_chunk = snapshot_every, parity, rows_per_chunk

    def stock_before(self, batch: int) -> DataFrame:
        """Stock after all batches before this one."""
        spark = self.opening.sparkSession
        last = batch // self.every * self.every - 1
        stock = self.opening.select("branch_id", "product_id", "quantity_available",
                                    "updated_at")
        if last >= 0:
            stock = spark.read.schema(STOCK).parquet(f"{self.folder}/stock/upto={last}")
        since = [f"{self.folder}/movements/batch={b}" for b in range(last + 1, batch)]
        if since:
            stock = new_inventory(stock, spark.read.schema(MOVED).parquet(*since))
        return stock

    def invalid(self, lines: DataFrame) -> DataFrame:
        """Events with a line that fails whatever the stock is."""
        return with_bad(lines, self.products, self.parity).groupBy(*EVENT).agg(
            F.max("bad").alias("bad")).filter("bad").select(*EVENT)

    def post(self, lines: DataFrame, batch: int) -> None:
        """Judge one batch and write what it changes."""
        fields = [c.split() for c in STOCK_LINES.split(", ")]
        lines = written(lines.select(*[F.col(c).cast(kind).alias(c) for c, kind in fields]))
        invalid = written(self.invalid(lines))
        same = [F.col(f"line.{c}").eqNullSafe(F.col(f"gone.{c}")) for c in EVENT]
        lines = written(lines.alias("line").join(invalid.alias("gone"), same, "left_anti"))
        stock = written(self.stock_before(batch))
        verdicts = written(
            decide(lines, stock, self.parity, self.rows_per_chunk))
        judged = written(
            with_balances(lines, verdicts, stock, self.rows_per_chunk, lines))
        moved = judged.filter(F.col("accepted"))
        self._write(moved, f"movements/batch={batch}")
        self._write(judged.filter(~F.col("accepted")).select(*EVENT).distinct()
                    .unionByName(invalid), f"rejections/batch={batch}")
        self._write(low_stock_crossings(moved, self.products), f"alerts/batch={batch}")
        if (batch + 1) % self.every == 0:
            self._write(new_inventory(stock, moved), f"stock/upto={batch}")

    def _write(self, rows: DataFrame, place: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{place}")

    def start(self, lines: DataFrame, **trigger) -> StreamingQuery:
        """Post a stream of stock lines."""
        return lines.writeStream.foreachBatch(self.post).option(
            "checkpointLocation", f"{self.folder}/progress"
        ).trigger(**(trigger or {"availableNow": True})).start()

    def movements(self) -> DataFrame:
        """All accepted movements so far."""
        spark = self.opening.sparkSession
        rows = spark.read.schema(f"{MOVED}, batch long").parquet(f"{self.folder}/movements")
        return rows.withColumn("movement_type", kind_name())

    def rejections(self) -> DataFrame:
        """All events turned down so far."""
        spark = self.opening.sparkSession
        return spark.read.schema(
            "branch_id long, posted_at timestamp_ntz, kind int, event_id long, batch long"
        ).parquet(f"{self.folder}/rejections")

    def alerts(self) -> DataFrame:
        """All alerts so far."""
        spark = self.opening.sparkSession
        return spark.read.schema(
            "branch_id long, product_id long, product_name string, quantity_available long, "
            "reorder_level int, alert_type string, posted_at timestamp_ntz, event_id long, "
            "line_no long, batch long").parquet(f"{self.folder}/alerts")


def low_stock_crossings(movements: DataFrame, products: DataFrame) -> DataFrame:
    """Movements that took a stock from above its reorder level to or below it."""
    levels = products.select(F.col("id").alias("product_id"), "product_name", "reorder_level")
    crossed = (F.col("quantity_before") > F.col("reorder_level")) & (
        F.col("quantity_after") <= F.col("reorder_level"))
    return movements.join(levels, "product_id").filter(crossed).withColumn(
        "quantity_available", F.col("quantity_after")
    ).select("branch_id", "product_id", "product_name", "quantity_available", "reorder_level",
             alert_type().alias("alert_type"), "posted_at", "event_id", "line_no")
