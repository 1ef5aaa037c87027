"""The stock ledger: union of postings, running balance, snapshot, consistency."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.operators.ordered import (
    ROWS_PER_CHUNK, in_order, previous_values, running_sums,
)

STOCK_KEY = ("branch_id", "product_id")
LEDGER_ORDER = ("created_at", "id")


def movement_ledger(d: Mapping[str, DataFrame]) -> DataFrame:
    """One signed row per stock change, from sales, procurements and adjustments."""
    sold = d["sale_items"].alias("i").join(
        d["sales"].alias("h"), F.col("i.sale_id") == F.col("h.id")
    ).select(
        "i.id", "h.branch_id", "i.product_id",
        F.lit("sale").alias("movement_type"),
        (-F.col("i.quantity")).alias("quantity_change"),
        F.col("i.sale_id").alias("reference_id"),
        F.lit(None).cast("string").alias("notes"),
        F.col("h.sales_agent_id").alias("recorded_by"),
        F.col("h.sale_date").alias("created_at"),
    )
    bought = d["procurement_items"].alias("i").join(
        d["procurements"].alias("h"), F.col("i.procurement_id") == F.col("h.id")
    ).select(
        "i.id", "h.branch_id", "i.product_id",
        F.lit("procurement").alias("movement_type"),
        F.col("i.quantity").alias("quantity_change"),
        F.col("i.procurement_id").alias("reference_id"),
        F.lit(None).cast("string").alias("notes"),
        "h.recorded_by",
        "h.created_at",
    )
    adjusted = d["stock_adjustments"].select(
        "id", "branch_id", "product_id",
        F.lit("adjustment").alias("movement_type"),
        F.col("adjustment_quantity").alias("quantity_change"),
        F.col("id").alias("reference_id"),
        F.col("reason").alias("notes"),
        F.col("adjusted_by").alias("recorded_by"),
        "created_at",
    )
    return sold.unionByName(bought).unionByName(adjusted)


def running_balance(ledger: DataFrame, rows_per_chunk: int | None = ROWS_PER_CHUNK,
                    probe: DataFrame | None = None) -> DataFrame:
    """Stock of the (branch, product) before and after each movement.

    See :func:`storelake.operators.ordered.in_order` for ``probe``.
    """
    change = F.col("quantity_change").cast("long")
    ordered = in_order(ledger, STOCK_KEY, LEDGER_ORDER, rows_per_chunk, probe)
    out = running_sums(ordered, {"quantity_after": change})
    return out.withColumn("quantity_before", F.col("quantity_after") - change)


def inventory_snapshot(ledger: DataFrame) -> DataFrame:
    """Stock per (branch, product): the sum of its changes."""
    return ledger.groupBy(*STOCK_KEY).agg(
        F.sum("quantity_change").alias("quantity_available"),
        F.max("created_at").alias("updated_at"),
    )


def latest_balance(movements: DataFrame) -> DataFrame:
    """Stock per (branch, product): the balance after its last movement."""
    return movements.groupBy(*STOCK_KEY).agg(
        F.max_by("quantity_after", F.struct(*LEDGER_ORDER)).alias("quantity_available"),
        F.max("created_at").alias("updated_at"),
    )


def ledger_consistency(movements: DataFrame, inventory: DataFrame,
                       rows_per_chunk: int | None = ROWS_PER_CHUNK,
                       probe: DataFrame | None = None) -> DataFrame:
    """Movements and stock rows that break the audit trail.

    ``sum``: before + change is not after. ``gap``: before is not the after of
    the movement before it. ``snapshot``: the last after is not the stock on
    record (a stock row without movements is not judged).
    """
    ordered = in_order(movements, STOCK_KEY, LEDGER_ORDER, rows_per_chunk, probe)
    rows = previous_values(ordered, {"_previous": "quantity_after"}, last="_final")
    stock = inventory.select(*[F.col(k).alias(f"_{k}") for k in STOCK_KEY],
                             F.col("quantity_available").alias("_stock"))
    # The stock on record is met by the last movement alone, in the same pass.
    same = [F.col(k) == F.col(f"_{k}") for k in STOCK_KEY]
    rows = rows.join(stock, same[0] & same[1] & F.col("_final"), "left")
    before, after = F.col("quantity_before"), F.col("quantity_after")

    def rule(name: str, movement: Column, expected: Column, actual: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), movement.cast("long").alias("movement_id"),
                        expected.cast("long").alias("expected"),
                        actual.cast("long").alias("actual"))

    return rows.select(*STOCK_KEY, F.explode(F.array(
        rule("sum", F.col("id"), before + F.col("quantity_change"), after),
        rule("gap", F.col("id"), F.col("_previous"), before),
        rule("snapshot", F.lit(None), after, F.col("_stock")),
    )).alias("c")).select(
        *STOCK_KEY, "c.movement_id", "c.rule", "c.expected", "c.actual"
    ).filter(F.col("expected") != F.col("actual"))
