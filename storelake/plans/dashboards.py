"""Dashboard tiles of directors, managers and sales agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.functions.predicates import at_or_below_reorder, branch_is
from storelake.plans.reports import (
    Frames, _branch_sales, _sold_per_product, completed, completed_on, money_sum,
    total_procurement, total_sales,
)
from storelake.sources.schemas import TOTAL


def director_branch_count(d: Frames) -> DataFrame:
    return d["branches"].filter(F.col("status") == "active").agg(F.count("*").alias("count"))


def director_total_sales(d: Frames) -> DataFrame:
    return total_sales(d)


def director_procurement_total(d: Frames) -> DataFrame:
    return total_procurement(d)


def director_top_products(d: Frames, n: int = 5) -> DataFrame:
    """Best sellers by quantity; products of one name count as one."""
    names = d["products"].select(F.col("id").alias("product_id"), "product_name")
    return _sold_per_product(d).join(names, "product_id").groupBy("product_name").agg(
        F.sum("qty_sold").alias("qty_sold"), F.sum("revenue").cast(TOTAL).alias("revenue"),
    ).orderBy(F.desc("qty_sold"), "product_name").limit(n)


def director_branch_performance(d: Frames) -> DataFrame:
    """Sales total per branch name, largest first."""
    return _branch_sales(d).groupBy("branch_name").agg(
        money_sum("amount").alias("total_sales")
    ).orderBy(F.desc("total_sales"), "branch_name")


def _branch_stock(d: Frames, branch_id: int | None) -> DataFrame:
    stock = d["branch_inventory"].filter(branch_is("branch_id", branch_id)).select(
        "product_id", "quantity_available")
    return stock.join(d["products"].withColumnRenamed("id", "product_id"), "product_id")


def manager_inventory_summary(d: Frames, branch_id: int | None) -> DataFrame:
    """Products, low (zero included) and out-of-stock counts; NULL counts for no rows."""
    def tally(condition):
        return F.sum(F.when(condition, 1).otherwise(0))

    return _branch_stock(d, branch_id).agg(
        F.count("*").alias("total_products"),
        tally(at_or_below_reorder()).alias("low_stock"),
        tally(F.col("quantity_available") == 0).alias("out_of_stock"),
    )


def manager_low_stock_top(d: Frames, branch_id: int | None, n: int = 5) -> DataFrame:
    """Items at or below their reorder level, lowest first."""
    return _branch_stock(d, branch_id).filter(at_or_below_reorder()).select(
        "product_id", "product_name", "quantity_available", "reorder_level"
    ).orderBy("quantity_available", "product_id").limit(n)


def manager_recent_procurements(d: Frames, branch_id: int | None, n: int = 5) -> DataFrame:
    """Latest procurements of a branch with the supplier's name."""
    latest = d["procurements"].filter(branch_is("branch_id", branch_id)).orderBy(
        F.desc_nulls_first("created_at"), F.desc("id")).limit(n)
    suppliers = d["suppliers"].select(F.col("id").alias("supplier_id"), "supplier_name")
    return latest.join(suppliers, "supplier_id", "left").select(
        *d["procurements"].columns, "supplier_name"
    ).orderBy(F.desc_nulls_first("created_at"), F.desc("id"))


def active_agents(d: Frames, branch_id: int | None) -> DataFrame:
    return d["users"].filter(
        branch_is("branch_id", branch_id) & (F.col("role") == "sales_agent")
        & (F.col("status") == "active"))


def agent_day_sales(d: Frames, date: str) -> DataFrame:
    """Completed sales of a day per agent, whatever the branch."""
    return completed_on(d, date).groupBy("sales_agent_id").agg(
        F.sum("total_amount").alias("amount"), F.count("*").alias("n"))


def manager_cashier_summary(d: Frames, branch_id: int | None, date: str) -> DataFrame:
    """Each active agent of the branch with the day's total and count."""
    agents = active_agents(d, branch_id)
    return agents.join(
        agent_day_sales(d, date), F.col("id") == F.col("sales_agent_id"), "left"
    ).select(
        F.col("id").alias("agent_id"), "full_name",
        F.coalesce("amount", F.lit(0)).cast(TOTAL).alias("total_sales"),
        F.coalesce("n", F.lit(0)).alias("sale_count"),
    )


def agent_daily_sales(d: Frames, agent_id: int, date: str) -> DataFrame:
    """One agent's total and count of a day."""
    return completed_on(d, date).filter(F.col("sales_agent_id") == agent_id).agg(
        money_sum("total_amount").alias("total"), F.count("*").alias("count"))


def agent_sales_totals(d: Frames) -> DataFrame:
    """The daily figures of every agent and day at once."""
    return completed(d).groupBy("sales_agent_id", F.to_date("sale_date").alias("sale_day")).agg(
        money_sum("total_amount").alias("total"), F.count("*").alias("count"))


def agent_recent_sales(d: Frames, agent_id: int, n: int = 5) -> DataFrame:
    """An agent's latest completed sales."""
    return completed(d).filter(F.col("sales_agent_id") == agent_id).orderBy(
        F.desc_nulls_first("sale_date"), F.desc("id")
    ).limit(n).select("receipt_number", "total_amount", "sale_date")
