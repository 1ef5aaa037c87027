"""Reports: daily sales, inventory, procurement, company performance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.functions.labels import export_status, report_status
from storelake.functions.predicates import (
    all_of, branch_is, days_between, is_blank, on_day, optional_eq,
)
from storelake.operators.ordered import numbered
from storelake.sources.schemas import MONEY, TOTAL
from storelake.sources.tables import of_months

Frames = Mapping[str, DataFrame]


def money_sum(column: Column | str) -> Column:
    """SUM that is 0 for no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast(TOTAL)


def completed(d: Frames) -> DataFrame:
    return d["sales"].filter(F.col("status") == "completed")


def completed_on(d: Frames, date: str) -> DataFrame:
    """Completed sales of a day."""
    return of_months(d, "sales", date, date).filter(
        (F.col("status") == "completed") & on_day("sale_date", date))


def count_items(d: Frames, sales: DataFrame) -> DataFrame:
    """Item lines per sale, for the given sales only."""
    wanted = sales.select(F.col("id").alias("sale_id"))
    return d["sale_items"].join(wanted, "sale_id", "left_semi").groupBy("sale_id").agg(
        F.count("*").alias("item_count"))


def daily_sales_detail(d: Frames, date: str, branch_id: int | None = None) -> DataFrame:
    """Completed sales of a day with agent and number of item lines."""
    sales = completed_on(d, date).filter(optional_eq("branch_id", branch_id))
    agents = d["users"].select(F.col("id").alias("sales_agent_id"),
                               F.col("full_name").alias("agent_name"))
    return sales.join(agents, "sales_agent_id").join(
        count_items(d, sales), F.col("id") == F.col("sale_id"), "left"
    ).select(
        "receipt_number", "agent_name", "total_amount", "sale_date",
        F.coalesce("item_count", F.lit(0)).alias("items"),
    ).orderBy("sale_date", "receipt_number")


def daily_sales_summary(d: Frames, date: str, branch_id: int | None = None) -> DataFrame:
    """Total and number of completed sales of a day."""
    return completed_on(d, date).filter(optional_eq("branch_id", branch_id)).agg(
        money_sum("total_amount").alias("total"), F.count("*").alias("count"))


def daily_sales_totals(d: Frames) -> DataFrame:
    """The daily summary of every branch and day at once."""
    return completed(d).groupBy("branch_id", F.to_date("sale_date").alias("sale_day")).agg(
        money_sum("total_amount").alias("total"), F.count("*").alias("count"))


def stock_of(d: Frames, branch_id: int | None) -> DataFrame:
    """Quantity per product in one branch."""
    return d["branch_inventory"].filter(branch_is("branch_id", branch_id)).select(
        "product_id", "quantity_available")


def category_names(d: Frames) -> DataFrame:
    return d["categories"].select(F.col("id").alias("category_id"), "category_name")


def active_products_with_stock(d: Frames, branch_id: int | None) -> DataFrame:
    """Active products with category and the branch's quantity, NULL if none."""
    products = d["products"].filter(F.col("status") == "active")
    return products.join(category_names(d), "category_id").join(
        stock_of(d, branch_id), F.col("id") == F.col("product_id"), "left")


def inventory_value_of(quantity: str = "quantity_available") -> Column:
    return (F.col(quantity) * F.col("cost_price")).cast(MONEY)


def inventory_report(d: Frames, branch_id: int | None) -> DataFrame:
    """Active products with stock, value and status label."""
    return active_products_with_stock(d, branch_id).select(
        "product_name", "category_name", "quantity_available", "reorder_level",
        "cost_price", "selling_price",
        inventory_value_of().alias("inventory_value"),
        report_status().alias("stock_status"),
    ).orderBy("category_name", "product_name")


def inventory_export(d: Frames, branch_id: int | None) -> DataFrame:
    """Rows of the exported sheet: value 0 and its own label for missing stock."""
    return active_products_with_stock(d, branch_id).select(
        "product_name", "category_name", "quantity_available", "reorder_level",
        "cost_price", "selling_price",
        F.coalesce(inventory_value_of(), F.lit(0).cast(MONEY)).alias("inventory_value"),
        export_status().alias("stock_status"),
    ).orderBy("category_name", "product_name")


def procurement_report(d: Frames, branch_id: int | None = None, date_from: str | None = None,
                       date_to: str | None = None) -> DataFrame:
    """Procurements with supplier, branch and recorder, newest first.

    A procurement nobody is recorded for does not appear.
    """
    return with_procurement_names(d, d["procurements"].filter(all_of([
        optional_eq("branch_id", branch_id),
        days_between("procurement_date", date_from, date_to),
    ]))).select(
        "reference_number", "procurement_date", "supplier_name", "branch_name",
        "recorded_by_name", "total_cost",
    ).withColumnRenamed("recorded_by_name", "recorded_by").orderBy(
        F.desc("procurement_date"), "reference_number")


def with_procurement_names(d: Frames, headers: DataFrame) -> DataFrame:
    suppliers = d["suppliers"].select(F.col("id").alias("supplier_id"), "supplier_name")
    branches = d["branches"].select(F.col("id").alias("branch_id"), "branch_name")
    users = d["users"].select(F.col("id").alias("recorded_by"),
                              F.col("full_name").alias("recorded_by_name"))
    return headers.join(branches, "branch_id").join(users, "recorded_by").join(
        suppliers, "supplier_id", "left")


def procurement_grand_total(rows: DataFrame) -> DataFrame:
    """Footer of the procurement report: the sum over the rows shown."""
    return rows.agg(money_sum("total_cost").alias("grand_total"))


def _branch_sales(d: Frames) -> DataFrame:
    per_branch = completed(d).groupBy("branch_id").agg(
        F.sum("total_amount").alias("amount"), F.count("*").alias("n"))
    return d["branches"].join(per_branch, F.col("id") == F.col("branch_id"), "left")


def company_branch_performance(d: Frames) -> DataFrame:
    """Sales total and count of every branch, largest first."""
    return _branch_sales(d).select(
        F.col("id").alias("branch_id"), "branch_name",
        F.coalesce("amount", F.lit(0)).cast(TOTAL).alias("total_sales"),
        F.coalesce("n", F.lit(0)).alias("sale_count"),
    ).orderBy(F.desc("total_sales"), "branch_id")


def ranked_branch_performance(d: Frames) -> DataFrame:
    """Branch performance with its position and a medal for the first three."""
    rows = company_branch_performance(d).withColumn("_down", -F.col("total_sales"))
    rank = F.col("rank")
    return numbered(rows, ["_down", "branch_id"], "rank").drop("_down").withColumn(
        "medal", F.when(rank == 1, "gold").when(rank == 2, "silver")
                  .when(rank == 3, "bronze")
    ).orderBy("rank")


def sold_items(d: Frames) -> DataFrame:
    """Item lines of completed sales."""
    done = completed(d).select(F.col("id").alias("sale_id"))
    return d["sale_items"].join(done, "sale_id", "left_semi")


def _sold_per_product(d: Frames) -> DataFrame:
    return sold_items(d).groupBy("product_id").agg(
        F.sum("quantity").alias("qty_sold"), F.sum("subtotal").alias("revenue"))


def company_top_products(d: Frames, n: int = 10) -> DataFrame:
    """Products with the highest revenue, by product."""
    products = d["products"].select(F.col("id").alias("product_id"), "product_name")
    return _sold_per_product(d).join(products, "product_id").select(
        "product_id", "product_name", "qty_sold", F.col("revenue").cast(TOTAL).alias("revenue"),
    ).orderBy(F.desc("revenue"), "product_id").limit(n)


def ranked_top_products(d: Frames, n: int = 10) -> DataFrame:
    """The top products with their position."""
    rows = company_top_products(d, n).withColumn("_down", -F.col("revenue"))
    # At most n rows are left, so one task numbers them.
    return numbered(rows, ["_down", "product_id"], "rank", small=True).drop("_down")


def company_top_categories(d: Frames, n: int = 5) -> DataFrame:
    """Categories with the highest revenue."""
    products = d["products"].select(F.col("id").alias("product_id"), "category_id")
    return _sold_per_product(d).join(products, "product_id").groupBy("category_id").agg(
        F.sum("revenue").alias("revenue")
    ).join(category_names(d), "category_id").select(
        "category_id", "category_name", F.col("revenue").cast(TOTAL).alias("revenue"),
    ).orderBy(F.desc("revenue"), "category_id").limit(n)


def total_sales(d: Frames) -> DataFrame:
    return completed(d).agg(money_sum("total_amount").alias("total"))


def total_procurement(d: Frames) -> DataFrame:
    return d["procurements"].agg(money_sum("total_cost").alias("total"))


def inventory_value(d: Frames) -> DataFrame:
    """Stock value over all branches, inactive products included."""
    prices = d["products"].select(F.col("id").alias("product_id"), "cost_price")
    # One row per product before the price is joined.
    stock = d["branch_inventory"].groupBy("product_id").agg(
        F.sum("quantity_available").alias("quantity"))
    return stock.join(prices, "product_id").agg(
        money_sum(F.col("quantity").cast("decimal(18,0)") * F.col("cost_price"))
        .alias("total"))


def company_totals(d: Frames) -> DataFrame:
    """Total sales, total procurement and inventory value in one row."""
    return total_sales(d).select(
        F.col("total").alias("total_sales"),
        total_procurement(d).scalar().alias("total_procurement"),
        inventory_value(d).scalar().alias("inventory_value"),
    )


def company_net_position(d: Frames) -> DataFrame:
    """Company totals with sales less procurement."""
    return company_totals(d).withColumn(
        "net_position", (F.col("total_sales") - F.col("total_procurement")).cast(TOTAL))


def role_branch(role: str, own_branch: int | None, chosen: int | None) -> int | None:
    """Directors choose the branch of a report, everyone else gets their own."""
    if role == "director":
        return None if is_blank(chosen) else chosen
    return own_branch
