"""Exports: sheets, documents, receipts, digests and the audit sink.

Everything is written by the tasks that hold the rows; documents are rows of
text in reading order, so their length does not matter.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.functions.labels import (
    format_clock, format_money, format_number, format_stamp, row_flag,
)
from storelake.functions.predicates import branch_is, on_day
from storelake.plans.listings import all_low_stock_alerts, receipt_headers
from storelake.plans.reports import (
    Frames, completed, inventory_export, money_sum,
)
from storelake.sources.schemas import TABLES

# Column headings of the exported inventory sheet.
INVENTORY_HEADINGS = {
    "product_name": "Product Name", "category_name": "Category",
    "quantity_available": "Qty Available", "reorder_level": "Reorder Level",
    "cost_price": "Cost Price", "selling_price": "Selling Price",
    "inventory_value": "Inventory Value", "stock_status": "Status",
}
# Column headings of the exported daily sales list.
SALES_HEADINGS = {"receipt_number": "Receipt #", "agent_name": "Agent",
                  "amount": "Amount (UGX)", "time": "Time"}

RULE = "─" * 36


@dataclass(frozen=True)
class Company:
    """Texts printed on receipts."""

    name: str = "EXAMPLE STORES"
    address: str = "1 Example Street"
    phone: str = "+000 000 000000"
    footer: str = "Thank you for shopping with Example Stores!"


def export_report(df: DataFrame, path: str, fmt: str = "csv",
                  labels: Mapping[str, str] | None = None) -> None:
    """Write a report as CSV (with heading), JSON or Parquet, columns renamed."""
    out = df.withColumnsRenamed(dict(labels or {}))
    writer = out.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_json(df: DataFrame, path: str) -> None:
    """Write a result as JSON lines."""
    export_report(df, path, "json")


def inventory_sheet(d: Frames, branch_id: int | None) -> DataFrame:
    """Rows of the inventory sheet with the highlight of each row."""
    return inventory_export(d, branch_id).withColumn("row_flag", row_flag("stock_status"))


def daily_sales_document(d: Frames, date: str, branch_id: int | None) -> DataFrame:
    """Detail rows of a day's sales and a closing row with the total.

    Without a branch the document is empty but for its total of zero.
    """
    agents = d["users"].select(F.col("id").alias("sales_agent_id"),
                               F.col("full_name").alias("agent_name"))
    sales = completed(d).filter(on_day("sale_date", date) & branch_is("branch_id", branch_id))
    detail = sales.join(agents, "sales_agent_id").select(
        F.lit(1).alias("part"), "sale_date", "receipt_number", "agent_name",
        format_number("total_amount").alias("amount"), format_clock("sale_date").alias("time"))
    summary = sales.agg(money_sum("total_amount").alias("total"), F.count("*").alias("count"))
    none = F.lit(None).cast("string")
    total = summary.select(
        F.lit(2).alias("part"), F.lit(None).cast("timestamp_ntz").alias("sale_date"),
        none.alias("receipt_number"), none.alias("agent_name"),
        F.concat(F.lit("Total Sales: "), format_money("total"), F.lit(" ("),
                 F.col("count").cast("string"), F.lit(" transactions)")).alias("amount"),
        none.alias("time"))
    return detail.unionByName(total).orderBy("part", "sale_date", "receipt_number").drop(
        "sale_date")


def receipt_lines(d: Frames, company: Company = Company()) -> DataFrame:
    """Printed text of every receipt, one row per line.

    The reading order is (sale_id, part, seq). Item names are cut to 18
    characters.
    """
    headers = receipt_headers(d)

    def labelled(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    top = [
        F.lit(company.name), F.lit(company.address), F.lit(company.phone), F.lit(RULE),
        labelled("Branch: ", F.col("branch_name")),
        labelled("Receipt: ", F.col("receipt_number")),
        labelled("Date: ", format_stamp("sale_date")),
        labelled("Served by: ", F.col("agent_name")),
        F.lit(RULE), _columns(F.lit("Item"), F.lit("Qty"), F.lit("Price"), F.lit("Total")),
    ]
    bottom = [
        F.lit(RULE),
        labelled("TOTAL: ", format_money("total_amount")),
        labelled("Paid: ", format_money("amount_paid")),
        labelled("Change: ", format_money("change_given")),
        F.lit(RULE), F.lit(company.footer), F.lit("***OFFICIAL RECEIPT***"),
    ]
    frame = F.array(*[
        F.struct(F.lit(part).alias("part"), F.lit(i).cast("long").alias("seq"),
                 text.alias("text"))
        for part, texts in ((1, top), (3, bottom)) for i, text in enumerate(texts, 1)])
    around = headers.select(F.col("id").alias("sale_id"), F.explode(frame).alias("l")).select(
        "sale_id", "l.*")
    names = d["products"].select(F.col("id").alias("product_id"), "product_name")
    known = headers.select(F.col("id").alias("sale_id"))
    items = d["sale_items"].join(known, "sale_id", "left_semi").join(names, "product_id").select(
        "sale_id", F.lit(2).alias("part"), F.col("id").alias("seq"),
        _columns(F.substring("product_name", 1, 18), F.col("quantity").cast("string"),
                 format_number("unit_price"), format_number("subtotal")).alias("text"))
    return around.unionByName(items)


def _columns(item: Column, quantity: Column, price: Column, total: Column) -> Column:
    return F.concat(F.rpad(item, 19, " "), F.lpad(quantity, 6, " "), F.lpad(price, 14, " "),
                    F.lpad(total, 14, " "))


def write_receipts(lines: DataFrame, path: str) -> None:
    """Write receipt lines as text files in reading order."""
    order = ["sale_id", "part", "seq"]
    lines.orderBy(*order).select("text").write.mode("errorifexists").text(path)


def low_stock_digest(d: Frames) -> DataFrame:
    """Low-stock items per branch with the manager to write to.

    One row per item; the recipient is the branch's active manager with the
    lowest id, and branches without one are left out. Empty while the setting
    low_stock_notifications is not true.
    """
    managers = d["users"].filter(
        (F.col("role") == "manager") & (F.col("status") == "active")
        & F.col("branch_id").isNotNull()
    ).groupBy("branch_id").agg(
        F.min_by(F.struct(F.col("full_name").alias("manager_name"),
                          F.col("email").alias("recipient")), "id").alias("_m")
    ).select("branch_id", "_m.*")
    switched_on = d["system_settings"].filter(
        F.col("setting_key") == "low_stock_notifications"
    ).agg(F.max(F.col("setting_value") == "true")).scalar()
    return all_low_stock_alerts(d).filter(F.coalesce(switched_on, F.lit(False))).join(
        managers, "branch_id"
    ).select("branch_id", "recipient", "manager_name", "product_id", "product_name",
             F.col("quantity_available").alias("current_stock"), "reorder_level")


def audit_event(df: DataFrame, user: Column, action: str, module: str,
                record: Column | None = None, details: Column | None = None,
                at: Column | None = None) -> DataFrame:
    """Audit rows for the rows of ``df``; ``details`` is a struct, stored as JSON."""
    kinds = TABLES["audit_logs"].columns
    return df.select(
        user.cast("long").alias("user_id"), F.lit(action).alias("action"),
        F.lit(module).alias("module"),
        (record if record is not None else F.lit(None)).cast("long").alias("record_id"),
        (F.to_json(details) if details is not None else F.lit(None).cast("string"))
        .alias("details"),
        F.lit(None).cast("string").alias("ip_address"),
        (at if at is not None else F.localtimestamp()).cast(kinds["created_at"])
        .alias("created_at"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows to the trail, stored by day."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy(
        "day").parquet(path)
