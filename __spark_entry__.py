
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle.sql import (  # noqa: E402
    BALANCE_DAY, BARCODE, BRANCH_DAY, DAY, RULED_TABLES, statements,
)
from storelake.functions import labels  # noqa: E402
from storelake.functions.predicates import has_role  # noqa: E402
from storelake.operators import dims, export, ledger, posting, quality  # noqa: E402
from storelake.operators.admission import ADJUSTMENT, PROCUREMENT, SALE  # noqa: E402
from storelake.plans import dashboards, listings, reports  # noqa: E402
from storelake.session import new_path, ship_package  # noqa: E402
from storelake.sources.driver_tables import load  # noqa: E402
from storelake.sources.schemas import PROCUREMENT_LINES  # noqa: E402
from storelake.sources.tables import Tables, parse_order_lines  # noqa: E402
from storelake.streaming import streams  # noqa: E402
from storelake.streaming.keyed import KeyedStock  # noqa: E402
from storelake.streaming.stock import StockStream  # noqa: E402

try:  # the operators over documents may have been taken out
    from storelake.llm import queries as corpus  # noqa: E402
except ImportError as missing:
    if not (missing.name or "").startswith("storelake.llm"):
        raise
    corpus = None

Query = Callable[[SparkSession, str], DataFrame]
BRANCH, AGENT = 3, 78


def entry(spark: SparkSession) -> DataFrame:
    """Sales of every branch at sf0.001."""
    return reports.company_branch_performance(load(spark, "/root/testdata/sf0.001"))


def over(build: Callable[[Tables], DataFrame]) -> Query:
    """A query over the retail tables derived from the folder."""
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(load(spark, folder))

    return query


# --- posting: the given orders as requests --------------------------------------

def baskets_of(d: Tables) -> tuple[DataFrame, DataFrame]:
    """The sales and their item lines as baskets still to be posted."""
    headers = d["sales"].select(
        F.col("id").alias("basket_id"), "branch_id", "sales_agent_id",
        F.col("sale_date").alias("posted_at"), "amount_paid")
    lines = d["sale_items"].select(
        F.col("sale_id").alias("basket_id"), F.col("id").alias("line_no"), "product_id",
        "quantity")
    return headers, lines


def procurements_of(d: Tables) -> tuple[DataFrame, DataFrame]:
    headers = d["procurements"].select(
        F.col("id").alias("procurement_id"), "branch_id", "supplier_id", "recorded_by",
        "reference_number", "notes", "procurement_date", F.col("created_at").alias("posted_at"))
    lines = d["procurement_items"].select(
        "procurement_id", F.col("id").alias("line_no"), "product_id", "quantity", "unit_cost")
    return headers, lines


def adjustments_of(d: Tables) -> DataFrame:
    return d["stock_adjustments"].select(
        F.col("id").alias("adjustment_id"), "branch_id", "product_id", "adjusted_by",
        F.col("adjustment_quantity").alias("quantity"), "reason",
        F.col("created_at").alias("posted_at"))


def post_sales(d: Tables) -> DataFrame:
    return posting.post_sales(*baskets_of(d), d["branch_inventory"], d["products"]).movements


def procurement_posting(d: Tables) -> posting.Posting:
    return posting.post_procurements(
        *procurements_of(d), d["branch_inventory"], d["products"])


def post_adjustments(d: Tables) -> DataFrame:
    return posting.post_adjustments(
        adjustments_of(d), d["branch_inventory"], d["products"]).movements


def post_events(d: Tables) -> DataFrame:
    """Everything from an empty store, in time order; the rejected requests."""
    baskets, basket_lines = baskets_of(d)
    procurements, procurement_lines = procurements_of(d)
    return posting.post_events(
        d["branch_inventory"].filter(F.lit(False)), d["products"], baskets, basket_lines,
        procurements, procurement_lines, adjustments_of(d)).rejections


# --- streaming: one pass over the folder with availableNow ----------------------

def stream_daily_sales(spark: SparkSession, folder: str) -> DataFrame:
    sales = load(spark, folder, streamed=["orders"])["sales"]
    place = new_path(spark, "daily-sales")
    streams.start_daily_sales(sales, place).awaitTermination()
    return streams.read_daily_totals(spark, place)


def stream_audit_ingest(spark: SparkSession, folder: str) -> DataFrame:
    audit = load(spark, folder, streamed=["events"])["audit_logs"]
    place = new_path(spark, "audit")
    streams.start_audit_ingest(audit, place).awaitTermination()
    return streams.read_audit_trail(spark, place)


def stock_lines_of(changes: DataFrame) -> DataFrame:
    """Stock changes as the lines that the stock streams take."""
    kind = F.col("movement_type")
    return changes.select(
        "branch_id", F.col("created_at").alias("posted_at"),
        F.when(kind == "procurement", PROCUREMENT).when(kind == "sale", SALE)
         .otherwise(ADJUSTMENT).alias("kind"),
        F.col("reference_id").alias("event_id"), F.col("id").alias("line_no"), "product_id",
        F.col("quantity_change").cast("long").alias("change"))


def stock_stream(spark: SparkSession, folder: str) -> StockStream:
    """All stock changes streamed into an empty store."""
    ship_package(spark)
    lines = stock_lines_of(load(spark, folder, streamed=["lineitem"])["stock_changes"])
    d = load(spark, folder)
    stream = StockStream(new_path(spark, "stock"),
                         d["branch_inventory"].filter(F.lit(False)), d["products"])
    stream.start(lines).awaitTermination()
    return stream


def in_parts(rows: DataFrame, column: str, start: Callable, newest_first: bool = False) -> None:
    """The rows in three parts by time; ``start`` runs a query over what is there each time.

    So the query is started again from its checkpoint for the second and the third part.
    """
    spark, inbox = rows.sparkSession, new_path(rows.sparkSession, "inbox")
    edges = rows.agg(F.percentile_approx(column, [0.33, 0.67])).first()[0] or []
    part = sum((F.coalesce(F.col(column) > F.lit(edge), F.lit(False)).cast("int")
                for edge in edges), F.lit(0))
    for number in (2, 1, 0) if newest_first else (0, 1, 2):
        rows.filter(part == number).write.mode("append").parquet(inbox)
        start(spark.readStream.schema(rows.schema).parquet(inbox)).awaitTermination()


def stream_stock_keyed(spark: SparkSession, folder: str) -> DataFrame:
    """All stock changes in three batches, into the keyed stock of an empty store."""
    ship_package(spark)
    d = load(spark, folder)
    keyed = KeyedStock(new_path(spark, "keyed-stock"),
                       d["branch_inventory"].filter(F.lit(False)), d["products"])
    in_parts(stock_lines_of(d["stock_changes"]), "posted_at", keyed.start)
    return keyed.movements().drop("batch")


def stream_user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the audit events, the newest third of which comes first."""
    ship_package(spark)
    place = new_path(spark, "sessions")
    in_parts(load(spark, folder)["audit_logs"].select("user_id", "created_at"), "created_at",
             lambda events: streams.start_user_sessions(events, place), newest_first=True)
    return streams.read_user_sessions(spark, place)


# --- exports, written and read back ---------------------------------------------

def exported(df: DataFrame, fmt: str, headings: dict[str, str]) -> DataFrame:
    spark, path = df.sparkSession, new_path(df.sparkSession, "export")
    export.export_report(df, path, fmt, headings)
    written = spark.read.format(fmt).option("header", True).schema(
        df.withColumnsRenamed(headings).schema).load(path)
    return written.withColumnsRenamed({b: a for a, b in headings.items()})


# --- changes to the small tables, made from the given tables --------------------

AS_OF = "2024-06-01 12:00:00"


def cash_submissions(d: Tables) -> DataFrame:
    """Every agent hands in the day's cash at six, some one unit short or over."""
    taken = dashboards.agent_sales_totals(d).select(
        "sales_agent_id", F.col("sale_day").alias("balance_date"),
        F.col("total").cast("decimal(14,2)").alias("expected_cash"))
    return taken.selectExpr(
        "sales_agent_id % 25 as branch_id", "sales_agent_id", "balance_date",
        "cast(1 as bigint) as manager_id", "expected_cash",
        "cast(expected_cash + cast(sales_agent_id % 3 - 1 as int) as decimal(14,2)) "
        "as submitted_cash",
        "'evening' as notes", "cast(balance_date as timestamp_ntz) + interval 18 hours "
        "as posted_at")


def update_suppliers(d: Tables) -> DataFrame:
    """Inactive suppliers are taken back, with an address."""
    changes = d["suppliers"].filter("status = 'inactive'").selectExpr(
        "id", "'active' as status", "concat('Warehouse ', id) as address")
    return dims.upsert_dim(d["suppliers"], changes, ["status", "address"], as_of=AS_OF)


def new_users(d: Tables) -> DataFrame:
    """Suppliers and, once more, the users themselves ask for an account."""
    return d["suppliers"].selectExpr(
        "id as place", "cast(null as bigint) as branch_id", "supplier_name as full_name",
        "concat(' ', supplier_name) as username", "concat(lower(supplier_name), '@example.com') "
        "as email", "'manager' as role"
    ).unionByName(d["users"].selectExpr(
        "id + 1000000000 as place", "branch_id", "full_name", "upper(username) as username",
        "email", "role"))


def new_barcodes(d: Tables) -> DataFrame:
    """A first barcode for every product, asked for twice, with spaces around it."""
    asked = d["products"].selectExpr(
        "id as product_id", "concat(' BC-', id, '-1 ') as barcode_value",
        "explode(array(1, 2)) as turn")
    return asked.selectExpr("product_id", "barcode_value", "product_id * 10 + turn as place")


def new_bug_reports(d: Tables) -> DataFrame:
    return d["audit_logs"].filter("action = 'PRODUCT_UPDATED'").selectExpr(
        "id as place", "user_id as reported_by", "module",
        "if(record_id > 50, 'high', null) as severity", "details as description")


def inactive(d: Tables, table: str) -> DataFrame:
    return d[table].filter("status = 'inactive'").select("id")


def order_payloads(d: Tables) -> DataFrame:
    """Procurement lines as the JSON text a client sends."""
    return d["procurement_items"].selectExpr(
        "id", "to_json(array(named_struct('product_id', product_id, 'quantity', quantity, "
        "'unit_cost', unit_cost))) as items")


def bad_order_payloads(d: Tables) -> DataFrame:
    """The same payloads with text for a quantity, without lines, or cut off."""
    items = F.col("items")
    return order_payloads(d).withColumn(
        "items", F.when(F.col("id") % 5 == 1, F.regexp_replace(
            items, '"quantity":[0-9]+', '"quantity":"many"'))
        .when(F.col("id") % 5 == 2, F.lit("[]"))
        .when(F.col("id") % 5 == 3, F.left(items, F.lit(9))).otherwise(items))


# --- display columns ------------------------------------------------------------

def movement_display(d: Tables) -> DataFrame:
    return d["stock_changes"].select(
        "id", labels.format_signed_quantity("quantity_change").alias("change_shown"),
        labels.movement_class("movement_type").alias("badge"),
        labels.or_dash("notes").alias("notes_shown"),
        labels.format_stamp("created_at").alias("at_shown"))


def cashier_display(d: Tables) -> DataFrame:
    return d["cashier_balances"].select(
        "id", labels.format_money("expected_cash").alias("expected_shown"),
        labels.format_signed_money("variance").alias("variance_shown"),
        labels.variance_text("variance").alias("variance_words"),
        labels.balance_class("status").alias("badge"),
        labels.format_long_date("balance_date").alias("day_shown"))


def catalog_display(d: Tables) -> DataFrame:
    return listings.product_catalog_exact(d).select(
        "id", labels.format_money("cost_price").alias("cost_shown"),
        labels.format_number("selling_price").alias("price_shown"),
        labels.barcode_label("barcode_count").alias("barcodes_shown"),
        labels.title_of_key(F.lower("product_name")).alias("title"))


def procurement_display(d: Tables) -> DataFrame:
    return d["procurements"].select(
        "id", labels.reference_or_id().alias("reference_shown"),
        labels.reference_or_id(prefix="#").alias("tile_shown"),
        labels.or_zero("supplier_id").alias("supplier_or_zero"),
        labels.format_money("total_cost").alias("cost_shown"))


def sale_display(d: Tables) -> DataFrame:
    return d["sales"].select(
        "id", labels.change_text("amount_paid", "total_amount").alias("change_shown"),
        labels.format_clock("sale_date").alias("clock"),
        labels.iso_date("sale_date").alias("day"),
        labels.receipt_number("sale_date", "id").alias("new_receipt_number"))


def maintenance_display(d: Tables) -> DataFrame:
    bugs = d["bug_reports"].select(
        "id", labels.severity_class("severity").alias("badge"),
        labels.bug_status_class("status").alias("status_badge"))
    audit = d["audit_logs"].select(
        "id", labels.audit_action_class("action", parity=True).alias("badge"),
        F.lit(None).cast("string").alias("status_badge"))
    return bugs.unionByName(audit)


# --- registry -------------------------------------------------------------------

def queries() -> dict[str, Query]:
    """All registered queries by name."""
    return retail_queries() | (corpus.queries() if corpus else {})


def retail_queries() -> dict[str, Query]:
    return {
        "daily_sales_detail": over(lambda d: reports.daily_sales_detail(d, DAY)),
        "daily_sales_summary": over(lambda d: reports.daily_sales_summary(d, DAY)),
        "daily_sales_totals": over(reports.daily_sales_totals),
        "inventory_report": over(lambda d: reports.inventory_report(d, BRANCH)),
        "inventory_export": over(lambda d: export.inventory_sheet(d, BRANCH)),
        "procurement_report": over(reports.procurement_report),
        "procurement_grand_total": over(
            lambda d: reports.procurement_grand_total(reports.procurement_report(d))),
        "company_branch_performance": over(reports.company_branch_performance),
        "ranked_branch_performance": over(reports.ranked_branch_performance),
        "company_top_products": over(reports.company_top_products),
        "ranked_top_products": over(reports.ranked_top_products),
        "company_top_categories": over(reports.company_top_categories),
        "company_net_position": over(reports.company_net_position),
        "director_branch_count": over(dashboards.director_branch_count),
        "director_total_sales": over(dashboards.director_total_sales),
        "director_procurement_total": over(dashboards.director_procurement_total),
        "inventory_value": over(reports.inventory_value),
        "director_top_products": over(dashboards.director_top_products),
        "director_branch_performance": over(dashboards.director_branch_performance),
        "manager_inventory_summary": over(
            lambda d: dashboards.manager_inventory_summary(d, BRANCH)),
        "manager_low_stock_top": over(lambda d: dashboards.manager_low_stock_top(d, BRANCH)),
        "manager_recent_procurements": over(
            lambda d: dashboards.manager_recent_procurements(d, BRANCH)),
        "manager_cashier_summary": over(
            lambda d: dashboards.manager_cashier_summary(d, BRANCH, BRANCH_DAY)),
        "agent_daily_sales": over(
            lambda d: dashboards.agent_daily_sales(d, AGENT, "2001-07-23")),
        "agent_sales_totals": over(dashboards.agent_sales_totals),
        "agent_recent_sales": over(lambda d: dashboards.agent_recent_sales(d, AGENT)),
        "sale_history": over(lambda d: listings.sale_history(d, "director")),
        "sale_history_of_manager": over(lambda d: listings.sale_history(
            d, "manager", branch_id=BRANCH, date_from="1996-01-01", date_to="1999-12-31")),
        "receipts": over(listings.receipts),
        "product_search": over(lambda d: listings.product_search(d, BRANCH, "SMALL").withColumn(
            "barcodes", F.array_join("barcodes", ","))),
        "product_search_by_barcode": over(
            lambda d: listings.product_search(d, BRANCH, BARCODE).withColumn(
                "barcodes", F.array_join("barcodes", ","))),
        "inventory_listing_low": over(
            lambda d: listings.inventory_listing(d, BRANCH, stock_status="low")),
        "sale_history_of_agent": over(
            lambda d: listings.sale_history(d, "sales_agent", user_id=AGENT)),
        "users_with_role": over(
            lambda d: d["users"].filter(has_role("role", ["manager", "director"]))),
        "inventory_listing": over(lambda d: listings.inventory_listing(d, BRANCH)),
        "inventory_listing_out": over(lambda d: listings.inventory_listing(
            d, BRANCH, search="a_v", stock_status="out")),
        "branch_stock_of_products": over(
            lambda d: listings.branch_stock_of_products(d, BRANCH)),
        "movement_history": over(lambda d: listings.movement_history(d, BRANCH)),
        "low_stock_alerts": over(lambda d: listings.low_stock_alerts(d, BRANCH)),
        "all_low_stock_alerts": over(listings.all_low_stock_alerts),
        "procurement_listing": over(lambda d: listings.procurement_listing(d, BRANCH)),
        "procurement_listing_of_dates": over(lambda d: listings.procurement_listing(
            d, BRANCH, date_from="1996-01-01", date_to="1997-06-30")),
        "procurement_details": over(listings.procurement_details),
        "product_catalog": over(listings.product_catalog),
        "product_catalog_exact": over(listings.product_catalog_exact),
        "barcodes_by_product": over(listings.barcodes_by_product),
        "category_summary": over(listings.category_summary),
        "branch_user_counts": over(listings.branch_user_counts),
        "supplier_listing": over(listings.supplier_listing),
        "user_listing": over(listings.user_listing),
        "active_branches": over(listings.active_branches_unsorted),
        "active_categories": over(lambda d: listings.active_lookup(d, "categories")),
        "active_suppliers": over(lambda d: listings.active_lookup(d, "suppliers")),
        "active_products": over(lambda d: listings.active_lookup(d, "products")),
        "active_products_with_cost": over(listings.active_products_with_cost),
        "user_lookup": over(listings.user_lookup),
        "users_who_sold": over(lambda d: listings.entities_by_id(
            d, "users", d["sales"].select(F.col("sales_agent_id").alias("id")))),
        "cashier_balancing": over(
            lambda d: listings.cashier_balancing(d, 2, BALANCE_DAY)),
        "audit_log_search": over(listings.audit_log_search),
        "bug_report_listing": over(listings.bug_report_listing),
        "open_bug_count": over(listings.open_bug_count),
        "movement_ledger": over(ledger.movement_ledger),
        "running_balance": over(lambda d: d["inventory_movements"]),
        "inventory_snapshot": over(lambda d: ledger.inventory_snapshot(d["stock_changes"])),
        "latest_balance": over(lambda d: ledger.latest_balance(d["inventory_movements"])),
        "ledger_consistency": over(lambda d: ledger.ledger_consistency(
            d["inventory_movements"], d["branch_inventory"], probe=d["stock_changes"])),
        "post_sales": over(post_sales),
        "post_procurements": over(lambda d: procurement_posting(d).movements),
        "post_procurements_headers": over(lambda d: procurement_posting(d).procurements),
        "post_procurements_stock": over(lambda d: procurement_posting(d).inventory),
        "post_procurements_audit": over(lambda d: procurement_posting(d).audit),
        "post_adjustments": over(post_adjustments),
        "post_events": over(post_events),
        "basket_totals": over(lambda d: posting.order_totals(
            d["sale_items"].select("sale_id", "product_id", "quantity").join(
                d["products"].select(F.col("id").alias("product_id"), "selling_price"),
                "product_id"), "sale_id", "selling_price")),
        "last_login": over(lambda d: dims.last_login(d["audit_logs"])),
        "failed_logins": over(lambda d: dims.failed_logins(d["audit_logs"])),
        "daily_sales_document": over(
            lambda d: export.daily_sales_document(d, BRANCH_DAY, BRANCH)),
        "receipt_lines": over(export.receipt_lines),
        "low_stock_digest": over(export.low_stock_digest),
        "repeated_product_names": over(
            lambda d: quality.check_unique(d["products"], ["product_name"])),
        "upsert_cashier_balance": over(lambda d: dims.upsert_cashier_balance(
            d["cashier_balances"], cash_submissions(d))),
        "update_suppliers": over(update_suppliers),
        "insert_users": over(lambda d: dims.insert_users(
            d["users"], new_users(d), ["place"], AS_OF)[0]),
        "insert_users_refused": over(lambda d: dims.insert_users(
            d["users"], new_users(d), ["place"], AS_OF)[1].select("username", "email")),
        "insert_missing_users": over(lambda d: dims.insert_missing(
            d["users"].select("username", "email"),
            new_users(d).selectExpr("lower(trim(username)) as username", "email"),
            ["username"])),
        "add_barcodes": over(lambda d: dims.add_barcodes(
            d["barcodes"], new_barcodes(d), ["place"], AS_OF)[0]),
        "delete_barcodes": over(lambda d: dims.delete_barcodes(
            d["barcodes"], d["barcodes"].join(
                inactive(d, "products").withColumnRenamed("id", "product_id"), "product_id",
                "left_semi"))[1]),
        "submit_bug_reports": over(lambda d: dims.submit_bug_reports(
            d["bug_reports"], new_bug_reports(d), ["place"], AS_OF)),
        "set_bug_status": over(lambda d: dims.set_bug_status(
            d["bug_reports"], d["bug_reports"].filter("status = 'open'").selectExpr(
                "id", "'in_progress' as status"), AS_OF)),
        "toggle_status": over(lambda d: dims.toggle_status(
            d["suppliers"], d["procurements"].selectExpr("supplier_id as id"))),
        "delete_products_barcodes": over(lambda d: dims.cascade_delete(
            d["barcodes"], "product_id", inactive(d, "products"))),
        "delete_branches_users": over(lambda d: dims.set_null_on_delete(
            d["users"], "branch_id", inactive(d, "branches"))),
        "parse_order_lines": over(lambda d: parse_order_lines(
            order_payloads(d), "items", "procurement")),
        "parse_bad_order_lines": over(lambda d: parse_order_lines(
            bad_order_payloads(d), "items", "procurement")),
        "check_order_lines": over(lambda d: quality.check_order_lines(
            bad_order_payloads(d).select("id", F.from_json("items", PROCUREMENT_LINES)
                                         .alias("lines")), "lines").select("id")),
        "apply_defaults": over(lambda d: quality.apply_defaults(
            d["bug_reports"].selectExpr("* except (severity, updated_at)",
                                        "nullif(severity, 'low') as severity",
                                        "cast(null as timestamp_ntz) as updated_at"),
            "bug_reports", AS_OF)),
        "audit_log_truncated": over(
            lambda d: listings.is_truncated(listings.audit_log_search(d), 500)),
        "alert_count": over(lambda d: listings.row_count(listings.low_stock_alerts(d, BRANCH))),
        "check_fk": over(lambda d: quality.check_fk(
            d["procurements"], "supplier_id", d["suppliers"].filter("status = 'active'"))),
        "check_domain": over(lambda d: quality.check_domain(
            d["bug_reports"], "severity", ["low", "medium"])),
        "check_not_null": over(lambda d: quality.check_not_null(
            d["procurements"], ["supplier_id", "recorded_by", "reference_number"])),
        "check_generated": over(lambda d: quality.check_generated(
            d["sale_items"].selectExpr("* except (subtotal)", "cast(if(quantity > 40, 0, "
                                       "subtotal) as decimal(14,2)) as subtotal"),
            "sale_items")),
        "quality_report": over(lambda d: quality.quality_report(d, RULED_TABLES)),
        "movement_display": over(movement_display),
        "cashier_display": over(cashier_display),
        "catalog_display": over(catalog_display),
        "procurement_display": over(procurement_display),
        "sale_display": over(sale_display),
        "maintenance_display": over(maintenance_display),
        "stream_daily_sales": stream_daily_sales,
        "stream_audit_ingest": stream_audit_ingest,
        "stream_stock_state": lambda spark, folder: stock_stream(spark, folder).movements(),
        "stream_low_stock_alerts": lambda spark, folder: stock_stream(spark, folder).alerts(),
        "stream_stock_keyed": stream_stock_keyed,
        "stream_user_sessions": stream_user_sessions,
        "inventory_export_file": over(lambda d: exported(
            export.inventory_sheet(d, BRANCH), "csv", export.INVENTORY_HEADINGS)),
        "procurement_report_file": over(
            lambda d: exported(reports.procurement_report(d), "json", {})),
        "user_sessions": over(lambda d: streams.user_sessions(d["audit_logs"])),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return statements() | (corpus.statements() if corpus else {})
