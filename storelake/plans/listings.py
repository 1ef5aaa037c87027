"""Listing, history, lookup and search pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.functions.labels import (
    alert_type, audit_action_class, listing_status, shortened, title_of_key,
)
from storelake.functions.predicates import (
    all_of, at_or_below_reorder, branch_is, days_between, low_stock, name_like,
    optional_eq, out_of_stock, scope_rows,
)
from storelake.plans.dashboards import active_agents, agent_day_sales
from storelake.plans.reports import (
    Frames, active_products_with_stock, category_names, count_items, stock_of,
    with_procurement_names,
)
from storelake.sources.schemas import DATE, TOTAL
from storelake.sources.tables import of_dates, of_months


def _agent_names(d: Frames) -> DataFrame:
    return d["users"].select(F.col("id").alias("sales_agent_id"),
                             F.col("full_name").alias("agent_name"))


def _branch_names(d: Frames) -> DataFrame:
    return d["branches"].select(F.col("id").alias("branch_id"), "branch_name")


def _product_names(d: Frames) -> DataFrame:
    return d["products"].select(F.col("id").alias("product_id"), "product_name")


def _newest(date: str) -> tuple[Column, Column]:
    return F.desc_nulls_first(date), F.desc("id")


# --- sales ---------------------------------------------------------------------

def sale_history(d: Frames, role: str, user_id: int | None = None,
                 branch_id: int | None = None, date_from: str | None = None,
                 date_to: str | None = None, agent_id: int | None = None,
                 n: int = 100) -> DataFrame:
    """Newest sales a role may see, voided ones included.

    Only managers can filter by agent. Agent and branch are declared NOT NULL
    references, so naming them after the cut returns the same rows.
    """
    agent = agent_id if role == "manager" else None
    shown = of_months(d, "sales", date_from, date_to).filter(all_of([
        scope_rows(role, user_id, branch_id),
        days_between("sale_date", date_from, date_to),
        optional_eq("sales_agent_id", agent),
    ])).orderBy(*_newest("sale_date")).limit(n)
    return shown.join(_agent_names(d), "sales_agent_id").join(
        _branch_names(d), "branch_id"
    ).join(count_items(d, shown), F.col("id") == F.col("sale_id"), "left").select(
        *d["sales"].columns, "agent_name", "branch_name",
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
    ).orderBy(*_newest("sale_date"))


def receipt_headers(d: Frames) -> DataFrame:
    """Sales with the names of agent and branch."""
    return d["sales"].join(_agent_names(d), "sales_agent_id").join(
        _branch_names(d), "branch_id")


def receipts(d: Frames) -> DataFrame:
    """All receipts, one row per item line (one with NULLs for a sale without lines).

    Lines stay rows, so a receipt of any length can be written out.
    """
    lines = d["sale_items"].join(_product_names(d), "product_id").select(
        F.col("id").alias("item_id"), F.col("sale_id"), "product_id", "product_name",
        "quantity", "unit_price", "subtotal")
    return receipt_headers(d).join(lines, F.col("id") == F.col("sale_id"), "left").drop(
        "sale_id")


def receipt(d: Frames, sale_id: int) -> DataFrame:
    """One receipt with its lines."""
    return receipts(d).filter(F.col("id") == sale_id).orderBy("item_id")


def product_search(d: Frames, branch_id: int | None, q: str, n: int = 10) -> DataFrame:
    """Active products in stock whose name contains ``q`` or that carry barcode ``q``.

    A product found by name lists all its barcodes, one found by barcode only the
    matching one. The list is built after the cut, for n products.
    """
    codes = d["barcodes"].select("product_id", "barcode_value")
    hits = codes.filter(F.col("barcode_value") == q).select(
        F.col("product_id").alias("_hit")).distinct()
    # Few products match, so their stock is joined last.
    matching = d["products"].filter(F.col("status") == "active").join(
        hits, F.col("id") == F.col("_hit"), "left"
    ).withColumn("_named", name_like("product_name", q)).filter(
        F.col("_named") | F.col("_hit").isNotNull())
    found = matching.join(
        stock_of(d, branch_id), F.col("id") == F.col("product_id"), "left"
    ).filter(F.col("quantity_available") > 0).join(category_names(d), "category_id").select(
        "id", "product_name", "selling_price", "description", "quantity_available",
        "category_name", "_named",
    ).orderBy("product_name", "id").limit(n)
    shown = found.join(
        codes, (F.col("id") == F.col("product_id"))
        & (F.col("_named") | (F.col("barcode_value") == q)), "left")
    return shown.groupBy(
        "id", "product_name", "selling_price", "description", "quantity_available",
        "category_name",
    ).agg(F.sort_array(F.collect_list("barcode_value")).alias("barcodes")).orderBy(
        "product_name", "id")


# --- inventory -----------------------------------------------------------------

def inventory_listing(d: Frames, branch_id: int | None, search: str | None = None,
                      category_id: int | None = None, stock_status: str | None = None
                      ) -> DataFrame:
    """Stock page of a branch with its three optional filters."""
    band = {"low": low_stock(), "out": out_of_stock()}.get(stock_status or "", F.lit(True))
    return active_products_with_stock(d, branch_id).filter(all_of([
        name_like("product_name", search), optional_eq("category_id", category_id), band,
    ])).select(
        "id", "product_name", "selling_price", "cost_price", "reorder_level", "unit",
        "category_name", "quantity_available", listing_status().alias("stock_status"),
    ).orderBy("product_name", "id")


def product_stock(d: Frames, branch_id: int | None, product_id: int) -> DataFrame:
    """One product with the branch's quantity, NULL if none is on record."""
    return d["products"].filter(F.col("id") == product_id).join(
        stock_of(d, branch_id), F.col("id") == F.col("product_id"), "left"
    ).drop("product_id")


def branch_stock_of_products(d: Frames, branch_id: int | None) -> DataFrame:
    """``product_stock`` for every product at once."""
    return d["products"].join(
        stock_of(d, branch_id), F.col("id") == F.col("product_id"), "left"
    ).drop("product_id")


def movement_history(d: Frames, branch_id: int | None, product_id: int | None = None,
                     movement_type: str | None = None, date_from: str | None = None,
                     date_to: str | None = None, n: int = 200) -> DataFrame:
    """Newest ledger rows of a branch with product and optional recorder.

    The product is a declared NOT NULL reference, so it is named after the cut.
    """
    shown = of_months(d, "inventory_movements", date_from, date_to).filter(all_of([
        branch_is("branch_id", branch_id),
        optional_eq("product_id", product_id),
        optional_eq("movement_type", movement_type),
        days_between("created_at", date_from, date_to),
    ])).orderBy(*_newest("created_at")).limit(n)
    recorder = d["users"].select(F.col("id").alias("recorded_by"),
                                 F.col("full_name").alias("recorded_by_name"))
    return shown.join(_product_names(d), "product_id").join(
        recorder, "recorded_by", "left"
    ).select(
        *d["inventory_movements"].columns, "product_name", "recorded_by_name"
    ).orderBy(*_newest("created_at"))


def low_stock_alerts(d: Frames, branch_id: int | None) -> DataFrame:
    """Items at or below their reorder level, lowest first, inactive ones included."""
    return all_low_stock_alerts(d).filter(branch_is("branch_id", branch_id)).select(
        "product_id", "product_name", "quantity_available", "reorder_level",
        "category_name", "alert_type",
    ).orderBy("quantity_available", "product_id")


def all_low_stock_alerts(d: Frames) -> DataFrame:
    """Low-stock items of every branch."""
    stock = d["branch_inventory"].select("branch_id", "product_id", "quantity_available")
    products = d["products"].select(
        F.col("id").alias("product_id"), "product_name", "reorder_level", "category_id")
    return stock.join(products, "product_id").filter(at_or_below_reorder()).join(
        category_names(d), "category_id"
    ).withColumn("alert_type", alert_type()).drop("category_id")


# --- procurement ---------------------------------------------------------------

def _named_procurements(d: Frames, headers: DataFrame) -> DataFrame:
    # The recorder's name takes the place of the recorder's id, as shown.
    return with_procurement_names(d, headers).drop("recorded_by").withColumnRenamed(
        "recorded_by_name", "recorded_by")


def procurement_listing(d: Frames, branch_id: int | None, date_from: str | None = None,
                        date_to: str | None = None, supplier_id: int | None = None
                        ) -> DataFrame:
    """Procurements of a branch, newest first."""
    headers = of_dates(d, "procurements", "procurement_date", date_from, date_to).filter(all_of([
        branch_is("branch_id", branch_id),
        days_between("procurement_date", date_from, date_to),
        optional_eq("supplier_id", supplier_id),
    ]))
    return _named_procurements(d, headers).orderBy(*_newest("created_at"))


def procurement_details(d: Frames) -> DataFrame:
    """All procurements, one row per item line."""
    lines = d["procurement_items"].join(_product_names(d), "product_id").select(
        F.col("id").alias("item_id"), "procurement_id", "product_id", "product_name",
        "quantity", "unit_cost", "subtotal")
    return _named_procurements(d, d["procurements"]).join(
        lines, F.col("id") == F.col("procurement_id"), "left").drop("procurement_id")


def procurement_detail(d: Frames, procurement_id: int) -> DataFrame:
    """One procurement with its lines."""
    return procurement_details(d).filter(F.col("id") == procurement_id).orderBy("item_id")


# --- products ------------------------------------------------------------------

def _barcode_counts(d: Frames) -> DataFrame:
    return d["barcodes"].groupBy("product_id").agg(F.count("*").alias("_codes"))


def _stock_totals(d: Frames) -> DataFrame:
    return d["branch_inventory"].groupBy("product_id").agg(
        F.count("*").alias("_rows"), F.sum("quantity_available").alias("_stock"))


def _catalog(d: Frames, search: str | None, category_id: int | None, status: str | None,
             barcode_count: Column, total_stock: Column) -> DataFrame:
    products = d["products"].filter(all_of([
        name_like("product_name", search), optional_eq("category_id", category_id),
        optional_eq("status", status),
    ]))
    return products.join(category_names(d), "category_id").join(
        _barcode_counts(d), F.col("id") == F.col("product_id"), "left"
    ).drop("product_id").join(
        _stock_totals(d), F.col("id") == F.col("product_id"), "left"
    ).select(
        *d["products"].columns, "category_name",
        barcode_count.alias("barcode_count"), total_stock.alias("total_stock"),
    ).orderBy("product_name", "id")


def product_catalog(d: Frames, search: str | None = None, category_id: int | None = None,
                    status: str | None = None) -> DataFrame:
    """Products with barcode count and stock as the original page shows them.

    Barcodes and stock rows multiply each other there, so a product with two
    barcodes and two stock rows counts four barcodes and twice its stock. The
    product of the two counts gives the same figures without joining the pairs.
    """
    codes, rows = F.coalesce("_codes", F.lit(0)), F.coalesce("_rows", F.lit(0))
    return _catalog(
        d, search, category_id, status,
        codes * F.greatest(rows, F.lit(1)),
        F.coalesce(F.col("_stock") * F.greatest(codes, F.lit(1)), F.lit(0)))


def product_catalog_exact(d: Frames, search: str | None = None,
                          category_id: int | None = None, status: str | None = None
                          ) -> DataFrame:
    """Products with their true barcode count and total stock."""
    return _catalog(d, search, category_id, status,
                    F.coalesce("_codes", F.lit(0)), F.coalesce("_stock", F.lit(0)))


def barcodes_by_product(d: Frames) -> DataFrame:
    """All barcodes, per product in the order they were made."""
    return d["barcodes"].orderBy("product_id", "created_at", "id")


def product_barcodes(d: Frames, product_id: int) -> DataFrame:
    """Barcodes of a product in the order they were made."""
    return d["barcodes"].filter(F.col("product_id") == product_id).orderBy("created_at", "id")


def category_summary(d: Frames) -> DataFrame:
    """Categories with creator and number of products."""
    counts = d["products"].groupBy("category_id").agg(F.count("*").alias("n"))
    creators = d["users"].select(F.col("id").alias("created_by"),
                                 F.col("full_name").alias("created_by_name"))
    return d["categories"].join(creators, "created_by", "left").join(
        counts, F.col("id") == F.col("category_id"), "left"
    ).select(
        *d["categories"].columns, "created_by_name",
        F.coalesce("n", F.lit(0)).alias("product_count"),
    ).orderBy("category_name")


# --- people, branches, suppliers -----------------------------------------------

def branch_user_counts(d: Frames) -> DataFrame:
    """Branches with their number of users."""
    counts = d["users"].groupBy("branch_id").agg(F.count("*").alias("n"))
    return d["branches"].join(counts, F.col("id") == F.col("branch_id"), "left").select(
        *d["branches"].columns, F.coalesce("n", F.lit(0)).alias("user_count"),
    ).orderBy("branch_name")


def supplier_listing(d: Frames) -> DataFrame:
    return d["suppliers"].orderBy("supplier_name", "id")


def user_listing(d: Frames, role: str | None = None, branch_id: int | None = None,
                 status: str | None = None) -> DataFrame:
    """Users with branch name; the password hash is never part of the table."""
    return d["users"].filter(all_of([
        optional_eq("role", role), optional_eq("branch_id", branch_id),
        optional_eq("status", status),
    ])).join(_branch_names(d), "branch_id", "left").select(
        *d["users"].columns, "branch_name").orderBy("full_name", "id")


# The name column shown in pick lists.
NAMES = {"branches": "branch_name", "categories": "category_name",
         "suppliers": "supplier_name", "products": "product_name"}


def active_lookup(d: Frames, table: str) -> DataFrame:
    """Key and name of the active rows of a table, by name."""
    return _active(d, table).orderBy(NAMES[table], "id")


def _active(d: Frames, table: str) -> DataFrame:
    return d[table].filter(F.col("status") == "active").select("id", NAMES[table])


def active_products_with_cost(d: Frames) -> DataFrame:
    return d["products"].filter(F.col("status") == "active").select(
        "id", "product_name", "cost_price").orderBy("product_name", "id")


def active_branches_unsorted(d: Frames) -> DataFrame:
    return _active(d, "branches")


def user_lookup(d: Frames) -> DataFrame:
    return d["users"].select("id", "full_name", "username").orderBy("full_name", "id")


def entity_by_id(d: Frames, table: str, key: int) -> DataFrame:
    """The row with this key."""
    return d[table].filter(F.col("id") == key)


def entities_by_id(d: Frames, table: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in the ``id`` column of ``keys``."""
    return d[table].join(keys.select("id"), "id", "left_semi")


# --- cashier, audit, maintenance -----------------------------------------------

def cashier_balancing(d: Frames, branch_id: int | None, date: str) -> DataFrame:
    """Expected and submitted cash of each active agent of the branch.

    Expected cash counts the agent's sales in every branch.
    """
    agents = active_agents(d, branch_id).select(F.col("id").alias("agent_id"), "full_name")
    balances = d["cashier_balances"].filter(
        branch_is("branch_id", branch_id)
        & (F.col("balance_date") == F.lit(date).cast(DATE))
    ).select(F.col("sales_agent_id").alias("_agent"), "submitted_cash", "variance",
             F.col("status").alias("balance_status"))
    return agents.join(
        agent_day_sales(d, date), F.col("agent_id") == F.col("sales_agent_id"), "left"
    ).join(balances, F.col("agent_id") == F.col("_agent"), "left").select(
        "agent_id", "full_name",
        F.coalesce("amount", F.lit(0)).cast(TOTAL).alias("expected_cash"),
        F.coalesce("n", F.lit(0)).alias("sale_count"),
        "submitted_cash", "variance", "balance_status",
    )


def audit_log_search(d: Frames, user_id: int | None = None, module: str | None = None,
                     date_from: str | None = None, date_to: str | None = None,
                     n: int = 500, parity: bool = False) -> DataFrame:
    """Newest audit rows with user, display class and shortened details."""
    shown = of_months(d, "audit_logs", date_from, date_to).filter(all_of([
        optional_eq("user_id", user_id), optional_eq("module", module),
        days_between("created_at", date_from, date_to),
    ])).orderBy(*_newest("created_at")).limit(n)
    users = d["users"].select(F.col("id").alias("user_id"), "full_name", "username")
    return shown.join(users, "user_id", "left").select(
        *d["audit_logs"].columns, "full_name", "username",
        audit_action_class("action", parity).alias("action_class"),
        F.substring("details", 1, 80).alias("details_shown"),
    ).orderBy(*_newest("created_at"))


def is_truncated(rows: DataFrame, shown: int) -> DataFrame:
    """Whether a capped list reached its cap: the notice below the list."""
    return rows.agg((F.count("*") >= shown).alias("truncated"))


def row_count(rows: DataFrame) -> DataFrame:
    """The badge beside a list."""
    return rows.agg(F.count("*").alias("count"))


def bug_report_listing(d: Frames) -> DataFrame:
    """Bug reports with reporter, newest first."""
    reporters = d["users"].select(F.col("id").alias("reported_by"),
                                  F.col("full_name").alias("reporter"))
    return d["bug_reports"].join(reporters, "reported_by", "left").select(
        *d["bug_reports"].columns, "reporter",
        shortened("description").alias("description_shown"),
    ).orderBy(*_newest("created_at"))


def open_bug_count(d: Frames) -> DataFrame:
    return d["bug_reports"].filter(F.col("status") == "open").agg(F.count("*").alias("count"))


def settings_listing(d: Frames) -> DataFrame:
    """Settings by key with the title shown above the field."""
    return d["system_settings"].withColumn("title", title_of_key("setting_key")).orderBy(
        "setting_key")
