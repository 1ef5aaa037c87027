"""Edge cases of reports, dashboards and listings on the hand-made company."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storelake.functions import labels, predicates
from storelake.operators import export
from storelake.plans import dashboards, listings, reports
from tests.hand import company

DAY = "2024-03-01"


@pytest.fixture(scope="module")
def d(spark):
    return company(spark)


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_missing_stock_row(d):
    def of(df, column):
        return df.filter("product_name = 'Apple' and category_name = 'Tools'").first()[column]

    assert of(listings.inventory_listing(d, 1), "stock_status") == "in_stock"
    assert of(reports.inventory_report(d, 1), "stock_status") == "OK"
    sheet = export.inventory_sheet(d, 1)
    assert of(sheet, "stock_status") == "Low Stock"
    assert of(sheet, "inventory_value") == 0
    assert of(sheet, "row_flag") == "yellow"
    out = listings.inventory_listing(d, 1, stock_status="out")
    assert values(out, "id") == [(1,), (4,)]


def test_stock_bands(d):
    assert values(listings.inventory_listing(d, 1, stock_status="low"), "id") == [(2,)]
    assert dict(values(listings.inventory_listing(d, 1), "id", "stock_status")) == {
        1: "out_of_stock", 2: "low_stock", 3: "in_stock", 4: "in_stock"}


def test_summary_counts_zero_as_low(d):
    row = dashboards.manager_inventory_summary(d, 1).first()
    assert (row.total_products, row.low_stock, row.out_of_stock) == (4, 3, 1)
    row = dashboards.manager_inventory_summary(d, 9).first()
    assert (row.total_products, row.low_stock, row.out_of_stock) == (0, None, None)


def test_inactive_products_count_in_value_and_alerts(d):
    assert reports.inventory_value(d).first().total == Decimal("124.00")
    assert [r.product_id for r in listings.low_stock_alerts(d, 1).collect()] == [1, 2, 5]


def test_catalog_fan_out(d):
    both = (listings.product_catalog(d).filter("id = 2").first(),
            listings.product_catalog_exact(d).filter("id = 2").first())
    assert [(r.barcode_count, r.total_stock) for r in both] == [(4, 24), (2, 12)]
    bare = listings.product_catalog(d).filter("id = 4").first()
    assert (bare.barcode_count, bare.total_stock) == (0, 0)


def test_products_of_one_name(d):
    by_name = values(dashboards.director_top_products(d), "product_name", "qty_sold")
    assert ("Apple", 7) in by_name
    by_id = values(reports.company_top_products(d), "product_name", "qty_sold")
    assert ("Apple", 3) in by_id and ("Apple", 4) in by_id


def test_history_shows_voided_sales(d):
    assert {r.id for r in listings.sale_history(d, "director").collect()} == {1, 2, 3, 4}
    shown = reports.daily_sales_detail(d, DAY).collect()
    assert [(r.receipt_number, r["items"]) for r in shown] == [("R1", 2), ("R2", 1)]


def test_history_scope(d):
    assert {r.id for r in listings.sale_history(d, "manager", 2, 1).collect()} == {1, 3, 4}
    assert {r.id for r in listings.sale_history(d, "manager", 2, 1, agent_id=4).collect()
            } == {4}
    # Agents see their own sales; an agent filter of theirs is ignored.
    assert {r.id for r in listings.sale_history(d, "sales_agent", 3, 1, agent_id=4).collect()
            } == {1, 2, 3}
    later = listings.sale_history(d, "director", date_from="2024-03-02")
    assert {r.id for r in later.collect()} == {4}
    assert listings.sale_history(d, "director", n=2).count() == 2


def test_day_bounds(d):
    row = reports.daily_sales_summary(d, DAY).first()
    assert (row.total, row["count"]) == (Decimal("15.50"), 2)
    assert reports.daily_sales_summary(d, "2030-01-01").first().total == 0


def test_procurement_without_recorder_or_supplier(d):
    rows = reports.procurement_report(d).collect()
    assert [(r.supplier_name, r.recorded_by) for r in rows] == [(None, "Max")]
    assert reports.procurement_grand_total(reports.procurement_report(d)).first()[0] == 7
    assert listings.procurement_detail(d, 2).first().product_name == "abc"
    assert listings.procurement_detail(d, 1).count() == 0


def test_no_branch(d):
    rows = reports.inventory_report(d, None).collect()
    assert len(rows) == 4 and all(r.quantity_available is None for r in rows)
    document = export.daily_sales_document(d, DAY, None).collect()
    assert [r.amount for r in document] == ["Total Sales: UGX 0 (0 transactions)"]


def test_daily_sales_document(d):
    rows = export.daily_sales_document(d, DAY, 1).collect()
    assert [(r.receipt_number, r.amount, r.time) for r in rows] == [
        ("R1", "10", "00:00:00"), (None, "Total Sales: UGX 10 (1 transactions)", None)]


def test_search(d):
    assert values(listings.product_search(d, 1, "B1"), "id", "barcodes") == [(2, ["B1"])]
    assert values(listings.product_search(d, 1, "AB"), "id", "barcodes") == [
        (2, ["B1", "B2"])]
    # A wildcard in the text keeps its meaning.
    assert values(listings.product_search(d, 1, "a_c"), "id") == [(2,)]
    assert listings.product_search(d, 1, "Apple").count() == 0


def test_company_report(d):
    rows = values(reports.company_branch_performance(d), "branch_name", "total_sales",
                  "sale_count")
    assert rows == [("North", Decimal("11.00"), 2), ("South", Decimal("5.50"), 1)]
    row = reports.company_net_position(d).first()
    assert (row.total_sales, row.total_procurement, row.net_position) == (
        Decimal("16.50"), 12, Decimal("4.50"))
    assert values(reports.ranked_branch_performance(d), "rank", "medal") == [
        (1, "gold"), (2, "silver")]
    assert reports.role_branch("director", None, "") is None
    assert reports.role_branch("manager", 1, 2) == 1


def test_cashier(d):
    rows = {r.agent_id: r for r in listings.cashier_balancing(d, 1, DAY).collect()}
    # Ana's sale in the other branch counts too; the inactive agent is left out.
    assert set(rows) == {3, 4}
    assert (rows[3].expected_cash, rows[3].submitted_cash, rows[3].variance) == (
        Decimal("15.50"), 90, -10)
    assert (rows[4].expected_cash, rows[4].sale_count, rows[4].balance_status) == (0, 0, None)
    tiles = {r.agent_id: r.sale_count for r in
             dashboards.manager_cashier_summary(d, 1, DAY).collect()}
    assert tiles == {3: 2, 4: 0}
    assert dashboards.agent_daily_sales(d, 3, DAY).first()["count"] == 2
    assert values(dashboards.agent_recent_sales(d, 3), "receipt_number") == [("R2",), ("R1",)]


def test_single_rows(d):
    assert listings.product_stock(d, 2, 2).first().quantity_available == 7
    assert listings.product_stock(d, 2, 1).first().quantity_available is None
    assert listings.entity_by_id(d, "users", 2).first().full_name == "Max"
    assert values(listings.product_barcodes(d, 2), "barcode_value") == [("B1",), ("B2",)]
    assert values(listings.receipt(d, 1), "product_name") == [("Apple",), ("Apple",)]
    assert listings.receipt(d, 4).first().product_name is None
    assert "password_hash" not in listings.user_listing(d).columns
    assert listings.user_listing(d, role="director").first().branch_name is None


def test_settings_and_bugs(d):
    rows = listings.settings_listing(d).collect()
    assert [r.setting_key for r in rows] == sorted(r.setting_key for r in rows)
    assert "Low Stock Notifications" in {r.title for r in rows}
    bug = listings.bug_report_listing(d).first()
    assert (bug.reporter, bug.description_shown) == ("Ana", "x" * 80 + "…")
    assert listings.open_bug_count(d).first()[0] == 1


def test_failed_login_class(d):
    def shown(parity):
        rows = listings.audit_log_search(d, parity=parity)
        return {r.action: r.action_class for r in rows.collect()}

    assert shown(False)["FAILED_LOGIN"] == "danger"
    assert shown(True)["FAILED_LOGIN"] == "success"
    assert listings.is_truncated(listings.audit_log_search(d, n=2), 2).first().truncated


def test_receipt_text(d):
    lines = export.receipt_lines(d).filter("sale_id = 2").orderBy("part", "seq").collect()
    texts = [r.text for r in lines]
    assert texts[1:3] == ["1 Example Street", "+000 000 000000"]
    assert "Served by: Ana" in texts and "TOTAL: UGX 5.5" in texts and "Change: UGX 0.5" in texts
    item = next(r.text for r in lines if r.part == 2)
    assert item[:19].rstrip() == "A very long produc" and item.endswith("1,234.5")


def test_digest(spark, d):
    rows = export.low_stock_digest(d).collect()
    assert {(r.recipient, r.product_id) for r in rows} == {("m@x", 1), ("m@x", 2), ("m@x", 5)}
    off = d.replacing(system_settings=d["system_settings"].withColumn(
        "setting_value", F.lit("false")))
    assert export.low_stock_digest(off).count() == 0


def test_optional_filters_start_from_true(spark):
    rows = spark.range(3)
    assert rows.filter(predicates.all_of([])).count() == 3
    assert rows.filter(predicates.optional_eq("id", "")).count() == 3
    assert rows.filter(predicates.optional_eq("id", 1)).count() == 1
    assert rows.filter(predicates.branch_is("id", None)).count() == 0


def test_texts(spark):
    row = spark.range(1).select(
        labels.format_number(F.lit("1234567.50").cast("decimal(14,2)")).alias("n"),
        labels.change_text(F.lit(5).cast("decimal(14,2)"), F.lit(9).cast("decimal(14,2)"))
        .alias("short"),
        labels.change_text(F.lit(0).cast("decimal(14,2)"), F.lit(9).cast("decimal(14,2)"))
        .alias("none"),
        labels.format_signed_money(F.lit(None).cast("decimal(14,2)")).alias("unknown"),
        labels.or_dash(F.lit("")).alias("empty"),
        labels.normalised(F.lit("  Ab ")).alias("login"),
    ).first()
    assert row.asDict() == {"n": "1,234,567.5", "short": "Short by: UGX 4", "none": None,
                            "unknown": "—", "empty": "—", "login": "ab"}
