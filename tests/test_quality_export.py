"""Quality checks, storage and export."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from storelake import read_tables, write_tables
from storelake.operators import export, quality
from storelake.plans import reports
from storelake.sources.driver_tables import load
from storelake.sources.schemas import TABLES, enforce_schema
from storelake.sources.tables import parse_order_lines
from tests.hand import ROWS, company, table


@pytest.fixture(scope="module")
def d(spark):
    return company(spark)


def test_checks_find_violations(spark, d):
    bad = table(spark, "bug_reports", [
        dict(id=1, reported_by=3, severity="low", description="a", status="open"),
        dict(id=1, reported_by=99, severity="odd", description=None, status=None)])
    assert quality.check_unique(bad, ["id"]).first().occurrences == 2
    assert quality.check_fk(bad, "reported_by", d["users"]).first().reported_by == 99
    # NULL passes a domain check.
    assert quality.check_domain(bad, "severity", ["low"]).count() == 1
    assert quality.check_domain(bad, "status", ["open"]).count() == 0
    assert quality.check_not_null(bad, ["description", "id"]).first().missing == "description"
    items = d["sale_items"].withColumn("subtotal", F.col("subtotal") + F.col("id") % 2)
    assert quality.check_generated(items, "sale_items").count() == 2
    report = {(r.rule, r.column_name): r.violations for r in quality.quality_report(
        d.replacing(bug_reports=bad), ["bug_reports"]).collect()}
    assert report[("unique", "id")] == 1 and report[("foreign", "reported_by")] == 1
    assert report[("domain", "severity")] == 1 and report[("not_null", "description")] == 1


def test_quality_report_counts_the_rules_of_every_given_table(spark, d):
    """The registered query judges movements and settings too, not a part of the tables."""
    given = [n for n in load(spark, "/root/testdata/sf0.001") if n in TABLES]
    assert set(entry.RULED_TABLES) == set(given) == set(TABLES) - {"password_resets"}
    move = dict(branch_id=1, product_id=2, movement_type="sale", quantity_change=-1,
                quantity_before=3, quantity_after=2)
    moves = table(spark, "inventory_movements", [
        dict(move, id=1), dict(move, id=1, product_id=77, recorded_by=78),
        dict(move, id=2, movement_type="gift", branch_id=79, quantity_after=None)])
    keys = table(spark, "system_settings", [
        dict(id=i, setting_key="company_name", updated_by=u) for i, u in ((1, 1), (2, 80))])
    report = {(r.table_name, r.rule, r.column_name): r.violations for r in quality.quality_report(
        d.replacing(inventory_movements=moves, system_settings=keys),
        entry.RULED_TABLES).collect()}
    assert {k[1:] for k, n in report.items() if k[0] == "inventory_movements" and n == 1} == {
        ("unique", "id"), ("domain", "movement_type"), ("not_null", "quantity_after"),
        ("foreign", "branch_id"), ("foreign", "product_id"), ("foreign", "recorded_by")}
    assert report["system_settings", "unique", "setting_key"] == 1
    assert report["system_settings", "foreign", "updated_by"] == 1


def test_hand_made_company_is_clean(d):
    assert quality.quality_report(d, ["users", "sales", "cashier_balances"]).filter(
        "violations > 0").count() == 0


def test_defaults(spark):
    out = quality.apply_defaults(
        table(spark, "sales", [dict(id=1, amount_paid=Decimal(1))]), "sales",
        "2024-01-01 00:00:00").first()
    assert (out.total_amount, out.payment_method, out.status, out.sale_date) == (
        0, "cash", "completed", datetime(2024, 1, 1))


def test_order_lines(spark):
    rows = spark.createDataFrame([
        (1, '[{"product_id": 1, "quantity": "2", "unit_cost": 1.5},'
            ' {"product_id": 2, "quantity": 3, "unit_cost": "x"}]'),
        (2, "[]"), (4, "not json"), (3, '[{"product_id": 1, "quantity": 0, "unit_cost": 1}]')],
        "id int, items string")
    lines = parse_order_lines(rows, "items", "procurement")
    assert [tuple(r) for r in lines.orderBy("id", "line_no").collect()] == [
        (1, 1, 1, 2, Decimal("1.50")), (1, 2, 2, 3, None), (2, None, None, None, None),
        (3, 1, 1, 0, Decimal("1.00")), (4, 0, None, None, None)]
    typed = rows.withColumn("lines", F.from_json(
        "items", "array<struct<product_id:long,quantity:string,unit_cost:string>>"))
    assert {r.id for r in quality.check_order_lines(typed, "lines").collect()} == {1, 2, 3, 4}
    good = typed.filter("id = 1").withColumn("lines", F.slice("lines", 1, 1))
    assert quality.check_order_lines(good, "lines").count() == 0


def test_tables_are_stored_and_read_back(spark, d, tmp_path):
    path = str(tmp_path / "tables")
    names = ["sales", "users", "sale_items"]
    write_tables(d, path, names)
    back = read_tables(spark, path, names)
    for name in names:
        assert back[name].schema.simpleString() == TABLES[name].struct.simpleString()
        assert sorted(back[name].collect()) == sorted(d[name].collect(), key=tuple) or (
            {r.id for r in back[name].collect()} == {r["id"] for r in ROWS[name]})
    assert reports.daily_sales_summary(back, "2024-03-01").first()["count"] == 2
    assert set(read_tables(spark, path)) == set(TABLES) - {"password_resets"}


def test_schema_drops_undeclared_columns(spark):
    rows = spark.createDataFrame([(1, "secret")], "id int, password_hash string")
    out = enforce_schema(rows, "users")
    assert out.columns == list(TABLES["users"].columns)
    assert out.first().id == 1 and out.first().username is None


def test_exports(spark, d, tmp_path):
    path = str(tmp_path / "sheet")
    export.export_report(export.inventory_sheet(d, 1), path, "csv", export.INVENTORY_HEADINGS)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == [*export.INVENTORY_HEADINGS.values(), "row_flag"]
    assert back.count() == 4
    export.write_json(reports.company_top_products(d), str(tmp_path / "top"))
    assert spark.read.json(str(tmp_path / "top")).count() == 3
    export.write_receipts(export.receipt_lines(d), str(tmp_path / "receipts"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "receipts")).collect()]
    assert lines.count("***OFFICIAL RECEIPT***") == 4


def test_audit_sink(spark, d, tmp_path):
    path = str(tmp_path / "audit")
    rows = export.audit_event(
        d["sales"], F.col("sales_agent_id"), "SALE_PROCESSED", "Sales", F.col("id"),
        F.struct(F.col("receipt_number").alias("receipt")), F.col("sale_date"))
    export.append_audit(rows, path)
    export.append_audit(rows.filter("record_id = 1"), path)
    back = spark.read.parquet(path)
    assert back.count() == 5
    assert back.filter("record_id = 1").first().details == '{"receipt":"R1"}'
    assert {str(r.day) for r in back.select("day").distinct().collect()} == {
        "2024-03-01", "2024-03-02"}
