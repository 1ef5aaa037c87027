"""What the plans must look like."""

import pytest

from storelake.operators import ledger, quality
from storelake.plans import dashboards, listings, reports
from storelake.sources.driver_tables import load
from storelake.sources.tables import read_tables, write_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def d(spark):
    return load(spark, FOLDER)


def plan(df, mode="formatted"):
    query = df._jdf.queryExecution()
    return query.explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_day_filter_reaches_the_scan(d):
    text = plan(reports.daily_sales_summary(d, "1995-07-12"))
    assert "GreaterThanOrEqual(o_orderdate,1995-07-12" in text
    assert "LessThan(o_orderdate,1995-07-13" in text


def test_only_needed_columns_are_read(d):
    text = plan(reports.company_branch_performance(d))
    assert "o_totalprice" in text and "o_orderpriority" not in text
    text = plan(listings.category_summary(d))
    assert "p_retailprice" not in text


def test_product_search_is_an_inner_join(d):
    text = plan(listings.product_search(d, 3, "x"), "extended").split("Optimized Logical Plan")[1]
    stock = text.split("branch_inventory")[0]
    assert "Join Inner" in stock


@pytest.mark.parametrize("query", [
    lambda d: reports.company_top_products(d),
    lambda d: dashboards.agent_recent_sales(d, 3),
    lambda d: dashboards.manager_low_stock_top(d, 3),
])
def test_top_k_does_not_sort_everything(d, query):
    assert "TakeOrderedAndProject" in plan(query(d))


@pytest.mark.parametrize("query", [
    reports.company_net_position, reports.company_top_categories,
    listings.product_catalog, lambda d: listings.inventory_listing(d, 3),
    lambda d: listings.receipts(d), lambda d: listings.cashier_balancing(d, 3, "1996-04-20"),
])
def test_no_cross_join_and_no_python(d, query):
    text = plan(query(d))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_stored_sales_are_pruned_by_month(spark, d, tmp_path):
    path = str(tmp_path / "tables")
    write_tables(d, path, ["sales"])
    assert spark.read.parquet(f"{path}/sales").select("_month").distinct().count() > 12
    back = read_tables(spark, path, ["sales"])
    assert back["sales"].count() == d["sales"].count()
    assert back["sales"].columns == d["sales"].columns
    day = "1995-07-12"
    for rows, want in (
            (reports.daily_sales_summary(back, day), reports.daily_sales_summary(d, day)),
            (dashboards.agent_day_sales(back, day), dashboards.agent_day_sales(d, day))):
        assert "PartitionFilters: [isnotnull(_month" in plan(rows)
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))


def test_stored_movements_and_audit_are_pruned_by_month(spark, d, tmp_path):
    path = str(tmp_path / "tables")
    names = ["inventory_movements", "audit_logs", "products", "users"]
    write_tables(d, path, names)
    back = read_tables(spark, path, names)
    for query in (
            lambda t: listings.movement_history(t, 3, date_from="1996-01-15",
                                                date_to="1996-12-20"),
            lambda t: listings.audit_log_search(t, date_from="2024-01-10")):
        assert "PartitionFilters: [isnotnull(_month" in plan(query(back))
        assert query(back).collect() == query(d).collect()


def test_stored_procurements_are_pruned_by_file_ranges(spark, d, tmp_path):
    path = str(tmp_path / "tables")
    names = ["procurements", "suppliers", "users", "branches"]
    write_tables(d, path, names)
    back = read_tables(spark, path, names)
    every = len(back["procurements"].inputFiles())
    for days in (("1996-01-01", "1996-03-31"), ("2000-11-01", None), (None, "1995-02-10"),
                 ("2050-01-01", None)):
        query = lambda t: listings.procurement_listing(t, 3, *days)
        read = back.of_dates("procurements", "procurement_date", *days)
        assert len(read.inputFiles()) < every / 5
        assert query(back).collect() == query(d).collect()
    assert back.of_dates("procurements", "procurement_date", None, None) is back["procurements"]


def test_quality_report_reads_each_table_once(d):
    names = ("users", "sales", "branches")
    text = plan(quality.quality_report({n: d[n] for n in names}, names), "simple")
    assert text.count("customer.parquet") == 2 and text.count("orders.parquet") == 1


def test_ledger_is_read_once_for_its_consistency(spark, d):
    moved = spark.createDataFrame([], d["inventory_movements"].schema)
    stock = spark.createDataFrame([], d["branch_inventory"].schema)
    text = plan(ledger.ledger_consistency(moved, stock), "simple")
    assert text.count("Window") <= 2 and "Union" not in text


def test_marks_of_rules_are_numbers(d):
    names = ("users", "sales", "branches")
    given = {n: d[n] for n in names}
    rules = {r: i for i, r in enumerate(r for n in names for r in quality._rules(n, given))}
    marks = quality._marks(d["sales"], "sales", rules, {"branches": 0, "users": 1})
    assert marks.dtypes == [("of", "int"), ("parent", "int"), ("key", "bigint")]
