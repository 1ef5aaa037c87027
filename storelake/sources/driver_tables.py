"""The retail tables derived from the given star-schema Parquet tables.

The mapping is made so that no derived table needs more shuffles than its
content asks for: line ids are fingerprints of the line, not row numbers, the
branch of a sale follows from its agent key, prices come from the line.
``FIXTURES.md`` lists the rules.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelake.operators.ledger import inventory_snapshot, running_balance
from storelake.operators.ordered import ROWS_PER_CHUNK
from storelake.sources.schemas import enforce_schema, with_generated
from storelake.sources.tables import Tables, default_settings

BRANCHES = 25
SALE, PROCUREMENT, ADJUSTMENT = "N", "A", "R"
# What each kind of event stands for in the audit trail.
ACTIONS = {"signup": "USER_CREATED", "click": "LOGIN", "error": "FAILED_LOGIN",
           "view": "PRODUCT_UPDATED", "purchase": "SALE_PROCESSED"}
MODULES = {"signup": "Users", "click": "Auth", "error": "Auth", "view": "Products",
           "purchase": "Sales"}


def _fingerprint(*parts: str) -> str:
    """60 bits of the MD5 of the parts, as a long."""
    texts = ", ".join(f"cast({p} as string)" for p in parts)
    return f"cast(conv(substring(md5(concat_ws('|', {texts})), 1, 15), 16, 10) as bigint)"


def _chosen(column: str, values: dict[str, str]) -> str:
    cases = " ".join(f"when '{key}' then '{value}'" for key, value in values.items())
    return f"case {column} {cases} end"


CATEGORY_ID = _fingerprint("p_type")
LINE_ID = _fingerprint(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_quantity as bigint)",
    "cast(l_extendedprice as decimal(18,2))", "cast(l_shipdate as date)")
# Price of one unit in cents, in whole numbers.
UNIT_CENTS = "(cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint))"
SIGNED = "if(l_linestatus = 'O', quantity, -quantity)"
REASON = "if(l_linestatus = 'O', 'Returned Goods', 'Damaged Products')"
OPENED = "timestamp_ntz'2020-01-01 00:00:00'"
STAMPS = (f"{OPENED} as created_at", f"{OPENED} as updated_at")


def _price(cents: str) -> str:
    return f"cast(cast({cents} as decimal(14,0)) * 0.01 as decimal(12,2))"


def load(spark: SparkSession, folder: str, rows_per_chunk: int | None = ROWS_PER_CHUNK,
         streamed: Collection[str] = ()) -> Tables:
    """All retail tables over ``folder``; nothing is read until a table is used.

    Given tables named in ``streamed`` are opened as streams.
    """

    def raw(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        if name not in streamed:
            return rows
        # As a pattern, because a plain path must be a folder for a stream.
        return spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}.parquet*")

    def branches() -> DataFrame:
        joined = raw("nation").join(raw("region"), F.expr("n_regionkey = r_regionkey"))
        return enforce_schema(joined.selectExpr(
            "n_nationkey as id", "n_name as branch_name", "r_name as location",
            "if(n_regionkey = 4, 'inactive', 'active') as status", *STAMPS), "branches")

    def users() -> DataFrame:
        return enforce_schema(raw("customer").selectExpr(
            "c_custkey as id", "c_nationkey as branch_id", "c_name as full_name",
            "lower(c_name) as username", "concat(lower(c_name), '@example.com') as email",
            "case c_mktsegment when 'BUILDING' then 'manager' "
            "when 'MACHINERY' then 'director' else 'sales_agent' end as role",
            "if(c_acctbal < 0, 'inactive', 'active') as status", *STAMPS), "users")

    def categories() -> DataFrame:
        kinds = raw("part").select("p_type").distinct().selectExpr(
            "p_type", f"{CATEGORY_ID} as id")
        return enforce_schema(kinds.selectExpr(
            "id", "p_type as category_name",
            "if(p_type = 'PROMO', 'inactive', 'active') as status",
            "if(id % 3 <> 0, id % 100, null) as created_by", *STAMPS), "categories")

    def suppliers() -> DataFrame:
        return enforce_schema(raw("supplier").selectExpr(
            "s_suppkey as id", "s_name as supplier_name",
            "if(s_acctbal < 0, 'inactive', 'active') as status", *STAMPS), "suppliers")

    def products() -> DataFrame:
        price = "cast(p_retailprice as decimal(12,2))"
        return enforce_schema(raw("part").selectExpr(
            "p_partkey as id", f"{CATEGORY_ID} as category_id", "p_name as product_name",
            "p_brand as description", f"{price} * 0.80 as cost_price",
            f"{price} as selling_price", "p_size as reorder_level", "'piece' as unit",
            "if(p_partkey % 17 = 0, 'inactive', 'active') as status", *STAMPS), "products")

    def barcodes() -> DataFrame:
        each = raw("part").filter("p_partkey % 4 > 0").selectExpr(
            "p_partkey", "explode(sequence(1, cast(p_partkey % 4 as int))) as k")
        return enforce_schema(each.selectExpr(
            "p_partkey * 10 + k as id", "p_partkey as product_id",
            "concat_ws('-', 'BC', p_partkey, k) as barcode_value",
            f"{OPENED} as created_at"), "barcodes")

    def sales() -> DataFrame:
        placed = raw("orders").selectExpr(
            "*", "cast(o_totalprice as decimal(14,2)) as total_amount")
        return enforce_schema(with_generated(placed.selectExpr(
            "o_orderkey as id", f"o_custkey % {BRANCHES} as branch_id",
            "o_custkey as sales_agent_id", "concat('RCP-', o_orderkey) as receipt_number",
            "total_amount",
            "cast(total_amount + cast(o_orderkey % 5 as int) as decimal(14,2)) as amount_paid",
            "'cash' as payment_method",
            "if(o_orderstatus = 'P', 'voided', 'completed') as status",
            "o_orderdate as sale_date"), "sales"), "sales")

    def lines() -> DataFrame:
        return raw("lineitem").selectExpr(
            f"{LINE_ID} as id", "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus",
            "l_shipdate", "l_partkey as product_id", "cast(l_quantity as int) as quantity",
            f"{_price(UNIT_CENTS)} as unit_price",
            f"{_price(UNIT_CENTS + ' * 80 div 100')} as unit_cost")

    def of_kind(flag: str) -> DataFrame:
        return lines().filter(F.col("l_returnflag") == flag)

    def sale_items() -> DataFrame:
        return enforce_schema(with_generated(
            of_kind(SALE).withColumnRenamed("l_orderkey", "sale_id"), "sale_items"),
            "sale_items")

    def procurement_items() -> DataFrame:
        return enforce_schema(with_generated(
            of_kind(PROCUREMENT).withColumnRenamed("l_orderkey", "procurement_id"),
            "procurement_items"), "procurement_items")

    def placed(rows: DataFrame) -> DataFrame:
        """Rows of an order with who placed it and where."""
        orders = raw("orders").selectExpr(
            "o_orderkey", "o_custkey", f"o_custkey % {BRANCHES} as branch_id")
        return rows.join(orders, F.expr("l_orderkey = o_orderkey"))

    def procurements() -> DataFrame:
        headers = of_kind(PROCUREMENT).groupBy("l_orderkey").agg(
            F.expr("sum(cast(quantity * unit_cost as decimal(14,2))) as total_cost"),
            F.expr("min(l_suppkey) as supplier"), F.expr("min(l_shipdate) as created_at"))
        return enforce_schema(placed(headers).selectExpr(
            "l_orderkey as id", "branch_id",
            "if(l_orderkey % 13 <> 0, supplier, null) as supplier_id",
            "if(l_orderkey % 11 <> 0, o_custkey, null) as recorded_by",
            "if(l_orderkey % 7 <> 0, concat('PO-', l_orderkey), null) as reference_number",
            "total_cost", "created_at as procurement_date", "created_at"), "procurements")

    def stock_adjustments() -> DataFrame:
        return enforce_schema(placed(of_kind(ADJUSTMENT)).selectExpr(
            "id", "branch_id", "product_id", "o_custkey as adjusted_by",
            f"{SIGNED} as adjustment_quantity", f"{REASON} as reason",
            "l_shipdate as created_at"), "stock_adjustments")

    def stock_changes() -> DataFrame:
        """The movement ledger without balances, from one pass over the lines."""
        rows = placed(lines().filter(F.col("l_returnflag").isin(SALE, PROCUREMENT, ADJUSTMENT)))
        kind = _chosen("l_returnflag", {SALE: "sale", PROCUREMENT: "procurement",
                                        ADJUSTMENT: "adjustment"})
        return rows.selectExpr(
            "id", "branch_id", "product_id", f"{kind} as movement_type",
            f"case l_returnflag when '{SALE}' then -quantity when '{PROCUREMENT}' "
            f"then quantity else {SIGNED} end as quantity_change",
            f"if(l_returnflag = '{ADJUSTMENT}', id, l_orderkey) as reference_id",
            f"if(l_returnflag = '{ADJUSTMENT}', {REASON}, null) as notes",
            f"if(l_returnflag <> '{PROCUREMENT}' or l_orderkey % 11 <> 0, o_custkey, null) "
            "as recorded_by",
            "l_shipdate as created_at")

    def inventory_movements() -> DataFrame:
        # A product's lines over all branches bound those of one branch, and
        # counting them needs no join.
        per_product = raw("lineitem").selectExpr("l_partkey as product_id")
        return enforce_schema(
            running_balance(stock_changes(), rows_per_chunk, per_product),
            "inventory_movements")

    def branch_inventory() -> DataFrame:
        return enforce_schema(inventory_snapshot(stock_changes()).selectExpr(
            "product_id * 1000 + branch_id as id", "branch_id", "product_id",
            "greatest(quantity_available, 0) as quantity_available", "updated_at"),
            "branch_inventory")

    def cashier_balances() -> DataFrame:
        taken = sales().filter("status = 'completed' and sales_agent_id % 3 = 0").groupBy(
            "branch_id", "sales_agent_id", F.expr("cast(sale_date as date) as balance_date")
        ).agg(F.expr("cast(sum(total_amount) as decimal(14,2)) as expected_cash"))
        difference = "cast(sales_agent_id % 5 - 2 as int)"
        handed_in = "sales_agent_id % 9 <> 0"
        closed = "cast(balance_date as timestamp_ntz)"
        return enforce_schema(with_generated(taken.selectExpr(
            "sales_agent_id * 100000 + datediff(balance_date, date'1970-01-01') as id",
            "branch_id", "sales_agent_id", "balance_date", "expected_cash",
            f"if({handed_in}, cast(expected_cash + {difference} as decimal(14,2)), null) "
            "as submitted_cash",
            f"case when not {handed_in} then 'pending' when {difference} = 0 then 'approved' "
            "else 'flagged' end as status",
            f"{closed} as created_at", f"if({handed_in}, {closed}, null) as approved_at",
        ), "cashier_balances"), "cashier_balances")

    def audit_logs() -> DataFrame:
        return enforce_schema(raw("events").selectExpr(
            "event_id as id", "if(event_id % 50 <> 0, user_id, null) as user_id",
            f"{_chosen('event_type', ACTIONS)} as action",
            f"{_chosen('event_type', MODULES)} as module",
            "get_json_object(props, '$.k') as record_id", "props as details",
            "ts as created_at"), "audit_logs")

    def bug_reports() -> DataFrame:
        return enforce_schema(raw("events").filter("event_type = 'error'").selectExpr(
            "event_id as id", "user_id as reported_by", "'Auth' as module",
            "case when value < 5 then 'low' when value < 20 then 'medium' "
            "when value < 60 then 'high' else 'critical' end as severity",
            "concat('Error number ', event_id, ' was shown while the user tried to sign in; "
            "the page said ', props) as description",
            "case event_id % 4 when 0 then 'open' when 1 then 'in_progress' "
            "when 2 then 'resolved' else 'closed' end as status",
            "ts as created_at", "ts as updated_at"), "bug_reports")

    return Tables({
        "branches": branches, "users": users, "categories": categories,
        "suppliers": suppliers, "products": products, "barcodes": barcodes,
        "branch_inventory": branch_inventory, "procurements": procurements,
        "procurement_items": procurement_items, "stock_adjustments": stock_adjustments,
        "stock_changes": stock_changes, "inventory_movements": inventory_movements,
        "sales": sales, "sale_items": sale_items, "cashier_balances": cashier_balances,
        "bug_reports": bug_reports, "audit_logs": audit_logs,
        "system_settings": lambda: default_settings(spark),
    })
