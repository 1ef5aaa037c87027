"""A small hand-made retail company: two branches, a few products and sales."""

from datetime import date, datetime
from decimal import Decimal

from storelake.sources.schemas import TABLES, enforce_schema, with_generated
from storelake.sources.tables import Tables, default_settings

NOW = datetime(2024, 3, 1, 9, 0)

ROWS = {
    "branches": [dict(id=1, branch_name="North", status="active"),
                 dict(id=2, branch_name="South", status="inactive")],
    "users": [
        dict(id=1, branch_id=None, full_name="Dana", username="dana", email="d@x",
             role="director", status="active"),
        dict(id=2, branch_id=1, full_name="Max", username="max", email="m@x",
             role="manager", status="active"),
        dict(id=3, branch_id=1, full_name="Ana", username="ana", email="a@x",
             role="sales_agent", status="active"),
        dict(id=4, branch_id=1, full_name="Bo", username="bo", email="b@x",
             role="sales_agent", status="active"),
        dict(id=5, branch_id=1, full_name="Cy", username="cy", email="c@x",
             role="sales_agent", status="inactive"),
    ],
    "categories": [dict(id=1, category_name="Food", status="active", created_by=1),
                   dict(id=2, category_name="Tools", status="inactive")],
    "suppliers": [dict(id=1, supplier_name="Acme", status="active")],
    "products": [
        dict(id=1, category_id=1, product_name="Apple", cost_price=Decimal("1.00"),
             selling_price=Decimal("1.50"), reorder_level=10, status="active"),
        dict(id=2, category_id=1, product_name="abc", cost_price=Decimal("2.00"),
             selling_price=Decimal("2.50"), reorder_level=10, status="active"),
        dict(id=3, category_id=2, product_name="xyz", cost_price=Decimal("3.00"),
             selling_price=Decimal("4.00"), reorder_level=10, status="active"),
        dict(id=4, category_id=2, product_name="Apple", cost_price=Decimal("4.00"),
             selling_price=Decimal("5.00"), reorder_level=10, status="active"),
        dict(id=5, category_id=2, product_name="A very long product name indeed",
             cost_price=Decimal("4.00"), selling_price=Decimal("1234.50"), reorder_level=10,
             status="inactive"),
    ],
    "barcodes": [dict(id=i, product_id=p, barcode_value=f"B{i}", created_at=NOW)
                 for i, p in ((1, 2), (2, 2), (3, 3))],
    # Product 4 has no stock row in branch 1.
    "branch_inventory": [
        dict(id=1, branch_id=1, product_id=1, quantity_available=0),
        dict(id=2, branch_id=1, product_id=2, quantity_available=5),
        dict(id=3, branch_id=1, product_id=3, quantity_available=20),
        dict(id=4, branch_id=2, product_id=2, quantity_available=7),
        dict(id=5, branch_id=1, product_id=5, quantity_available=10),
    ],
    "procurements": [
        dict(id=1, branch_id=1, supplier_id=1, recorded_by=None, total_cost=Decimal(5),
             procurement_date=date(2024, 3, 1), created_at=NOW),
        dict(id=2, branch_id=1, supplier_id=None, recorded_by=2, total_cost=Decimal(7),
             reference_number="", procurement_date=date(2024, 3, 2), created_at=NOW),
    ],
    "procurement_items": [dict(id=1, procurement_id=2, product_id=2, quantity=7,
                               unit_cost=Decimal(1))],
    "sales": [
        dict(id=1, branch_id=1, sales_agent_id=3, receipt_number="R1",
             total_amount=Decimal("10.00"), amount_paid=Decimal("20.00"), status="completed",
             sale_date=datetime(2024, 3, 1, 0, 0)),
        dict(id=2, branch_id=2, sales_agent_id=3, receipt_number="R2",
             total_amount=Decimal("5.50"), amount_paid=Decimal("6.00"), status="completed",
             sale_date=datetime(2024, 3, 1, 23, 59, 59, 999999)),
        dict(id=3, branch_id=1, sales_agent_id=3, receipt_number="R3",
             total_amount=Decimal("99.00"), amount_paid=Decimal("99.00"), status="voided",
             sale_date=datetime(2024, 3, 1, 12, 0)),
        dict(id=4, branch_id=1, sales_agent_id=4, receipt_number="R4",
             total_amount=Decimal("1.00"), amount_paid=Decimal("1.00"), status="completed",
             sale_date=datetime(2024, 3, 2, 0, 0)),
    ],
    "sale_items": [
        dict(id=1, sale_id=1, product_id=1, quantity=3, unit_price=Decimal("1.50")),
        dict(id=2, sale_id=1, product_id=4, quantity=4, unit_price=Decimal("5.00")),
        dict(id=3, sale_id=2, product_id=5, quantity=1, unit_price=Decimal("1234.50")),
        dict(id=4, sale_id=3, product_id=3, quantity=50, unit_price=Decimal("4.00")),
    ],
    "cashier_balances": [dict(id=1, branch_id=1, sales_agent_id=3, balance_date=date(2024, 3, 1),
                              expected_cash=Decimal(100), submitted_cash=Decimal(90),
                              status="flagged", created_at=NOW, approved_at=NOW)],
    "inventory_movements": [],
    "stock_adjustments": [],
    "bug_reports": [dict(id=1, reported_by=3, module="Sales", severity="high",
                         description="x" * 81, status="open", created_at=NOW)],
    "audit_logs": [
        dict(id=1, user_id=3, action="LOGIN", module="Auth", created_at=NOW),
        dict(id=2, user_id=None, action="FAILED_LOGIN", module="Auth", created_at=NOW),
        dict(id=3, user_id=3, action="LOGIN", module="Auth",
             created_at=datetime(2024, 3, 2, 8, 0)),
    ],
}


def table(spark, name, rows):
    """Rows with the declared types; missing columns are NULL."""
    spec = TABLES[name]
    values = [tuple(r.get(c) for c in spec.columns) for r in rows]
    df = enforce_schema(spark.createDataFrame(values, spec.struct), name)
    return with_generated(df, name) if spec.generated else df


def company(spark) -> Tables:
    made = {n: (lambda n=n: table(spark, n, ROWS[n])) for n in ROWS}
    return Tables({**made, "system_settings": lambda: default_settings(spark)})
