"""Declared schemas, value domains, defaults and keys of the retail tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, INT, STR = T.LongType(), T.IntegerType(), T.StringType()
TS, DATE = T.TimestampNTZType(), T.DateType()
PRICE, MONEY = T.DecimalType(12, 2), T.DecimalType(14, 2)
# Sums of money over whole tables.
TOTAL = T.DecimalType(24, 2)

# The domains of stored columns. Names, keys and defaults of the tables
# below are fixed as well.
STATUSES = ("active", "inactive")
ROLES = ("director", "manager", "sales_agent")
SALE_STATUSES = ("completed", "voided")
MOVEMENT_TYPES = ("procurement", "sale", "adjustment", "opening")
BALANCE_STATUSES = ("pending", "approved", "flagged")
SEVERITIES = ("low", "medium", "high", "critical")
BUG_STATUSES = ("open", "in_progress", "resolved", "closed")

# Stands for the posting time in ``defaults``.
AS_OF = object()


@dataclass(frozen=True)
class Foreign:
    column: str
    parent: str
    on_delete: str = "restrict"


@dataclass(frozen=True)
class Table:
    """One declared table."""

    columns: dict[str, T.DataType]
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[Foreign, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    # generated column -> (left, operator, right)
    generated: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in self.columns.items()])


TABLES: dict[str, Table] = {
    "branches": Table(
        dict(id=LONG, branch_name=STR, location=STR, phone=STR, email=STR, status=STR,
             created_at=TS, updated_at=TS),
        required=("id", "branch_name"),
        unique=(("id",), ("branch_name",)),
        domains={"status": STATUSES},
        defaults={"status": "active", "created_at": AS_OF, "updated_at": AS_OF},
    ),
    "users": Table(
        dict(id=LONG, branch_id=LONG, full_name=STR, username=STR, email=STR, role=STR,
             status=STR, last_login=TS, created_at=TS, updated_at=TS),
        required=("id", "full_name", "username", "email", "role"),
        unique=(("id",), ("username",), ("email",)),
        foreign=(Foreign("branch_id", "branches", "set null"),),
        domains={"role": ROLES, "status": STATUSES},
        defaults={"status": "active", "created_at": AS_OF, "updated_at": AS_OF},
    ),
    "password_resets": Table(
        dict(id=LONG, user_id=LONG, token=STR, expires_at=TS, used=T.BooleanType(),
             created_at=TS),
        required=("id", "token", "expires_at"),
        unique=(("id",), ("token",)),
        foreign=(Foreign("user_id", "users", "cascade"),),
        defaults={"used": False, "created_at": AS_OF},
    ),
    "categories": Table(
        dict(id=LONG, category_name=STR, description=STR, status=STR, created_by=LONG,
             created_at=TS, updated_at=TS),
        required=("id", "category_name"),
        unique=(("id",), ("category_name",)),
        foreign=(Foreign("created_by", "users"),),
        domains={"status": STATUSES},
        defaults={"status": "active", "created_at": AS_OF, "updated_at": AS_OF},
    ),
    "suppliers": Table(
        dict(id=LONG, supplier_name=STR, contact_person=STR, phone=STR, email=STR,
             address=STR, status=STR, created_at=TS, updated_at=TS),
        required=("id", "supplier_name"),
        unique=(("id",),),
        domains={"status": STATUSES},
        defaults={"status": "active", "created_at": AS_OF, "updated_at": AS_OF},
    ),
    "products": Table(
        dict(id=LONG, category_id=LONG, product_name=STR, description=STR, cost_price=PRICE,
             selling_price=PRICE, reorder_level=INT, unit=STR, status=STR, created_by=LONG,
             created_at=TS, updated_at=TS),
        required=("id", "category_id", "product_name", "cost_price", "selling_price",
                  "reorder_level"),
        unique=(("id",),),
        foreign=(Foreign("category_id", "categories"), Foreign("created_by", "users")),
        domains={"status": STATUSES},
        defaults={"cost_price": 0, "selling_price": 0, "reorder_level": 10, "unit": "piece",
                  "status": "active", "created_at": AS_OF, "updated_at": AS_OF},
    ),
    "barcodes": Table(
        dict(id=LONG, product_id=LONG, barcode_value=STR, created_at=TS),
        required=("id", "product_id", "barcode_value"),
        unique=(("id",), ("barcode_value",)),
        foreign=(Foreign("product_id", "products", "cascade"),),
        defaults={"created_at": AS_OF},
    ),
    "branch_inventory": Table(
        dict(id=LONG, branch_id=LONG, product_id=LONG, quantity_available=INT, updated_at=TS),
        required=("id", "branch_id", "product_id", "quantity_available"),
        unique=(("id",), ("branch_id", "product_id")),
        foreign=(Foreign("branch_id", "branches", "cascade"),
                 Foreign("product_id", "products", "cascade")),
        defaults={"quantity_available": 0, "updated_at": AS_OF},
    ),
    "procurements": Table(
        dict(id=LONG, branch_id=LONG, supplier_id=LONG, recorded_by=LONG,
             reference_number=STR, notes=STR, total_cost=MONEY, procurement_date=DATE,
             created_at=TS),
        required=("id", "branch_id", "procurement_date"),
        unique=(("id",),),
        foreign=(Foreign("branch_id", "branches"), Foreign("supplier_id", "suppliers"),
                 Foreign("recorded_by", "users")),
        defaults={"total_cost": 0, "procurement_date": AS_OF, "created_at": AS_OF},
    ),
    "procurement_items": Table(
        dict(id=LONG, procurement_id=LONG, product_id=LONG, quantity=INT, unit_cost=PRICE,
             subtotal=MONEY),
        required=("id", "procurement_id", "product_id", "quantity", "unit_cost"),
        unique=(("id",),),
        foreign=(Foreign("procurement_id", "procurements", "cascade"),
                 Foreign("product_id", "products")),
        generated={"subtotal": ("quantity", "*", "unit_cost")},
    ),
    "stock_adjustments": Table(
        dict(id=LONG, branch_id=LONG, product_id=LONG, adjusted_by=LONG,
             adjustment_quantity=INT, reason=STR, created_at=TS),
        required=("id", "branch_id", "product_id", "adjustment_quantity", "reason"),
        unique=(("id",),),
        foreign=(Foreign("branch_id", "branches"), Foreign("product_id", "products"),
                 Foreign("adjusted_by", "users")),
        defaults={"created_at": AS_OF},
    ),
    "inventory_movements": Table(
        dict(id=LONG, branch_id=LONG, product_id=LONG, movement_type=STR, quantity_change=INT,
             quantity_before=LONG, quantity_after=LONG, reference_id=LONG, notes=STR,
             recorded_by=LONG, created_at=TS),
        required=("id", "branch_id", "product_id", "movement_type", "quantity_change",
                  "quantity_before", "quantity_after"),
        unique=(("id",),),
        foreign=(Foreign("branch_id", "branches"), Foreign("product_id", "products"),
                 Foreign("recorded_by", "users")),
        domains={"movement_type": MOVEMENT_TYPES},
        defaults={"created_at": AS_OF},
    ),
    "sales": Table(
        dict(id=LONG, branch_id=LONG, sales_agent_id=LONG, receipt_number=STR,
             total_amount=MONEY, amount_paid=MONEY, change_given=MONEY, payment_method=STR,
             status=STR, sale_date=TS),
        required=("id", "branch_id", "sales_agent_id", "receipt_number", "total_amount",
                  "amount_paid"),
        unique=(("id",), ("receipt_number",)),
        foreign=(Foreign("branch_id", "branches"), Foreign("sales_agent_id", "users")),
        domains={"status": SALE_STATUSES},
        defaults={"total_amount": 0, "payment_method": "cash", "status": "completed",
                  "sale_date": AS_OF},
        generated={"change_given": ("amount_paid", "-", "total_amount")},
    ),
    "sale_items": Table(
        dict(id=LONG, sale_id=LONG, product_id=LONG, quantity=INT, unit_price=PRICE,
             subtotal=MONEY),
        required=("id", "sale_id", "product_id", "quantity", "unit_price"),
        unique=(("id",),),
        foreign=(Foreign("sale_id", "sales", "cascade"), Foreign("product_id", "products")),
        generated={"subtotal": ("quantity", "*", "unit_price")},
    ),
    "cashier_balances": Table(
        dict(id=LONG, branch_id=LONG, sales_agent_id=LONG, manager_id=LONG, balance_date=DATE,
             expected_cash=MONEY, submitted_cash=MONEY, variance=MONEY, status=STR, notes=STR,
             created_at=TS, approved_at=TS),
        required=("id", "branch_id", "sales_agent_id", "balance_date", "expected_cash"),
        unique=(("id",), ("branch_id", "sales_agent_id", "balance_date")),
        foreign=(Foreign("branch_id", "branches"), Foreign("sales_agent_id", "users"),
                 Foreign("manager_id", "users")),
        domains={"status": BALANCE_STATUSES},
        defaults={"balance_date": AS_OF, "status": "pending", "created_at": AS_OF},
        generated={"variance": ("submitted_cash", "-", "expected_cash")},
    ),
    "bug_reports": Table(
        dict(id=LONG, reported_by=LONG, module=STR, severity=STR, description=STR, status=STR,
             created_at=TS, updated_at=TS),
        required=("id", "description"),
        unique=(("id",),),
        foreign=(Foreign("reported_by", "users"),),
        domains={"severity": SEVERITIES, "status": BUG_STATUSES},
        defaults={"severity": "medium", "status": "open", "created_at": AS_OF,
                  "updated_at": AS_OF},
    ),
    "audit_logs": Table(
        dict(id=LONG, user_id=LONG, action=STR, module=STR, record_id=LONG, details=STR,
             ip_address=STR, created_at=TS),
        required=("id", "action"),
        unique=(("id",),),
        foreign=(Foreign("user_id", "users"),),
        defaults={"created_at": AS_OF},
    ),
    "system_settings": Table(
        dict(id=LONG, setting_key=STR, setting_value=STR, description=STR, updated_by=LONG,
             updated_at=TS),
        required=("id", "setting_key"),
        unique=(("id",), ("setting_key",)),
        foreign=(Foreign("updated_by", "users"),),
        defaults={"updated_at": AS_OF},
    ),
}

# The settings a fresh installation starts with (neutral texts).
DEFAULT_SETTINGS = (
    ("company_name", "Example Stores", "Company name"),
    ("company_address", "1 Example Street", "Company address"),
    ("company_phone", "+000 000 000000", "Company phone"),
    ("receipt_footer", "Thank you for shopping with Example Stores!",
     "Receipt footer message"),
    ("low_stock_notifications", "true", "Enable low stock email alerts"),
    ("session_timeout_minutes", "60", "Session timeout in minutes"),
)
# The branch a fresh installation starts with.
DEFAULT_BRANCH = ("Head Office Branch", "Example City", "+000 000 000001",
                  "headoffice@example.com", "active")

SALE_LINES = T.ArrayType(T.StructType([
    T.StructField("product_id", LONG), T.StructField("quantity", STR)]))
PROCUREMENT_LINES = T.ArrayType(T.StructType([
    T.StructField("product_id", LONG), T.StructField("quantity", STR),
    T.StructField("unit_cost", STR)]))


def enforce_schema(df: DataFrame, name: str) -> DataFrame:
    """Select and cast to the declared columns; absent ones become NULL.

    Undeclared columns (a password hash, say) are dropped.
    """
    known = set(df.columns)
    return df.selectExpr(*[
        f"cast({c if c in known else 'null'} as {t.simpleString()}) as {c}"
        for c, t in TABLES[name].columns.items()
    ])


def generated_value(name: str, column: str) -> Column:
    """The formula of a generated column."""
    table = TABLES[name]
    kind = table.columns[column].simpleString()
    return F.expr(f"cast({' '.join(table.generated[column])} as {kind})")


def with_generated(df: DataFrame, name: str) -> DataFrame:
    """Fill the generated columns of one table."""
    return df.withColumns({c: generated_value(name, c) for c in TABLES[name].generated})
