"""Batch posting of sales, procurements and stock adjustments.

One posting takes a batch of requests and the stock on record, and returns the
rows to add to each table, the new stock and the rejected requests. Nothing is
updated in place; a rejected request adds nothing. All operators are the same
serial posting restricted to some kinds of request.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.functions.labels import receipt_number
from storelake.functions.predicates import is_blank
from storelake.operators.admission import (
    ADJUSTMENT, EVENT, FINISH_ROWS, LINE_ORDER, PROCUREMENT, SALE, balances, decide,
    new_inventory,
)
from storelake.operators.ledger import STOCK_KEY
from storelake.operators.ordered import ROWS_PER_CHUNK, numbered
from storelake.session import discard, sparing_disk, written
from storelake.sources.schemas import DATE, MONEY, PRICE, TABLES, enforce_schema, with_generated

KINDS = {PROCUREMENT: "procurement", SALE: "sale", ADJUSTMENT: "adjustment"}

# What the requests look like.
BASKETS = ("basket_id long, branch_id long, sales_agent_id long, posted_at timestamp_ntz, "
           "amount_paid decimal(14,2)")
BASKET_LINES = "basket_id long, line_no long, product_id long, quantity int"
PROCUREMENTS = ("procurement_id long, branch_id long, supplier_id long, recorded_by long, "
                "reference_number string, notes string, procurement_date date, "
                "posted_at timestamp_ntz")
PROCUREMENT_LINES = ("procurement_id long, line_no long, product_id long, quantity int, "
                     "unit_cost decimal(12,2)")
ADJUSTMENTS = ("adjustment_id long, branch_id long, product_id long, adjusted_by long, "
               "quantity int, reason string, posted_at timestamp_ntz")


@dataclass(frozen=True)
class Posting:
    """Rows to add to each table, the new stock, and what was turned down."""

    sales: DataFrame
    sale_items: DataFrame
    procurements: DataFrame
    procurement_items: DataFrame
    stock_adjustments: DataFrame
    movements: DataFrame
    inventory: DataFrame
    rejections: DataFrame
    audit: DataFrame


def post_events(
    inventory: DataFrame,
    products: DataFrame,
    baskets: DataFrame | None = None,
    basket_lines: DataFrame | None = None,
    procurements: DataFrame | None = None,
    procurement_lines: DataFrame | None = None,
    adjustments: DataFrame | None = None,
    parity: bool = False,
    first_id: int = 1,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    finish_rows: int = FINISH_ROWS,
) -> Posting:
    """Post all requests in the order (posted_at, kind, id).

    Ids must be unique per kind. At one moment procurements come before sales
    and sales before adjustments. By default the lines of a basket are added up
    per product and every quantity must be positive; ``parity=True`` tests each
    line alone, so two lines of one product may take its stock below zero, and
    lets any quantity pass. New movement and item rows are numbered from
    ``first_id``; the numbers of rejected lines stay unused.

    Every step is written and what it was made from is deleted, so the disk holds a step or
    two at a time: the lines, once each, and the shuffle of one step.
    """
    spark = inventory.sparkSession

    def given(df: DataFrame | None, schema: str) -> DataFrame:
        return df if df is not None else spark.createDataFrame([], schema)

    with sparing_disk(spark):
        # Read several times; what they are derived from may be far larger.
        inventory = written(inventory.select(*STOCK_KEY, "quantity_available", "updated_at"),
                            "stock")
        procurements, adjustments = (df if df is None else written(df, "requests")
                                     for df in (procurements, adjustments))
        headers, *parts = _requests(
            given(baskets, BASKETS), given(basket_lines, BASKET_LINES),
            given(procurements, PROCUREMENTS), given(procurement_lines, PROCUREMENT_LINES),
            given(adjustments, ADJUSTMENTS), products)
        parts = [written(part, "lines") for part in parts]
        lines = reduce(DataFrame.unionByName, parts)
        checked = written(_checked(headers, lines, parity), "checked")
        discard(procurements, adjustments)
        # From here on a line's number stands for its place in the order.
        placed = numbered(lines.drop("known"), ["branch_id", *LINE_ORDER], "number",
                          first_id - 1, without=["line_no"])
        discard(*parts)
        reason = F.col("reason")
        # Procurements alone are all accepted: there is nothing to decide.
        if placed.filter(F.col("kind") != PROCUREMENT).isEmpty():
            open_lines = placed.filter(F.lit(False))
        else:
            open_lines = placed.join(checked.filter(reason.isNull()).select(*EVENT),
                                     list(EVENT), "left_semi")
        verdicts = decide(open_lines, inventory, parity, rows_per_chunk, finish_rows)
        events = written(checked.join(verdicts, list(EVENT), "left"), "events")
        discard(checked, verdicts)
        judged = written(_judged(placed, events), "judged")
        discard(placed)
        halves = []
        for half in (0, 1):
            # Products do not depend on each other; so half of the lines are shuffled at a time.
            lines = judged.filter(F.pmod(F.xxhash64(*STOCK_KEY), F.lit(2)) == half)
            balanced = balances(lines, inventory, ["number"], rows_per_chunk, lines)
            halves.append(written(balanced, "posted"))
            discard(balanced)
        posted = reduce(DataFrame.unionByName, halves)
        discard(judged)
    outcome = _outcome(events, posted, parity)
    accepted = posted.filter(F.col("accepted"))
    passed = outcome.filter(F.col("reason").isNull())

    def of(kind: int, df: DataFrame) -> DataFrame:
        return df.filter(F.col("kind") == kind)

    sales = enforce_schema(with_generated(of(SALE, passed).select(
        F.col("event_id").alias("id"), "branch_id",
        F.col("actor").alias("sales_agent_id"),
        receipt_number("posted_at", "event_id").alias("receipt_number"),
        F.coalesce("total", F.lit(0)).cast(MONEY).alias("total_amount"),
        "amount_paid",
        F.lit("cash").alias("payment_method"), F.lit("completed").alias("status"),
        F.col("posted_at").alias("sale_date"),
    ), "sales"), "sales")
    sale_items = enforce_schema(with_generated(of(SALE, accepted).select(
        F.col("number").alias("id"), F.col("event_id").alias("sale_id"), "product_id",
        (-F.col("change")).cast("int").alias("quantity"), F.col("price").alias("unit_price"),
    ), "sale_items"), "sale_items")
    bought = of(PROCUREMENT, passed)
    proc_headers = enforce_schema(bought.select(
        F.col("event_id").alias("id"), "branch_id", "supplier_id",
        F.col("actor").alias("recorded_by"), "reference_number", "notes",
        F.col("total").cast(MONEY).alias("total_cost"),
        F.coalesce("procurement_date", F.col("posted_at").cast(DATE)).alias("procurement_date"),
        F.col("posted_at").alias("created_at"),
    ), "procurements")
    proc_items = enforce_schema(with_generated(of(PROCUREMENT, accepted).select(
        F.col("number").alias("id"), F.col("event_id").alias("procurement_id"), "product_id",
        F.col("change").cast("int").alias("quantity"), F.col("price").alias("unit_cost"),
    ), "procurement_items"), "procurement_items")
    adjusted = of(ADJUSTMENT, accepted)
    adjustment_rows = enforce_schema(adjusted.select(
        F.col("event_id").alias("id"), "branch_id", "product_id",
        F.col("actor").alias("adjusted_by"),
        F.col("change").cast("int").alias("adjustment_quantity"),
        F.col("note").alias("reason"), F.col("posted_at").alias("created_at"),
    ), "stock_adjustments")
    movements = enforce_schema(accepted.select(
        F.col("number").alias("id"), "branch_id", "product_id",
        kind_name().alias("movement_type"),
        F.col("change").cast("int").alias("quantity_change"),
        "quantity_before", "quantity_after",
        F.col("event_id").alias("reference_id"), F.col("note").alias("notes"),
        F.col("actor").alias("recorded_by"), F.col("posted_at").alias("created_at"),
    ), "inventory_movements")
    return Posting(
        sales, sale_items, proc_headers, proc_items, adjustment_rows, movements,
        new_inventory(inventory, accepted),
        outcome.filter(F.col("reason").isNotNull()).select(
            kind_name().alias("request"), "event_id", "branch_id", "posted_at", "reason"),
        _audit(sales, proc_headers, adjusted),
    )


def post_sales(baskets: DataFrame, lines: DataFrame, inventory: DataFrame,
               products: DataFrame, **options) -> Posting:
    """Post a batch of baskets; see :func:`post_events`."""
    return post_events(inventory, products, baskets=baskets, basket_lines=lines, **options)


def post_procurements(headers: DataFrame, lines: DataFrame, inventory: DataFrame,
                      products: DataFrame, **options) -> Posting:
    """Post a batch of procurements; see :func:`post_events`."""
    return post_events(inventory, products, procurements=headers, procurement_lines=lines,
                       **options)


def post_adjustments(adjustments: DataFrame, inventory: DataFrame, products: DataFrame,
                     **options) -> Posting:
    """Post a batch of stock adjustments; see :func:`post_events`."""
    return post_events(inventory, products, adjustments=adjustments, **options)


def procurement_branch(role: str, own_branch: int | None, chosen: int | None) -> int | None:
    """Directors name the branch of a procurement, everyone else uses their own."""
    return (None if is_blank(chosen) else chosen) if role == "director" else own_branch


def order_totals(lines: DataFrame, key: str, price: str) -> DataFrame:
    """Sum of quantity x price per order."""
    return lines.groupBy(key).agg(
        F.sum(F.col("quantity") * F.col(price)).cast(MONEY).alias("total"))


def kind_name() -> Column:
    kind = F.col("kind")
    return F.when(kind == PROCUREMENT, KINDS[PROCUREMENT]).when(
        kind == SALE, KINDS[SALE]).otherwise(KINDS[ADJUSTMENT])


def _requests(baskets, basket_lines, procurements, procurement_lines, adjustments, products
              ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All requests in one form: headers, and the lines of each kind, prices filled in."""
    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    def header(df: DataFrame, kind: int, key: str, actor: str, **more: Column) -> DataFrame:
        base = {"amount_paid": null("decimal(14,2)"), "supplier_id": null("long"),
                "reference_number": null("string"), "notes": null("string"),
                "procurement_date": null("date")}
        return df.select(
            "branch_id", "posted_at", F.lit(kind).alias("kind"),
            F.col(key).alias("event_id"), F.col(actor).alias("actor"),
            *[c.alias(n) for n, c in {**base, **more}.items()])

    def line(df: DataFrame, kind: int, key: str, quantity: Column, price: Column) -> DataFrame:
        # A row without line number stands for an empty payload.
        return df.filter(F.col("line_no").isNotNull()).select(
            F.lit(kind).alias("kind"), F.col(key).alias("event_id"), "line_no", "product_id",
            quantity.cast("long").alias("change"), price.alias("price"))

    known = products.select(F.col("id").alias("_product"),
                            F.col("selling_price").cast(PRICE).alias("_selling"))

    def priced(lines: DataFrame) -> DataFrame:
        return lines.join(known, F.col("product_id") == F.col("_product"), "left").withColumn(
            "price", F.when(F.col("kind") == SALE, F.col("_selling")).otherwise(F.col("price"))
        ).withColumn("known", F.col("_product").isNotNull()).drop("_product", "_selling")

    sale_heads = header(baskets, SALE, "basket_id", "sales_agent_id",
                        amount_paid=F.col("amount_paid"))
    buy_heads = header(
        procurements, PROCUREMENT, "procurement_id", "recorded_by",
        **{c: F.col(c) for c in
           ("supplier_id", "reference_number", "notes", "procurement_date")})
    adjust_heads = header(adjustments, ADJUSTMENT, "adjustment_id", "adjusted_by")
    adjust_lines = adjustments.select(
        "branch_id", "posted_at", F.lit(ADJUSTMENT).alias("kind"),
        F.col("adjustment_id").alias("event_id"), F.lit(1).alias("line_no"), "product_id",
        F.col("quantity").cast("long").alias("change"), null("decimal(12,2)").alias("price"),
        F.col("adjusted_by").alias("actor"), F.col("reason").alias("note"))

    def order_lines(lines: DataFrame, heads: DataFrame) -> DataFrame:
        # Products come first, while the lines are narrow.
        return priced(lines).join(heads.select(*EVENT, "actor"), ["kind", "event_id"]).select(
            *EVENT, "line_no", "product_id", "change", "price", "actor",
            null("string").alias("note"), "known")

    return (sale_heads.unionByName(buy_heads).unionByName(adjust_heads),
            order_lines(line(basket_lines, SALE, "basket_id", -F.col("quantity"),
                             null("decimal(12,2)")), sale_heads),
            order_lines(line(procurement_lines, PROCUREMENT, "procurement_id",
                             F.col("quantity"), F.col("unit_cost")), buy_heads),
            priced(adjust_lines))


def _checked(headers: DataFrame, lines: DataFrame, parity: bool) -> DataFrame:
    """Headers with total and the reason they fail whatever the stock is."""
    kind, change = F.col("kind"), F.col("change")
    missing = F.col("product_id").isNull() | change.isNull()
    bad_sale = missing if parity else missing | (change >= 0)
    bad_buy = missing | (change == 0) | F.col("price").isNull() | (F.col("price") == 0)
    bad_adjustment = missing | F.col("note").isNull()
    bad = F.when(kind == SALE, bad_sale).when(kind == PROCUREMENT, bad_buy).otherwise(
        bad_adjustment)
    amount = F.when(kind == SALE, -change).otherwise(change)
    per_event = lines.groupBy(*EVENT).agg(
        F.count("*").alias("line_count"), F.max(bad).alias("bad"),
        F.min("known").alias("all_known"),
        F.sum(amount.cast("decimal(18,0)") * F.col("price")).alias("total"))
    joined = headers.join(per_event, list(EVENT), "left")
    count = F.coalesce("line_count", F.lit(0))
    empty = (count == 0) & ((kind == PROCUREMENT) | F.lit(not parity))
    reason = (F.when(F.col("branch_id").isNull(), "no_branch")
              .when(empty, "no_lines")
              .when(F.col("bad"), "invalid_line")
              .when((kind == SALE) & F.col("amount_paid").isNull(), "no_payment")
              .when((kind != SALE) & ~F.col("all_known"), "unknown_product")
              .when((kind == SALE) & ~F.col("all_known"), "insufficient_stock")
              .when((kind == SALE) & (F.col("amount_paid") < F.coalesce("total", F.lit(0))),
                    "underpaid"))
    return joined.withColumn("reason", reason).drop("bad", "all_known")


def _judged(lines: DataFrame, events: DataFrame) -> DataFrame:
    """The lines of events that only the stock or the payment can fail, with ``accepted``.

    An underpaid basket is never accepted, but the stock it met is of interest (``unpaid``).
    """
    reason = F.col("reason")
    sound = events.filter(reason.isNull() | (reason == "underpaid")).groupBy(*EVENT).agg(
        F.max("accepted").alias("accepted"), F.max(reason.isNotNull()).alias("unpaid"))
    return lines.join(sound, list(EVENT)).withColumn(
        "accepted", F.coalesce("accepted", F.col("kind") == PROCUREMENT))


def _outcome(events: DataFrame, posted: DataFrame, parity: bool) -> DataFrame:
    """Final reason per event. Stock is tested before payment, so an underpaid
    basket that also met too little stock is turned down for the stock."""
    kind = F.col("kind")
    taken = F.max(-F.col("change")) if parity else F.sum(-F.col("change"))
    short = posted.filter("unpaid").groupBy(*EVENT, "product_id").agg(
        taken.alias("_taken"), F.min("quantity_before").alias("_met"),
        F.min("had_row").alias("_row"),
    ).filter((F.col("_met") < F.col("_taken")) | ~F.col("_row")).select(
        *EVENT, F.lit(True).alias("_short")).distinct()
    rows = events.join(short, list(EVENT), "left")
    by_stock = F.when(kind == SALE, "insufficient_stock").otherwise("below_zero")
    return rows.withColumn(
        "reason",
        F.when(F.col("_short"), "insufficient_stock")
         .when(F.col("reason").isNotNull(), F.col("reason"))
         .when((kind != PROCUREMENT) & (F.col("line_count") > 0)
               & ~F.coalesce("accepted", F.lit(False)), by_stock)
    ).drop("accepted", "_short")


def _audit(sales: DataFrame, procurements: DataFrame, adjusted: DataFrame) -> DataFrame:
    """The audit rows of a posting; numbering is left to the audit sink."""
    sold = sales.select(
        F.col("sales_agent_id").alias("user_id"), F.lit("SALE_PROCESSED").alias("action"),
        F.lit("Sales").alias("module"), F.col("id").alias("record_id"),
        F.to_json(F.struct(F.col("receipt_number").alias("receipt"),
                           F.col("total_amount").alias("total"))).alias("details"),
        F.col("sale_date").alias("created_at"))
    bought = procurements.select(
        F.col("recorded_by").alias("user_id"), F.lit("PROCUREMENT_RECORDED").alias("action"),
        F.lit("Procurement").alias("module"), F.col("id").alias("record_id"),
        F.to_json(F.struct(F.col("total_cost").alias("total"))).alias("details"),
        "created_at")
    changed = adjusted.select(
        F.col("actor").alias("user_id"), F.lit("STOCK_ADJUSTED").alias("action"),
        F.lit("Inventory").alias("module"), F.col("product_id").alias("record_id"),
        F.to_json(F.struct(F.col("change").alias("adjustment_quantity"),
                           F.col("note").alias("reason"),
                           F.col("quantity_before").alias("qtyBefore"),
                           F.col("quantity_after").alias("qtyAfter"))).alias("details"),
        F.col("posted_at").alias("created_at"))
    return sold.unionByName(bought).unionByName(changed).withColumn(
        "ip_address", F.lit(None).cast(TABLES["audit_logs"].columns["ip_address"]))
