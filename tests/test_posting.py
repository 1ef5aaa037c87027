"""Posting against the serial rules, and its edge cases."""

import os
import random
import time
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from storelake.operators import posting as p
from storelake.session import discard, shared_folder, sparing_disk, written
from storelake.sources.driver_tables import load
from storelake.sources.tables import parse_order_lines
from tests.serial import post

START = datetime(2024, 1, 1)
PRICES = {1: Decimal("2.50"), 2: Decimal("4.00"), 3: Decimal("0.99"), 4: Decimal("10.00")}


def frames(spark, requests, stock, prices=PRICES):
    baskets, basket_lines, procs, proc_lines, adjustments = [], [], [], [], []
    for r in requests:
        at = START + timedelta(minutes=r["at"])
        if r["kind"] == "sale":
            baskets.append((r["id"], r["branch"], 7, at, r["paid"]))
            basket_lines += [(r["id"], i, *x) for i, x in enumerate(r["lines"], 1)]
        elif r["kind"] == "procurement":
            procs.append((r["id"], r["branch"], None, 8, None, None, None, at))
            proc_lines += [(r["id"], i, a, b, Decimal("1.00"))
                           for i, (a, b) in enumerate(r["lines"], 1)]
        else:
            (product, quantity), = r["lines"]
            adjustments.append((r["id"], r["branch"], product, 9, quantity, "count", at))
    df = spark.createDataFrame
    return dict(
        inventory=df([(b, q, n, None) for (b, q), n in stock.items()],
                     "branch_id long, product_id long, quantity_available int, "
                     "updated_at timestamp_ntz"),
        products=df(list(prices.items()), "id long, selling_price decimal(12,2)"),
        baskets=df(baskets, p.BASKETS), basket_lines=df(basket_lines, p.BASKET_LINES),
        procurements=df(procs, p.PROCUREMENTS),
        procurement_lines=df(proc_lines, p.PROCUREMENT_LINES),
        adjustments=df(adjustments, p.ADJUSTMENTS))


def check(spark, requests, stock, **options):
    parity = options.get("parity", False)
    accepted, reasons, moves, final = post(requests, stock, PRICES, parity)
    out = p.post_events(**frames(spark, requests, stock), **options)
    got = {(r.request, r.event_id): r.reason for r in out.rejections.collect()}
    assert got == reasons
    shown = out.movements.orderBy("created_at", "id").collect()
    assert sorted((m.movement_type, m.reference_id, m.branch_id, m.product_id,
                   m.quantity_change, m.quantity_before, m.quantity_after)
                  for m in shown) == sorted(moves)
    assert {(r.branch_id, r.product_id): r.quantity_available
            for r in out.inventory.collect()} == final
    assert sorted(r.id for r in out.sales.collect()) == sorted(
        i for k, i in accepted if k == "sale")
    return out


def random_requests(seed, count=60, quantities=(1, 6), branches=2):
    rng = random.Random(seed)
    requests = []
    for i in range(1, count + 1):
        kind = rng.choices(["sale", "procurement", "adjustment"], [7, 1, 2])[0]
        size = 1 if kind == "adjustment" else rng.randint(1, 4)
        lines = [(rng.randint(1, 4), rng.randint(*quantities)) for _ in range(size)]
        if kind == "adjustment":
            lines = [(lines[0][0], rng.randint(-6, 6))]
        total = sum((PRICES[a] * b for a, b in lines), Decimal(0))
        requests.append(dict(kind=kind, id=i, branch=rng.randint(1, branches),
                             at=rng.randint(0, count // 2), lines=lines,
                             paid=total + Decimal(rng.choice([-1, 0, 0, 0, 5]))))
    stock = {(b, q): rng.randint(0, 25) for b in range(1, branches + 1)
             for q in range(1, 5) if rng.random() < 0.8}
    return requests, stock


@pytest.mark.parametrize("finish_rows", [0, 200_000])
@pytest.mark.parametrize("parity", [False, True])
def test_matches_serial_posting(spark, parity, finish_rows):
    requests, stock = random_requests(1, count=40)
    check(spark, requests, stock, parity=parity, finish_rows=finish_rows)


def test_hot_groups_are_read_in_chunks(spark):
    requests, stock = random_requests(2, count=30, branches=1)
    check(spark, requests, stock, rows_per_chunk=10, finish_rows=20)


def test_parity_takes_negative_quantities(spark):
    requests, stock = random_requests(3, count=30, quantities=(-2, 5))
    check(spark, requests, stock, parity=True, finish_rows=5)


@settings(max_examples=2, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(10, 10_000))
def test_strict_posting_never_oversells(spark, seed):
    requests, stock = random_requests(seed, count=25)
    out = check(spark, requests, stock, finish_rows=seed % 2 * 10)
    assert out.inventory.filter("quantity_available < 0").count() == 0


def sale(i, at, lines, paid="1000"):
    return dict(kind="sale", id=i, branch=1, at=at, lines=lines, paid=Decimal(paid))


def test_duplicate_lines(spark):
    basket = [sale(1, 0, [(1, 3), (1, 3)])]
    check(spark, basket, {(1, 1): 5})
    out = check(spark, basket, {(1, 1): 5}, parity=True)
    assert out.inventory.first().quantity_available == -1


def test_baskets_in_time_order(spark):
    out = check(spark, [sale(1, 0, [(1, 4)]), sale(2, 1, [(1, 3)]), sale(3, 2, [(1, 1)])],
                {(1, 1): 5})
    assert sorted(r.id for r in out.sales.collect()) == [1, 3]
    assert out.inventory.first().quantity_available == 0


def test_underpaid_and_empty(spark):
    out = check(spark, [sale(1, 0, [(4, 1)], "9.99"), sale(2, 1, []),
                        sale(3, 2, [(4, 9)], "1")], {(1, 4): 5})
    assert {r.reason for r in out.rejections.collect()} == {
        "underpaid", "no_lines", "insufficient_stock"}
    assert out.movements.count() == 0


def test_empty_basket_passes_under_parity(spark):
    check(spark, [sale(2, 1, [])], {(1, 4): 5}, parity=True)


def test_adjustments(spark):
    def adjust(i, product, quantity):
        return dict(kind="adjustment", id=i, branch=1, at=i, lines=[(product, quantity)])

    out = check(spark, [adjust(1, 1, -3), adjust(2, 2, 4)], {(1, 1): 2})
    move = out.movements.first()
    assert (move.product_id, move.quantity_before, move.quantity_after) == (2, 0, 4)
    assert move.notes == "count"
    audit = out.audit.first()
    assert audit.action == "STOCK_ADJUSTED" and audit.record_id == 2


def test_totals_and_change(spark):
    out = check(spark, [sale(1, 0, [(1, 2), (3, 1)], "10.00")], {(1, 1): 5, (1, 3): 1})
    row = out.sales.first()
    assert (row.total_amount, row.change_given) == (Decimal("5.99"), Decimal("4.01"))
    assert row.receipt_number == f"RCP-{int(START.timestamp() * 1000)}-1"
    assert {r.subtotal for r in out.sale_items.collect()} == {Decimal("5.00"), Decimal("0.99")}


def test_malformed_requests_are_turned_down(spark):
    df = frames(spark, [sale(1, 0, [(1, 1)])], {(1, 1): 5})
    df["baskets"] = spark.createDataFrame(
        [(1, None, 7, START, Decimal(9)), (2, 1, 7, START, None), (3, 1, 7, START, Decimal(9)),
         (4, 1, 7, START, Decimal(9))], p.BASKETS)
    df["basket_lines"] = spark.createDataFrame(
        [(1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, None), (4, 1, 99, 1)], p.BASKET_LINES)
    out = p.post_events(**df)
    assert {r.event_id: r.reason for r in out.rejections.collect()} == {
        1: "no_branch", 2: "no_payment", 3: "invalid_line", 4: "insufficient_stock"}


def test_procurement_branch():
    assert p.procurement_branch("director", None, 4) == 4
    assert p.procurement_branch("director", 3, "") is None
    assert p.procurement_branch("manager", 3, 4) == 3


def test_long_chains_are_judged_in_bounded_turns(spark):
    # One branch, two products: nearly every basket hangs on the one before it.
    requests, stock = random_requests(7, count=50, branches=1)
    check(spark, requests, stock, finish_rows=8, rows_per_chunk=20)


@pytest.mark.parametrize("finish_rows", [200_000, 300])
def test_given_orders_from_an_empty_store(spark, finish_rows):
    d = load(spark, "/root/testdata/sf0.001")
    baskets, basket_lines = entry.baskets_of(d)
    procurements, procurement_lines = entry.procurements_of(d)
    adjustments = entry.adjustments_of(d)
    requests = {}
    for r in baskets.collect():
        requests["sale", r.basket_id] = dict(
            kind="sale", id=r.basket_id, branch=r.branch_id, at=r.posted_at, lines=[],
            paid=r.amount_paid)
    for r in procurements.collect():
        requests["procurement", r.procurement_id] = dict(
            kind="procurement", id=r.procurement_id, branch=r.branch_id, at=r.posted_at,
            lines=[])
    for r in basket_lines.orderBy("line_no").collect():
        requests["sale", r.basket_id]["lines"].append((r.product_id, r.quantity))
    for r in procurement_lines.orderBy("line_no").collect():
        requests["procurement", r.procurement_id]["lines"].append((r.product_id, r.quantity))
    for r in adjustments.collect():
        requests["adjustment", r.adjustment_id] = dict(
            kind="adjustment", id=r.adjustment_id, branch=r.branch_id, at=r.posted_at,
            lines=[(r.product_id, r.quantity)])
    prices = {r.id: r.selling_price for r in d["products"].collect()}
    _, reasons, moves, final = post(requests.values(), {}, prices)
    out = p.post_events(d["branch_inventory"].filter("false"), d["products"], baskets,
                        basket_lines, procurements, procurement_lines, adjustments,
                        finish_rows=finish_rows)
    assert {(r.request, r.event_id): r.reason for r in out.rejections.collect()} == reasons
    assert sorted((m.movement_type, m.reference_id, m.branch_id, m.product_id,
                   m.quantity_change, m.quantity_before, m.quantity_after)
                  for m in out.movements.collect()) == sorted(moves)
    assert {(r.branch_id, r.product_id): r.quantity_available
            for r in out.inventory.collect()} == final


def test_payloads_are_posted(spark):
    df = frames(spark, [], {(1, 1): 5})
    df["baskets"] = spark.createDataFrame(
        [(i, 1, 7, START, Decimal(9)) for i in (1, 2, 3, 4)], p.BASKETS)
    payloads = spark.createDataFrame([
        (1, '[{"product_id": 1, "quantity": 2}]'), (2, "[]"), (3, "[{"),
        (4, '[{"product_id": 1, "quantity": "two"}]')], "basket_id long, items string")
    df["basket_lines"] = parse_order_lines(payloads, "items", "sale")
    out = p.post_events(**df)
    assert [(r.sale_id, r.quantity) for r in out.sale_items.collect()] == [(1, 2)]
    assert {r.event_id: r.reason for r in out.rejections.collect()} == {
        2: "no_lines", 3: "invalid_line", 4: "invalid_line"}
    assert out.inventory.first().quantity_available == 3


def test_undecided_events_of_a_branch_spread_over_groups(spark):
    """One branch, chains of products that do not touch: a group for each chain."""
    import storelake.operators.admission as admission

    rng = random.Random(9)
    lines = []
    for event in range(400):
        chain = rng.randrange(40)
        for n, product in enumerate(rng.sample([3 * chain, 3 * chain + 1, 3 * chain + 2], 2)):
            lines.append((1, START + timedelta(minutes=event), admission.SALE, event, n, product,
                          "x", 1, -1, 0, 0, 9, True, True))
    waiting = spark.createDataFrame([(*x[:6], *x[7:]) for x in lines],
                                    "branch_id long, posted_at timestamp_ntz, kind int, event_id "
                                    "long, line_no int, product_id long, need long, change long, "
                                    "base long, lowest long, highest long, wants_row boolean, "
                                    "row_now boolean")
    groups = admission._with_component(waiting).groupBy("component").agg(
        F.collect_set((F.col("product_id") / 3).cast("int")).alias("chains"),
        F.max("lines").alias("lines"), F.count("*").alias("n")).collect()
    assert len(groups) == 40 and all(len(g.chains) == 1 and g.lines == g.n for g in groups)


def test_components_of_long_chains(spark):
    from storelake.operators.graph import components

    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 600) if i % 200 != 199]
    links += [(1000 + rng.randint(0, 30), 1000 + rng.randint(0, 30)) for _ in range(20)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    want = {}
    for a, b in links * 50:
        low = min(want.get(a, a), want.get(b, b))
        want[a] = want[b] = low
    while True:
        again = {k: want[v] for k, v in want.items()}
        for a, b in links:
            again[a] = again[b] = min(again[a], again[b])
        if again == want:
            break
        want = again
    for last_links in (2_000_000, 10):
        got = {r.node: r.root for r in components(df, last_links).collect()}
        assert got == {k: v for k, v in want.items() if k != v}


def test_components_share_the_calls_of_a_task(spark):
    """Many small components: one sorted stream for each task, events cut between batches."""
    import storelake.operators.admission as admission

    rng = random.Random(5)
    lines = []
    for event in range(3000):
        chain = rng.randrange(300)
        for product in rng.sample([3 * chain, 3 * chain + 1, 3 * chain + 2], 2):
            lines.append((chain, 1, START + timedelta(minutes=event), admission.SALE, event,
                          product, -1, 1, 5, True, True, False))
    rows = spark.createDataFrame(lines, "component long, branch_id long, posted_at timestamp_ntz, "
                                 "kind int, event_id long, product_id long, change long, "
                                 "need long, base long, wants_row boolean, row_now boolean, "
                                 "makes_row boolean")
    left, want = {}, {}
    for event in range(3000):
        own = [x[5] for x in lines[2 * event:2 * event + 2]]
        want[event] = all(left.get(p, 5) >= 1 for p in own)
        for p in own if want[event] else ():
            left[p] = left.get(p, 5) - 1
    for batch in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            judged = admission._in_turn(rows)
            got = {r.event_id: r.verdict == admission.ACCEPTED for r in judged.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want
    text = judged._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in text and "MapInArrow" in text


def kept_tables(spark):
    place = f"{shared_folder(spark).removeprefix('file:')}/storelake"
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {b for b in blocks.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}


def none_left(spark, before):
    """Whether all shuffle files made since are gone; they are removed in the background."""
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.2)
    return False


@pytest.mark.parametrize("options", [{}, {"finish_rows": 8, "rows_per_chunk": 20}])
def test_a_posting_leaves_only_what_its_outputs_read(spark, options):
    requests, stock = random_requests(7, count=50, branches=1)
    df = frames(spark, requests, stock)
    tables, shuffles = kept_tables(spark), shuffle_files(spark)
    out = p.post_events(**df, **options)
    left = [name.rsplit("-", 1)[0] for name in kept_tables(spark) - tables]
    assert sorted(left) == ["events", "posted", "posted", "stock"]
    assert none_left(spark, shuffles)
    assert out.rejections.count() + out.sales.count() + out.procurements.count() \
        + out.stock_adjustments.count() == 50


def test_tables_and_shuffles_are_given_back(spark):
    rows = spark.range(1000).selectExpr("id % 7 as k", "id")
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    tables, shuffles = kept_tables(spark), shuffle_files(spark)
    with sparing_disk(spark):
        table = written(rows.repartition("k"))
        assert table.groupBy("k").count().count() == 7
    assert none_left(spark, shuffles)
    assert spark.conf.get("spark.sql.parquet.compression.codec") == codec
    assert len(kept_tables(spark) - tables) == 1
    discard(table, rows, None)
    assert kept_tables(spark) == tables
