"""Keyed state, merged segments and the id index give what the batch operators give."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelake.operators.admission import ADJUSTMENT, PROCUREMENT, SALE
from storelake.sources.driver_tables import load
from storelake.streaming import streams
from storelake.streaming.id_index import IdIndex, bloom_filter, may_hold
from storelake.streaming.keyed import KeyedStock
from storelake.streaming.segments import SegmentTable
from storelake.streaming.stock import STOCK, STOCK_LINES, StockStream

START = datetime(2024, 1, 1)
FOLDER = "/root/testdata/sf0.001"


def stock_lines(events=150, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(1, events + 1):
        kind = rng.choice([SALE, SALE, PROCUREMENT, ADJUSTMENT])
        branch = rng.choice([1, 1, 1, 2, None])
        at = START + timedelta(minutes=i // 2)
        products = rng.sample([1, 2, 3, 4], rng.randint(1, 3))
        if kind == SALE:
            parts = [(p, rng.choice([-1, -2, -3, -4, 0, None])) for p in products]
            parts += parts[:1] if rng.random() < 0.2 else []
        elif kind == PROCUREMENT:
            parts = [(p, rng.randint(0, 9)) for p in products[:2]] * rng.choice([1, 1, 2])
        else:
            parts = [(products[0], rng.randint(-4, 4))]
        if rng.random() < 0.05:
            parts.append((rng.choice([99, None]), -1))
        out += [(branch, at, rng.choice([kind] * 9 + [None]), i, n, p, c)
                for n, (p, c) in enumerate(parts, 1)]
    return out


def products_of(spark):
    return spark.createDataFrame([(1, "a", 3), (2, "b", 3), (3, "c", 5), (4, "d", 0)],
                                 "id long, product_name string, reorder_level int")


MOVE = ["branch_id", "posted_at", "kind", "event_id", "line_no", "product_id", "change",
        "quantity_before", "quantity_after", "had_row", "movement_type"]


def in_any_order(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("parity", [False, True])
def test_keyed_stock_over_batches_with_restarts(spark, tmp_path, parity):
    """Three batches, the query started anew for each: the rows of one batch posting."""
    lines = stock_lines()
    opening = spark.createDataFrame([(1, 1, 12, START), (2, 3, 5, START), (7, 1, 4, START)], STOCK)
    products = products_of(spark)
    inbox = str(tmp_path / "in")
    keyed = KeyedStock(str(tmp_path / "keyed"), opening, products, parity=parity)
    for part in range(3):
        rows = [x for x in lines if part == min((x[3] // 2) // 25, 2)]
        spark.createDataFrame(rows, STOCK_LINES).repartition(3).coalesce(1).write.mode(
            "append").parquet(inbox)
        flow = spark.readStream.schema(STOCK_LINES).parquet(inbox)
        keyed.start(flow).awaitTermination()
    posted = StockStream(str(tmp_path / "posted"), opening, products, parity=parity)
    posted.post(spark.createDataFrame(lines, STOCK_LINES), 0)
    assert keyed.judged().select("batch").distinct().count() == 3
    assert in_any_order(keyed.movements(), *MOVE) == in_any_order(posted.movements(), *MOVE)
    event = ["branch_id", "posted_at", "kind", "event_id"]
    assert in_any_order(keyed.rejections(), *event) == in_any_order(posted.rejections(), *event)
    alert = [c for c in posted.alerts().columns if c != "batch"]
    assert in_any_order(keyed.alerts(), *alert) == in_any_order(posted.alerts(), *alert)
    key = ["branch_id", "product_id", "quantity_available"]
    assert in_any_order(keyed.stock(), *key) == in_any_order(posted.stock_before(1), *key)
    assert in_any_order(keyed.state(), *key) == in_any_order(keyed.stock(), *key)


def test_lanes_split_a_branch(spark, tmp_path):
    """Adjustments and procurements of one line need no more than their product's stock."""
    rng = random.Random(2)
    lines = [(1, START + timedelta(minutes=i), rng.choice([PROCUREMENT, ADJUSTMENT]), i, 1,
              rng.randint(1, 4), rng.randint(1, 4) * rng.choice([1, 1, -1])) for i in range(80)]
    lines = [x if x[2] == ADJUSTMENT else (*x[:6], abs(x[6])) for x in lines]
    opening = spark.createDataFrame([(1, 1, 2, START)], STOCK)
    rows = spark.createDataFrame(lines, STOCK_LINES)
    rows.write.parquet(str(tmp_path / "in"))
    flow = spark.readStream.schema(STOCK_LINES).parquet(str(tmp_path / "in"))
    keyed = KeyedStock(str(tmp_path / "keyed"), opening, products_of(spark),
                       lane=F.col("product_id"))
    keyed.start(flow).awaitTermination()
    posted = StockStream(str(tmp_path / "posted"), opening, products_of(spark))
    posted.post(rows, 0)
    assert in_any_order(keyed.movements(), *MOVE) == in_any_order(posted.movements(), *MOVE)
    state = spark.read.format("statestore").option("path", str(tmp_path / "keyed/progress")).option(
        "stateVarName", "stock").load()
    assert state.select("key").distinct().count() == 4


def test_sessions_whose_older_half_comes_second(spark, tmp_path):
    audit = load(spark, FOLDER)["audit_logs"].select("id", "user_id", "created_at").unionByName(
        spark.createDataFrame([(-1, 7, None), (-2, 7, None), (-3, None, START)],
                              "id long, user_id long, created_at timestamp_ntz"))
    middle = audit.selectExpr("percentile_approx(created_at, 0.5)").first()[0]
    late = F.coalesce(F.col("created_at") <= F.lit(middle), F.lit(False))
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (audit.filter(~late), audit.filter(late & (F.col("id") % 3 != 0)),
                 audit.filter(late & (F.col("id") % 3 == 0))):
        part.write.mode("append").parquet(inbox)
        flow = spark.readStream.schema(audit.schema).parquet(inbox)
        streams.start_user_sessions(flow, out).awaitTermination()
    got, want = streams.read_user_sessions(spark, out), streams.user_sessions(audit)
    assert in_any_order(got, *want.columns) == in_any_order(want, *want.columns)


def test_late_events_join_sessions(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id long, created_at timestamp_ntz"
    for minutes in ([0, 100, 220], [50, 400], [160, 161]):
        spark.createDataFrame([(1, START + timedelta(minutes=m)) for m in minutes], schema
                              ).write.mode("append").parquet(inbox)
        flow = spark.readStream.schema(schema).parquet(inbox)
        streams.start_user_sessions(flow, out).awaitTermination()
    got = streams.read_user_sessions(spark, out).orderBy("session_start").collect()
    assert [(r.session_start, r.session_end, r.events) for r in got] == [
        (START + timedelta(minutes=a), START + timedelta(minutes=b), n)
        for a, b, n in ((0, 220, 6), (400, 400, 1))]


# --- segments and ids -----------------------------------------------------------


def test_segments_stay_few_and_versions_whole(spark, tmp_path):
    schema = "k long, v long"
    table = SegmentTable(spark, str(tmp_path / "t"), schema,
                         lambda rows: rows.groupBy("k").agg(F.max("v").alias("v")), fan=3)
    want = {}
    for batch in range(14):
        rows = [(k, batch) for k in range(batch % 4, 12, 4)]
        want |= dict(rows)
        for _ in range(1 + (batch % 7 == 0)):  # some batches are run again
            table.add(spark.createDataFrame(rows, schema).coalesce(1), batch)
        live = table.live()
        assert [s.first for s in live][0] == 0 and live[-1].last == batch
        assert all(a.last + 1 == b.first for a, b in zip(live, live[1:]))
        assert len(live) <= 2 * 3
    got = table.read().groupBy("k").agg(F.max("v").alias("v")).collect()
    assert {r.k: r.v for r in got} == want
    # A batch that did not get as far as its version is not seen.
    table._write(spark.createDataFrame([(1, 999)], schema), type(live[0])(0, 14, 14))
    assert table.read().filter("v = 999").count() == 0
    assert SegmentTable(spark, str(tmp_path / "none"), schema, lambda r: r).read().count() == 0


def test_daily_totals_open_few_files(spark, tmp_path):
    sales = load(spark, FOLDER)["sales"]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    sales.repartition(10).write.parquet(inbox)
    flow = spark.readStream.schema(sales.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    streams.start_daily_sales(flow, out).awaitTermination()
    table = streams._daily_totals(spark, out)
    assert table.live()[-1].last == 9 and len(table.live()) == 3
    got = streams.read_daily_totals(spark, out)
    want = sales.filter("status = 'completed'").groupBy(
        "branch_id", F.to_date("sale_date").alias("sale_day")).agg(F.count("*").alias("count"))
    cols = ["branch_id", "sale_day", "count"]
    assert in_any_order(got, *cols) == in_any_order(want, *cols)


def test_bloom_filters_never_miss():
    rng = np.random.default_rng(1)
    held = rng.integers(-2 ** 62, 2 ** 62, 3000)
    made = bloom_filter(held)
    assert may_hold(made, held).all()
    assert may_hold(made, rng.integers(-2 ** 62, 2 ** 62, 20_000)).mean() < 0.01
    assert not may_hold(bloom_filter(held[:0]), held[:5]).any()


def test_audit_batches_read_only_buckets_that_hit(spark, tmp_path):
    """Twenty batches: no bucket is read without a repeat, few with one; null ids all stay."""
    schema = "id long, created_at timestamp_ntz, details string"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = []
    for batch in range(20):
        rows = [(100 * batch + i, START + timedelta(hours=batch), "x") for i in range(4)]
        want += rows
        rows += [(None, START, "n")] * 2
        want += [(None, START, "n")] * 2
        if batch % 5 == 4:  # an id of an earlier batch, of another day
            rows.append((100 * (batch - 3) + 1, START + timedelta(days=batch), "again"))
        if batch == 7:  # two events of one id
            rows.append((702, START, "earlier"))
            want[want.index((702, START + timedelta(hours=7), "x"))] = (702, START, "earlier")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    flow = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    read = []
    known = IdIndex.known
    try:
        def noted(self, ids, batch):
            out_ = known(self, ids, batch)
            read.append((batch, self.read_buckets))
            return out_

        IdIndex.known = noted
        streams.start_audit_ingest(flow, out, buckets=8).awaitTermination()
    finally:
        IdIndex.known = known
    got = streams.read_audit_trail(spark, out).select("id", "created_at", "details").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert [b for b, _ in read] == list(range(20))
    repeats = [len(found) for b, found in read if b % 5 == 4]
    others = [len(found) for b, found in read if b % 5 != 4]
    assert all(1 <= n <= 3 for n in repeats) and sum(others) <= 3


def test_a_block_of_products_is_one_value_of_the_state(spark, tmp_path):
    """2,000 products of a branch: as many values as blocks, whose quantities stay right."""
    lines = [(1, START + timedelta(minutes=i), PROCUREMENT, i, 1, i % 2000 - 500, 1 + i % 3)
             for i in range(4000)]
    opening = spark.createDataFrame([(1, -7, 12, START), (1, 9_000_000_000, 5, START)], STOCK)
    products = spark.range(-500, 1500).selectExpr("id", "'x' as product_name",
                                                  "3 as reorder_level")
    spark.createDataFrame(lines, STOCK_LINES).write.parquet(str(tmp_path / "in"))
    keyed = KeyedStock(str(tmp_path / "keyed"), opening, products)
    keyed.start(spark.readStream.schema(STOCK_LINES).parquet(str(tmp_path / "in"))
                ).awaitTermination()
    values = spark.read.format("statestore").option(
        "path", str(tmp_path / "keyed/progress")).option("stateVarName", "stock").load()
    assert values.count() == 9
    key = ["branch_id", "product_id", "quantity_available"]
    assert in_any_order(keyed.state(), *key) == in_any_order(keyed.stock(), *key)


def test_neighbouring_users_share_a_group(spark, tmp_path):
    """500 users: a group of the state for 64 of them, and sessions of their own."""
    rows = [(u, START + timedelta(minutes=50 * (u % 3) * n)) for u in range(-100, 400)
            for n in range(3)]
    events = spark.createDataFrame(rows, "user_id long, created_at timestamp_ntz")
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (events.filter("user_id % 2 = 0"), events.filter("user_id % 2 <> 0")):
        part.write.mode("append").parquet(inbox)
        flow = spark.readStream.schema(events.schema).parquet(inbox)
        streams.start_user_sessions(flow, out).awaitTermination()
    got, want = streams.read_user_sessions(spark, out), streams.user_sessions(events)
    assert in_any_order(got, *want.columns) == in_any_order(want, *want.columns)
    state = spark.read.format("statestore").option("path", f"{out}/progress").option(
        "stateVarName", "sessions").load()
    assert state.select("key").distinct().count() == 9 and state.count() == 500
