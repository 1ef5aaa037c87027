"""Chunked reading gives what one window per key gives."""

import random

import pytest
from pyspark.sql import functions as F

from storelake.operators.ledger import ledger_consistency, running_balance
from storelake.operators.ordered import (
    dense_numbers, in_order, numbered, previous_values, row_numbers,
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    # Key 1 holds two thirds of the rows, many of them at one moment.
    data = [(1 if rng.random() < 0.67 else rng.randint(2, 6),
             0 if rng.random() < 0.5 else rng.randint(0, 9), i, rng.randint(-5, 5))
            for i in range(600)]
    return spark.createDataFrame(data, "k long, t int, i int, v int").repartition(5)


@pytest.mark.parametrize("limit", [None, 25, 10_000])
def test_row_numbers_and_previous(rows, limit):
    data = sorted((r.k, r.t, r.i, r.v) for r in rows.collect())
    place, last, want = {}, {}, []
    for k, t, i, v in data:
        place[k] = place.get(k, 0) + 1
        want.append((k, i, place[k], last.get(k)))
        last[k] = v
    o = in_order(rows, ["k"], ["t", "i"], limit)
    assert o.chunked == (limit == 25)
    got = row_numbers(o, "n").select("k", "i", "n").join(
        previous_values(o, {"p": "v"}).select("k", "i", "p"), ["k", "i"])
    assert sorted((r.k, r.i, r.n, r.p) for r in got.collect()) == sorted(want)
    final = previous_values(o, {"p": "v"}, last="z").filter("z").select("k", "i", "p")
    ends = {k: (k, i, p) for k, i, _, p in want}
    assert sorted(map(tuple, final.collect())) == sorted(ends.values())


def test_probe_with_fewer_keys_is_an_upper_bound(rows):
    probe = rows.select("k")
    assert in_order(rows, ["k", "t"], ["i"], 300).chunked is False
    assert in_order(rows, ["k", "t"], ["i"], 300, probe).chunked is True


@pytest.mark.parametrize("small", [True, False])
def test_numbers_over_all_rows(rows, small):
    got = numbered(rows, ["t", "i"], "n", start=10, small=small).orderBy("n").collect()
    assert [r.n for r in got] == list(range(11, 611))
    assert [(r.t, r.i) for r in got] == sorted((r.t, r.i) for r in got)


def test_dense_numbers_of_keys_with_nulls(spark):
    data = [(k, i % 7, i) for i in range(300) for k in (None, "a", "b")[:1 + i % 3]]
    rows = spark.createDataFrame(data, "k string, t int, i int").repartition(4)
    got, counts = dense_numbers(rows, ["k"], ["t", "i"], "n")
    want = {}
    for k, t, i in data:
        want.setdefault(k, []).append((t, i))
    assert {(r.k, r.n): (r.t, r.i) for r in got.collect()} == {
        (k, n): at for k, places in want.items() for n, at in enumerate(sorted(places), 1)}
    assert {r.k: r.n for r in counts.collect()} == {k: len(p) for k, p in want.items()}


def test_numbering_has_no_task_for_all_rows(rows):
    plan = numbered(rows, ["t", "i"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert dense_numbers(rows.limit(0), [], ["i"], "n")[0].count() == 0


@pytest.mark.parametrize("limit", [30, 10_000])
def test_ledger_identity(rows, limit):
    ledger = rows.select(
        F.lit(1).cast("long").alias("branch_id"), F.col("k").alias("product_id"),
        F.timestamp_seconds("t").cast("timestamp_ntz").alias("created_at"),
        F.col("i").alias("id"), F.col("v").alias("quantity_change"))
    moves = running_balance(ledger, limit).cache()
    totals = {r.product_id: r.q for r in
              moves.groupBy("product_id").agg(F.sum("quantity_change").alias("q")).collect()}
    stock = moves.select("branch_id", "product_id").distinct().join(
        moves.groupBy("product_id").agg(F.sum("quantity_change").alias("quantity_available")),
        "product_id")
    assert totals
    assert ledger_consistency(moves, stock, limit).count() == 0
    broken = moves.withColumn("quantity_after", F.col("quantity_after") + F.when(
        F.col("id") == 17, 1).otherwise(0))
    rules = {r.rule for r in ledger_consistency(broken, stock, limit).collect()}
    assert "sum" in rules and rules <= {"sum", "gap", "snapshot"}


def test_numbering_shuffles_rows_once(spark):
    rows = spark.range(50).selectExpr("id % 3 as k", "id as i")
    for keys in ([], ["k"]):
        plan = dense_numbers(rows, keys, ["i"], "n")[0]._jdf.queryExecution().optimizedPlan()
        assert "row_number" not in plan.toString()


def test_numbered_rows_do_not_move_to_meet_the_ranges(rows):
    plan = numbered(rows, ["t", "i"], "n", without=["t"])
    assert "t" not in plan.columns and plan.agg(F.max("n")).first()[0] == 600
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
