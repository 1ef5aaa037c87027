"""Inserts, updates and deletes of the small tables."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from storelake.operators import dims
from storelake.sources.tables import default_branches, default_settings
from tests.hand import NOW, company, table

AS_OF = "2024-06-01 12:00:00"
MOMENT = datetime(2024, 6, 1, 12)


@pytest.fixture(scope="module")
def d(spark):
    return company(spark)


def submissions(spark, *rows):
    return spark.createDataFrame(
        [(1, 3, date(2024, 3, 1), 2, Decimal(e), None if s is None else Decimal(s), n,
          NOW + timedelta(hours=i)) for i, (e, s, n) in enumerate(rows)],
        "branch_id long, sales_agent_id long, balance_date date, manager_id long, "
        "expected_cash decimal(14,2), submitted_cash decimal(14,2), notes string, "
        "posted_at timestamp_ntz")


def test_balance_handed_in_again(spark, d):
    out = dims.upsert_cashier_balance(d["cashier_balances"],
                                      submissions(spark, (120, 120, "recount")))
    row = out.first()
    assert (row.expected_cash, row.submitted_cash, row.variance, row.status, row.notes) == (
        100, 120, 20, "approved", "recount")
    again = dims.upsert_cashier_balance(out, submissions(spark, (120, 120, "recount")))
    assert again.collect() == out.collect()


def test_first_balance_of_a_day(spark, d):
    empty = table(spark, "cashier_balances", [])
    out = dims.upsert_cashier_balance(
        empty, submissions(spark, (100, 90, "a"), (130, 130, "b"), (131, None, "c")))
    row = out.first()
    assert (out.count(), row.id, row.expected_cash, row.status, row.notes) == (
        1, 1, 100, "flagged", "c")
    assert row.created_at == NOW and row.approved_at == NOW + timedelta(hours=2)


def test_update_by_key(spark, d):
    changes = spark.createDataFrame(
        [(2, "Maxim", "", 1), (2, "Maximilian", "new@x", 2), (99, "Nobody", "n@x", 1)],
        "id long, full_name string, email string, turn int")
    out = dims.upsert_dim(d["users"], changes, ["full_name", "email"], as_of=AS_OF,
                          keep_if_blank=["email"], order=["turn"])
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 5
    assert (rows[2].full_name, rows[2].email, rows[2].updated_at) == (
        "Maximilian", "new@x", MOMENT)
    assert rows[3].updated_at is None
    first = dims.upsert_dim(d["users"], changes.filter("turn = 1"), ["full_name", "email"],
                            as_of=AS_OF, keep_if_blank=["email"])
    kept = first.filter("id = 2").first()
    assert (kept.full_name, kept.email) == ("Maxim", "m@x")


def test_users_are_unique_by_name_and_mail(spark, d):
    new = spark.createDataFrame(
        [(1, " MAX ", "q1@x"), (2, "eve", "e@x"), (3, "Eve", "e2@x"), (4, "fay", "e@x"),
         # Refused for the name of 2, so its mail stays free for 6.
         (5, "eve", "f@x"), (6, "gil", "f@x"), (7, "hal", "a@x")],
        "turn int, username string, email string").selectExpr(
        "*", "username as full_name", "'sales_agent' as role")
    added, refused = dims.insert_users(d["users"], new, ["turn"], AS_OF)
    rows = added.orderBy("id").collect()
    assert [(r.id, r.username, r.email, r.status) for r in rows] == [
        (6, "eve", "e@x", "active"), (7, "gil", "f@x", "active")]
    assert {r.turn for r in refused.collect()} == {1, 3, 4, 5, 7}


def test_product_defaults(spark, d):
    new = spark.createDataFrame([(1, "Nail", 0, ""), (1, "Nail", None, "kg")],
                                "category_id long, product_name string, reorder_level int, "
                                "unit string")
    added, refused = dims.insert_products(d["products"], new, ["unit"], AS_OF)
    rows = added.orderBy("id").collect()
    # Product names need not be unique.
    assert [(r.id, r.reorder_level, r.unit, r.cost_price, r.status) for r in rows] == [
        (6, 10, "piece", 0, "active"), (7, 10, "kg", 0, "active")]
    assert refused.count() == 0


def test_barcodes(spark, d):
    new = spark.createDataFrame([(1, 1, " B9 "), (1, 2, "B9"), (2, 3, "B1 ")],
                                "product_id long, turn int, barcode_value string")
    added, refused = dims.add_barcodes(d["barcodes"], new, ["turn"], AS_OF)
    assert [(r.id, r.barcode_value) for r in added.collect()] == [(4, "B9")]
    assert sorted(r.barcode_value for r in refused.collect()) == ["B1", "B9"]
    left, gone = dims.delete_barcodes(d["barcodes"], spark.createDataFrame(
        [(3,), (77,)], "id long"))
    assert left.count() == 2 and [tuple(r) for r in gone.collect()] == [(3, 3)]


def test_toggle_settings_bugs(spark, d):
    ids = spark.createDataFrame([(1,), (1,)], "id long")
    rows = {r.id: r.status for r in dims.toggle_status(d["categories"], ids).collect()}
    assert rows == {1: "inactive", 2: "inactive"}
    back = dims.toggle_status(dims.toggle_status(d["categories"], ids), ids)
    assert {r.id: r.status for r in back.collect()} == {1: "active", 2: "inactive"}
    changes = spark.createDataFrame(
        [({"company_name": "New", "no_such_key": "x"}, NOW)],
        "changes map<string,string>, posted_at timestamp_ntz")
    settings = dims.apply_settings(d["system_settings"], changes, 1, AS_OF)
    found = {r.setting_key: r for r in settings.collect()}
    assert len(found) == 6 and found["company_name"].setting_value == "New"
    assert found["company_name"].updated_by == 1
    assert found["company_phone"].updated_at is None
    bugs = dims.set_bug_status(d["bug_reports"], spark.createDataFrame(
        [(1, "resolved")], "id long, status string"), AS_OF)
    assert bugs.first().status == "resolved" and bugs.first().updated_at == MOMENT
    report = dims.submit_bug_reports(d["bug_reports"], spark.createDataFrame(
        [("Broken", 3)], "description string, reported_by long"), ["description"], AS_OF)
    assert (report.first().id, report.first().severity, report.first().status) == (
        2, "medium", "open")


def test_seed_rows_are_added_once(spark):
    seed = default_branches(spark)
    once = dims.insert_missing(seed, seed, ["branch_name"])
    assert once.count() == 1
    none = table(spark, "branches", [])
    assert dims.insert_missing(none, seed.union(seed), ["branch_name"]).count() == 1
    assert default_settings(spark).count() == 6


def test_deletes(spark, d):
    gone = spark.createDataFrame([(1,)], "id long")
    changed = dims.delete_rows(d, "branches", gone)
    assert changed["branches"].count() == 1
    assert {r.branch_id for r in changed["users"].collect()} == {None}
    assert {r.branch_id for r in changed["branch_inventory"].collect()} == {2}
    changed = dims.delete_rows(d, "sales", gone)
    assert {r.sale_id for r in changed["sale_items"].collect()} == {2, 3}


def test_logins(d):
    assert [tuple(r) for r in dims.last_login(d["audit_logs"]).collect()] == [
        (3, datetime(2024, 3, 2, 8, 0))]
    assert dims.failed_logins(d["audit_logs"], "2024-03-01").first().failures == 1
    assert dims.failed_logins(d["audit_logs"], "2024-03-02").count() == 0


def test_latest_row_per_key(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "c")],
                                 "k int, t int, v string")
    assert sorted(map(tuple, dims.latest_per_key(rows, ["k"], ["t"]).collect())) == [
        (1, 2, None), (2, 1, "c")]


def test_a_chain_of_clashes_takes_few_rounds(spark, monkeypatch):
    """Each row clashes with the one before it, by name or by address in turn."""
    n, rounds = 10_000, []
    asked = spark.range(n).selectExpr(
        "id as place", "concat('name', (id + 1) div 2) as username",
        "concat('address', id div 2) as email", "concat('N', id) as full_name",
        "'manager' as role", "cast(null as bigint) as branch_id")
    users = spark.createDataFrame([], dims.TABLES["users"].struct)
    clashing = dims._clashing
    monkeypatch.setattr(dims, "_clashing", lambda *a: rounds.append(1) or clashing(*a))
    added, refused = dims.insert_users(users, asked, ["place"])
    assert {int(r.full_name[1:]) for r in added.select("full_name").collect()} == set(
        range(0, n, 2))
    assert refused.count() == n // 2 and len(rounds) < 20


@pytest.mark.parametrize("turn_rows", [1, 8, 200_000])
def test_clashes_give_what_one_after_another_gives(spark, turn_rows):
    rng = random.Random(6)
    rows = [(i, None, f"N{i}", f"u{rng.randint(0, 25)}", rng.choice([f"e{rng.randint(0, 40)}@x"]),
             "manager") for i in range(60)]
    taken, want = (set(), set()), []
    for i, _, name, username, email, _ in rows:
        if username not in taken[0] and email not in taken[1]:
            taken[0].add(username)
            taken[1].add(email)
            want.append(name)
    asked = spark.createDataFrame(rows, "place long, branch_id long, full_name string, "
                                        "username string, email string, role string")
    users = spark.createDataFrame([], dims.TABLES["users"].struct)
    added, refused = dims.insert_dim(users, asked, "users", ["place"], turn_rows=turn_rows)
    assert [r.full_name for r in added.orderBy("id").collect()] == want
    assert refused.count() == len(rows) - len(want)
