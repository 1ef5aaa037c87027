"""Inserts, updates and deletes of the small tables, as new DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.functions.labels import normalised
from storelake.functions.predicates import days_between
from storelake.operators.graph import components
from storelake.operators.ordered import numbered, side_by_side
from storelake.operators.quality import apply_defaults
from storelake.session import written
from storelake.sources.schemas import TABLES, enforce_schema, with_generated


#: Rows of one group of clashing rows that are gone through in one task.
TURN_ROWS = 200_000


def latest_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; combined before the shuffle, so any key size works."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    ).select(*key, "_row.*").select(*rows.columns)


def next_ids(new: DataFrame, current: DataFrame, order: Sequence[str],
             column: str = "id") -> DataFrame:
    """Give new rows the ids after the largest one in use."""
    top = current.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    return numbered(new.drop(column), order, column, start=top)


def insert_missing(current: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add rows whose key is not in use; the others are skipped."""
    fresh = new.dropDuplicates(list(key)).join(current.select(*key), list(key), "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def insert_dim(current: DataFrame, new: DataFrame, table: str, order: Sequence[str],
               unique: Sequence[Sequence[str]] | None = None, as_of: str | None = None,
               falsy: Sequence[str] = (), turn_rows: int = TURN_ROWS
               ) -> tuple[DataFrame, DataFrame]:
    """Insert rows in ``order``; returns the rows added and the rows turned down.

    A row is turned down if one of its unique values is in use or was taken by a
    row before it that got in. Columns in ``falsy`` take their default for an
    empty text or 0 too. Rows that clash with each other, directly or through others,
    are gone through in order as one group of at most ``turn_rows``.
    """
    declared = TABLES[table]
    sets = [list(u) for u in (unique if unique is not None else declared.unique)
            if list(u) != ["id"]]
    given = new
    for column in declared.columns:
        if column not in given.columns:
            given = given.withColumn(column, F.lit(None).cast(declared.columns[column]))
    # The place in line settles ties and names the rows in the rounds below.
    queued = numbered(given, order, "_place")
    waiting = written(with_generated(apply_defaults(queued, table, as_of, falsy), table))
    everyone, taken_in = waiting, []
    for names in sets:
        waiting = _without_taken(waiting, current, names)
    waiting = written(waiting) if sets else waiting
    while sets:
        clashing = written(_clashing(waiting, sets))
        free = waiting.join(clashing.select("_place"), "_place", "left_anti")
        small = clashing.filter(F.col("_size") <= turn_rows)
        judged = written(free.select("_place").unionByName(_first_come(small, sets)), "let-in")
        if clashing.filter(F.col("_size") > turn_rows).isEmpty():
            taken_in.append(waiting.join(judged, "_place", "left_semi"))
            break
        # Of a larger group those go in that no row before them can stop.
        leads = clashing.filter(F.col("_size") > turn_rows)
        for n in range(len(sets)):
            leads = leads.filter(F.col(f"_lead{n}").isNull() | (F.col(f"_lead{n}") == F.col("_place")))
        first = written(waiting.join(judged.unionByName(leads.select("_place")), "_place",
                                     "left_semi"))
        taken_in.append(first)
        waiting = waiting.join(first.select("_place"), "_place", "left_anti").join(
            small.select("_place"), "_place", "left_anti")
        for names in sets:
            waiting = _without_taken(waiting, first, names)
        waiting = written(waiting)
    added = reduce(DataFrame.unionByName, taken_in) if sets else waiting
    refused = everyone.join(added.select("_place"), "_place", "left_anti")
    rows = enforce_schema(next_ids(added, current, ["_place"]), table)
    return rows, refused.drop("_place", "id")


def _clashing(waiting: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Rows that share a unique value with another: place, the values as texts (null for
    one that is not wholly known), the first place with each, group and size of the group.
    """
    out = waiting.select("_place", *[
        F.when(_all_known(names), F.to_json(F.struct(*names))).alias(f"_value{n}")
        for n, names in enumerate(sets)])
    for n in range(len(sets)):
        shared = out.filter(F.col(f"_value{n}").isNotNull()).groupBy(f"_value{n}").agg(
            F.min("_place").alias(f"_lead{n}"), F.count("*").alias("_n")).filter("_n > 1")
        out = out.join(shared.drop("_n"), f"_value{n}", "left")
    leads = [f"_lead{n}" for n in range(len(sets))]
    out = written(out.filter(F.coalesce(*leads).isNotNull()), "clashes")
    links = out.select(F.col("_place").alias("a"), F.explode(F.array_compact(F.array(*leads)))
                       .alias("b"))
    roots = components(links).select(F.col("node").alias("_place"), "root")
    out = out.join(roots, "_place", "left").withColumn("_group", F.coalesce("root", "_place"))
    sizes = out.groupBy("_group").agg(F.count("*").alias("_size"))
    return out.drop("root").join(sizes, "_group")


def _first_come(clashing: DataFrame, sets: list[list[str]]) -> DataFrame:
    """The places that get in when each group is gone through in order."""
    values = [f"_value{n}" for n in range(len(sets))]

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, taken = None, [set() for _ in values]
        for rows in frames:
            places = []
            for own_group, place, *own in zip(*(rows[c].tolist() for c in columns)):
                if own_group != group:
                    group, taken = own_group, [set() for _ in values]
                if not any(v in held for v, held in zip(own, taken) if isinstance(v, str)):
                    places.append(place)
                    for v, held in zip(own, taken):
                        held.add(v)
            yield pd.DataFrame({"_place": places}, dtype="int64")

    columns = ["_group", "_place", *values]
    return side_by_side(clashing.select(*columns), "_group", ["_place"]).mapInPandas(
        judge, "_place long")


def _all_known(names: Sequence[str]) -> Column:
    return reduce(and_, (F.col(n).isNotNull() for n in names))


def _without_taken(rows: DataFrame, holders: DataFrame, names: list[str]) -> DataFrame:
    return rows.join(holders.select(*names).distinct(), names, "left_anti").select(
        *rows.columns)


def insert_users(current: DataFrame, new: DataFrame, order: Sequence[str],
                 as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert users; login names are stored trimmed and in lower case."""
    return insert_dim(current, new.withColumn("username", normalised("username")), "users",
                      order, as_of=as_of)


def insert_products(current: DataFrame, new: DataFrame, order: Sequence[str],
                    as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert products; an empty unit or reorder level takes the default."""
    return insert_dim(current, new, "products", order, as_of=as_of,
                      falsy=("reorder_level", "unit"))


def submit_bug_reports(current: DataFrame, new: DataFrame, order: Sequence[str],
                       as_of: str | None = None) -> DataFrame:
    """Insert bug reports as open, of medium severity unless stated."""
    return insert_dim(current, new, "bug_reports", order, as_of=as_of)[0]


def add_barcodes(current: DataFrame, new: DataFrame, order: Sequence[str],
                 as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert barcodes, trimmed; a value in use anywhere is turned down."""
    return insert_dim(current, new.withColumn("barcode_value", F.trim("barcode_value")),
                      "barcodes", order, as_of=as_of)


def delete_barcodes(current: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining barcodes, and id and product of the deleted ones."""
    wanted = ids.select("id")
    return (current.join(wanted, "id", "left_anti"),
            current.join(wanted, "id", "left_semi").select("id", "product_id"))


def upsert_dim(current: DataFrame, changes: DataFrame, columns: Sequence[str],
               key: Sequence[str] = ("id",), as_of: str | None = None,
               keep_if_blank: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Overwrite the listed columns of the rows named by key; unknown keys are ignored.

    With ``order`` several changes of a key are allowed and the last one wins. A
    blank value leaves the columns in ``keep_if_blank`` as they are.
    """
    if order:
        changes = latest_per_key(changes, key, order)
    stamped = "updated_at" in current.columns
    at = (F.col("updated_at") if "updated_at" in changes.columns
          else F.lit(None).cast("timestamp_ntz"))
    new = changes.select(
        *[F.col(k).alias(f"_k_{k}") for k in key],
        *[F.col(c).alias(f"_n_{c}") for c in columns],
        at.alias("_at"), F.lit(True).alias("_hit"))
    on = reduce(and_, (F.col(k) == F.col(f"_k_{k}") for k in key))

    def value(name: str) -> Column:
        if name == "updated_at" and stamped and name not in columns:
            moment = F.coalesce(F.col("_at"), _moment(as_of))
            return F.when(F.col("_hit"), moment).otherwise(F.col(name)).alias(name)
        if name not in columns:
            return F.col(name)
        given = F.col(f"_n_{name}")
        if name in keep_if_blank:
            given = F.coalesce(F.nullif(given, F.lit("")), F.col(name))
        return F.when(F.col("_hit"), given).otherwise(F.col(name)).alias(name)

    return current.join(new, on, "left").select(*[value(c) for c in current.columns])


def _moment(as_of: str | None) -> Column:
    return (F.localtimestamp() if as_of is None else F.lit(as_of)).cast("timestamp_ntz")


def toggle_status(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Swap active and inactive for the given ids."""
    hit = ids.select(F.col("id").alias("_id")).distinct()
    swapped = F.when(F.col("status") == "active", "inactive").otherwise("active")
    return rows.join(hit, F.col("id") == F.col("_id"), "left").withColumn(
        "status", F.when(F.col("_id").isNotNull(), swapped).otherwise(F.col("status"))
    ).drop("_id")


def apply_settings(settings: DataFrame, changes: DataFrame, user_id: int,
                   as_of: str | None = None) -> DataFrame:
    """Apply posted ``changes`` (a map column of key -> value, with ``posted_at``).

    Unknown keys are ignored; the last posting of a key wins.
    """
    each = changes.select("posted_at", F.explode("changes").alias("setting_key",
                                                                  "setting_value"))
    last = latest_per_key(each, ["setting_key"], ["posted_at", "setting_value"])
    return upsert_dim(settings, last.withColumn("updated_by", F.lit(user_id).cast("long")),
                      ["setting_value", "updated_by"], ["setting_key"], as_of)


def set_bug_status(bugs: DataFrame, changes: DataFrame, as_of: str | None = None) -> DataFrame:
    """Set the status of bug reports from ``(id, status)`` rows."""
    return upsert_dim(bugs, changes, ["status"], as_of=as_of)


BALANCE_KEY = ("branch_id", "sales_agent_id", "balance_date")


def upsert_cashier_balance(current: DataFrame, submissions: DataFrame) -> DataFrame:
    """Record handed-in cash; one row per branch, agent and day.

    A new submission replaces cash, notes, manager, status and approval time. The
    expected cash stays as first recorded, while the status compares the figures
    submitted together. ``submissions`` carry ``posted_at``.
    """
    gap = F.coalesce("submitted_cash", F.lit(0)) - F.col("expected_cash")
    judged = submissions.withColumn(
        "status", F.when(F.abs(gap) > 0, "flagged").otherwise("approved"))
    taken = ["submitted_cash", "notes", "manager_id", "status"]
    order = F.struct("posted_at", "submitted_cash")
    batch = judged.groupBy(*BALANCE_KEY).agg(
        F.min_by("expected_cash", order).alias("_expected"),
        F.min("posted_at").alias("_first"), F.max("posted_at").alias("_last"),
        F.max_by(F.struct(*taken), order).alias("_new"))
    rows = current.withColumn("_old", F.lit(True)).join(batch, list(BALANCE_KEY), "full")
    hit = F.col("_last").isNotNull()
    merged = rows.withColumns({
        **{c: F.when(hit, F.col("_new")[c]).otherwise(F.col(c)) for c in taken},
        "expected_cash": F.when(F.col("_old"), F.col("expected_cash"))
                          .otherwise(F.col("_expected")),
        "approved_at": F.when(hit, F.col("_last")).otherwise(F.col("approved_at")),
        "created_at": F.when(F.col("_old"), F.col("created_at")).otherwise(F.col("_first")),
    })
    kept = merged.filter(F.col("_old"))
    added = next_ids(merged.filter(F.col("_old").isNull()), current, list(BALANCE_KEY))
    table = "cashier_balances"
    both = kept.select(*current.columns).unionByName(added.select(*current.columns))
    return enforce_schema(with_generated(both, table), table)


def cascade_delete(child: DataFrame, column: str, removed: DataFrame) -> DataFrame:
    """Child rows left after the parent keys in ``removed`` (column id) are gone."""
    return child.join(removed.select(F.col("id").alias(column)), column, "left_anti").select(
        *child.columns)


def set_null_on_delete(child: DataFrame, column: str, removed: DataFrame) -> DataFrame:
    """Child rows with the reference to a removed parent cleared."""
    gone = removed.select(F.col("id").alias("_gone")).distinct()
    return child.join(gone, F.col(column) == F.col("_gone"), "left").withColumn(
        column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")


def delete_rows(d, table: str, removed: DataFrame) -> dict[str, DataFrame]:
    """Tables changed by deleting the rows of ``table`` whose id is in ``removed``.

    References declared ON DELETE CASCADE lose their rows, SET NULL ones their
    value; other references are left for ``check_fk`` to report.
    """
    gone = removed.select("id").distinct()
    changed = {table: d[table].join(gone, "id", "left_anti")}
    for name, spec in TABLES.items():
        rules = [f for f in spec.foreign if f.parent == table and name in d]
        rows = d[name] if name in d else None
        for f in rules:
            if f.on_delete == "cascade":
                rows = cascade_delete(rows, f.column, gone)
            elif f.on_delete == "set null":
                rows = set_null_on_delete(rows, f.column, gone)
        if any(f.on_delete != "restrict" for f in rules):
            changed[name] = rows
            cascading = [f.column for f in rules if f.on_delete == "cascade"]
            if cascading and "id" in rows.columns:
                lost = d[name].filter(reduce(or_, (F.col(c).isNotNull() for c in cascading))
                                      ).join(rows.select("id"), "id", "left_anti")
                for k, v in delete_rows(d, name, lost).items():
                    if k != name:
                        changed[k] = v
    return changed


def last_login(audit: DataFrame) -> DataFrame:
    """Latest login of each user, from the audit trail."""
    return audit.filter((F.col("action") == "LOGIN") & F.col("user_id").isNotNull()).groupBy(
        "user_id").agg(F.max("created_at").alias("last_login"))


def failed_logins(audit: DataFrame, date_from: str | None = None,
                  date_to: str | None = None) -> DataFrame:
    """Number of failed logins of each user."""
    return audit.filter(
        (F.col("action") == "FAILED_LOGIN") & days_between("created_at", date_from, date_to)
    ).groupBy("user_id").agg(F.count("*").alias("failures"))
