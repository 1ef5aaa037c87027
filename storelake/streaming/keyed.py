"""State by key: the stock of each branch, and the sessions of each user.

Both use Spark's arbitrary state with the RocksDB store, so state may be larger than
memory, is restored after a restart, and is read row by row for the products or sessions
that a batch touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from storelake.operators.admission import (
    EVENT, EVENT_ORDER, PROCUREMENT, SALE, new_inventory,
)
from storelake.operators.posting import kind_name
from storelake.streaming.stock import MOVED, STOCK_LINES, low_stock_crossings, with_bad

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


# --- stock ----------------------------------------------------------------------

#: The stock of so many neighbouring products (as a power of two) is one value of the state.
BLOCK_BITS = 8
LINE_COLUMNS = [c.split()[0] for c in STOCK_LINES.split(", ")]
#: What the state operator gets besides the key: no nulls, ``lacks`` has a bit for each.
JUDGED = f"{MOVED}, lacks int"


class StockKeeper(StatefulProcessor):
    """Judges the events of one key in time order against its stock."""

    def __init__(self, parity: bool) -> None:
        self.parity = parity

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Every call of the state is a message to the JVM: a block of products takes one.
        self.stock = handle.getMapState("stock", "block long",
                                        "products array<long>, quantities array<long>")

    def block(self, number: int) -> dict[int, int]:
        """The stock of the products of a block that have any on record."""
        held = self.stock.getValue((number,))
        return {} if held is None else dict(zip(held[0], held[1], strict=True))

    def update(self, changes: dict[int, int]) -> None:
        blocks: dict[int, dict[int, int]] = {}
        for product, quantity in changes.items():
            blocks.setdefault(product >> BLOCK_BITS, {})[product] = quantity
        for number, own in blocks.items():
            merged = self.block(number) | own
            self.stock.updateValue((number,), (list(merged), list(merged.values())))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = initialState[["product_id", "quantity_available"]].itertuples(index=False)
        self.update({int(product): int(quantity) for product, quantity in rows})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(rows, ignore_index=True)
        lines["unnamed"] = lines["lacks"] & _EVENT_BITS
        lines = lines.sort_values([*EVENT_ORDER, "unnamed", "line_no", "product_id"],
                                  kind="stable", ignore_index=True)
        touched = lines["product_id"].unique()
        own: dict[int, int] = {}
        for number in np.unique(touched >> BLOCK_BITS).tolist():
            own |= self.block(number)
        before = {p: own[p] for p in touched.tolist() if p in own}
        judged = self.judged(lines, own)
        self.update({p: own[p] for p in touched.tolist()
                     if p in own and own[p] != before.get(p)})
        yield judged

    def judged(self, lines: pd.DataFrame, stock: dict[int, int]) -> pd.DataFrame:
        """The sorted lines with the verdict on their events, and the stock before and after."""
        change, product, bad, kind = (
            lines[c].tolist() for c in ("change", "product_id", "bad", "kind"))
        verdicts, afters, met, had = [], [], [], []
        for first, end in _runs(lines):
            needs: dict[int, int] = {}
            for i in range(first, end):
                p, taken = product[i], -change[i]
                known = needs.get(p)
                needs[p] = taken if known is None else (
                    max(known, taken) if self.parity else known + taken)
            accepted = not any(bad[first:end]) and (kind[first] == PROCUREMENT or all(
                stock.get(p, 0) >= need and (kind[first] != SALE or p in stock)
                for p, need in needs.items()))
            for i in range(first, end):
                p = product[i]
                held = stock.get(p, 0)
                after = held + (change[i] if accepted else 0)
                had.append(p in stock)
                if accepted:
                    stock[p] = after
                verdicts.append(accepted)
                afters.append(after)
                met.append(held)
        return lines.assign(accepted=verdicts, quantity_after=afters, quantity_before=met,
                            had_row=had)[[c.split()[0] for c in JUDGED.split(", ")]]

    def close(self) -> None:
        pass


def _runs(lines: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """First line and end of one event after another, of sorted lines."""
    new = np.zeros(len(lines), bool)
    new[:1] = True
    for c in (*EVENT, "unnamed"):
        value = lines[c].to_numpy()
        new[1:] |= value[1:] != value[:-1]
    edges = [*np.flatnonzero(new).tolist(), len(lines)]
    return zip(edges, edges[1:])


_EVENT_BITS = sum(1 << i for i, c in enumerate(LINE_COLUMNS) if c in EVENT)


def judged_lines(lines: DataFrame, opening: DataFrame, products: DataFrame,
                 lane: Column | None = None, parity: bool = False) -> DataFrame:
    """Every line of a stream with its verdict and the stock before and after it."""
    kinds = dict(c.split() for c in STOCK_LINES.split(", "))
    lane = (F.lit(0) if lane is None else F.coalesce(lane, F.lit(0))).cast("long")
    typed = lines.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    lacks = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0)
                 for i, c in enumerate(LINE_COLUMNS)), F.lit(0))
    zero = {c: F.lit(0) for c in kinds} | {"posted_at": F.lit("1970-01-01").cast("timestamp_ntz")}
    marked = with_bad(typed, products, parity).withColumns(
        {"lacks": lacks.cast("int"), "lane": lane}).withColumns(
        {c: F.coalesce(c, zero[c]).cast(k) for c, k in kinds.items()})
    keys = [F.col("branch_id").alias("branch_key"), F.col("lane")]
    first = opening.select(
        F.col("branch_id").alias("branch_key"), lane.alias("lane"), "product_id",
        F.col("quantity_available").cast("long").alias("quantity_available"))
    out = marked.select(*keys[:1], "*").groupBy("branch_key", "lane").transformWithStateInPandas(
        StockKeeper(parity), JUDGED, "Append", "None",
        initialState=first.groupBy("branch_key", "lane"))
    return out.select(*[
        F.when(F.col("lacks").bitwiseAND(1 << LINE_COLUMNS.index(c)) == 0, F.col(c)).alias(c)
        if c in LINE_COLUMNS else F.col(c)
        for c in (x.split()[0] for x in MOVED.split(", "))])


class KeyedStock:
    """The stock of each branch as keyed state; what it judged is kept in ``folder``.

    A branch's events of one micro-batch are judged in time order in one group; events
    that come in a later batch are judged then. ``lane`` splits a busy branch: a column of
    branch_id and product_id that is the same for all lines of any event, such as the
    product where there are adjustments and procurements of one line only, or the
    department where no basket mixes departments. Without such a column, and for a
    branch too busy for one task, post batches with ``stock.StockStream``: it gives the same
    rows, and spreads a branch. All lines of one event must come in one batch.
    """

    def __init__(self, folder: str, opening: DataFrame, products: DataFrame,
                 lane: Column | None = None, parity: bool = False) -> None:
        self.folder, self.opening, self.products = folder, opening, products
        self.lane, self.parity = lane, parity

    def start(self, lines: DataFrame, **trigger) -> StreamingQuery:
        """Judge a stream of stock lines; a batch that is run again writes the same."""
        judged = judged_lines(lines, self.opening, self.products, self.lane, self.parity)

        def store(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").partitionBy("accepted").parquet(
                f"{self.folder}/judged/batch={batch}")

        with rocks_db(lines.sparkSession):
            return judged.writeStream.outputMode("append").option(
                "checkpointLocation", f"{self.folder}/progress"
            ).foreachBatch(store).trigger(**(trigger or {"availableNow": True})).start()

    def judged(self) -> DataFrame:
        """All lines so far, with the number of their batch."""
        spark = self.opening.sparkSession
        return spark.read.schema(f"{MOVED}, batch long").parquet(f"{self.folder}/judged")

    def movements(self) -> DataFrame:
        """All accepted movements so far."""
        return self.judged().filter("accepted").withColumn("movement_type", kind_name())

    def rejections(self) -> DataFrame:
        """All events turned down so far."""
        return self.judged().filter("not accepted").select(*EVENT, "batch").distinct()

    def alerts(self) -> DataFrame:
        """All movements so far that took a stock to its reorder level or below."""
        return low_stock_crossings(self.movements(), self.products)

    def stock(self) -> DataFrame:
        """The stock after all batches so far."""
        return new_inventory(self.opening, self.movements())

    def state(self) -> DataFrame:
        """The stock as the state store has it."""
        rows = self.opening.sparkSession.read.format("statestore").option(
            "path", f"{self.folder}/progress").option("stateVarName", "stock").load()
        held = F.arrays_zip("user_map_value.products", "user_map_value.quantities")
        return rows.select(F.col("key.branch_key").alias("branch_id"), F.inline(held).alias(
            "product_id", "quantity_available"))


# --- sessions -------------------------------------------------------------------

#: The time of events without one: they are a session of their own.
NO_TIME = -(1 << 62)
#: So many neighbouring users (as a power of two) are one group.
USER_BITS = 6
SLOTS = "user_id long, first long, last long, n long"
CHANGED = "user_id long, first long, last long, events long, removed boolean"


def _slots(gap: int):
    """Events of one user in one slot of the gap's length are always in one session."""
    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            slot = pdf["at"] - pdf["at"] % gap
            yield pdf.groupby(["user_id", slot.rename("slot")], sort=False)["at"].agg(
                ["min", "max", "count"]).reset_index("user_id").rename(
                columns={"min": "first", "max": "last", "count": "n"})

    return combine


class SessionKeeper(StatefulProcessor):
    """Joins new stretches of the users of a block with the sessions they touch.

    The sessions of a user are one value of the state, so a user that a batch touches takes
    two messages to the JVM, and neighbouring users share a call.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState(
            "sessions", "user_id long", "first array<long>, last array<long>, n array<long>")

    def known(self, user: int) -> dict[int, tuple[int, int]]:
        held = self.sessions.getValue((user,))
        return {} if held is None else {
            first: (last, n) for first, last, n in zip(*held, strict=True)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known: dict[int, dict[int, tuple[int, int]]] = {}
        now: dict[int, dict[int, tuple[int, int]]] = {}
        for pdf in rows:  # a chunk at a time: what is held are sessions, not events
            more: dict[int, list[tuple[int, int, int]]] = {}
            for user, *stretch in zip(*(pdf[c].tolist() for c in (
                    "user_id", "first", "last", "n"))):
                more.setdefault(user, []).append(tuple(stretch))
            for user, stretches in more.items():
                if user not in known:
                    known[user] = now[user] = self.known(user)
                now[user] = self.joined(now[user], stretches)
        out = []
        for user, sessions in now.items():
            before = known[user]
            gone = [first for first in before if first not in sessions]
            new = [(first, *held) for first, held in sessions.items()
                   if before.get(first) != held]
            if gone or new:
                lasts, counts = zip(*sessions.values())
                self.sessions.updateValue((user,), (list(sessions), list(lasts), list(counts)))
            out += [(user, first, last, n, False) for first, last, n in new]
            out += [(user, first, *before[first], True) for first in gone]
        if out:
            yield pd.DataFrame(out, columns=["user_id", "first", "last", "events", "removed"])

    def joined(self, sessions: dict[int, tuple[int, int]], more) -> dict[int, tuple[int, int]]:
        """Sessions and stretches, joined where they are at most the gap apart."""
        out: list[list[int]] = []
        stretches = [(first, last, n) for first, (last, n) in sessions.items()]
        for first, last, n in sorted([*stretches, *((int(a), int(b), int(c)) for a, b, c in more)]):
            if out and first - out[-1][1] <= self.gap:
                out[-1][1:] = max(out[-1][1], last), out[-1][2] + n
            else:
                out.append([first, last, n])
        return {first: (last, n) for first, last, n in out}

    def close(self) -> None:
        pass


def changed_sessions(events: DataFrame, gap_minutes: int) -> DataFrame:
    """The sessions that each batch made, changed or joined to another (``removed``)."""
    gap = gap_minutes * 60 * 1_000_000
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    times = events.filter("user_id is not null").select(
        F.col("user_id").cast("long").alias("user_id"),
        F.coalesce(at, F.lit(NO_TIME)).alias("at"))
    slots = times.mapInPandas(_slots(gap), SLOTS).withColumn(
        "users", F.shiftright("user_id", USER_BITS))
    changed = slots.groupBy("users").transformWithStateInPandas(
        SessionKeeper(gap), CHANGED, "Update", "None")

    def moment(name: str) -> Column:
        timed = F.when(F.col(name) != NO_TIME, F.col(name))
        return F.timestamp_micros(timed).cast("timestamp_ntz")

    return changed.select("user_id", moment("first").alias("session_start"),
                          moment("last").alias("session_end"), "events", "removed")
