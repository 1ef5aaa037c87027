"""Which stock events are accepted, when each one depends on those before it.

An event (a basket, a procurement, an adjustment) takes effect as a whole or not
at all. Whether it is accepted depends on the stock left by the accepted events
before it, over all its products. Events are judged in the order (posted_at,
kind, event_id).

Reading a branch row by row would put a busy branch into one task. Instead every
undecided line gets two bounds from running sums over its (branch, product):

* the lowest stock it can meet: all undecided withdrawals before it happen and
  no undecided arrival does,
* the highest stock it can meet: the other way round.

An event whose lines are all covered by the lowest stock is accepted, one with a
line not covered by the highest is rejected, and the next round has tighter
bounds. The first undecided event of a branch has equal bounds, so each round
decides something and the result is the one of the serial order.

From the second round on, the undecided events that share a product of a branch, or are
linked by a chain of such, form a component. Events of two components do not depend on
each other, so a component is judged in order by itself, within one task, as soon as
it has at most ``FINISH_ROWS`` undecided lines. The others go on with bounds. If a round
leaves more than half of their lines undecided, the next one judges the first
``FINISH_ROWS`` of each in order, so long chains of events that hang on each other take
no more rounds than that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.operators.graph import components
from storelake.operators.ledger import STOCK_KEY
from storelake.operators.ordered import (
    ROWS_PER_CHUNK, Ordered, in_order, row_numbers, running_sums, side_by_side,
)
from storelake.session import discard, made_from, written

# Order of events posted at the same moment.
PROCUREMENT, SALE, ADJUSTMENT = 0, 1, 2
EVENT = ("branch_id", "posted_at", "kind", "event_id")
EVENT_ORDER = ("posted_at", "kind", "event_id")
LINE_ORDER = (*EVENT_ORDER, "line_no")

FINISH_ROWS = 200_000
# A need no stock level can miss.
NO_NEED = -(2 ** 62)
UNDECIDED, ACCEPTED, REJECTED = 0, 1, 2


def opening_stock(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add ``opening``: the stock on record, NULL for no stock row."""
    stock = inventory.select(
        *[F.col(k).alias(f"_{k}") for k in STOCK_KEY],
        F.col("quantity_available").cast("long").alias("opening"))
    on = (F.col("branch_id") == F.col("_branch_id")) & (
        F.col("product_id") == F.col("_product_id"))
    return lines.join(stock, on, "left").drop(*[f"_{k}" for k in STOCK_KEY])


def needs(lines: DataFrame, parity: bool) -> DataFrame:
    """One row per event and product: the stock it needs and the change it makes.

    A sale needs a stock row with its quantity: the sum of its lines, or with
    ``parity`` only the largest line. An adjustment must not end below zero and,
    like a procurement, makes the stock row if there is none.
    """
    kind = F.col("kind")
    # Every line of a sale takes stock out, so its need is the negative change.
    taken = F.max(-F.col("change")) if parity else F.sum(-F.col("change"))
    out = lines.groupBy(*EVENT, "product_id").agg(
        taken.alias("_taken"), F.sum("change").alias("change"))
    return out.select(
        *EVENT, "product_id", "change",
        F.when(kind == PROCUREMENT, F.lit(NO_NEED)).when(kind == SALE, F.col("_taken"))
         .otherwise(-F.col("change")).cast("long").alias("need"),
        (kind != SALE).alias("makes_row"),
        (kind == SALE).alias("wants_row"),
        F.when(kind == PROCUREMENT, ACCEPTED).otherwise(UNDECIDED).alias("state"),
    )


def decide(lines: DataFrame, inventory: DataFrame, parity: bool = False,
           rows_per_chunk: int = ROWS_PER_CHUNK, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """``accepted`` per sale and adjustment; procurements are always accepted.

    What the rounds write is deleted as they go, but for the verdicts.
    """
    first = written(opening_stock(needs(lines, parity), inventory), "needs")
    start = in_order(first, STOCK_KEY, EVENT_ORDER, rows_per_chunk)
    if start.chunked:
        discard(first)
    work, decided = start.df, []
    before, in_turn = None, False
    while True:
        total = work.filter(F.col("state") == UNDECIDED).count()
        if not total:
            break
        bounds = _bounds(Ordered(work, start.keys, start.order, start.chunked))
        waiting = bounds.filter(F.col("state") == UNDECIDED)
        if before is None:
            # The bounds decide what they can before anything is judged in turn.
            verdicts = written(_judge(waiting), "verdicts")
        else:
            waiting = _with_component(waiting)
            small = waiting.filter(F.col("lines") <= finish_rows)
            large = waiting.filter(F.col("lines") > finish_rows)
            verdicts = _in_turn(small)
            if large.isEmpty():
                decided.append(written(verdicts, "verdicts"))
                discard(waiting)
                break
            in_turn = total > before / 2 and not in_turn
            if in_turn:
                large = _first_events(large, finish_rows, rows_per_chunk)
            verdicts = written(verdicts.unionByName(
                _in_turn(large) if in_turn else _judge(large)), "verdicts")
            discard(waiting, large)
        before = total
        decided.append(verdicts)
        done, work = work, _next_round(work, verdicts)
        discard(done)
    discard(work)
    if not decided:
        decided = [lines.sparkSession.createDataFrame([], _VERDICT)]
    final = reduce(DataFrame.unionByName, decided).filter(F.col("verdict") != UNDECIDED).select(
        *EVENT, (F.col("verdict") == ACCEPTED).alias("accepted"))
    return made_from(final, *decided)


def _with_component(waiting: DataFrame) -> DataFrame:
    """Add ``component``, of the events that depend on each other, and its ``lines``; written.

    Products are known by a hash: two that share one make a component larger, no more.
    """
    waiting = written(waiting.withColumn("_node", F.xxhash64(*STOCK_KEY)), "waiting")
    links = waiting.groupBy(*EVENT).agg(
        F.min("_node").alias("a"), F.collect_set("_node").alias("all")).filter(
        F.size("all") > 1).select("a", F.explode("all").alias("b"))
    linked = components(links)
    roots = linked.select(F.col("node").alias("_node"), "root")
    nodes = waiting.groupBy("_node").agg(F.count("*").alias("_n")).join(
        roots, "_node", "left").withColumn("component", F.coalesce("root", "_node"))
    nodes = written(nodes.select("_node", "_n", "component"), "conflict-nodes")
    sizes = nodes.groupBy("component").agg(F.sum("_n").alias("lines"))
    out = written(waiting.join(nodes.join(sizes, "component").drop("_n"), "_node").drop("_node"),
                  "conflicts")
    discard(waiting, nodes, linked)
    return out


def _bounds(work: Ordered) -> DataFrame:
    """Add the stock each line meets for certain, at least and at most."""
    open_, done = F.col("state") == UNDECIDED, F.col("state") == ACCEPTED
    change, makes = F.col("change"), F.col("makes_row").cast("int")
    parts = {
        "_done": F.when(done, change).otherwise(0),
        "_up": F.when(open_, F.greatest(change, F.lit(0))).otherwise(0),
        "_down": F.when(open_, F.least(change, F.lit(0))).otherwise(0),
        "_made": F.when(done, makes).otherwise(0),
        "_may": F.when(open_, makes).otherwise(0),
    }
    rows = running_sums(work, parts, keep_chunk=True)
    # The sums include the row itself; what counts is the state before it.
    before = {n: F.col(n) - own for n, own in parts.items()}
    known = F.coalesce("opening", F.lit(0)) + before["_done"]
    row_now = F.col("opening").isNotNull() | (before["_made"] > 0)
    return rows.withColumns({
        "base": known.cast("long"),
        "lowest": (known + before["_down"]).cast("long"),
        "highest": (known + before["_up"]).cast("long"),
        "row_now": row_now,
        "row_may": row_now | (before["_may"] > 0),
    }).drop(*parts)


def _judge(waiting: DataFrame) -> DataFrame:
    """Verdicts that hold whatever becomes of the undecided events."""
    need, wants = F.col("need"), F.col("wants_row")
    sure = (F.col("lowest") >= need) & (~wants | F.col("row_now"))
    hopeless = (F.col("highest") < need) | (wants & ~F.col("row_may"))
    return waiting.groupBy(*EVENT).agg(
        F.when(F.max(hopeless), REJECTED).when(F.min(sure), ACCEPTED).otherwise(UNDECIDED)
        .alias("verdict"))


def _first_events(waiting: DataFrame, limit: int, rows_per_chunk: int) -> DataFrame:
    """The first events of each component that make up at most ``limit`` lines."""
    lines = waiting.select("component", *EVENT, "product_id")
    ordered = in_order(lines, ["component"], [*EVENT_ORDER, "branch_id", "product_id"],
                       rows_per_chunk)
    placed = row_numbers(ordered, "_place")
    first = placed.groupBy(*EVENT).agg(F.max("_place").alias("_last")).filter(
        F.col("_last") <= limit)
    return made_from(waiting.join(first.select(*EVENT), list(EVENT), "left_semi"), ordered.df)


def _next_round(work: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of the products that still have an undecided event."""
    rows = written(work.join(verdicts, list(EVENT), "left").withColumn(
        "state", F.coalesce("verdict", "state")).drop("verdict").filter(
        F.col("state") != REJECTED), "round")
    open_keys = rows.filter(F.col("state") == UNDECIDED).select(*STOCK_KEY).distinct()
    return made_from(rows.join(open_keys, list(STOCK_KEY), "left_semi"), rows)


_VERDICT = "branch_id long, posted_at timestamp_ntz, kind int, event_id long, verdict int"


def _in_turn(waiting: DataFrame) -> DataFrame:
    """Judge events one after another, a bounded number of lines per component.

    Most components are a few lines, so a task takes many of them from one sorted stream
    instead of a call for each.
    """
    order = [F.asc_nulls_last(c) for c in (*EVENT_ORDER, "branch_id")]
    return side_by_side(waiting.select(*_TURN), "component", order).mapInArrow(
        _judge_in_turn, _VERDICT)


_TURN = ("component", *EVENT, "product_id", "change", "need", "base", "wants_row", "row_now",
         "makes_row")


def _judge_in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The verdict on each event of the sorted lines; an event may go on in the next batch."""
    turn, cut = _Turn(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        lines = pa.Table.from_batches([batch] if cut is None else [cut, batch]).combine_chunks()
        starts = _event_starts(lines)
        if len(starts) > 1:
            yield from turn.verdicts(lines, starts[:-1], int(starts[-1]))
        cut = lines.slice(int(starts[-1])).combine_chunks().to_batches()[0]
    if cut is not None:
        yield from turn.verdicts(pa.Table.from_batches([cut]), np.zeros(1, np.int64), cut.num_rows)


def _event_starts(lines: pa.Table) -> np.ndarray:
    """Where events begin in sorted lines; a line without event id is one by itself."""
    new = np.zeros(lines.num_rows, bool)
    new[0] = True
    for name in ("component", *EVENT):
        known = lines[name].is_valid().to_numpy()
        value = lines[name].cast(pa.int64()).fill_null(0).to_numpy()
        new[1:] |= (value[1:] != value[:-1]) | (known[1:] != known[:-1])
    return np.flatnonzero(new | ~known)  # event_id is the last one


class _Turn:
    """What the accepted events of the component at hand have changed."""

    def __init__(self) -> None:
        self.component: int | None = None
        self.moved: dict[tuple[int, int], int] = {}
        self.made: set[tuple[int, int]] = set()

    def verdicts(self, lines: pa.Table, starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        column = {c: lines[c].to_pylist() for c in
                  ("component", "change", "need", "base", "wants_row", "row_now", "makes_row")}
        component, change, need, base, wants, row_now, makes = column.values()
        keys = list(zip(lines["branch_id"].to_pylist(), lines["product_id"].to_pylist()))
        found = []
        edges = [*starts.tolist(), end]
        for first, after in zip(edges, edges[1:]):
            if component[first] != self.component:
                self.component, self.moved, self.made = component[first], {}, set()
            moved, made = self.moved, self.made
            accepted = all(
                base[i] + moved.get(keys[i], 0) >= need[i]
                and (not wants[i] or row_now[i] or keys[i] in made) for i in range(first, after))
            if accepted:
                for i in range(first, after):
                    moved[keys[i]] = moved.get(keys[i], 0) + change[i]
                    if makes[i]:
                        made.add(keys[i])
            found.append(ACCEPTED if accepted else REJECTED)
        judged = lines.select(list(EVENT)).take(pa.array(starts)).append_column(
            "verdict", pa.array(found, pa.int32()))
        yield from judged.combine_chunks().to_batches()


def with_balances(lines: DataFrame, verdicts: DataFrame, inventory: DataFrame,
                  rows_per_chunk: int = ROWS_PER_CHUNK, probe: DataFrame | None = None
                  ) -> DataFrame:
    """Lines with ``accepted`` and the stock before and after each of them."""
    judged = lines.join(verdicts, list(EVENT), "left").withColumn(
        "accepted", F.coalesce("accepted", F.col("kind") == PROCUREMENT))
    return balances(judged, inventory, LINE_ORDER, rows_per_chunk, probe)


def balances(judged: DataFrame, inventory: DataFrame, order: Sequence[str] = LINE_ORDER,
             rows_per_chunk: int = ROWS_PER_CHUNK, probe: DataFrame | None = None) -> DataFrame:
    """The stock before and after each of the lines, of which is known if they are accepted.

    A line of a rejected event changes nothing: before and after are the stock
    it met. ``had_row`` tells whether a stock row existed by then. If a product has more lines
    than a chunk, they are written; :func:`storelake.session.discard` deletes that table.
    """
    judged = opening_stock(judged, inventory)
    effect: Column = F.when(F.col("accepted"), F.col("change")).otherwise(0)
    makes: Column = (F.col("accepted") & (F.col("kind") != SALE)).cast("int")
    ordered = in_order(judged, STOCK_KEY, order, rows_per_chunk, probe)
    rows = running_sums(ordered, {"_moved": effect, "_made": makes})
    after = F.coalesce("opening", F.lit(0)) + F.col("_moved")
    out = rows.withColumns({
        "quantity_after": after.cast("long"),
        "quantity_before": (after - effect).cast("long"),
        "had_row": F.col("opening").isNotNull() | (F.col("_made") - makes > 0),
    }).drop("_moved", "_made", "opening")
    return made_from(out, ordered.df)


def new_inventory(inventory: DataFrame, accepted_lines: DataFrame) -> DataFrame:
    """Stock after the accepted lines; rows that were missing are made."""
    moved = accepted_lines.groupBy(*STOCK_KEY).agg(
        F.sum("change").alias("_change"), F.max("posted_at").alias("_at"))
    old = inventory.select(*STOCK_KEY, "quantity_available", "updated_at")
    return old.join(moved, list(STOCK_KEY), "full").select(
        *STOCK_KEY,
        (F.coalesce("quantity_available", F.lit(0)) + F.coalesce("_change", F.lit(0)))
        .cast("int").alias("quantity_available"),
        F.coalesce("_at", "updated_at").alias("updated_at"),
    )
