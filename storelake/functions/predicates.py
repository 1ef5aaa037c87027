"""Filter building blocks shared by the reports, dashboards and listings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(value: object) -> bool:
    """An absent filter: None or an empty text."""
    return value is None or value == ""


def all_of(conditions: Iterable[Column]) -> Column:
    """Conjunction that starts from TRUE, so no condition means no filter."""
    return reduce(and_, conditions, F.lit(True))


def optional_eq(column: Column | str, value: object) -> Column:
    """Equality, or no filter for a blank value."""
    return F.lit(True) if is_blank(value) else _col(column) == F.lit(value)


def branch_is(column: Column | str, branch_id: int | None) -> Column:
    """Equality with a branch; no branch selects nothing."""
    return _col(column) == F.lit(branch_id).cast("long")


def on_day(column: Column | str, day: str) -> Column:
    """Timestamp falls on the calendar day."""
    return F.to_date(_col(column)) == F.lit(day).cast("date")


def days_between(column: Column | str, first: str | None, last: str | None) -> Column:
    """Date (or the date of a timestamp) in an optionally open, closed range."""
    day = F.to_date(_col(column))
    bounds = []
    if not is_blank(first):
        bounds.append(day >= F.lit(first).cast("date"))
    if not is_blank(last):
        bounds.append(day <= F.lit(last).cast("date"))
    return all_of(bounds)


def scope_rows(role: str, user_id: int | None, branch_id: int | None,
               branch: str = "branch_id", agent: str = "sales_agent_id") -> Column:
    """Rows a role may see: managers their branch, agents their own, directors all."""
    if role == "manager":
        return branch_is(branch, branch_id)
    if role == "sales_agent":
        return F.col(agent) == F.lit(user_id).cast("long")
    return F.lit(True)


def has_role(column: Column | str, roles: Iterable[str]) -> Column:
    """Role is one of the list."""
    return _col(column).isin(list(roles))


def name_like(column: Column | str, text: str | None) -> Column:
    """Case-insensitive substring match; wildcards in the text keep their meaning."""
    if is_blank(text):
        return F.lit(True)
    return F.like(F.lower(_col(column)), F.lower(F.lit(f"%{text}%")))


def at_or_below_reorder(quantity: str = "quantity_available",
                        level: str = "reorder_level") -> Column:
    """Stock has reached the reorder level; out of stock counts too."""
    return F.col(quantity) <= F.col(level)


def low_stock(quantity: str = "quantity_available", level: str = "reorder_level") -> Column:
    """Stock has reached the reorder level but is not used up."""
    return at_or_below_reorder(quantity, level) & (F.col(quantity) > 0)


def out_of_stock(quantity: str = "quantity_available") -> Column:
    """Stock is zero or was never recorded."""
    return (F.col(quantity) == 0) | F.col(quantity).isNull()


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
