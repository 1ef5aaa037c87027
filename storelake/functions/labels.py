"""Labels, display fallbacks and number formats used by reports and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts shown for labels and missing values, here and in the functions below.
DASH = "—"


def _stock_case(quantity: Column, level: Column, out: str, low: str, ok: str) -> Column:
    # A missing quantity compares as NULL, so it gets the last label.
    return F.when(quantity == 0, out).when(quantity <= level, low).otherwise(ok)


def report_status(quantity: str = "quantity_available",
                  level: str = "reorder_level") -> Column:
    """Label of the inventory report; a missing stock row reads OK."""
    return _stock_case(F.col(quantity), F.col(level), "Out of Stock", "Low Stock", "OK")


def listing_status(quantity: str = "quantity_available",
                   level: str = "reorder_level") -> Column:
    """Label of the stock page; a missing stock row reads in_stock."""
    return _stock_case(F.col(quantity), F.col(level), "out_of_stock", "low_stock", "in_stock")


def export_status(quantity: str = "quantity_available",
                  level: str = "reorder_level") -> Column:
    """Label of the exported sheet; a missing stock row is compared as zero."""
    known = F.col(quantity)
    return (F.when(known == 0, "Out of Stock")
            .when(F.coalesce(known, F.lit(0)) <= F.col(level), "Low Stock")
            .otherwise("OK"))


def row_flag(status: Column | str) -> Column:
    """Highlight colour class of an exported row."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "Out of Stock", "red").when(s == "Low Stock", "yellow")


def alert_type(quantity: str = "quantity_available") -> Column:
    return F.when(F.col(quantity) == 0, "out_of_stock").otherwise("low_stock")


def or_dash(text: Column | str) -> Column:
    """Text, or a dash when it is missing or empty."""
    return F.coalesce(F.nullif(_col(text), F.lit("")), F.lit(DASH))


def reference_or_id(reference: str = "reference_number", key: str = "id",
                    prefix: str = "PRO-") -> Column:
    """Reference number, or the prefixed key when it is missing or empty."""
    return F.coalesce(F.nullif(F.col(reference), F.lit("")),
                      F.concat(F.lit(prefix), F.col(key).cast("string")))


def or_zero(number: Column | str) -> Column:
    return F.coalesce(_col(number), F.lit(0))


def format_number(number: Column | str) -> Column:
    """Thousands separators, up to three decimals, no trailing zeros."""
    return F.call_function("format_number", _col(number), F.lit("#,##0.###"))


def format_money(amount: Column | str, currency: str = "UGX") -> Column:
    return F.concat(F.lit(f"{currency} "), format_number(amount))


def format_signed_money(amount: Column | str, currency: str = "UGX") -> Column:
    """Variance: a plus sign from zero upwards, a dash when not known."""
    a = _col(amount)
    return F.coalesce(F.concat(F.when(a >= 0, "+").otherwise(""), format_money(a, currency)),
                      F.lit(DASH))


def format_signed_quantity(change: Column | str) -> Column:
    """Stock change: a plus sign above zero."""
    c = _col(change)
    return F.concat(F.when(c > 0, "+").otherwise(""), c.cast("string"))


def format_clock(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "HH:mm:ss")


def format_stamp(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def format_long_date(day: Column | str) -> Column:
    return F.date_format(_col(day), "EEEE, d MMMM yyyy")


def iso_date(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")


def title_of_key(key: Column | str) -> Column:
    """low_stock_notifications -> Low Stock Notifications."""
    return F.initcap(F.replace(_col(key), F.lit("_"), F.lit(" ")))


def shortened(text: Column | str, length: int = 80, mark: str = "…") -> Column:
    """First characters, with a mark when the text goes on."""
    t = _col(text)
    return F.when(F.length(t) > length, F.concat(F.substring(t, 1, length), F.lit(mark))
                  ).otherwise(t)


def barcode_label(count: Column | str) -> Column:
    c = _col(count)
    return F.concat(c.cast("string"), F.lit(" barcode"), F.when(c != 1, "s").otherwise(""))


def normalised(text: Column | str) -> Column:
    """Login names and mail addresses are compared trimmed and in lower case."""
    return F.lower(F.trim(_col(text)))


def audit_action_class(action: Column | str, parity: bool = False) -> Column:
    """Display class of an audit action.

    ``parity=True`` tests LOGIN first, which shows a failed login as a success.
    """
    a = _col(action)
    login = (a.contains("LOGIN"), "success")
    failed = (a.contains("FAILED"), "danger")
    rules = [*((login, failed) if parity else (failed, login)),
             (a.contains("DELETE"), "danger"), (a.contains("CREATE"), "info")]
    return _first(rules, "secondary")


def severity_class(severity: Column | str) -> Column:
    s = _col(severity)
    return _first([(s == "critical", "danger"), (s == "high", "warning")], "secondary")


def bug_status_class(status: Column | str) -> Column:
    s = _col(status)
    return _first([(s == "resolved", "success"), (s == "open", "danger")], "warning")


def movement_class(kind: Column | str) -> Column:
    k = _col(kind)
    return _first([(k == "procurement", "success"), (k == "sale", "info")], "warning")


def balance_class(status: Column | str) -> Column:
    """A balance nobody handed in yet has no status."""
    s = _col(status)
    return _first([(s == "approved", "success"), (s == "flagged", "danger"),
                   (s.isNotNull(), "warning")], "secondary")


def variance_text(variance: Column | str, currency: str = "UGX") -> Column:
    """Wording of a live cash difference."""
    v = _col(variance)
    return (F.when(v == 0, "Balanced")
            .when(v > 0, F.concat(F.lit("Surplus: "), format_money(v, currency)))
            .otherwise(F.concat(F.lit("Shortage: "), format_money(F.abs(v), currency))))


def change_text(paid: Column | str, total: Column | str, currency: str = "UGX") -> Column:
    """Wording of the change due at the till; NULL until something is paid."""
    change = _col(paid) - _col(total)
    wording = F.when(change >= 0, F.concat(F.lit("Change: "), format_money(change, currency))
                     ).otherwise(F.concat(F.lit("Short by: "),
                                          format_money(F.abs(change), currency)))
    return F.when(_col(paid) > 0, wording)


def receipt_number(ts: Column | str, sale_id: Column | str) -> Column:
    """RCP-<milliseconds>-<sale id>; the id replaces a random suffix."""
    millis = F.unix_millis(_col(ts).cast("timestamp"))
    return F.concat_ws("-", F.lit("RCP"), millis.cast("string"), _col(sale_id).cast("string"))


def _first(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
