"""The posting rules applied one request after another, to compare against."""

from decimal import Decimal


def post(requests, stock, prices, parity=False):
    """``requests``: dicts with kind, id, branch, at, lines [(product, qty[, cost])], paid.

    Returns accepted ids per kind, reasons, movements and the final stock.
    """
    order = {"procurement": 0, "sale": 1, "adjustment": 2}
    stock = dict(stock)
    accepted, reasons, moves = [], {}, []
    for r in sorted(requests, key=lambda r: (r["at"], order[r["kind"]], r["id"])):
        reason = _reason(r, stock, prices, parity)
        if reason:
            reasons[(r["kind"], r["id"])] = reason
            continue
        accepted.append((r["kind"], r["id"]))
        for product, quantity, *_ in r["lines"]:
            key = (r["branch"], product)
            change = -quantity if r["kind"] == "sale" else quantity
            before = stock.get(key, 0)
            stock[key] = before + change
            moves.append((r["kind"], r["id"], *key, change, before, before + change))
    return accepted, reasons, moves, stock


def _reason(r, stock, prices, parity):
    lines = r["lines"]
    if r["kind"] == "procurement":
        return "invalid_line" if any(q == 0 for _, q in lines) else None
    if r["kind"] == "adjustment":
        product, quantity = lines[0]
        return "below_zero" if stock.get((r["branch"], product), 0) + quantity < 0 else None
    if not lines and not parity:
        return "no_lines"
    if not parity and any(q <= 0 for _, q in lines):
        return "invalid_line"
    wanted = {}
    for product, quantity in lines:
        if parity:
            wanted[product] = max(quantity, wanted.get(product, quantity))
        else:
            wanted[product] = quantity + wanted.get(product, 0)
    for product, quantity in wanted.items():
        key = (r["branch"], product)
        if key not in stock or stock[key] < quantity:
            return "insufficient_stock"
    total = sum((prices[p] * q for p, q in lines), Decimal(0))
    return "underpaid" if r["paid"] < total else None
