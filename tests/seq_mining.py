"""Recurring-set mining one basket at a time, from a table of decisions over the rules R1-R6.

Test oracle only.  A basket is placed in a zone by its best coefficient, and
the sizes left over on either side choose a row of ``DECISIONS``; the row's
steps are then carried out in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# (zone, basket has enough left, set has enough left) -> steps
DECISIONS = {
    ("far", True, True): ["found"], ("far", True, False): ["found"],
    ("part", True, True): ["offer basket rest"], ("part", True, False): ["offer basket rest"],
    ("near", True, False): ["offer basket rest", "count"],
    ("near", False, True): ["shrink", "offer set rest"],
    ("near", True, True): ["shrink", "offer basket rest", "offer set rest"],
    ("near", False, False): ["count"],
}


@dataclass
class Line:
    now: frozenset
    seen: set = field(default_factory=set)


def coefficient(x, y) -> float:
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def nearest(lines: list[Line], x) -> tuple[float, Line | None]:
    """Best coefficient and its line, the oldest on a tie; no line if nothing overlaps."""
    ranked = sorted(((coefficient(x, line.now), -age) for age, line in enumerate(lines)), reverse=True)
    if not ranked or ranked[0][0] == 0:
        return 0.0, None
    return ranked[0][0], lines[-ranked[0][1]]


def one_basket(lines: list[Line], key, basket: frozenset, min_size: int, high: float, low: float) -> None:
    r, line = nearest(lines, basket)
    zone = "near" if r > high else "part" if r > low else "far"
    known = line.now if line and zone != "far" else frozenset()
    rest = {"basket": basket - known, "set": known - basket}
    row = (zone, len(rest["basket"]) >= min_size, len(rest["set"]) >= min_size)
    for step in DECISIONS.get(row, []):
        if step == "found":
            lines.append(Line(basket, {key}))
        elif step == "count":
            line.seen.add(key)
        elif step == "shrink" and len(known & basket) > min_size:
            line.now, line.seen = known & basket, {key}
        elif step.startswith("offer"):
            offer = frozenset(rest[step.split()[1]])
            again, other = nearest(lines, offer)
            if again > high:
                other.seen.add(key)
            else:
                lines.append(Line(offer, {key}))


def mine(baskets, min_size: int, passes: int, high: float = 0.8, low: float = 0.2) -> list[Line]:
    """``baskets``: (key, accounts) in processing order; the lines after the last pass."""
    lines: list[Line] = []
    for _ in range(passes):
        for line in lines:
            line.seen = set()
        for key, accounts in baskets:
            one_basket(lines, key, frozenset(accounts), min_size, high, low)
    return lines
