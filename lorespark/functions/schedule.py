"""Checks of schedule intents: cron expressions and time zones. Nothing here runs a schedule."""

from __future__ import annotations

import re
from zoneinfo import available_timezones

# The fields of a cron expression with their bounds and names.
FIELDS = ((0, 59, ()), (0, 23, ()), (1, 31, ()), (1, 12, ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")), (0, 7, ("sun", "mon", "tue", "wed", "thu", "fri", "sat")))


def valid_cron(text: str) -> bool:
    """Five fields of numbers or names, ranges, lists and steps, each within its bounds."""
    fields = text.split()
    return len(fields) == 5 and all(all(_segment(s, *bounds) for s in f.split(",")) for f, bounds in zip(fields, FIELDS))


def _segment(text: str, low: int, high: int, names: tuple[str, ...]) -> bool:
    m = re.fullmatch(r"(\*|[0-9]+|[A-Za-z]{3})(?:-([0-9]+|[A-Za-z]{3}))?(?:/([0-9]+))?", text)
    if not m or m.group(1) == "*" and m.group(2):
        return False

    def value(x: str) -> int | None:
        n = int(x) if x.isdigit() else names.index(x.lower()) + (low if low else 0) if x.lower() in names else None
        return n if n is not None and low <= n <= high else None

    first = low if m.group(1) == "*" else value(m.group(1))
    last = first if not m.group(2) else value(m.group(2))
    return first is not None and last is not None and first <= last and (m.group(3) is None or 1 <= int(m.group(3)) <= high)


def valid_timezone(name: str) -> bool:
    return name in available_timezones()
