"""Slices of a database table that hold about as many rows each.

The database counts its rows per hour; neighbouring hours are merged until a slice is
full. An hour that alone overfills one is counted again by minute, and a minute by second.
Keys are the beginnings of timestamps as text, whose order is that of time; slices are
bounded on the bare column, so the database answers them from its time index.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

#: Levels that rows are counted by, coarse to fine, and the characters of their keys.
LEVELS = {"hour": 13, "minute": 16, "second": 19}

# How each database writes the beginning of a timestamp as text.
_MYSQL_FORMS = {"hour": "%Y-%m-%d %H:00:00", "minute": "%Y-%m-%d %H:%i:00", "second": "%Y-%m-%d %H:%i:%s"}
_POSTGRES_FORM = "YYYY-MM-DD HH24:MI:SS"

Counts = Sequence[tuple[str, int]]


@dataclass(frozen=True)
class Slice:
    """Rows from the key ``low`` up to the key ``high``; None where it is open."""

    low: str | None
    high: str | None
    rows: int

    def predicate(self, column: str = "request_ts") -> str:
        bounds = [f"{column} >= '{self.low}'"] if self.low is not None else []
        bounds += [f"{column} < '{self.high}'"] if self.high is not None else []
        return " AND ".join(bounds) or f"{column} IS NOT NULL"


def key_expression(kind: str, level: str, column: str = "request_ts") -> str:
    """The beginning of a timestamp as text, in the words of the database."""
    if kind == "mysql":
        return f"DATE_FORMAT({column}, '{_MYSQL_FORMS[level]}')"
    if kind == "postgresql":
        return f"TO_CHAR(DATE_TRUNC('{level}', {column}), '{_POSTGRES_FORM}')"
    return f"SUBSTR({column}, 1, {LEVELS[level]})"  # stored as text


def count_query(kind: str, table: str, level: str, low: str | None = None, high: str | None = None) -> str:
    """Rows per key of a level, in part of the table; one row per key comes back."""
    key = key_expression(kind, level)
    where = Slice(low, high, 0).predicate()
    return f"SELECT {key} AS slot, COUNT(*) AS n FROM {table} WHERE {where} GROUP BY {key}"


def equal_depth(counts: Counts, rows: int) -> list[Slice]:
    """Neighbouring keys merged into slices of at most ``rows`` rows, keys permitting.

    The slices cover all moments once: the first is open below, the last above, and
    what lies between two keys belongs to the first of them.
    """
    if rows < 1:
        raise ValueError("a slice has at least one row")
    starts, sizes = [], []
    for key, n in sorted(counts):
        if not starts or sizes[-1] + n > rows:
            starts.append(key)
            sizes.append(0)
        sizes[-1] += n
    if not starts:
        return [Slice(None, None, 0)]
    lows, highs = [None, *starts[1:]], [*starts[1:], None]
    return [Slice(low, high, n) for low, high, n in zip(lows, highs, sizes)]


def planned(count: Callable[[str, str | None, str | None], Counts], rows: int, low: str | None = None) -> list[Slice]:
    """Slices of about ``rows`` rows from the key ``low`` on.

    ``count(level, low, high)`` asks the database. Only keys that overfill a slice are
    counted on the next level, all neighbouring ones at once; a second that does stays
    one slice. What comes back is bounded by the hours of the log and, for each slice
    beyond one an hour, by 120 finer keys.
    """
    levels = list(LEVELS)
    found = sorted(count(levels[0], low, None))
    for level in levels[1:]:
        keys = [key for key, _ in found]
        full = [i for i, (_, n) in enumerate(found) if n > rows]
        finer: list[tuple[str, int]] = []
        for first, last in _neighbours(full):
            begin = low if first == 0 else keys[first]
            end = keys[last + 1] if last + 1 < len(keys) else None
            finer += count(level, begin, end)
        found = sorted([c for i, c in enumerate(found) if i not in set(full)] + finer)
    return [Slice(low if s.low is None else s.low, s.high, s.rows) for s in equal_depth(found, rows)]


def _neighbours(places: list[int]) -> list[tuple[int, int]]:
    """First and last of each unbroken row of places."""
    out: list[tuple[int, int]] = []
    for i in places:
        if out and out[-1][1] == i - 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out
