"""Ranges of a table's id that hold about equally many rows.

Ranges of equal width do not: where ids have gaps, most of them are empty and one holds
nearly all rows. Here the database counts ids in bins, crowded bins are counted again in narrower
ones, and ranges end where the counts say. It answers with a few hundred rows at a time.
"""

from collections.abc import Callable
from typing import NamedTuple

BINS = 256


class Bin(NamedTuple):
    """Least and greatest id found in it, and how many rows."""

    low: int
    high: int
    rows: int


# Counts the ids from the first to the second number in bins of a width.
CountBins = Callable[[int, int, int], list[Bin]]


def bounds_sql(table: str, column: str) -> str:
    return f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}"


def bins_sql(table: str, column: str, low: int, high: int, width: int) -> str:
    """Only bins that have rows come back."""
    return (
        f"SELECT MIN({column}) AS low, MAX({column}) AS high, COUNT(*) AS num_rows FROM {table} "
        f"WHERE {column} >= {low} AND {column} <= {high} GROUP BY FLOOR(({column} - {low}) / {width})"
    )


def histogram(count: CountBins, low: int, high: int, parts: int) -> list[Bin]:
    """Bins in ascending order, none with more than half of one of ``parts`` shares, unless a single id has more.

    Each round makes a crowded bin ``BINS`` times narrower, and fewer than twice ``parts`` can be
    crowded, so rounds are few: three for a million million ids.
    """
    whole = [Bin(low, high, -1)]
    most = None
    while True:
        found: list[Bin] = []
        for one in whole:
            if one.rows >= 0 and (one.rows <= most or one.low == one.high):
                found.append(one)
            else:
                found += count(one.low, one.high, max(1, -(-(one.high - one.low + 1) // BINS)))
        found.sort()
        if most is None:
            most = sum(one.rows for one in found) / (2 * parts)
        if len(found) == len(whole):
            return found
        whole = found


def split_points(bins: list[Bin], parts: int) -> list[int]:
    """Ids at which ranges begin, the first one aside; at most ``parts`` - 1."""
    share = sum(one.rows for one in bins) / parts
    points, rows, due = [], 0, share
    for at, one in enumerate(bins[:-1]):
        rows += one.rows
        if rows >= due - one.rows / 2:
            points.append(bins[at + 1].low)
            due = share * (len(points) + 1)
    return points[: parts - 1]


def predicates(points: list[int], column: str) -> list[str]:
    """One condition for each range; every row meets exactly one, nulls the first, new ids the last."""
    if not points:
        return ["1 = 1"]
    first = f"{column} < {points[0]} OR {column} IS NULL"
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(points, points[1:])]
    return [first, *inner, f"{column} >= {points[-1]}"]


def ranges(bounds: tuple[int | None, int | None], count: CountBins, parts: int, column: str) -> list[str]:
    """Conditions for ``parts`` ranges, or fewer where there are fewer ids."""
    low, high = bounds
    if low is None or high is None or low == high or parts < 2:
        return predicates([], column)
    return predicates(split_points(histogram(count, low, high, parts), parts), column)
