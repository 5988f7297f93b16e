"""Position lists as pure column expressions: union, ordered chains, unordered windows.

`lists` is a column of arrays of positions in argument order, `n` a column; the number of lists may differ by row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTS = "array<int>"


def union(lists: Column) -> Column:
    """Distinct positions of all lists, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def _within(after: Column, p: Column, n: Column) -> Column:
    """Positions q > p of `after`, read up to the first one more than n beyond p (lists of chains are not sorted)."""
    stop = F.array_position(F.transform(after, lambda q: q - p > n), F.lit(True)).cast("int")
    read = F.when(stop == 0, after).otherwise(F.slice(after, F.lit(1), F.greatest(stop - 1, F.lit(0))))
    return F.filter(read, lambda q: q > p)


def chain_ends(lists: Column, n: Column) -> Column:
    """The last position of every chain p1 < p2 < ... with steps of at most n, depth first, repeats included."""
    rest = F.slice(lists, F.lit(2), F.size(lists) - 1)
    step = lambda ends, after: F.flatten(F.transform(ends, lambda p: _within(after, p, n)))
    return F.aggregate(rest, F.element_at(lists, 1), step)


def chain_count(lists: Column, n: Column) -> Column:
    """size(chain_ends) over ascending lists of distinct positions, without listing the chains."""
    counted = "array<struct<e:int,c:bigint>>"
    first = F.transform(F.element_at(lists, 1), lambda p: F.struct(p.alias("e"), F.lit(1).cast("bigint").alias("c"))).cast(counted)

    def step(state: Column, after: Column) -> Column:
        reach = lambda q: F.aggregate(F.filter(state, lambda s: (s["e"] < q) & (q - s["e"] <= n)), F.lit(0).cast("bigint"), lambda a, s: a + s["c"])
        return F.filter(F.transform(after, lambda q: F.struct(q.alias("e"), reach(q).alias("c"))), lambda s: s["c"] > 0).cast(counted)

    rest = F.slice(lists, F.lit(2), F.size(lists) - 1)
    return F.aggregate(F.aggregate(rest, first, step), F.lit(0).cast("bigint"), lambda a, s: a + s["c"])


def window_ends(lists: Column, n: Column) -> Column:
    """Matches of one position from each list within n words, any order: the largest position of each.

    One pointer for each list; a match moves all of them, otherwise those at the smallest position move.
    A single list is its own result.
    """
    state = "struct<at:array<int>,found:array<int>>"
    start = F.struct(F.transform(lists, lambda x: F.lit(0)).alias("at"), F.array().cast(_INTS).alias("found")).cast(state)

    def step(s: Column, _: Column) -> Column:
        now = F.zip_with(s["at"], lists, lambda i, x: F.get(x, i))
        over = F.exists(now, lambda p: p.isNull())
        low, high = F.array_min(now), F.array_max(now)
        match = high - low < n
        moved = F.zip_with(s["at"], now, lambda i, p: F.when(match | (p == low), i + 1).otherwise(i))
        found = F.when(match, F.concat(s["found"], F.array(high))).otherwise(s["found"])
        return F.when(over, s).otherwise(F.struct(moved.alias("at"), found.alias("found")).cast(state))

    turns = F.sequence(F.lit(1), F.greatest(F.size(F.flatten(lists)), F.lit(1)))
    return F.when(F.size(lists) == 1, F.element_at(lists, 1)).otherwise(F.aggregate(turns, start, step, lambda s: s["found"]))
