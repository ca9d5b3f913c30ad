"""Neighbours and running sums over a whole table in id order, without a task that sees all rows.

Rows are ordered by key, nulls first, and those of equal key by a tie, a hash of what they hold. The table is cut into
ranges of that order of about equal row counts; a key, or null, that holds much of the table is cut by its ties.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
#: Upper bounds of ranges: (key, tie), in order.
Bounds = list[tuple[int | None, int]]


def id_bounds(df: DataFrame, key: str, n: int) -> Bounds:
    """Upper bounds, but for the last range, of some n ranges. Ties are taken to be spread evenly over all 64-bit integers."""
    if n < 2:
        return []
    q, rows, known = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n), F.count("*"), F.count(key)).first()
    shares: list[tuple[int | None, int]] = [(None, round(n * (rows - known) / rows))] if rows > known else []
    shares += sorted(Counter(int(x) for x in q or []).items())
    out: Bounds = []
    for k, m in shares:
        out += [(k, _LOW + (j << 64) // m) for j in range(1, m)]
        out.append((k, _HIGH))
    return out


def bucket_of(key: str, tie: str, bounds: Bounds) -> Column:
    """The number of bounds below a row, by a binary search inside the expression."""

    def search(bounds: Bounds, above) -> Column:
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: at + F.when(above(at + step - 1), step).otherwise(0)) if bounds else F.lit(0)

    none, some = [b for b in bounds if b[0] is None], [b for b in bounds if b[0] is not None]
    held = [F.lit([x[i] for x in b] or [0]).cast("array<bigint>") for b, i in ((none, 1), (some, 0), (some, 1))]
    by_tie = search(none, lambda at: F.get(held[0], at) < F.col(tie))
    by_both = search(some, lambda at: (F.get(held[1], at) < F.col(key)) | ((F.get(held[1], at) == F.col(key)) & (F.get(held[2], at) < F.col(tie))))
    return F.when(F.col(key).isNull(), by_tie).otherwise(by_both + len(none))


def dealt(df: DataFrame, buckets: int, bucket: str) -> DataFrame:
    """One partition for each bucket number below buckets."""
    return df.repartitionById(buckets, F.col(bucket)) if hasattr(df, "repartitionById") else df.repartitionByRange(buckets, bucket)
