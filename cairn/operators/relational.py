"""Relational operators as DataFrame transformations: they say what is wanted, Catalyst and AQE choose how."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

COMPARE = {"=": operator.eq, "==": operator.eq, "<>": operator.ne, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
#: A side is broadcast on request only up to this size, by Catalyst's estimate.
BROADCAST_BYTES = 64 << 20
#: tiled_join: pairs that a task compares on average, rows of a tile, rows of one key that a task sorts, tasks.
TASK_PAIRS, TILE_ROWS, PART_ROWS, MOST_TASKS = 1 << 24, 1 << 10, 1 << 17, 1 << 17


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's output."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def filter_rows(df: DataFrame, *conditions: Column | str) -> DataFrame:
    """Rows for which every condition is true."""
    return reduce(DataFrame.filter, conditions, df)


def project(df: DataFrame, *exprs: Column | str, **named: Column) -> DataFrame:
    """Columns by name or expression, then named expressions."""
    return df.select(*exprs, *(e.alias(n) for n, e in named.items()))


def _on(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], compare: Sequence[tuple[str, str, str]] = ()) -> Column:
    terms = [left[a] == right[b] for a, b in keys] + [COMPARE[op](left[a], right[b]) for a, op, b in compare]
    return reduce(operator.and_, terms)


def hash_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", places: int | None = None) -> DataFrame:
    """Equi-join on (left column, right column) pairs; how: inner, left, right, full, left_semi, left_anti.

    Null keys match nothing. places: compare decimal keys rounded to so many places. Catalyst broadcasts a side
    that is small by its statistics and sorts or hashes both else; AQE splits skewed keys.
    """
    if places is None:
        return left.join(right, _on(left, right, keys), how)
    return left.join(right, reduce(operator.and_, [F.round(left[a], places) == F.round(right[b], places) for a, b in keys]), how)


def _extremes(build: DataFrame, keys: Sequence[tuple[str, str]], column: str) -> DataFrame:
    """For each key of build the least and greatest value of column: one row a key, aggregated before the shuffle."""
    own = [F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(keys)]
    return build.groupBy(*own).agg(F.min(column).alias("__least"), F.max(column).alias("__most")).filter("__least is not null")


#: Whether some value between least and most that occur satisfies value OP it.
_EXISTS = {
    "<": lambda x: x < F.col("__most"),
    "<=": lambda x: x <= F.col("__most"),
    ">": lambda x: x > F.col("__least"),
    ">=": lambda x: x >= F.col("__least"),
    "<>": lambda x: (x != F.col("__least")) | (x != F.col("__most")),
    "!=": lambda x: (x != F.col("__least")) | (x != F.col("__most")),
}


def _exists_join(probe: DataFrame, build: DataFrame, keys: Sequence[tuple[str, str]], compare: Sequence[tuple[str, str, str]], how: str) -> DataFrame:
    if len(compare) != 1 or compare[0][1] in ("=", "=="):
        return probe.join(build, _on(probe, build, keys, compare), how)
    column, op, other = compare[0]
    found = _extremes(build, keys, other)
    on = [probe[a] == found[f"__k{i}"] for i, (a, _) in enumerate(keys)] + [_EXISTS[op](probe[column])]
    return probe.join(found, reduce(operator.and_, on), how)


def semi_join(probe: DataFrame, build: DataFrame, keys: Sequence[tuple[str, str]], compare: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Rows of probe with a row of build of equal keys for which every (probe column, operator, build column) holds.

    With one inequality, build is reduced to its extremes per key first, so that a key of many rows on both sides
    isn't compared pair by pair.
    """
    return _exists_join(probe, build, keys, compare, "left_semi")


def anti_join(probe: DataFrame, build: DataFrame, keys: Sequence[tuple[str, str]], compare: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Rows of probe that semi_join leaves out; all of them if build is empty."""
    return _exists_join(probe, build, keys, compare, "left_anti")


def nested_loop_join(left: DataFrame, right: DataFrame, compare: Sequence[tuple[str, str, str]], how: str = "inner") -> DataFrame:
    """Theta join on (left column, operator, right column) terms; with an equality among them it is a hash join."""
    return left.join(right, _on(left, right, (), compare), how)


def replicated_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Equi-join with right copied to every task if its estimated size is at most most bytes, else a plain one."""
    on = _on(left, right, keys)
    return left.join(F.broadcast(right) if size_in_bytes(right) <= most else right, on, how)


def radix_join(left: DataFrame, right: DataFrame, key: tuple[str, str]) -> DataFrame:
    """Inner join of hash-partitioned sides, each partition joined by a hash table of right."""
    return left.join(right.hint("shuffle_hash"), _on(left, right, [key]))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], on: tuple[str, str], values: Sequence[str]) -> DataFrame:
    """left with the values of right's latest row, among those of equal keys, that isn't later than left's (on: both times).

    Nulls without such a row; of right's rows of one time the greatest values count. Both sides meet once, sorted by key
    and time; nothing is compared pair by pair.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    held = F.struct(*(F.col(v).alias(v) for v in values))
    a = left.select(*(F.col(k).alias(n) for (k, _), n in zip(keys, names, strict=True)), F.col(on[0]).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(held).schema[0].dataType).alias("__held"))
    b = right.select(*(F.col(k).alias(n) for (_, k), n in zip(keys, names, strict=True)), F.col(on[1]).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"), held.alias("__held"))
    b = b.filter(F.col("__t").isNotNull()).groupBy(*names, "__t", "__side", "__row").agg(F.max("__held").alias("__held"))
    order = Window.partitionBy(*names).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__held", F.last("__held", ignorenulls=True).over(order)).filter("__side = 1")
    known = reduce(operator.and_, [F.col(n).isNotNull() for n in names], F.col("__t").isNotNull())
    return found.select("__row.*", *(F.when(known, F.col("__held")[v]).alias(v) for v in values))


def _tiles(df: DataFrame, keys: Sequence[str], compare: Sequence[str], side: str, parts: int, rows: int) -> DataFrame:
    """Tiles of at most so many rows of one key: the key, the tile's part and number, each compared column's extremes, the rows.

    A key's rows fall into parts by a hash of all columns and are numbered by the first compared column and then that
    hash, so a task that runs again makes the same tiles.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    whole = F.xxhash64(*(F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema))
    row = F.struct(*(F.col(x).alias(f"{side}{i}") for i, x in enumerate(df.columns)))
    cut = df.select(*(F.col(x).alias(k) for k, x in zip(ks, keys, strict=True)), *(F.col(x).alias(f"{side}c{i}") for i, x in enumerate(compare)), row.alias(f"{side}s"), whole.alias("__hash"), F.pmod(whole, F.lit(parts)).alias(f"{side}p"))
    number = F.row_number().over(Window.partitionBy(*ks, f"{side}p").orderBy(*(f"{side}c{i}" for i in range(len(compare[:1]))), "__hash"))
    ends = [f(f"{side}c{i}").alias(f"{side}{end}{i}") for i in range(len(compare)) for end, f in (("least", F.min), ("most", F.max))]
    return cut.withColumn(f"{side}n", F.floor((number - 1) / rows)).groupBy(*ks, f"{side}p", f"{side}n").agg(F.collect_list(f"{side}s").alias(f"{side}s"), *ends)


def tiled_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], compare: Sequence[tuple[str, str, str]] = (), pairs: int = TASK_PAIRS, rows: int = TILE_ROWS, part: int = PART_ROWS) -> DataFrame:
    """Inner join on (left column, right column) keys that many rows share and (left column, operator, right column) terms.

    The pairs of equal keys are counted first. Up to pairs of them are left to a plain join; more are cut into tiles of
    rows of either side, which are dealt to tasks by the number of pairs, so neither many rows of one key nor a small
    input with many pairs makes a long task. Tiles whose extremes rule a term out never meet. A key's rows are sorted
    into tiles in parts of about part rows.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    sides = []
    for df, at in ((left, 0), (right, -1)):
        own, compared = [k[at] for k in keys], [term[at] for term in compare]
        sides.append((reduce(DataFrame.filter, [F.col(x).isNotNull() for x in {*own, *compared}], df), own, compared))
    a, b = (df.groupBy(*(F.col(x).alias(k) for k, x in zip(ks, own, strict=True))).agg(F.count("*").cast("double").alias(n)) for (df, own, _), n in zip(sides, ("__a", "__b"), strict=True))
    found, *most = a.join(b, ks, "full").agg(F.sum(F.col("__a") * F.col("__b")), F.max("__a"), F.max("__b")).first()
    if (found or 0) <= pairs:
        return left.join(right, _on(left, right, keys, compare))
    tiles = [_tiles(*side, name, math.ceil(n / part), rows) for side, name, n in zip(sides, ("__l", "__r"), most, strict=True)]
    meet = tiles[0].join(tiles[1], ks)
    for i, (_, op, _) in enumerate(compare):
        if op in ("<", "<=", ">", ">="):
            ends = ("least", "most") if op[0] == "<" else ("most", "least")
            meet = meet.filter(COMPARE[op](F.col(f"__l{ends[0]}{i}"), F.col(f"__r{ends[1]}{i}")))
    tile = [*ks, "__lp", "__ln", "__rp", "__rn"]
    meet = meet.select(*tile, "__ls", "__rs").repartition(min(math.ceil(found / pairs), MOST_TASKS), *tile)
    # Generated code holds all that an exploded row yields; transform isn't generated, so here it's a few rows against a tile.
    few = F.transform(F.sequence(F.lit(1), F.size("__ls"), F.lit(16)), lambda i: F.slice("__ls", i, 16))
    met = meet.select("__rs", F.explode(few).alias("__ls")).select("__rs", F.inline("__ls")).select("*", F.inline("__rs"))
    for x, op, y in compare:
        met = met.filter(COMPARE[op](F.col(f"__l{left.columns.index(x)}"), F.col(f"__r{right.columns.index(y)}")))
    return met.select(*(F.col(f"{name}{i}").alias(x) for name, df in (("__l", left), ("__r", right)) for i, x in enumerate(df.columns)))


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with right.low <= left.point <= right.high, numbers: both sides meet in bins of width (about an interval's length)."""
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = right.filter(F.col(low) <= F.col(high)).withColumn("__bins", F.explode(bins))
    binned = left.withColumn("__bin", F.floor(F.col(point) / width))
    return tiled_join(binned, spread, [("__bin", "__bins")], [(point, ">=", low), (point, "<=", high)]).drop("__bin", "__bins")


def same_rows(a: DataFrame, b: DataFrame, places: int | None = None) -> bool:
    """Whether both have the same columns and rows, in any order, repeated ones counted; places: decimals rounded before."""
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        return False
    if places is not None:
        near = [F.round(f.name, places).alias(f.name) if f.dataType.typeName() in ("float", "double") else F.col(f.name) for f in a.schema]
        a, b = a.select(near), b.select(near)
    counted = [df.groupBy(*df.columns).agg(F.count("*").alias("__n")) for df in (a, b)]
    return counted[0].exceptAll(counted[1]).isEmpty() and counted[1].exceptAll(counted[0]).isEmpty()


def aggregate(df: DataFrame, keys: Sequence[Column | str] = (), having: Column | str | None = None, **aggs: Column) -> DataFrame:
    """Groups by keys (none: one row) with named aggregates, then the groups for which having is true."""
    out = df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggs.items())) if keys else df.agg(*(a.alias(n) for n, a in aggs.items()))
    return out if having is None else out.filter(having)


def order_by(df: DataFrame, *keys: str | tuple[str, str], nulls: str = "last") -> DataFrame:
    """Rows by column names or (name, "asc" or "desc") pairs; nulls: first or last, for every key."""
    pairs = [(k, "asc") if isinstance(k, str) else k for k in keys]
    return df.orderBy(*(getattr(F.col(name), f"{way}_nulls_{nulls}")() for name, way in pairs))


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """n rows after the first offset ones; after order_by a top-n, kept per task and merged."""
    return (df.offset(offset) if offset else df).limit(n)


def collect(df: DataFrame) -> list[Row]:
    """All rows on the driver."""
    return df.collect()
