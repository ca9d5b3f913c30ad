"""Joins on keys of many rows: the pairs are dealt to tasks by their number, and all of them come out."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import range_join, tiled_join
from cairn.operators.relational import COMPARE
from cairn.plans.catalogue import QUERIES

NAN = float("nan")


def order(x):
    """Spark's order of doubles: NaN is equal to itself and above all others, zeros are equal."""
    return (1, 0.0) if math.isnan(x) else (0, x + 0.0)


@pytest.mark.parametrize("compare", [[], [("x", "<", "y")], [("x", ">=", "y"), ("x", "<=", "z")], [("x", "<>", "y"), ("x", ">", "z")], [("x", "=", "y")]])
def test_tiles_against_brute_force(spark, compare):
    rnd = random.Random(len(compare))
    ks, xs = [0.0, -0.0, 1.5, 1.5, 1.5, NAN, None], [*map(float, range(6)), -0.0, NAN, None]
    left = [(i // 2, rnd.choice(ks), rnd.choice(xs)) for i in range(60)] + [(7, 1.5, 2.0)] * 9
    right = [(i // 2, rnd.choice(ks), rnd.choice(xs), rnd.choice(xs)) for i in range(50)] + [(8, 1.5, 2.0, 3.0)] * 9
    a, b = spark.createDataFrame(left, "id int, k double, x double"), spark.createDataFrame(right, "id int, k2 double, y double, z double")
    want = []
    for (i, k, x), (j, k2, y, z) in itertools.product(left, right):
        of = {"x": x, "y": y, "z": z}
        known = None not in (k, k2) and all(None not in (of[p], of[q]) for p, _, q in compare)
        if known and order(k) == order(k2) and all(COMPARE[op](order(of[p]), order(of[q])) for p, op, q in compare):
            want.append((i, str(x), j, str(y), str(z)))
    for pairs, rows, part in ((1 << 30, 3, 5), (40, 3, 5), (7, 1, 1000)):
        got = tiled_join(a, b, [("k", "k2")], compare, pairs, rows, part)
        assert got.columns == ["id", "k", "x", "id", "k2", "y", "z"]
        rows_ = got.toDF("i", "k", "x", "j", "k2", "y", "z").collect()
        assert sorted((r.i, str(r.x), r.j, str(r.y), str(r.z)) for r in rows_) == sorted(want)


def test_tiles_of_nothing_and_of_maps(spark):
    none = spark.createDataFrame([], "k int, x int")
    assert tiled_join(none, none.toDF("k2", "y"), [("k", "k2")], pairs=0).isEmpty()
    maps = spark.range(30).select(F.lit(1).alias("k"), F.create_map("id", "id").alias("m"))
    assert tiled_join(maps, maps.toDF("k2", "m2"), [("k", "k2")], pairs=100, rows=4).count() == 900


def test_rounded_keys_of_many_rows_are_dealt(spark, tmp_path):
    n = 6000
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit(900.0).alias("p_retailprice")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pairs = QUERIES["join_float_2dp"](spark, str(tmp_path))
    assert pairs.rdd.getNumPartitions() >= 3
    got = pairs.agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).first()
    assert (got.n, got.x, got.y) == (n * (n - 1) // 2, sum(i * (n - 1 - i) for i in range(n)), sum(i * i for i in range(n)))


def test_bins_of_many_rows_are_dealt(spark, tmp_path):
    parts, spans = 12000, 3000
    spark.range(parts).select(F.col("id").alias("p_partkey"), (900.0 + F.col("id") % 40).alias("p_retailprice")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(spans).select(F.col("id").alias("s_suppkey"), (880.0 + F.col("id") % 30).alias("s_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = QUERIES["range_join"](spark, str(tmp_path))
    assert pairs.rdd.getNumPartitions() >= 3
    want = [(p, s) for p in range(40) for s in range(30) if 880 + s <= 900 + p <= 930 + s]
    got = pairs.groupBy((F.col("p_partkey") % 40).alias("p"), (F.col("s_suppkey") % 30).alias("s")).count().collect()
    assert sorted(tuple(r) for r in got) == [(p, s, parts // 40 * (spans // 30)) for p, s in want]


@pytest.mark.parametrize("rows", [0, 40])
def test_range_join_in_tiles(spark, monkeypatch, rows):
    rnd = random.Random(rows)
    spans = [(i, a := rnd.uniform(-50, 50), a + rnd.uniform(-5, 40)) for i in range(rows)]
    points = [(i, rnd.uniform(-60, 60)) for i in range(50)] + [(98, -0.0), (99, None)]
    monkeypatch.setattr(tiled_join, "__defaults__", ((), 20, 4, 16))
    pairs = range_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "s int, low double, high double"), "x", "low", "high", 17.0)
    assert pairs.columns == ["p", "x", "s", "low", "high"]
    assert sorted((q.p, q.s) for q in pairs.collect()) == sorted((p, s) for p, x in points for s, a, b in spans if x is not None and a <= x <= b)
