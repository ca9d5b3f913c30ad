"""Connected components of an edge table, by repeated joins (large-star, small-star); nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


#: Edges that a task writes at least, so that few edges don't end up in very many files.
TASK_EDGES = 20_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns id and root (the least id reachable) for every id of edges (a, b bigint, not null).

    Each round links every id's neighbours to the least of them and itself, first the larger ones, then the
    smaller ones; the least id of an id's neighbours is a map-side aggregate, so an id with very many neighbours
    isn't gathered. Rounds are written to the shared folder. More than most_rounds raise RuntimeError.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    files = 1 + now.count() // TASK_EDGES  # rounds have about as many edges
    for _ in range(most_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a")
        old, now = now, materialize(
            star.select("a", F.col("m").alias("b")).union(star.filter("b <> m").select("b", "m")).filter("a <> b").distinct().coalesce(files), "edges"
        )
        drop(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
        seen = state
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
