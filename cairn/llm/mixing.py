"""Mixing sources to target weights; only DataFrame expressions.

The words of a source's documents, laid end to end in a fixed order, are packed into blocks of fixed length. Each
output shard draws, slot by slot, from which source its blocks come: a multinomial draw, whose outcome is how many
blocks the mixture takes of a source. The draws go in waves; each wave's weights are what the waves before left of
the targets, so that the totals come near them also where there are few blocks. A source's slots, counted through
all shards, are mapped through a pseudorandom permutation of its block numbers, a new one for each pass, and joined
with the blocks by number. Everything follows from hashes of seed, shard and slot: reruns agree.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

#: The weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """How many words a text has; a null text has none."""
    spaces = r"[\x20\x09-\x0D]*"
    return F.char_length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{spaces}", ""), f"{WORD}{spaces}", "w")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Columns source, source_size, target, weight of each source; sizes has source and source_size.

    share of all sizes is dealt out by weight. Targets stop at most times the size, the excess going to the others
    by weight: with level the words per weight of those that don't stop, a target is min(cap, level * weight). In
    order of cap / weight, the level is found at the first source that doesn't stop. One row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.lit(list(weights))
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).cast("double")).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everyone = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everyone) * share
    left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left
    tried = ranked.withColumn("level", level).withColumn("free", F.col("level") <= F.col("cap") / F.col("weight"))
    settled = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everyone)["level"]
    return tried.withColumn("target", F.least("cap", F.coalesce(settled * F.col("weight"), F.col("cap")))).select("source", "source_size", "target", "weight")


def _permute(df: DataFrame, i: str, n: str, seed: str, rounds: int = 3) -> DataFrame:
    """df with column i, 0 to n - 1, mapped through a pseudorandom permutation of these numbers; n below 2**42.

    Each round multiplies the numbers below the largest power of two in n by an odd number and xors their upper
    half into the lower, within their bits, then rotates all mod n; every step is one to one.
    """
    df = df.withColumn("__bits", F.length(F.bin(n)) - 1).withColumn("__top", F.expr("shiftleft(1L, __bits)")).withColumn("__half", F.expr("greatest(1, (__bits + 1) div 2)"))
    for r in range(rounds):
        odd = F.pmod(F.xxhash64(seed, F.lit(2 * r)), F.lit(1 << 18)) * 2 + 1
        df = df.withColumn("__mixed", (F.col(i) * odd).bitwiseAND(F.col("__top") - 1))
        df = df.withColumn(i, F.when(F.col(i) < F.col("__top"), F.expr("__mixed ^ shiftright(__mixed, cast(__half as int))")).otherwise(F.col(i)))
        df = df.withColumn(i, (F.col(i) + F.pmod(F.xxhash64(seed, F.lit(2 * r + 1)), F.col(n))) % F.col(n))
    return df.drop("__bits", "__top", "__half", "__mixed")


def _search(array: Column, value: Column, most: int) -> Column:
    """How many of an ascending array's values (most at most) are not above value: a binary search."""
    steps = [1 << k for k in reversed(range(max(1, most.bit_length())))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: at + F.when(F.get(array, at + step - 1) <= value, step).otherwise(0))


def streams(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each document's words stand in its source's stream: docs (row, k, source, size) with sid and start.

    Documents are dealt to buckets of a few thousand by a hash of key and size (so that a key's many texts part); sums over buckets, then within each,
    give the places, so a source of any size is spread out.
    """
    n = docs.count()
    bucketed = docs.withColumn("bucket", F.pmod(F.when(F.col("k").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("k", "size")), F.lit(max(1, n // 4096))))
    known = sources.select("sid", F.col("source").alias("s2"))
    numbered = bucketed.join(known, F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "source")
    sums = numbered.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = Window.partitionBy("sid", "bucket").orderBy("k", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(offsets, ["sid", "bucket"]).select("row", "k", "sid", "size", (F.col("offset") + F.col("before")).alias("start"))


def waves(slots: list[int], near: float) -> list[tuple[int, int]]:
    """Ranges of all slots' numbers, halving what is left, until the deviation of a last one's draw is a share near of the least target."""
    total, least = sum(slots), min((n for n in slots if n), default=1)
    last, at, out = max(4, int(near * near * total * least)), 0, []
    while total - at > last:
        out.append((at, at + (total - at + 1) // 2))
        at = out[-1][1]
    return [*out, (at, total)] if at < total else out


def drawn(spark: SparkSession, slots: list[int], shards: int, seed: int, near: float) -> DataFrame | None:
    """Columns sid (from 1), shard, n: how many of each shard's slots fall to each source; slots: the sources' targets."""
    left, parts = list(slots), []
    todo = waves(slots, near)
    for k, (low, high) in enumerate(todo):
        tos = list(accumulate(left))
        slot = spark.range(low, high, 1, max(1, min(high - low, 2 * spark.sparkContext.defaultParallelism), (high - low) >> 19))
        shard = F.expr(f"cast(id % {shards} as int)")
        u = F.pmod(F.xxhash64(F.lit(seed), shard, F.expr(f"id div {shards}")), F.lit(tos[-1]))
        part = slot.select((_search(F.lit(tos).cast("array<bigint>"), u, len(tos)) + 1).alias("sid"), shard.alias("shard")).groupBy("sid", "shard").agg(F.count("*").alias("n"))
        parts.append(part)
        if k + 1 < len(todo):
            for r in part.groupBy("sid").agg(F.sum("n").alias("n")).collect():  # a row for each source
                left[r["sid"] - 1] = max(0, left[r["sid"] - 1] - r["n"])
    return reduce(DataFrame.unionAll, parts).groupBy("sid", "shard").agg(F.sum("n").alias("n")) if parts else None


def slots(sources: DataFrame, shards: int, seed: int, most: int, near: float = 0.005, chunk: int = 4096) -> DataFrame:
    """Every slot of the mixture: shard, sid, pass, block. sources: sid (1, 2, ...), blocks, slots (the target in blocks).

    Draws beyond most passes over a source are void. The driver holds a number for each source.
    """
    spark = sources.sparkSession
    wanted = [r["slots"] for r in sources.select("sid", "slots").orderBy("sid").collect()]
    counts = drawn(spark, wanted, shards, seed, near)
    if counts is None:
        return spark.createDataFrame([], "shard int, sid int, pass bigint, block bigint")
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranged = counts.join(sources.select("sid", "blocks"), "sid").withColumn("low", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("high", F.least(F.col("low") + F.col("n"), F.col("blocks") * most))
    # a source's slots of a shard stand side by side: ranges of bounded length, then their numbers
    ranges = ranged.filter("low < high").select("sid", "shard", "blocks", "high", F.explode(F.sequence("low", F.col("high") - 1, F.lit(chunk).cast("long"))).alias("at"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(wanted) >> 18)
    numbers = ranges.repartition(parts, "sid", "at").select("sid", "shard", "blocks", F.explode(F.sequence("at", F.least(F.col("at") + chunk, "high") - 1)).alias("i"))
    found = numbers.select("sid", "shard", "blocks", F.expr("i div blocks").alias("pass"), F.expr("i % blocks").alias("block"))
    listed = _permute(found.withColumn("seed", F.xxhash64(F.lit(seed), "sid", "pass")), "block", "blocks", "seed").select("shard", "sid", "pass", "block")
    # ranges make far more rows than Catalyst's estimate knows of: never broadcast
    return listed.hint("merge")


def plan(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, block: int) -> tuple[DataFrame, DataFrame]:
    """sources (sid, source, source_size, target, blocks, slots) and streams (row, k, sid, size, start) of docs (row, k, source, size)."""
    found = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots_ = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), F.floor(blocks * most).cast("long"))).otherwise(0)
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = materialize(found.select(sid.alias("sid"), "source", "source_size", "target", blocks.alias("blocks"), slots_.alias("slots")), "sources")
    return sources, streams(docs, sources)


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """Each document's parts: block, and the words from first to last (of the document, from 0) that stand in it; size 0: one row of nulls."""
    numbers = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    cut = placed.select("row", "k", "sid", "size", "start", F.explode_outer(numbers).alias("block"))
    low, high = F.greatest(F.col("block") * block - F.col("start"), F.lit(0)), F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    return cut.select("row", "k", "sid", "size", "block", low.alias("first"), high.alias("end"))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = 64, shards: int = 32, seed: int = 1, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """How many words the mixture takes of each document.

    Columns key, size, source_size, target (the source's), taken, n_shards (output shards that hold some of its
    words); one row per input row, repeated rows and null keys included. A null text has size 0; a null source is
    a source of its own, the last. Sources are few: targets and draws keep a number for each in one place.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "words")
    sources, placed = plan(rows, weights, share, most, block)
    # most shards at most for each block
    chosen = slots(sources, shards, seed, most).groupBy("sid", "block").agg(F.count("*").alias("times"), F.collect_set("shard").alias("in")).hint("merge")
    found = _pieces(placed, block).join(chosen, ["sid", "block"], "left")
    per_row = found.groupBy("row", "k", "sid", "size").agg(
        F.coalesce(F.sum((F.col("end") - F.col("first")) * F.col("times")), F.lit(0)).alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_set("in")))).cast("long").alias("n_shards")
    )
    return per_row.join(sources.select("sid", "source_size", "target"), "sid").select(F.col("k").alias(key), "size", "source_size", "target", "taken", "n_shards")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = 64, shards: int = 32, seed: int = 1, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixture as documents: docs with each text cut down to the words taken of it, in order, and out_shards.

    A row for each pass over a source and document of which that pass takes words; white space after a word goes
    with it. out_shards: the output shards that drew those words, in order. Documents of which nothing is taken have
    no row. Other columns are kept as they are; if out_shards is one of them, the new one has underscores before it.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mixed")
    sizes = materialize(rows.select(F.col("__row").alias("row"), F.col(key).alias("k"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "words")
    sources, placed = plan(sizes, weights, share, most, block)
    chosen = slots(sources, shards, seed, most)
    spans = _pieces(placed, block).join(chosen, ["sid", "block"]).groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "end", "shard"))).alias("__spans"))
    parts = F.regexp_extract_all(F.col(text), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    # the words are bound by a lambda of their own, so that they are cut out once for all spans
    cut = F.transform(F.array(parts), lambda words: F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(words, (s["first"] + 1).cast("int"), (s["end"] - s["first"]).cast("int")))), ""))[0]
    held = rows.join(spans.select(F.col("row").alias("__row"), "__spans"), "__row")
    name = free_name(docs, "out_shards")
    return held.select(*(cut.alias(c) if c == text else F.col(c) for c in docs.columns), F.array_sort(F.array_distinct(F.transform("__spans", lambda s: s["shard"]))).alias(name))
