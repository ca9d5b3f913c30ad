"""Document fingerprints: SimHash, and permuted block tables that find all fingerprints within a Hamming radius.

The terms are the five-word shingles of shingles.py (a shorter text has one), weighted by how often they occur.
Each term's 128-bit hash votes for or against each bit; a bit is set if the votes for it prevail. A text without
words has no votes and so the fingerprint 0.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8
from .order import bucket_of, dealt, id_bounds
from .shingles import mix, shingles, words

BITS = 128
#: Bits in which near copies (likeness 0.8 of shingle sets) differ at most, but for few; unrelated texts differ in about 64.
NEAR_BITS = 28
#: A byte's eight bits as eight counters of one byte each, so that adding 64-bit words counts eight bits at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def fingerprints(column: pa.Array, width: int = 5, parts: int = 512) -> np.ndarray:
    """One row of 16 bytes for each text. parts: how many runs of 255 terms at most are summed at a time."""
    data, offsets = utf8(column)
    runs, at = shingles(*words(data, offsets), width)
    n = len(at) - 1
    votes = np.zeros((n, BITS // 8, 8), np.int64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        # a counter holds 255 at most: long texts are summed in runs
        cuts = [np.arange(a, b, 255) for a, b in zip(at[full], at[full + 1], strict=True)]
        owner, begins = np.repeat(full, [len(x) for x in cuts]), np.concatenate(cuts)
        for i in range(0, len(begins), parts):
            low, high = begins[i], begins[i + parts] if i + parts < len(begins) else len(runs)
            own = runs[low:high]
            bits = np.stack([own, mix(own + np.uint64(0xA0761D6478BD642F))], axis=1).view(np.uint8)
            sums = np.add.reduceat(_LANES[bits], begins[i : i + parts] - low, axis=0)
            np.add.at(votes, owner[i : i + parts], sums.view(np.uint8).reshape(len(sums), BITS // 8, 8))
    return np.packbits(2 * votes > np.diff(at)[:, None, None], axis=2)[:, :, 0]


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key and fingerprint (32 hexadecimal digits), one row per input row; a null text counts as empty."""

    def run(batches):
        for batch in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in fingerprints(batch.column(1))])], [key, "fingerprint"])

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def _half(text: str, half: int) -> Column:
    return F.conv(F.substring(text, 1 + 16 * half, 16), 16, -10).cast("bigint")


def distance(a: str, b: str) -> Column:
    """Bits in which two fingerprint columns differ."""
    return sum((F.bit_count(_half(a, i).bitwiseXOR(_half(b, i))) for i in range(2)), F.lit(0))


def within(queries: DataFrame, prints: DataFrame, radius: int, agree: int = 1) -> DataFrame:
    """All pairs (fingerprint of queries, fingerprint of prints) of different fingerprints at most radius bits apart.

    The bits are cut into radius + agree blocks. Fingerprints that near agree in agree blocks at least, so each
    choice of agree blocks makes a table, keyed by those blocks' bits; candidates share a key in some table and are
    then compared in full. No pair is missed. Equal fingerprints are taken once: copies are for the caller to count.
    A larger agree makes more tables with longer keys and so fewer candidates.
    """
    blocks = radius + agree
    edges = [round(32 * i / blocks) for i in range(blocks + 1)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = [F.concat(F.lit(f"{k}:"), *(F.substring("fingerprint", edges[i] + 1, edges[i + 1] - edges[i]) for i in chosen)) for k, chosen in enumerate(combinations(range(blocks), agree))]
        return df.select("fingerprint").filter("fingerprint is not null").distinct().select(F.col("fingerprint").alias(name), F.explode(F.array(*keys)).alias("key"))

    pairs = tables(queries, "a").join(tables(prints, "b"), "key").filter(F.col("a") != F.col("b"))
    return pairs.withColumn("distance", distance("a", "b")).filter(F.col("distance") <= radius).select("a", "b", "distance").distinct()


def near_lists(queries: DataFrame, prints: DataFrame, radius: int, most: int = 32768, key: str = "doc_id") -> DataFrame:
    """For radii too wide for block tables: columns a (fingerprint of queries) and near, the ids in order of all other
    fingerprints of prints at most radius bits apart; no row for a fingerprint without any.

    A fingerprint's id is its least key, so copies are listed once. Every query is compared with every fingerprint,
    in tiles of about most by most of them; a tile gives one row for each query that finds something. Rows of prints
    with a null fingerprint or key are left out.
    """
    left = queries.select("fingerprint").filter("fingerprint is not null").distinct()
    right = prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min(key).cast("bigint").alias("id")).filter("id is not null")
    rows, columns = (-(-df.count() // most) or 1 for df in (left, right))
    own = lambda side, n: F.expr(f"cast(pmod(xxhash64(fingerprint, {side}), {n}) as int)")
    left = left.select(F.lit(0).alias("side"), own(0, rows).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"), "fingerprint", F.lit(0).cast("bigint").alias("id"))
    right = right.select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), own(1, columns).alias("j"), "fingerprint", "id")

    def run(batches):
        at, held, ids = None, ([], []), []
        for batch in batches:
            for side, i, j, x, k in zip(*(batch.column(c).to_pylist() for c in ("side", "i", "j", "fingerprint", "id")), strict=True):
                if at != (i, j):
                    yield from told(*held, ids)
                    at, held, ids = (i, j), ([], []), []
                held[side].append(x)
                if side:
                    ids.append(k)
        yield from told(*held, ids)

    def told(a, b, ids):
        if not a or not b:
            return
        x, y = (np.frombuffer(bytes.fromhex("".join(s)), np.uint64).reshape(-1, 2) for s in (a, b))
        found, ids = [[] for _ in a], np.array(ids)
        for low in range(0, len(y), 8192):
            y0, y1 = np.ascontiguousarray(y[low : low + 8192].T)
            for k, (x0, x1) in enumerate(x):
                d = np.bitwise_count(y0 ^ x0) + np.bitwise_count(y1 ^ x1)
                if len(to := np.flatnonzero((d <= radius) & (d > 0))):
                    found[k].append(ids[low + to])
        for low in range(0, len(a), 1024):
            some = [k for k in range(low, min(low + 1024, len(a))) if found[k]]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in some]), pa.array([np.concatenate(found[k]) for k in some], pa.list_(pa.int64()))], ["a", "near"])

    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * columns)
    lists = left.union(right).repartition(parts, "i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "a string, near array<bigint>")
    return lists.groupBy("a").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))


def edited_fingerprints(docs: DataFrame, parts: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the last third gives way to the next text's start.

    The next document is the next in descending key order, rows of equal key by a hash of their texts and rows with a
    null key last; after the last comes the first. The rows are dealt out by ranges of that order, and each range also
    gets the row that follows its last, so no task sees all rows, nor all of a key that very many rows share.
    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness: the
    share of equal bits).
    """
    df = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("tie", F.xxhash64("t"))
    bounds = id_bounds(df, "k", parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("b", bucket_of("k", "tie", bounds))
    # the first row of each part, in descending order, is also a guest of the part before it; a row for each part
    given = F.col("k").isNotNull()
    heads = sorted(df.groupBy("b").agg(F.max(F.struct(given.alias("given"), "k", "tie")).alias("head")).select("b", "head.k", "head.tie").collect())
    first, least, after = ([None] * (len(bounds) + 1) for _ in range(3))
    for i, (b, k, tie) in enumerate(heads):
        first[b], least[b], after[b] = k, tie, heads[(i + 1) % len(heads)][0]
    at = lambda x, kind: F.get(F.lit(x).cast(f"array<{kind}>"), F.col("b"))
    is_head = F.col("k").eqNullSafe(at(first, "bigint")) & (F.col("tie") == at(least, "bigint"))
    places = [F.struct(F.col("b"), F.lit(0).alias("guest")), F.struct(F.when(is_head, at(after, "int")).alias("b"), F.lit(1).alias("guest"))]
    rows = df.select(F.explode(F.array(*places)).alias("p"), "k", "t", "tie").select("p.b", "p.guest", "k", "t", "tie").filter("b is not null")
    rows = dealt(rows, len(bounds) + 1, "b").sortWithinPartitions("b", "guest", F.col("k").desc_nulls_last(), F.col("tie").desc(), F.col("t").desc())

    def run(batches):
        held = None
        for batch in slices(batches, "t"):
            prints = list(fingerprints(batch.column("t")))
            fresh = list(zip(*(batch.column(c).to_pylist() for c in ("b", "guest", "k", "t")), prints, strict=True))
            chain = ([held] if held else []) + fresh
            held = chain[-1]
            yield from told(list(zip(chain, chain[1:], strict=False)))
        if held:
            yield from told([(held, (None,))])

    def told(pairs):
        pairs = [(x, y if y[0] == x[0] else (x[0], 0, None, "", np.zeros(BITS // 8, np.uint8))) for x, y in pairs if not x[1]]
        if not pairs:
            return
        texts = [x[3][: len(x[3]) - (n := len(x[3]) // 3)] + y[3][:n] for x, y in pairs]
        edited = fingerprints(pa.array(texts, pa.large_string()))
        own, nxt = np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs])
        likeness = [1 - np.unpackbits(own ^ other, axis=1).sum(axis=1) / BITS for other in (edited, nxt)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[2] for x, _ in pairs], pa.int64()),
                pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts]),
                pa.array([x.tobytes().hex() for x in own]),
                pa.array([x.tobytes().hex() for x in edited]),
                *map(pa.array, likeness),
            ],
            ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    out = rows.mapInArrow(run, "k bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("k", key)
