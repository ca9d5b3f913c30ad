"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set comparison decides.

A document's set is that of its five-word shingles (a shorter text has one; a text without words has none and
links to nothing but other texts without words). Documents with equal sets are one member, so copies never meet.
Each tree files the members in a prefix trie by its own sequence of minhashes; no two trees share a hash. Matched
prefixes are shortened until the pairs that share one in some tree reach the target recall; all members of a node
of that depth are compared with each other, however many they are: few ones pair by pair, crowded nodes in tiles of
bounded size, where members that are already connected aren't compared again. Candidates whose set sizes or
sketches are clearly too different go; the rest tie members to groups, and within each group all pairs are counted
exactly, on 64-bit shingle hashes, again in tiles of bounded size. Classes are components of the exact links only.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, materialize, slices, utf8
from .graph import components
from .shingles import distinct, mix, shingles, words

HASHES = 128
DEPTH = 8
#: Members of a trie node up to which its pairs are written out; members of a crowded node's tile. Neither changes what is found.
FEW, CROWD = 8, 2048
#: Members of groups, or rows that aren't their class's first, that go to the texts at most (some 100 bytes each); more of them meet the texts by a shuffle.
BROADCAST_ROWS = 300_000
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def tree_order(trees: int, depth: int) -> np.ndarray:
    """Which hashes make each tree's prefix: fixed, pseudorandom, each hash in one tree at most."""
    return np.random.default_rng(0).permutation(HASHES)[: trees * depth].reshape(trees, depth)


def shortest_prefix(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix length at which a pair of just the threshold shares it in some tree with the target recall."""
    found = [k for k in range(1, DEPTH + 1) if trees * k <= HASHES and 1 - (1 - threshold**k) ** trees >= recall]
    return max(found, default=1)


def sketch_floor(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The most equal hashes to ask of a pair, so that trees and sketch together find one of just the threshold with the target recall."""
    missed, floor = (1 - threshold**depth) ** trees, 0
    while floor < HASHES and (missed := missed + math.comb(HASHES, floor) * threshold**floor * (1 - threshold) ** (HASHES - floor)) <= 1 - recall:
        floor += 1
    return floor


def signatures(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least 16 bits of HASHES hash functions over each text's shingles; texts without shingles have 0xFFFF."""
    full = np.flatnonzero(np.diff(at))
    out = np.full((len(at) - 1, HASHES), 0xFFFF, np.uint16)
    if len(full):
        for i, seed in enumerate(_SEEDS):
            low = np.minimum.reduceat((runs ^ (runs >> np.uint64(29))) * seed >> np.uint64(32), at[full])
            out[full, i] = mix(low) & np.uint64(0xFFFF)
    return out


def text_hash(text: str) -> Column:
    """Tells the texts of one key apart; whoever needs certainty compares the shingle sets' digests as well."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def digest_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sets_of(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """Columns k, h (text_hash), digest (of the shingle set), size, sig (binary): one row per row of docs."""

    def run(batches):
        for batch in slices(batches, "t"):
            runs, at = shingles(*words(*utf8(batch.column("t"))), width)
            sets, sigs = distinct(runs, at), signatures(runs, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("h"), pa.array([digest_of(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sigs], pa.binary())],
                ["k", "h", "digest", "size", "sig"],
            )

    return docs.select(F.col(key).cast("bigint").alias("k"), text_hash(text).alias("h"), F.col(text).alias("t")).mapInArrow(run, "k bigint, h bigint, digest binary, size bigint, sig binary")


def near_forest(ids: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, side: np.ndarray | None, threshold: float, floor: int) -> list[tuple[int, int]]:
    """Pairs that connect what all near pairs of the members connect, or all near pairs of members on different sides.

    Near: sizes allow the threshold and floor hashes at least are equal.
    """
    pairs, free = [], np.ones(len(ids), bool)
    for first in range(len(ids)):
        if not free[first]:
            continue
        free[first], reach = False, [first]
        while reach:
            x = reach.pop()
            to = np.flatnonzero(free if side is None else free & (side != side[x]))
            to = to[np.minimum(sizes[to], sizes[x]) / np.maximum(sizes[to], sizes[x]) >= threshold]
            to = to[np.count_nonzero(sigs[to] == sigs[x], axis=1) >= floor]
            free[to] = False
            reach.extend(to.tolist())
            pairs += [(int(ids[x]), int(ids[y])) for y in to]
    return pairs


def candidates(members: DataFrame, threshold: float, trees: int, recall: float, few: int = FEW, crowd: int = CROWD) -> DataFrame:
    """Columns a, b: pairs of members (columns id, size, sig) that connect all that share a node and whose sketches allow the threshold."""
    least = shortest_prefix(threshold, trees, recall)
    order = tree_order(trees, least)

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            # a node's number; two nodes that got the same one would only be compared in vain
            node = np.tile(np.arange(1, trees + 1, dtype=np.uint64), (len(sig), 1))
            for i in range(least):
                node = mix(node * np.uint64(1 << 16) + sig[:, order[:, i]])
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel().view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), trees))], ["node", "id"])

    paths = members.select("id", "sig").mapInArrow(run, "node bigint, id bigint")
    counts = paths.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    nodes = materialize(paths.join(counts, "node"), "nodes")
    listed = nodes.filter(F.col("n") <= few).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("x"))
    two = F.expr("inline(flatten(transform(x, (a, i) -> transform(slice(x, i + 2, size(x)), b -> struct(a, b)))))")
    pairs = listed.select(two).toDF("a", "b").distinct()
    floor = sketch_floor(threshold, trees, least, recall)

    def alike(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= floor)).select(["a", "b"])

    sa, sb = (members.select(F.col("id").alias(c), F.col("size").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
    fit = pairs.join(sa, "a").join(sb, "b").filter(F.least("na", "nb") / F.greatest("na", "nb") >= threshold)
    sparse = fit.select("a", "b", "sa", "sb").mapInArrow(alike, "a bigint, b bigint")

    tiles = nodes.filter(F.col("n") > few).withColumn("of", F.ceil(F.col("n") / crowd).cast("int")).withColumn("own", F.expr("cast(pmod(xxhash64(id, 7), of) as int)"))
    placed = tiles.withColumn("other", F.explode(F.expr("sequence(0, of - 1)"))).select("id", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

    def within(batches):
        at, held = None, []
        for batch in batches:
            for node, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in ("node", "i", "j", "own", "id", "size", "sig")), strict=True):
                if at != (node, i, j):
                    yield from told(at, held)
                    at, held = (node, i, j), []
                held.append(rest)
        yield from told(at, held)

    def told(at, held):
        if len(held) < 2:
            return
        own, ids, sizes = (np.array([x[c] for x in held]) for c in range(3))
        sigs = np.frombuffer(b"".join(x[3] for x in held), np.uint16).reshape(-1, HASHES)
        found = near_forest(ids, sizes, sigs, own if at[1] != at[2] else None, threshold, floor)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.join(members.select("id", "size", "sig"), "id").repartition(parts, "node", "i", "j").sortWithinPartitions("node", "i", "j")
    return sparse.union(dealt.select("node", "i", "j", "own", "id", "size", "sig").mapInArrow(within, "a bigint, b bigint"))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left has in common with each of right: products of 0/1 columns, some at a time."""
    sets = left + right
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]]))
    on_left = owner < len(left)
    # only shingles that both sides have matter
    both = (np.bincount(column[on_left], minlength=column[-1] + 1) > 0) & (np.bincount(column[~on_left], minlength=column[-1] + 1) > 0)
    place = np.cumsum(both) - 1
    kept = both[column]
    column, owner = place[column[kept]], owner[kept]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(both.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        has = np.zeros((len(sets), min(4096, int(both.sum()) - low)), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def tile_links(left: list[tuple], right: list[tuple] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Exact links among left, or between left and right: for each member the linked copies and linked members, and a spanning forest.

    A member is (id, copies, set).
    """
    other = left if right is None else right
    sizes, wide = (np.array([len(m[2]) for m in side], np.float32) for side in (left, other))
    shared = _shared([m[2] for m in left], [m[2] for m in other])
    linked = shared / (sizes[:, None] + wide - shared) >= np.float32(threshold) - np.float32(1e-6)
    # a quotient that rounding puts near the threshold is decided in whole numbers
    for i, j in zip(*np.nonzero(linked & (np.abs(shared / (sizes[:, None] + wide - shared) - threshold) < 1e-5)), strict=True):
        linked[i, j] = int(shared[i, j]) / (int(sizes[i]) + int(wide[j]) - int(shared[i, j])) >= threshold
    if right is None:
        np.fill_diagonal(linked, False)
    copies = [np.array([m[1] for m in side]) for side in (left, other)]
    if right is None:
        n_copies, n_members = linked @ copies[1], linked.sum(axis=1)
    else:
        n_copies, n_members = np.concatenate([linked @ copies[1], linked.T @ copies[0]]), np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])
    ids = [m[0] for m in left] + [m[0] for m in right or []]
    n, offset = len(ids), 0 if right is None else len(left)
    # each tree of the forest is a star around its first member
    forest, seen = [], np.zeros(n, bool)
    for first in np.flatnonzero(n_members):
        if not seen[first]:
            seen[first], reach = True, [first]
            while reach:
                x = reach.pop()
                to = np.flatnonzero(linked[x]) + offset if right is None or x < offset else np.flatnonzero(linked[:, x - offset])
                fresh = to[~seen[to]]
                seen[fresh] = True
                reach.extend(fresh.tolist())
                forest += [(ids[y], ids[first]) for y in fresh]
    return n_copies, n_members, forest


def classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 24, recall: float = 0.999999, tile: int = 1024, weight: int = 1 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What links() tells of each row, with k for key, and h (text_hash) and first_h (that of the class's first row).

    A member is a different shingle set, numbered by itself, so texts that share a key aren't confused. tile and
    weight bound a tile's members and shingles; they don't change the result.
    """
    prints = materialize(sets_of(docs, text, key, width), "minhash")
    found = prints.filter("k is not null").groupBy("digest").agg(F.min(F.struct("k", "h")).alias("o"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    members = materialize(found.select("digest", "o.k", "o.h", "copies", "size", "sig", F.monotonically_increasing_id().alias("id")), "members")
    near = candidates(members.filter("size > 0"), threshold, trees, recall)
    groups = materialize(components(near).join(members.select("id", "k", "h", "digest", "copies", "size"), "id"), "groups")
    counts = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") / weight)).cast("int").alias("of"))
    tiles = materialize(groups.join(counts, "root").withColumn("own", F.expr("cast(pmod(xxhash64(id, 7), of) as int)")).drop("size"), "tiles")
    # each member's text: rows of its first key and text hash; of repeated ones any, once it's known that the set is the member's
    texts = docs.select(F.col(key).cast("bigint").alias("k"), text_hash(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(broadcast_if_few(tiles, BROADCAST_ROWS), ["k", "h"])

    def sets(batches):
        seen: set[int] = set()  # repeated rows of one member meet in one task, or a few
        for batch in slices(batches, "t"):
            shingled, own = distinct(*shingles(*words(*utf8(batch.column("t"))), width)), []
            for i, (k, digest) in enumerate(zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), strict=True)):
                if k not in seen and digest_of(shingled[i]) == digest:
                    seen.add(k)
                    own.append(i)
            kept = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in names), pa.array([shingled[i].tobytes() for i in own], pa.binary())], [*names, "s"])

    names = ["id", "root", "of", "own", "copies"]
    held = texts.select(*names, "digest", "t").mapInArrow(sets, "id bigint, root bigint, of int, own int, copies bigint, s binary")
    other = F.explode(F.expr("sequence(0, of - 1)"))
    placed = held.withColumn("other", other).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "copies", "s")

    def count(batches):
        at, left, right = None, {}, {}
        for batch in batches:
            for root, i, j, own, k, n, s in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "own", "id", "copies", "s")), strict=True):
                if at != (root, i, j):
                    yield from done(at, left, right)
                    at, left, right = (root, i, j), {}, {}
                (left if own == i else right).setdefault(k, (k, n, np.frombuffer(s, np.uint64)))
        yield from done(at, left, right)

    def done(at, left, right):
        if at is None or len(left) + len(right) < 2 or (at[1] != at[2] and not (left and right)):
            return
        a, b = list(left.values()), list(right.values())
        n_copies, n_members, forest = tile_links(a, b if at[1] != at[2] else None, threshold)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([m[0] for m in a + b] + [x for x, _ in forest], pa.int64()),
                pa.array([None] * (len(a) + len(b)) + [y for _, y in forest], pa.int64()),
                pa.array([*n_copies.tolist(), *[0] * len(forest)], pa.int64()),
                pa.array([*n_members.tolist(), *[0] * len(forest)], pa.int64()),
            ],
            ["a", "b", "n", "m"],
        )

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = materialize(placed.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(count, "a bigint, b bigint, n bigint, m bigint"), "links")
    linked = components(told.filter("b is not null").select("a", "b")).join(members.select("id", "k", "h"), "id")
    firsts = linked.groupBy("root").agg(F.min(F.struct("k", "h")).alias("first"))
    classed = linked.join(firsts, "root").select("id", "first")
    sums = told.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    known = members.select("digest", "id", F.struct("k", "h").alias("o"), "copies").join(classed, "id", "left").join(sums, "id", "left")
    rows = prints.select("k", "h", "digest").join(known, "digest", "left")
    given = F.col("k").isNotNull()
    first = F.coalesce("first", "o")
    return rows.select(
        "k",
        "h",
        F.when(given, first["k"]).alias("class_id"),
        F.when(given, first["h"]).alias("first_h"),
        F.when(given, F.col("o")["k"]).alias("set_id"),
        F.when(given, F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links"),
        F.when(given, F.coalesce("m", F.lit(0))).otherwise(0).alias("n_sets"),
    )


def links(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """Each document's class and links, one row per input row.

    Columns: key, class_id (the least key of all that links connect it with), set_id (the least key with the same
    shingle set), n_links (other documents whose sets have a Jaccard likeness of threshold or more, copies
    included), n_sets (other sets among them). Rows with a null key are left out of groups: class_id and set_id
    null, n_links 0. Rows that repeat a key count as documents of their own, each by its own text. A null text
    counts as empty; all texts without words are one set. Clashing extra columns don't matter. how: as in classes().
    """
    return classes(docs, threshold, text=text, key=key, **how).select(F.col("k").alias(key), "class_id", "set_id", "n_links", "n_sets")


def firsts(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that are their class's first (least key, then least text hash), and all rows with a null key.

    Rows that repeat both key and text are one document and stay or go together.
    """
    k, h = F.col("k"), F.col("h")
    copies = classes(docs, threshold, text=text, key=key, **how).filter((F.col("class_id") != k) | (F.col("first_h") != h)).select(k.alias("__k"), h.alias("__h")).distinct()
    copies = broadcast_if_few(materialize(copies, "copies"), BROADCAST_ROWS)
    return docs.join(copies, (docs[key] == copies["__k"]) & (text_hash(text) == copies["__h"]), "left_anti")
