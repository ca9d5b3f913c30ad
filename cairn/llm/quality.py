"""Quality classifier: nearest-neighbour voting over latent-semantic vectors of labelled documents.

Terms describe how a text is written, not what about: triples of character classes, words that repeat the word or
the third word before them, words and word triples seen before in the text, and capital or symbol-only words.
A text's term shares (square roots, weighted by rarity among the labelled texts) are projected on the labelled
texts' leading singular vectors. Every document's cosine with all labelled vectors is computed exactly, block by
block, and its nearest neighbours vote, each with a power of its similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, utf8
from .shingles import BLOCK, shingles, words

_CLASSES = 16
#: Byte classes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 space, 5 line end, 6 beyond ASCII, then some marks of their own.
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:] = 1, 2, 3, 4, 5, 6
for _i, _marks in enumerate((".", ",", "!?", "*#", "$%&@", "|<>{}[]", ":;=", "-_/\\", "'\"()")):
    _CLASS[[ord(x) for x in _marks]] = 7 + _i
_EXTRA = 6
#: Texts whose term counts are held at once.
_ROWS = 128
TERMS = _CLASSES**3 + _EXTRA


def _repeats(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of each text's hashes that stood in the text before."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    again = np.zeros(len(at) - 1)
    if len(h) > 1:
        again += np.bincount(o[1:][(h[1:] == h[:-1]) & (o[1:] == o[:-1])], minlength=len(at) - 1)
    return again / np.maximum(1, np.diff(at))


def _lag(hashes: np.ndarray, at: np.ndarray, lag: int) -> np.ndarray:
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag]) if len(hashes) > lag else np.zeros(0, bool)
    return np.bincount(owner[lag:][same] if len(same) else [], minlength=len(at) - 1) / np.maximum(1, np.diff(at))


def term_shares(column: pa.Array) -> np.ndarray:
    """One row of TERMS numbers for each text: square roots of shares. A text without characters has zeros.

    Bytes are counted BLOCK at a time, so that memory doesn't grow with a text but for its words' hashes.
    """
    data, offsets = utf8(column)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    last = np.concatenate([offsets[1:][sizes > 0] - 1, offsets[1:][sizes > 1] - 2])  # no triple starts there
    counts, per_kind = np.zeros(n * _CLASSES**3, np.int64), np.zeros(n * _CLASSES, np.int64)
    for low in range(0, len(data), BLOCK):
        high = min(low + BLOCK, len(data))
        kind = np.zeros(high - low + 2, np.int32)
        kind[: min(len(data), high + 2) - low] = _CLASS[data[low : high + 2]]
        owner = np.repeat(np.arange(n), np.diff(np.clip(offsets, low, high)))
        triple = kind[:-2] * _CLASSES**2 + kind[1:-1] * _CLASSES + kind[2:]
        whole = np.ones(high - low, bool)
        whole[last[(last >= low) & (last < high)] - low] = False
        counts += np.bincount(owner[whole] * _CLASSES**3 + triple[whole], minlength=len(counts))
        per_kind += np.bincount(owner * _CLASSES + kind[:-2], minlength=len(per_kind))
    out = np.zeros((n, TERMS), np.float32)
    out[:, : _CLASSES**3] = counts.reshape(n, -1) / np.maximum(1, sizes - 2)[:, None]
    shares = per_kind.reshape(n, -1) / np.maximum(1, sizes)[:, None]
    hashes, at = words(data, offsets)
    out[:, _CLASSES**3 :] = np.stack([_lag(hashes, at, 1), _lag(hashes, at, 3), _repeats(hashes, at) ** 2, _repeats(*shingles(hashes, at, 3)), shares[:, 2], shares[:, [9, 10, 11, 12]].sum(axis=1)], axis=1)
    return np.sqrt(out)


class Voter:
    """A fitted model: rarity of terms, projection, labelled unit vectors and labels. rows are weighted in place."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, power: float, seed: int = 1):
        self.neighbours, self.power = min(neighbours, len(labels)), power
        self.rarity = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + np.float32(0.3)
        rows *= self.rarity  # from here on weighted
        base = rows.T @ np.random.default_rng(seed).standard_normal((len(rows), rank + 16)).astype(np.float32)
        for _ in range(3):  # subspace iteration
            base = np.linalg.qr(base)[0]
            base = rows.T @ (rows @ base)
        base = np.linalg.qr(base)[0]
        self.projection = (base @ np.linalg.svd(rows @ base, full_matrices=False)[2].T[:, :rank]).astype(np.float32)
        self.vectors = self.normed(rows @ self.projection)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean())

    def unit(self, rows: np.ndarray) -> np.ndarray:
        return self.normed((rows * self.rarity) @ self.projection)

    @staticmethod
    def normed(out: np.ndarray) -> np.ndarray:
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        for low in range(0, len(rows), block):
            likeness = self.unit(rows[low : low + block]) @ self.vectors.T
            near = np.argpartition(-likeness, self.neighbours - 1, axis=1)[:, : self.neighbours]
            votes = np.maximum(np.take_along_axis(likeness, near, axis=1), 0).astype(float) ** self.power
            total = votes.sum(axis=1)
            some = total > 1e-9
            out[low : low + block][some] = (votes * self.labels[near]).sum(axis=1)[some] / total[some]
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, rank: int = 32, neighbours: int = 15, power: float = 8.0, text: str = "text", key: str = "doc_id", label: str = "quality") -> Voter | None:
    """A Voter from at most sample labelled documents of each class (parameter: the least hashes of key and text).

    Rows with null key or label are left out, as are labels without a document. A key that is labelled or stands for
    documents more than once counts once for each, but never beyond the sample. Without rows of both classes: None.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)").distinct()
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (0, 1)]
    chosen = parts[0].union(parts[1])  # at most twice the sample: small enough to broadcast

    def run(batches):
        for batch in slices(batches, "t", rows=_ROWS):
            rows = term_shares(batch.column("t"))
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), batch.column("y"), pa.array([x.tolist() for x in at], pa.list_(pa.int32())), pa.array([r[x].tolist() for r, x in zip(rows, at, strict=True)], pa.list_(pa.float32()))], ["k", "h", "y", "at", "value"])

    texts = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("k", "h", "y", "t")
    vectors = materialize(texts.mapInArrow(run, "k bigint, h bigint, y int, at array<int>, value array<float>"), "labelled")
    found = pa.concat_tables([vectors.filter(F.col("y") == y).orderBy("h", "k").limit(sample).toArrow() for y in (0, 1)])
    found = found.sort_by([(c, "ascending") for c in ("k", "y", "h")]).combine_chunks()
    y = found["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    # straight from Arrow: as Python objects the vectors would take several times their size
    lists = [found[c].combine_chunks() for c in ("at", "value")]
    rows = np.zeros((len(y), TERMS), np.float32)
    rows[np.repeat(np.arange(len(y)), lists[0].value_lengths().to_numpy()), lists[0].flatten().to_numpy()] = lists[1].flatten().to_numpy()
    return Voter(rows, y, rank, neighbours, power)


def score(docs: DataFrame, voter: Voter | None, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """Columns key, keep and score, called name (0 to 1, higher: label 1 likelier); one row per input row.

    A null text counts as empty; a text without neighbours of positive likeness, as an empty one, gets the labelled
    rows' mean label. Without a voter every score is 1, so that nothing is rejected unseen.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [key, *keep]
    if voter is None:
        return docs.select(*names).withColumn(name, F.lit(1.0))
    held = docs.sparkSession.sparkContext.broadcast(voter)  # sample, rank and number of terms bound its size

    def run(batches):
        for batch in slices(batches, "__text", rows=_ROWS):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(held.value.scores(term_shares(batch.column("__text"))))], [*names, name])

    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"`{name}` double"]))
