"""Token-id output: a content-addressed store of id chunks with document recipes and Merkle manifests.

Id streams are cut where a rolling hash of the last ids says so, so equal passages give equal chunks. A chunk is
named by its digest and stored once; a document's recipe lists its chunks and holds their Merkle root; a manifest
per part holds the Merkle root of its documents' roots, and the store's root is that of its parts. Reading digests
the stored bytes anew and compares every level: chunks with their names, documents with their recipes' roots, parts
with their manifests, and the manifests with the store's root.

Files, all in one folder: spool files (scratch) take what encoding tasks produce; packs hold the unique chunks in
ascending key order, as zstd frames of some ten KB; recipes and manifests are tables. An address is a pack, a
frame's offset and length in it, and a chunk's offset and length within the frame.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import STEP, file_tokenizer
from .common import delete_path, fresh_path, materialize, open_store, slices
from .order import bucket_of, dealt, id_bounds
from .shingles import mix

LEAST, MASK, MOST = 64, np.uint64(255), 4096
_WINDOW = 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


#: Ids whose rolling hashes are computed at a time.
_STRETCH = 1 << 16
_UP, _DOWN = _powers(_BASE, _STRETCH), _powers(_INVERSE, _STRETCH)


def _marks(ids: np.ndarray) -> np.ndarray:
    """Ends of all windows of _WINDOW ids whose hash has MASK's bits all 0."""
    out = []
    for low in range(0, max(1, len(ids) - _WINDOW + 1), _STRETCH - _WINDOW):
        x = mix(ids[low : low + _STRETCH].astype(np.uint64) + np.uint64(1))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * _UP[: len(x)], out=total[1:])
        rolled = (total[_WINDOW:] - total[:-_WINDOW]) * _DOWN[: max(0, len(x) - _WINDOW + 1)]
        out.append(np.flatnonzero((rolled >> np.uint64(32)) & MASK == 0) + (low + _WINDOW))
    return np.unique(np.concatenate(out))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of a stream's chunks: where the hash of the last _WINDOW ids has MASK's bits all 0, LEAST to MOST ids apart."""
    return cuts_of_each(ids, [0, len(ids)])[0]


def cuts_of_each(ids: np.ndarray, bounds: list[int]) -> list[list[int]]:
    """cuts() of each of several streams, which stand end to end; counted from the stream's start."""
    marks, out = _marks(ids).tolist(), []
    k = 0
    for start, stop in zip(bounds, bounds[1:], strict=False):
        ends, at = [], start
        while stop - at > LEAST:  # a mark after LEAST ids has its whole window in the stream
            k = bisect_left(marks, at + LEAST, k)
            end = marks[k] if k < len(marks) and marks[k] <= min(at + MOST, stop) else min(at + MOST, stop)
            ends.append(end - start)
            at = end
        if at < stop:
            ends.append(stop - start)
        out.append(ends)
    return out


def digest_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves: pairs are hashed level by level, an odd last one moves up; no leaves: the digest of nothing."""
    level = [digest_of(b"\0" + x) for x in leaves] or [digest_of(b"")]
    while len(level) > 1:
        level = [digest_of(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class PackWriter:
    """Appends byte strings to one file as zstd frames of about frame bytes; a string never spans frames.

    add() gives a string's number; once closed, places[number] is (frame offset, frame length, offset, length).
    """

    def __init__(self, folder: str, name: str, frame: int = 64 << 10):
        import zstandard

        self.folder, self.name, self.frame = folder, name, frame
        self.pack, self.file, self.held, self.size, self.at = zstandard.ZstdCompressor(3), None, [], 0, 0
        self.places: list[tuple[int, int, int, int]] = []

    def add(self, raw: bytes) -> int:
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= self.frame:
            self.flush()
        return len(self.places) + len(self.held) - 1

    def flush(self) -> None:
        if not self.held:
            return
        if self.file is None:
            fs, base = open_store(self.folder)
            fs.create_dir(base, recursive=True)
            self.file = fs.open_output_stream(f"{base}/{self.name}")
        body = self.pack.compress(b"".join(self.held))
        self.file.write(body)
        inner = 0
        for raw in self.held:
            self.places.append((self.at, len(body), inner, len(raw)))
            inner += len(raw)
        self.at, self.held, self.size = self.at + len(body), [], 0

    def close(self) -> None:
        self.flush()
        if self.file is not None:
            self.file.close()


class PackReader:
    """Reads addressed strings of the packs in a folder; the last few files and frames stay open and decoded."""

    def __init__(self, folder: str, files: int = 8, frames: int = 64):
        import zstandard

        self.fs, self.base = open_store(folder)
        self.unpack, self.most = zstandard.ZstdDecompressor(), (files, frames)
        self.files: OrderedDict = OrderedDict()
        self.frames: OrderedDict = OrderedDict()

    def _held(self, kept: OrderedDict, most: int, key, make):
        if key in kept:
            kept.move_to_end(key)
        else:
            kept[key] = make()
            while len(kept) > most:
                old = kept.popitem(last=False)[1]
                if hasattr(old, "close"):
                    old.close()
        return kept[key]

    def read(self, name: str, at: int, length: int, inner: int, size: int) -> bytes:
        def frame() -> bytes:
            file = self._held(self.files, self.most[0], name, lambda: self.fs.open_input_file(f"{self.base}/{name}"))
            return self.unpack.decompress(file.read_at(length, at))

        return self._held(self.frames, self.most[1], (name, at), frame)[inner : inner + size]


_PLACE = "pack string, at bigint, length bigint, inner bigint, size bigint"


def _task_name(kind: str) -> str:
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}"


def write(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", folder: str | None = None) -> dict:
    """Encode every text with a tokenizers file, append end_id, and store all ids; a handle for read().

    Rows are taken in ascending key order (nulls first; rows of equal key in the order of a hash of their ids), each
    with the place start of its first id in the whole stream. A null text counts as empty: only end_id. Ids are
    stored as unsigned 16-bit integers where the vocabulary allows, else as 32-bit ones. Every pass's result is a
    table in the shared folder, so lost executors cost one pass at most.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    spool, packs = f"{folder}/spool", f"{folder}/packs"
    from tokenizers import Tokenizer

    wide = max(end_id, Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1) >= 1 << 16
    unit = np.dtype("<u4" if wide else "<u2")
    end = np.array([end_id], "<u4")

    def encode(batches):
        encoder, name = file_tokenizer(tokenizer), _task_name("spool")
        out, rows = PackWriter(spool, name), []
        for batch in slices(batches, "t", STEP):
            coded = encoder.encode(batch.column("t"))
            ids = np.concatenate([x for own in coded for x in (own, end)]).astype(unit)
            at = [0, *np.cumsum([len(own) + 1 for own in coded]).tolist()]
            for k, a, b, ends in zip(batch.column("k").to_pylist(), at, at[1:], cuts_of_each(ids, at), strict=False):
                raw = ids[a:b].tobytes()
                bounds = [0, *(e * unit.itemsize for e in ends)]
                digests = [digest_of(raw[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
                rows.append((k, b - a, merkle(digests), digests, bounds[1:], out.add(raw)))
        out.close()
        for i in range(0, len(rows), 2000):
            k, n, root, digests, ends, number = zip(*rows[i : i + 2000], strict=True)
            at, length, inner, size = zip(*(out.places[x] for x in number), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(root, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(ends, pa.list_(pa.int64())), pa.array([name] * len(k)), *(pa.array(x, pa.int64()) for x in (at, length, inner, size))],
                ["k", "n", "root", "digests", "ends", "pack", "at", "length", "inner", "size"],
            )

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    coded = materialize(rows.mapInArrow(encode, f"k bigint, n bigint, root binary, digests array<binary>, ends array<bigint>, {_PLACE}").withColumn("row", F.monotonically_increasing_id()), "encoded")

    # places in the whole stream: sums over key ranges, then within each
    bounds = id_bounds(coded, "k", int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = coded.withColumn("tie", F.xxhash64("root")).withColumn("part", bucket_of("k", "tie", bounds))
    sums = [(r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()]  # a row for each part
    before, total = [0] * (len(bounds) + 1), 0
    for part, n in sums:
        before[part], total = total, total + n
    order = Window.partitionBy("part").orderBy("k", "tie", "root", "row").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.select("row", "k", "part", "n", "tie", "root").withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0)) + F.get(F.lit(before).cast("array<bigint>"), F.col("part")))
    recipes = materialize(starts.select("row", "part", "start").join(coded, "row"), "recipes")

    # every digest's owner is the first place in key order that has it; owners' chunks go to the packs
    listed = recipes.select("start", F.posexplode("digests").alias("pos", "digest"))
    owners = listed.groupBy("digest").agg(F.min(F.struct("start", "pos")).alias("o")).select("o.start", "o.pos").groupBy("start").agg(F.collect_set("pos").alias("own"))
    owned = recipes.join(owners, "start").select("part", "start", "digests", "ends", "own", "pack", "at", "length", "inner", "size")
    ordered = dealt(owned, len(bounds) + 1, "part").sortWithinPartitions("part", "start")

    def pack(batches):
        reader, out, found = PackReader(spool), PackWriter(packs, _task_name("pack")), []
        for batch in batches:
            for digests, ends, own, *place in zip(*(batch.column(c).to_pylist() for c in ("digests", "ends", "own", "pack", "at", "length", "inner", "size")), strict=True):
                raw, low = reader.read(*place), [0, *ends]
                found += [(digests[i], out.add(raw[low[i] : low[i + 1]])) for i in sorted(own)]
        out.close()
        for i in range(0, len(found), 5000):
            digest, number = zip(*found[i : i + 5000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([out.name] * len(digest)), *(pa.array(x, pa.int64()) for x in zip(*(out.places[x] for x in number), strict=True))], ["digest", "pack", "at", "length", "inner", "size"])

    catalog = materialize(ordered.mapInArrow(pack, f"digest binary, {_PLACE}"), "chunks")
    delete_path(spark, spool)
    found = {"folder": packs, "unit": unit.str, "recipes": recipes.select("row", "k", "part", "start", "n", "root", "digests"), "chunks": catalog, "parts": len(bounds) + 1}
    found["manifests"] = materialize(manifests(found), "manifests")
    return found | {"root": merkle(list(_manifest_roots(found).values()))}


def _manifest_roots(handle: dict) -> dict[int, bytes]:
    """Each part's root, in the order of the parts: a row for each part."""
    return {r["part"]: bytes(r["root"]) for r in handle["manifests"].orderBy("part").collect()}


def read(handle: dict, key: str = "doc_id") -> DataFrame:
    """Every document from the store: key, start, n_tokens, ids_crc32 (of little-endian 32-bit ids), root, part.

    ValueError for a chunk that differs from its digest, a document whose length or root its recipe doesn't give, a
    part whose documents' roots don't give its manifest's, and manifests that don't give the store's root.
    """
    unit, folder, told = np.dtype(handle["unit"]), handle["folder"], _manifest_roots(handle)
    if merkle(list(told.values())) != handle["root"]:
        raise ValueError("the manifests aren't the store's")
    wanted = handle["recipes"].select("row", F.posexplode("digests").alias("pos", "digest"))
    placed = wanted.join(handle["chunks"], "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "pack", "at", "length", "inner", "size"))).alias("chunks"))
    rows = dealt(handle["recipes"].select("row", "k", "part", "start", "n", F.col("root").alias("named")).join(placed, "row"), handle["parts"], "part").sortWithinPartitions("part", "start")

    def run(batches):
        reader, at_part, seen = PackReader(folder), None, []
        for batch in batches:
            crcs, roots = [], []
            lists = batch.column("chunks")
            fields = lists.flatten().flatten()  # pos, digest, then the address
            digests, places = fields[1].to_pylist(), list(zip(*(x.to_pylist() for x in fields[2:]), strict=True))
            at = [0, *np.cumsum(lists.value_lengths().to_numpy()).tolist()]
            for i, (part, n, named) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "n", "named")), strict=True)):
                parts = [reader.read(*place) for place in places[at[i] : at[i + 1]]]
                own = [digest_of(raw) for raw in parts]
                if own != digests[at[i] : at[i + 1]]:
                    raise ValueError("damaged chunk")
                ids = np.frombuffer(b"".join(parts), unit).astype("<u4")
                if len(ids) != n or merkle(own) != named:
                    raise ValueError("a recipe doesn't give its document")
                if part != at_part:
                    checked(at_part, seen)
                    at_part, seen = part, []
                seen.append(named)
                crcs.append(zlib.crc32(ids.tobytes()))
                roots.append(named)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "start", "n")), pa.array(crcs, pa.int64()), pa.array(roots, pa.binary()), batch.column("part")], [key, "start", "n_tokens", "ids_crc32", "root", "part"])
        checked(at_part, seen)

    def checked(part, roots):
        if part is not None and merkle(roots) != told.get(part):
            raise ValueError("a part's documents aren't those of its manifest")

    return rows.mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint, root binary, part int")


def manifests(handle: dict) -> DataFrame:
    """The Merkle manifest of each part: part, documents, root (over its documents' roots in stream order)."""

    def run(batches):
        at, roots = None, []
        for batch in batches:
            for part, root in zip(batch.column("part").to_pylist(), batch.column("root").to_pylist(), strict=True):
                if part != at:
                    if roots:
                        yield told(at, roots)
                    at, roots = part, []
                roots.append(root)
        if roots:
            yield told(at, roots)

    def told(part, roots):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(roots)], pa.int64()), pa.array([merkle(roots)], pa.binary())], ["part", "documents", "root"])

    rows = dealt(handle["recipes"].select("part", "start", "root"), handle["parts"], "part").sortWithinPartitions("part", "start")
    return rows.mapInArrow(run, "part int, documents bigint, root binary")
