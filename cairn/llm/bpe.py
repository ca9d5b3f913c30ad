"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import STEP, rank_encoding
from .common import slices


def verify_decoded(own, coded: list[np.ndarray], texts: pa.Array) -> None:
    """Raise ValueError unless each text's ids decode to its bytes; null counts as empty."""
    for x, text in zip(coded, texts.to_pylist(), strict=True):
        if own.decode_bytes(x.tolist()) != (text or "").encode():
            raise ValueError("ids don't decode to their text")


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False, verify: bool = False) -> DataFrame:
    """Columns keep, n_tokens, and ids (array of int) or ids_sha256 and decoded_sha256, one row per input row.

    ranks: path of a rank file that every executor can read; pattern: the pre-tokenizer's regular expression.
    Every match of pattern is encoded by itself, special tokens' strings as ordinary text. A null text counts as
    empty and has no ids; repeated rows stay; columns of docs not named in keep are left out, whatever their names;
    texts are cut where the pattern starts a new piece in any case, or not at all if it isn't chunks.PATTERN. verify: decode each row's ids and raise
    ValueError if they don't give the text's bytes.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    out = [f"`{c}` {kinds[c].simpleString()}" for c in keep]
    out += ["n_tokens bigint"] + ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests

    def run(batches):
        own, encoder = rank_encoding(ranks, pattern)
        for batch in slices(batches, "__text", STEP):
            coded = encoder.encode(batch.column("__text"))
            if verify:
                verify_decoded(own, coded, batch.column("__text"))
            columns = [batch.column(c) for c in keep] + [pa.array([len(x) for x in coded], pa.int64())]
            names = [*keep, "n_tokens"]
            if ids:
                flat = np.concatenate(coded).view("<i4")
                columns.append(pa.ListArray.from_arrays(np.cumsum([0, *(len(x) for x in coded)]).astype(np.int32), pa.array(flat, pa.int32())))
                names.append("ids")
            if digests:
                columns.append(pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in coded]))
                columns.append(pa.array([hashlib.sha256(own.decode_bytes(x.tolist())).hexdigest() for x in coded]))
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join(out))


def decode(coded: DataFrame, ranks: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep and raw (binary): the bytes of each row's ids, which need not be valid UTF-8. Null ids: null.

    An id that the rank file lacks raises KeyError.
    """
    kinds = {f.name: f.dataType for f in coded.schema.fields}

    def run(batches):
        own, _ = rank_encoding(ranks, pattern)
        for batch in batches:
            raw = [None if x is None else own.decode_bytes(x) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(raw, pa.binary())], [*keep, "raw"])

    return coded.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, ", ".join([f"`{c}` {kinds[c].simpleString()}" for c in keep] + ["raw binary"]))
