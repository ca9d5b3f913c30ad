"""Ranges in id order: equal shares, keys that hold much of the table cut apart, neighbours right across every cut."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cairn.llm import simhash, token_store
from cairn.llm.order import bucket_of, id_bounds


def hot(make, rnd):
    rows = [(i, f"text {rnd.random()} " * rnd.randint(0, 4)) for i in range(100)]
    rows += [(50, f"hot {rnd.random()}") for _ in range(100)] + [(None, f"none {rnd.random()}") for _ in range(100)]
    rnd.shuffle(rows)
    return make(*rows)


def test_hot_keys_are_cut(make):
    df = hot(make, random.Random(1)).withColumn("tie", F.xxhash64("text"))
    bounds = id_bounds(df, "doc_id", 12)
    rows = df.select("doc_id", "tie", bucket_of("doc_id", "tie", bounds).alias("b")).collect()
    order = lambda k, t: (k is not None, k or 0, t)
    for r in rows:
        assert r.b == sum(order(*x) < order(r.doc_id, r.tie) for x in bounds)
    sizes = Counter(r.b for r in rows)
    assert max(sizes.values()) <= 60 and len(sizes) >= 9
    assert id_bounds(df.limit(0), "doc_id", 12) == [] == id_bounds(df, "doc_id", 1)


@pytest.mark.parametrize("parts", [1, 2, 12, 500])
def test_next_documents(make, parts):
    docs = hot(make, random.Random(2))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie), reverse=True)
    want = []
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        n = len(r.text) // 3
        want.append((str(r.doc_id), len(r.text), hashlib.sha256((r.text[: len(r.text) - n] + nxt.text[:n]).encode()).hexdigest()))
    got = simhash.edited_fingerprints(docs, parts=parts).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def test_only_null_keys(make):
    docs = make((None, "abcdef"), (None, "uvwxyz"))
    assert {r.edited_sha256 for r in simhash.edited_fingerprints(docs).collect()} == {hashlib.sha256(x).hexdigest() for x in (b"abcduv", b"uvwxab")}


def test_store_of_hot_keys(make):
    """Starts are sums of lengths in order, whatever ranges the keys fall into."""
    docs = hot(make, random.Random(3))
    rows = sorted(token_store.read(token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys) and len(rows) == docs.count()
