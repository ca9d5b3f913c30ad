"""Each stage of the pipeline against plain Python on the small documents."""

import re

import public_tokenizers

import corpus_pipeline
from cairn.llm import bpe

from .test_contracts import brute_links


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    kept, unique, clean, mixed, coded = _run(spark, docs, tiny)
    assert kept.columns == unique.columns == clean.columns == mixed.columns == columns
    before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in kept.collect()}
    assert sum(labels.get(k) == 1 for k in after) >= 0.98 * sum(y == 1 for y in labels.values())
    assert sum(labels.get(k) == 0 for k in after) <= 0.1 * sum(y == 0 for y in labels.values())
    assert all(before[k] == r for k, r in after.items())
    _, classes = brute_links({k: r.text for k, r in after.items()})
    assert {r.doc_id for r in unique.collect()} == set(classes.values())
    rows = {r.doc_id: r for r in clean.collect()}
    secret = re.compile(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    assert set(rows) == set(classes.values()) and not any(secret.search(r.text) for r in rows.values())
    assert all(r.text == after[k].text for k, r in rows.items() if not secret.search(after[k].text))
    assert all(r.n_chars == len(r.text) for r in rows.values())
    words = sum(len(r.text.split()) for r in rows.values())
    got = mixed.collect()
    assert abs(sum(len(r.text.split()) for r in got) - 1.5 * words) < 0.02 * words
    texts = sorted(bytes(r.raw).decode() for r in bpe.decode(coded, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect())
    assert texts == sorted(r.text for r in got)


def _run(spark, docs, tiny):
    from cairn.llm.common import materialize

    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, tiny), f"stage-{i}")
        yield docs


def test_run(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).columns == ["doc_id", "source", "n_tokens", "ids"]
