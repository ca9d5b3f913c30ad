"""The classifier's bounds: the sample holds whatever keys repeat, and blocks of bytes don't change the terms."""

import numpy as np
import pyarrow as pa

from cairn.llm import quality


def test_sample_bounds_repeated_keys(spark, make):
    docs = make(*((1, f"same key, text number {i}") for i in range(300)), (2, "another document"), *((i, f"more {i}") for i in range(3, 40)))
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), *((i, i % 2) for i in range(2, 40))], "doc_id bigint, quality int")
    for sample in (1, 5):
        voter = quality.fit(docs, labels, sample=sample)
        assert voter is None or (len(voter.labels) <= 2 * sample and max(np.bincount(voter.labels.astype(int))) <= sample)
    assert len(quality.fit(docs, labels, sample=50).labels) > 60


def test_ties_give_the_mean_vote(spark, make):
    docs = make((1, "the very same text"), (2, "the very same text"), (3, "the very same text"), (4, ""), (5, None))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert set(got.values()) == {0.5}


def test_blocks_don_t_change_terms(monkeypatch):
    column = pa.array(["Some text, with 12 numbers. " * 9, "", None, "a", "ab", "abc", "é中 👍 !?\n" * 20])
    before = quality.term_shares(column)
    for block in (1, 7, 64):
        monkeypatch.setattr(quality, "BLOCK", block)
        assert np.array_equal(quality.term_shares(column), before)
