"""Every stage of the pipeline on odd rows, empty tables, ties, and columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import ODD


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    labels = [(1, 1, 0), (2, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def clashing(docs):
    names = ("h", "kh", "kinds", "__k", "root", "of", "own", "score", "out_shards", "shard", "first", "sig", "n")
    return docs.withColumns({n: F.lit(i) for i, n in enumerate(names) if n not in docs.columns})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, make, folder, name, stage):
    plain = make(*ODD, (7, "password=hunter2222 " * 3), (7, "password=hunter2222 " * 3))
    for docs in (plain, plain.limit(0), clashing(plain)):
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        else:
            assert len(rows) == docs.count()


def test_secrets_go_and_the_rest_stays(spark, make, folder):
    docs = make((1, "x password=hunter2222 y"), (1, "nothing secret"), (None, "AKIA" + "B" * 16), (None, None))
    got = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.redact_secrets(spark, docs, folder).collect()}
    assert got == {(1, "x [SECRET] y", 12), (1, "nothing secret", 14), (None, "[SECRET]", 8), (None, None, None)}


def test_ties_among_copies(spark, make, folder):
    """Of equal texts under several keys the least key stays; a key's other texts stay as well."""
    docs = make((5, "one two three four five six"), (3, "one two three four five six"), (3, "quite another text stands here now"), (9, "ONE two, three four five six!"))
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, folder).collect()) == [(3, "one two three four five six"), (3, "quite another text stands here now")]
