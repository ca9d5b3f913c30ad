"""A training corpus from raw documents, in five stages; each takes all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. The
driver writes each result as Parquet and reads it again for the next stage; run() does so in the shared folder.
SQL can't express nearest-neighbour votes, so ORACLE_SQL is None; tests hold each stage against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, lsh_forest, mixing, quality, secret_scan
from cairn.llm.common import free_name, materialize, table


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels.quality, doesn't reject (score 0.5 or more)."""
    voter = quality.fit(docs, table(spark, sf_dir, "labels"))
    rest, score = tuple(c for c in docs.columns if c != "doc_id"), free_name(docs, "score")
    return quality.score(docs, voter, keep=rest, name=score).filter(F.col(score) >= 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group that links of Jaccard likeness 0.8 connect.

    Documents without doc_id stay; of rows that repeat a doc_id each goes by its own text, equal ones together.
    """
    return lsh_forest.firsts(docs).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by [SECRET]."""
    return _with_length(secret_scan.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: 150 % of all words, sources weighing 3, 1, 2, repeating, none taken more than twice."""
    return _with_length(mixing.mix(docs).select(*docs.columns))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document of the mixture; ids that don't decode to their text are an error."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source"), verify=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
