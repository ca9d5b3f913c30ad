"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the rank file, and what they decode to; a row for each document."""
    import public_tokenizers

    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also, for each doc_id divisible by 20 (null for others): near_prints, how many other fingerprints the block
    tables find at most 3 bits from its own, and near_docs, the least doc_ids, in order, of all other fingerprints at
    most NEAR_BITS from its own; documents of equal fingerprint share these lists and are listed once."""
    from .simhash import NEAR_BITS, edited_fingerprints, near_lists, within

    prints = materialize(edited_fingerprints(table(spark, sf_dir, "documents")), "simhash")
    asked = F.col("doc_id") % 20 == 0
    found = within(prints.filter(asked), prints, 3, agree=2).groupBy(F.col("a").alias("fingerprint")).agg(F.count("*").alias("n"))
    near = near_lists(prints.filter(asked), prints, NEAR_BITS).withColumnRenamed("a", "fingerprint")
    # lists meet the documents asked about only
    full = prints.filter(asked).join(found, "fingerprint", "left").join(near, "fingerprint", "left")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    none = F.array().cast("array<bigint>")
    rest = prints.filter(~F.coalesce(asked, F.lit(False))).select(*columns, F.lit(None).cast("bigint").alias("near_prints"), F.lit(None).cast("array<bigint>").alias("near_docs"))
    return full.select(*columns, F.coalesce("n", F.lit(0)).alias("near_prints"), F.coalesce("near", none).alias("near_docs")).union(rest)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document; also n_shards, the output shards that drew some of its words."""
    from .mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the base kinds and of published token formats in every text; a row for each document."""
    from .secret_scan import BASE, joined, scan

    found = scan(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *(count(i).alias(f"n_{rule.kind}") for i, rule in enumerate(BASE)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also media_width and media_height, from the stored headers alone, and the address: shard, offset."""
    from .media import contents, headers, store

    kept = store(table(spark, sf_dir, "documents"))
    seen = contents(materialize(headers(kept.addresses), "media-headers")).drop("folder")
    return kept.rows.join(seen, "payload").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), F.lower(F.hex("digest")).alias("media_sha256"),
        "feature", "media_width", "media_height", "shard", "offset",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases, and the labels of all templates found; a row for each document."""
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: the longest rule's, else that of trees trained on the pages that rules decide; also score."""
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by nearest labelled neighbours, learned from the rows that aren't held out; a row for each document."""
    from .quality import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = score(docs, fit(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also root: the Merkle root of the document's chunks."""
    import public_tokenizers

    from .token_store import read, write

    found = read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", F.lower(F.hex("root")).alias("root"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class and its number of links; also set_id and n_sets, see links()."""
    from .lsh_forest import links

    return links(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_secret_scan, op4_media, op5_license_scan, op6_url_filter, op7_quality, op8_token_store, op9_ngram_jaccard, op10_byte_bpe)}

ORACLE_SQL: dict[str, str] = {}
