import pytest

PLAIN = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with extra columns whose names could clash."""

    def docs(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, PLAIN)
        return df.selectExpr("*", "1 as k", "2 as t", "3 as row", "4 as spans", "5 as size", "6 as b", "7 as id", "8 as digest", "9 as __x")

    return docs


@pytest.fixture(scope="session")
def corpus(spark, tiny):
    return {r.doc_id: r for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def result(spark, tiny):
    """A registered query's rows on the small tables, by doc_id or page_id; computed once."""
    from cairn.llm.queries import QUERIES

    seen = {}

    def get(name):
        if name not in seen:
            seen[name] = {r[0]: r for r in QUERIES[name](spark, tiny).collect()}
        return seen[name]

    return get


#: Rows that every operator must take: nulls anywhere, empty, blank, repeated rows and keys, ties.
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one two three"), (4, "one two three"), (None, "no key at all here"), (None, None), (5, "é ß 中文 👍 words"), (6, "a\u00a0b  c ")]
