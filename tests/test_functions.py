import datetime

import pytest
from pyspark.sql import functions as F

from cairn.functions import dates_from_epoch, extract_year, in_list, int_divide, like, llm, near_equal, not_like, register, sub_string
from cairn.types import schema, spark_type


def values(df, *exprs):
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_like(spark):
    df = spark.createDataFrame([("abc",), ("a_c",), ("a%c",), ("",), (None,)], "s string")
    pick = lambda cond: [r.s for r in df.filter(cond).collect()]
    assert pick(like("s", "a_c")) == ["abc", "a_c", "a%c"]
    assert pick(like("s", r"a\%c")) == ["a%c"] and pick(like("s", r"a\_c")) == ["a_c"]
    assert pick(like("s", "%")) == ["abc", "a_c", "a%c", ""]
    assert pick(not_like("s", "a%")) == [""]


def test_year_edges(spark):
    df = spark.sql("select explode(array(timestamp_ntz'1996-12-31 23:59:59', timestamp_ntz'1997-01-01 00:00:00')) ts")
    assert values(df, extract_year("ts")) == [(1996,), (1997,)]
    assert df.select(extract_year("ts")).dtypes[0][1] == "bigint"


def test_epoch_dates(spark):
    df = spark.createDataFrame([(820425600,)], "s long")
    assert values(df, dates_from_epoch("s", "Asia/Shanghai"), dates_from_epoch("s")) == [(datetime.date(1996, 1, 1), datetime.date(1995, 12, 31))]


def test_sub_string_counts_from_zero(spark):
    df = spark.createDataFrame([("hello",)], "s string")
    assert values(df, sub_string("s", 0, 2), sub_string("s", 3, 9), sub_string("s", 9, 2)) == [("he", "lo", "")]
    with pytest.raises(ValueError):
        sub_string("s", -1, 2)


def test_numbers(spark):
    df = spark.createDataFrame([(7, 2, 1.001, 1.004), (-7, 2, 1.001, 1.006), (1, 0, 0.0, 0.0)], "a int, b int, x double, y double")
    assert values(df, int_divide("a", "b"), near_equal("x", "y")) == [(3, True), (-3, False), (None, True)]
    assert values(df, F.col("a") + F.col("x"))[0] == (8.001,)
    assert values(df.filter(in_list("a", (1, 7))), "a") == [(7,), (1,)]


def test_llm(spark):
    df = spark.createDataFrame([("x", "p"), (None, None)], "a string, b string")
    assert values(df, llm("say: ", "a")) == [("say: x",), ("say: ",)]
    assert values(df, llm("q ", "a", "b", backend=lambda texts, others: [f"{t}|{o}" for t, o in zip(texts, others)])) == [("q x|p",), ("q |None",)]
    register(spark)
    df.createOrReplaceTempView("llm_in")
    assert [r[0] for r in spark.sql("select llm('say: ', a, b) from llm_in").collect()] == ["say: x", "say: "]
    assert spark.sql("select sub_string('hello', 1, 3)").first()[0] == "ell"


def test_types():
    assert spark_type("varchar(20)").simpleString() == "string" and spark_type("INTEGER").simpleString() == "int"
    assert schema(("a", "float4"), ("b", "bool")).simpleString() == "struct<a:float,b:boolean>"
    with pytest.raises(ValueError):
        spark_type("blob")
