"""Intermediate tables: only those that are named go."""

from pathlib import Path

from cairn.llm.common import drop, materialize, scratch_dir


def test_drop_takes_one_table(spark):
    a, b = materialize(spark.range(5), "a"), materialize(spark.range(7), "b")
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    drop(a)
    gone = before - {p.name for p in folder.iterdir()}
    assert len(gone) == 1 and gone.pop().startswith("a-") and b.count() == 7


def test_drop_leaves_other_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "own"))
    own = spark.read.parquet(str(tmp_path / "own"))
    drop(own)
    assert own.count() == 3


def test_empty_table(spark):
    drop(materialize(spark.range(0), "none"))
