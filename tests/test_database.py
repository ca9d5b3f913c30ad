import pytest

from cairn.errors import InvalidData, NoSuchDatabase, NoSuchTable, SchemaMismatch, StatementError, TableExists
from cairn.sources import Database, read_text, show, write_csv
from cairn.sql import QueryHandler
from cairn.types import schema

NATION = schema(("n_nationkey", "INTEGER"), ("n_name", "STRING"), ("n_regionkey", "INTEGER"), ("n_comment", "STRING"))


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


@pytest.fixture
def files(tmp_path):
    out = []
    for i in range(2):
        path = tmp_path / f"nation.tbl_{i}"
        path.write_text("".join(f"{k}|N{k}|{k % 5}| some words \n" for k in range(i * 3, i * 3 + 3)))
        out.append(str(path))
    return out


def test_load_and_reopen(spark, db, files):
    db.register("nation", NATION, ["n_nationkey"])
    assert db.load_files("nation", files) == 6
    again = Database(spark, db.folder, create=False)
    assert again.tables() == ["nation"] and again.primary_key("nation") == ["n_nationkey"]
    rows = sorted(tuple(r) for r in again.table("nation").collect())
    assert rows[4] == (4, "N4", 4, " some words ") and again.schema("nation") == NATION


def test_load_errors(db, tmp_path):
    db.register("nation", NATION)
    for text in ("1|a\n", "1|a|2|b|c\n", "x|a|2|b\n"):
        (bad := tmp_path / "bad.tbl").write_text("0|z|0|z\n" + text)
        with pytest.raises(InvalidData):
            db.load_files("nation", str(bad))
    with pytest.raises(InvalidData):
        db.load_files("nation", str(tmp_path / "missing.tbl"))
    assert db.table("nation").count() == 0


def test_trailing_separator_and_quotes(spark, tmp_path):
    (path := tmp_path / "t.tbl").write_text('1|say "hi"|\n2||\n')
    assert [tuple(r) for r in read_text(spark, str(path), schema(("a", "int"), ("b", "string"))).collect()] == [(1, 'say "hi"'), (2, "")]


def test_registry(spark, db, tmp_path):
    db.register("t", schema(("a", "int")))
    with pytest.raises(TableExists):
        db.register("t", schema(("a", "int")))
    with pytest.raises(SchemaMismatch):
        db.insert("t", spark.createDataFrame([(1,)], "a bigint"))
    with pytest.raises(InvalidData):
        db.insert("t", spark.createDataFrame([], "a int"))
    db.insert("t", spark.createDataFrame([(1,)], "a int"))
    db.insert("t", spark.createDataFrame([(2,)], "a int"))
    assert sorted(r.a for r in db.table("t").collect()) == [1, 2]
    db.drop("t")
    with pytest.raises(NoSuchTable):
        db.table("t")
    with pytest.raises(NoSuchDatabase):
        Database(spark, str(tmp_path / "none"), create=False)
    with pytest.raises(NoSuchDatabase):
        Database.delete(spark, str(tmp_path))
    Database.delete(spark, db.folder)
    assert not (tmp_path / "db").exists()


def test_sql(spark, db):
    q = QueryHandler(db)
    q.query("CREATE TABLE A (id INTEGER PRIMARY KEY, score FLOAT, name varchar(20))")
    q.query("create table b (id int, age int, primary key (id));")
    assert db.primary_key("A") == ["id"] and db.primary_key("b") == ["id"]
    db.insert("A", spark.createDataFrame([(1, 0.5, "x"), (2, 1.5, None)], db.schema("A")))
    db.insert("b", spark.createDataFrame([(1, 30)], db.schema("b")))
    got = q.query("with o as (select id, max(age) m from b group by id) select a.id, coalesce(m, 0) m from A a left join o on a.id = o.id order by m desc limit 1")
    assert got.row_count() == 1 and tuple(got.df.first()) == (1, 30)
    assert q.query("select name from A where id in (select id from b) and not score > 1").row_count() == 1
    assert q.query("select * from (values (1, 'a'), (2, 'b')) as v(id, s)").row_count() == 2
    assert "30" in got.show()
    for bad in ("selec 1", "select nope from A", "select 1; select 2", "create table c (a blob)", "create table c (a int, primary key (z))"):
        with pytest.raises(StatementError):
            q.query(bad)
    q.query("drop table b")
    with pytest.raises(StatementError):
        q.query("select * from b")


def test_csv_and_show(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string").coalesce(1)
    write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    assert show(df, 1).count("\n") == 4 and "NULL" in show(df, 1, tail=True)
    assert "| x | y |" in capsys.readouterr().out
