"""A database: a folder of Parquet tables with a definition file each, on any file system that Spark reaches."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidData, NoSuchDatabase, NoSuchTable, SchemaMismatch, TableExists
from .text import checked, read_text

_MARK = "_database.json"
_DEFINITION = "_definition.json"


class Database:
    """Tables by name below one folder: folder/name/data holds Parquet files, folder/name/_definition.json the schema.

    Opening costs one file lookup; tables are read from their definitions when asked for, without inference.
    """

    def __init__(self, spark: SparkSession, folder: str, create: bool = True):
        """Open folder; NoSuchDatabase if it is no database and create is false."""
        self.spark, self.folder = spark, folder.rstrip("/")
        if not self._exists(_MARK):
            if not create:
                raise NoSuchDatabase(folder)
            self._put(_MARK, {"version": 1})

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def _put(self, name: str, value: dict) -> None:
        fs, path = self._path(name)
        out = fs.create(path, True)
        try:
            out.write(json.dumps(value).encode())
        finally:
            out.close()

    def _get(self, name: str) -> dict:
        fs, path = self._path(name)
        file = fs.open(path)
        try:
            return json.loads(bytes(file.readAllBytes()))
        finally:
            file.close()

    def register(self, name: str, schema: T.StructType, primary_key: Sequence[str] = ()) -> None:
        """Define an empty table; TableExists if there is one. The primary key is kept, not enforced."""
        if self._exists(f"{name}/{_DEFINITION}"):
            raise TableExists(name)
        self._put(f"{name}/{_DEFINITION}", {"schema": schema.jsonValue(), "primary_key": list(primary_key)})

    def schema(self, name: str) -> T.StructType:
        if not self._exists(f"{name}/{_DEFINITION}"):
            raise NoSuchTable(name)
        return T.StructType.fromJson(self._get(f"{name}/{_DEFINITION}")["schema"])

    def primary_key(self, name: str) -> list[str]:
        self.schema(name)
        return self._get(f"{name}/{_DEFINITION}")["primary_key"]

    def table(self, name: str) -> DataFrame:
        """The table's rows as they are now; NoSuchTable if it isn't registered."""
        schema = self.schema(name)
        if not self._exists(f"{name}/data"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/data")

    def tables(self) -> list[str]:
        fs, path = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return sorted(n for n in names if self._exists(f"{n}/{_DEFINITION}"))

    def insert(self, name: str, rows: DataFrame) -> None:
        """Append rows of exactly the table's names and types; SchemaMismatch otherwise, InvalidData if there are none."""
        schema = self.schema(name)
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in schema]:
            raise SchemaMismatch(f"{name}: {rows.schema.simpleString()} is not {schema.simpleString()}")
        if not self._append(name, rows):
            raise InvalidData(f"no rows for {name}")

    def _append(self, name: str, rows: DataFrame) -> int:
        """How many rows were written; they are counted as they go by."""
        seen = Observation()
        checked(rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet, f"{self.folder}/{name}/data")
        return seen.get["n"]

    def load_files(self, name: str, paths: str | Sequence[str], separator: str = "|") -> int:
        """Append delimited text files, in parallel; how many rows they have.

        InvalidData for a missing file, a wrong number of fields or a bad value; then nothing of the call is kept.
        """
        schema = self.schema(name)
        from pyspark.errors import AnalysisException

        try:
            rows = read_text(self.spark, paths, schema, separator)
        except AnalysisException as e:
            raise InvalidData(str(e).split("\n")[0][:200]) from None
        return self._append(name, rows)

    def drop(self, name: str, purge: bool = False) -> None:
        """Forget a table; purge also deletes its rows, which else stay in place and are read again if it is redefined."""
        self.schema(name)
        fs, path = self._path(name if purge else f"{name}/{_DEFINITION}")
        fs.delete(path, True)

    @staticmethod
    def delete(spark: SparkSession, folder: str) -> None:
        """Remove a database and all its tables; NoSuchDatabase, and nothing removed, if folder is none."""
        db = Database(spark, folder, create=False)
        fs, path = db._path("")
        fs.delete(path, True)
