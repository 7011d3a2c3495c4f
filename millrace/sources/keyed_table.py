"""Tables on disk that are changed by key: rows lie in buckets of their key's hash, and a change rewrites the buckets that it touches."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import relational
from millrace.operators.keyed import free_name
from millrace.sources.workspace import discard, materialize

META = "_keyed"


class KeyedTable:
    """A Parquet table in a folder, partitioned by ``pmod(xxhash64(key), buckets)``; a key has one row at most.

    A change reads the buckets of its keys, writes their new rows aside in the shared workspace, and then replaces just these
    buckets. What is replaced was computed before, so a task that runs again writes the same rows, and a change that was
    cut off while it replaced buckets is repaired by making it again. One writer at a time; a reader that must not
    see half a change reads between changes. The key, the number of buckets and the schema are kept beside the data.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int, schema: T.StructType) -> None:
        self.spark, self.path, self.key, self.buckets, self.schema = spark, path, key, buckets, schema
        self.bucket = "bucket"
        while self.bucket in {f.name.lower() for f in schema.fields}:
            self.bucket = "_" + self.bucket

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
        """Writes a new table; of rows that repeat a key that of the largest values stays. Null keys are an error, and so is a path that has a table."""
        table = cls(rows.sparkSession, path, key, buckets, rows.schema)
        if table._exists(f"{path}/{META}"):
            raise ValueError(f"there is a table in {path}")
        table._refuse_nulls(rows)
        table._write(table._bucketed(relational.last_by_key(rows, key)))
        meta = [(key, buckets, rows.schema.json())]
        rows.sparkSession.createDataFrame(meta, "key string, buckets int, schema string").coalesce(1).write.parquet(f"{path}/{META}")
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        meta = spark.read.parquet(f"{path}/{META}").first()
        return cls(spark, path, meta.key, meta.buckets, T.StructType.fromJson(json.loads(meta.schema)))

    def read(self) -> DataFrame:
        return self._stored().drop(self.bucket)

    def lookup(self, keys: Sequence) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]]))
        return self._stored().where(F.col(self.bucket).isin(self._touched(wanted))).join(wanted, self.key, "left_semi").select(self.schema.names)

    def update(self, changes: DataFrame) -> list[int]:
        """Rows whose key is in ``changes`` take its values, nulls too; keys that the table has not got are left out. The buckets rewritten."""
        return self._change(changes, lambda rows, new: relational.update_by_key(rows, new, self.key))

    def insert(self, new: DataFrame) -> list[int]:
        """Adds rows whose key the table has not got; columns that ``new`` lacks are null."""
        return self._change(new, lambda rows, new: rows.unionByName(self._whole(new).join(rows, self.key, "left_anti")))

    def upsert(self, changes: DataFrame) -> list[int]:
        """Updates the keys that are there and inserts the others."""

        def change(rows: DataFrame, new: DataFrame) -> DataFrame:
            return relational.update_by_key(rows, new, self.key).unionByName(self._whole(new).join(rows, self.key, "left_anti"))

        return self._change(changes, change)

    def mark(self, keys: DataFrame, **values: Column) -> list[int]:
        """Sets columns of the rows of some keys, as a soft delete does: ``mark(keys, deleted_at=now, is_active=F.lit(False))``."""

        def change(rows: DataFrame, new: DataFrame) -> DataFrame:
            hit = free_name(rows, "hit")
            met = rows.join(new.select(self.key).withColumn(hit, F.lit(True)), self.key, "left")
            set_to = lambda c: F.when(F.col(hit), values[c].cast(self.schema[c].dataType)).otherwise(F.col(c)) if c in values else F.col(c)
            return met.select(*[set_to(c).alias(c) for c in self.schema.names])

        return self._change(keys, change)

    def delete(self, keys: DataFrame) -> list[int]:
        """Removes the rows of some keys."""
        return self._change(keys, lambda rows, new: rows.join(new, self.key, "left_anti"))

    def _change(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        self._refuse_nulls(changes)
        new = materialize(relational.last_by_key(changes, self.key), "keyed-changes")
        touched = self._touched(new)
        if not touched:
            return []
        old = self._stored().where(F.col(self.bucket).isin(touched)).select(self.schema.names)
        made = materialize(self._bucketed(change(old, new).select(self.schema.names)), "keyed-rows")
        # A bucket that lost its last row is in no partition of the result, so nothing replaces it.
        filled = {r[0] for r in made.select(self.bucket).distinct().collect()}
        self._write(made)
        for bucket in set(touched) - filled:
            self._remove(f"{self.path}/{self.bucket}={bucket}")
        for done in (new, made):
            discard(done)
        return touched

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some keys, as many as the table has at most."""
        return sorted(r[0] for r in rows.select(self._bucket_of()).distinct().collect())

    def _bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int").alias(self.bucket)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], self._bucket_of())

    def _whole(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(self.bucket, T.IntegerType())])).parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        """Replaces the partitions that the rows are in, and no others; a bucket is one file."""
        dealt = rows.repartition(self.buckets, self.bucket)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.bucket).parquet(self.path)

    def _refuse_nulls(self, rows: DataFrame) -> None:
        if not rows.where(F.col(self.key).isNull()).isEmpty():
            raise ValueError(f"{self.key} is null in some rows")

    def _file(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, files = self._file(path)
        return files.exists(at)

    def _remove(self, path: str) -> None:
        at, files = self._file(path)
        files.delete(at, True)
