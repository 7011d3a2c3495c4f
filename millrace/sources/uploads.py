"""Uploaded image files: scan, validation, storage by name and the response record."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.keyed import free_name
from millrace.sources import images

STATIC = "static/"
STORED, FAILED = "Image uploaded successfully", "Image upload failed"


def scan_images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, content, modified) of the files of a folder; empty files hold nothing and are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("modificationTime").alias("modified"))


def checked(uploads: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds ``image``: format, size and, if it is no whole image or its name is not that of one, the problem."""
    return images.decoded(uploads, "content", "name", max_bytes=max_bytes)


def split_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); the rejected ones with their ``problem``."""
    found, name = checked(uploads), free_name(uploads, "problem")
    valid = found.where(F.col("image.problem").isNull()).select(uploads.columns)
    return valid, found.withColumn(name, F.col("image.problem")).where(F.col(name).isNotNull()).select(*uploads.columns, name)


def response(uploads: DataFrame) -> DataFrame:
    """(name, detail, imageUrl, status) of every upload."""
    ok = F.col("image.problem").isNull()
    return checked(uploads.select("name", "content")).select(
        "name",
        F.when(ok, STORED).otherwise(FAILED).alias("detail"),
        F.when(ok, F.concat(F.lit(STATIC), F.col("name"))).otherwise("").alias("imageUrl"),
        F.when(ok, 200).otherwise(400).alias("status"),
    )


def last_by_name(uploads: DataFrame, order: str = "modified") -> DataFrame:
    """A later upload replaces an earlier one of the same name; ties go to the larger content hash, and of equal ones one stays.

    Names, times and digests alone are compared; content is shuffled only for the uploads that stay.
    """
    digest = free_name(uploads, "digest")
    hashed = uploads.withColumn(digest, F.sha2("content", 256))
    last = hashed.groupBy("name").agg(F.max(F.struct(F.col(order).alias("at"), F.col(digest).alias("digest"))).alias("last"))
    last = last.select(F.col("name").alias("__name"), "last.at", F.col("last.digest").alias("__digest"))
    same = (hashed["name"] == last["__name"]) & hashed[order].eqNullSafe(last["at"]) & hashed[digest].eqNullSafe(last["__digest"])
    return hashed.join(last, same, "left_semi").dropDuplicates(["name"]).select(uploads.columns)


def store(uploads: DataFrame, folder: str, order: str = "modified") -> DataFrame:
    """Writes the valid uploads as files of ``folder``, overwriting by name, and returns (name, bytes) as written.

    The folder is a path or URI that all executors reach. Names are reduced to their last part.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = [os.path.basename(n) for n in batch.column(0).to_pylist()], []
            for name, content in zip(names, batch.column(1)):
                with files.open_output_stream(f"{root}/{name}") as out:
                    out.write(content.as_buffer())
                sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    valid = last_by_name(split_uploads(uploads)[0], order)
    return valid.select("name", "content").mapInArrow(write, "name string, bytes long")
