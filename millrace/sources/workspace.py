"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths made since the innermost ``settled`` began.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def workspace(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``).

    Where the setting is absent a local master gets a folder of its own; on a cluster that is an error, because
    executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="millrace-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{workspace(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: lineage ends there and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, tag: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Materializes what ``build`` returns, then deletes every other table that was made meanwhile."""
    token = _made.set(inner := [])
    try:
        df = build()
    finally:
        _made.reset(token)
    out = materialize(df, tag)
    for path in inner:
        _delete(spark, path)
    return out


STORE = "millrace-stored"


def stored_path(spark: SparkSession, tag: str) -> str:
    """A new path beside the stored steps, which ``clean`` leaves alone."""
    return f"{workspace(spark)}/{STORE}/{tag}-{uuid.uuid4().hex}"


def inputs_digest(spark: SparkSession, paths: Sequence[str], by_content: bool = False) -> str:
    """A digest of files and folders: names below each path, lengths and times of change, or with ``by_content`` names and what the files hold.

    By content every file is read by a task, a whole file at a time; only digests come to the driver.
    """
    told = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        top = files.resolvePath(at).toString()
        if by_content:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            rows = found.select("path", F.sha2("content", 256).alias("digest")).collect()
            told.append(sorted((r.path.rpartition("/")[2] if r.path.endswith(top) else r.path.split(top, 1)[-1], r.digest) for r in rows))
            continue
        listed, each = files.listFiles(at, True), []
        while listed.hasNext():
            one = listed.next()
            if not one.getPath().getName().startswith(("_", ".")):
                each.append((one.getPath().toString().removeprefix(top), one.getLen(), one.getModificationTime()))
        told.append(sorted(each))
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()


def remembered(
    spark: SparkSession, step: str, inputs: Sequence[str], parameters: Mapping, build: Callable[[], DataFrame], by_content: bool = False, folder: str | None = None
) -> DataFrame:
    """The stored result of a step, or else what ``build`` returns, stored for this session and later ones.

    The key is a digest of the step's name, its parameters and its input files (``inputs_digest``), so a change of any of
    them builds anew. Results are in ``folder``, by default one beside the tables of the workspace, which ``clean`` leaves
    alone. A result is written under a name of its own and renamed when it is whole; a folder that a broken-off rename or
    copy left without its mark of success is taken for none and written again. Whoever finishes second takes the first one's.
    """
    told = json.dumps([step, inputs_digest(spark, inputs, by_content), parameters], sort_keys=True, default=str)
    base = folder or f"{workspace(spark)}/{STORE}"
    final = f"{base}/{step}-{hashlib.sha256(told.encode()).hexdigest()}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(final).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = lambda: files.exists(path(f"{final}/_SUCCESS"))
    if not whole():
        aside = f"{base}/_{step}-{uuid.uuid4().hex}"
        build().write.parquet(aside)
        if files.exists(path(final)) and not whole():
            files.delete(path(final), True)
        if whole() or not files.rename(path(aside), path(final)):
            files.delete(path(aside), True)
    return spark.read.parquet(final)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` made; it must not be read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/millrace/" in f}:
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that the library has in the session's shared folder; none of its results may be read afterwards."""
    _delete(spark, f"{workspace(spark)}/millrace")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
