"""Table access, names and folders shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.session import shared_folder

#: Rows in one Arrow batch.  A batch then holds a few megabytes of text, also in a Python worker
#: that shares a small executor; operators cut a batch of long texts further by bytes.
ARROW_ROWS = 512
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
    # Spark's own values, which a query of another subpackage may have changed in the same session
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    "spark.sql.sources.fileCompressionFactor": "1.0",
}
#: What separates words, as a class of a regular expression (Java and RE2).
WORD = r"[^\x20\x09-\x0D]+"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as double underscores) for the jobs that run inside, put back afterwards."""
    named = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in named}
    for key, value in named.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own for one run, inside the one that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def files_of(folder: str):
    """The file system of a URI or a plain path, and the path in it."""
    from pyarrow import fs

    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:") if folder.startswith(("/", "file:")) else folder
    return fs.FileSystem.from_uri(uri)


def written_at(frame: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write a frame as Parquet to the shared folder and read it back; also its folder."""
    spark = frame.sparkSession
    folder = new_folder(spark, what)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder), folder


def written(frame: DataFrame, what: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back.

    Later steps then read only the columns they need, nothing is computed twice, and a lost
    executor costs no more than the tasks it was running.
    """
    return written_at(frame, what)[0]


def discard(folder: str) -> None:
    """Remove a table of this run that no later step reads.  Where files can not be reached from here it stays."""
    try:
        files, base = files_of(folder)
        files.delete_dir(base)
    except (OSError, ValueError):
        pass


def kind(**fields) -> StructType:
    """A struct type from names and types."""
    out = StructType()
    for name, of in fields.items():
        out = out.add(name, of)
    return out


def free_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have, whatever its letters' case."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def crc(column: str | Column) -> Column:
    """Unsigned CRC-32 of a value written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column)
