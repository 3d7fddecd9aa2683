"""Session settings, table loading and lineage cutting."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

#: Tables whose rows are parsed, which costs more than moving them.
TEXT_TABLES = ("documents", "pages", "conversations", "events")

#: Runtime settings every job relies on.  AQE sizes and splits shuffle partitions; joins are
#: broadcast only when the measured side is below Spark's own size threshold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # parsing text costs far more than opening a file: smaller splits keep all cores at work
    "spark.sql.files.maxPartitionBytes": "32m",
    # Spark's own values, which ``by_claim`` changes for one query
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    "spark.sql.sources.fileCompressionFactor": "1.0",
}
#: For queries whose tables all lie by claim: they are joined by claim and source where they lie, and files, which hold
#: compressed columns, count as larger when Spark asks what is small enough to be broadcast.
BY_CLAIM = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.fileCompressionFactor": "20.0",
}
#: A session of one machine may name into how many partitions tables of text are dealt when they are read: files
#: with a single row group would keep one core at work.  On a cluster it is unset, and files are the partitions.
TABLE_PARTITIONS = "spark.tracewell.tablePartitions"
#: Settings a session must be built with.  Recording the Python call site of every column
#: costs more than building the column.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session, where they differ."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def by_claim(spark: SparkSession) -> SparkSession:
    """Settings for a query whose tables lie by claim; the next query begins with ``configure`` again."""
    for key, value in BY_CLAIM.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "8g", name: str = "tracewell") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config(TABLE_PARTITIONS, os.environ.get("TABLE_PARTITIONS", "8"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in {**SETTINGS, **STATIC_SETTINGS}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{directory}/{name}.parquet")
    parts = spark.conf.get(TABLE_PARTITIONS, None)
    return rows.repartition(int(parts)) if parts and name in TEXT_TABLES else rows


def parts(spark: SparkSession) -> int:
    """Partitions of tables that are dealt by a key."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by keys over as many partitions as a shuffle has, however few files they come in.

    For narrow rows whose work is heavy: neither the size of a file nor that of a shuffle tells how long a task takes,
    so the number is fixed, which AQE leaves alone.
    """
    return rows.repartition(parts(rows.sparkSession), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # a local session has one machine; its warehouse is the folder that it names itself
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own for one run, inside the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Materialize a frame in the shared checkpoint folder and forget how it was made."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def kept(frame: DataFrame, *keys: str) -> DataFrame:
    """Write a frame that ``spread`` has dealt by keys once, into the shared folder, and read it back.

    No row is moved, neither now nor when it is read: such tables are joined, grouped and numbered by their keys where
    they lie.  Files hold compressed columns, of which a step reads those it needs.
    """
    spark = frame.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    frame.write.format("parquet").bucketBy(parts(spark), *keys).option(
        "path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name: the folder was given, and stays
    return rows
