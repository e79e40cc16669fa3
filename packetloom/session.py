"""Session helpers: builder settings, shared folders and size checks."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

_SHIPPED: set[str] = set()

# What a Python worker gets at once. With rows alone as the limit, a batch of
# files grows with the table until it has all rows that fit.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

# Tables up to this many rows may be used as literals or inlined relations.
SMALL_TABLE_ROWS = 10_000


def build_session(app: str = "packetloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the library is tuned for.

    Shuffle parallelism is left to adaptive execution: start from many small
    partitions and let it coalesce them, split skewed joins and switch to
    broadcast joins where the measured size allows it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        BATCH_BYTES[0]: BATCH_BYTES[1],
        "spark.sql.parquet.filterPushdown": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="packetloom-"), os.path.basename(package))
        # Spark serves the archive from the driver to every executor.
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches of Python workers in a session that has no bound of its own."""
    key, size = BATCH_BYTES
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="packetloom-"))
    return os.path.dirname(context.getCheckpointDir().rstrip("/"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/packetloom/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_if_small(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> list[Row] | None:
    """All rows of ``df`` if there are at most ``limit`` of them, else None.

    At most ``limit + 1`` rows ever reach the driver, so this is safe on a
    table of unknown size; callers need a distributed path for None.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table with few input splits to all cores.

    A table of many files already has more splits than cores and is returned
    as it is, so large inputs are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
