"""Session settings.

On a cluster the session comes from the cluster; these helpers only fill in what is
unset, so they can be called on any session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "microfolio", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, the warehouse of a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("/", "file:")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return warehouse


def stages_folder(spark: SparkSession) -> str:
    """Where this application keeps its stage tables."""
    return f"{shared_folder(spark)}/stages/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame as a named intermediate table: written once, read by all later steps, and there when executors are lost."""
    path = f"{stages_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that one task sorts, joins and sums.
ROWS_OF_A_TASK = 250_000


def parts_for(*tables: DataFrame) -> int | None:
    """Parts in which a task holds ``ROWS_OF_A_TASK`` rows of the largest table; None where Spark's own layout does not hold more.

    Each table is counted, so give stored tables, not results.
    """
    rows = max(t.count() for t in tables)
    parts = -(-rows // ROWS_OF_A_TASK)
    return parts if parts > tables[0].sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The rows laid out by the keys in so many parts; unchanged without a number, for the next step to lay out."""
    return df.repartition(parts, *keys) if parts else df


def _located(spark: SparkSession, path: str):
    """(path, file system it belongs to)"""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _located(spark, path)
    return files.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    target, files = _located(spark, path)
    files.delete(target, True)


def remove_stages(spark: SparkSession) -> None:
    """Delete the stage tables of this application, once their results have been written or read."""
    remove_path(spark, stages_folder(spark))
