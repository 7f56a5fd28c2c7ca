"""Where steps keep what later steps read several times, and how many rows they hand to Python at a time."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, GroupedData, SparkSession

#: Bytes of rows that Spark hands to a Python worker at a time, in a session that names no bound of its own.
BATCH_BYTES = "1m"


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Have a session hand rows to Python in batches of bounded bytes and not of 10 000 rows of any length. Without ``spark``, the one that is active."""
    spark, name = spark or SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def sorted_groups(rows: DataFrame, *keys: str) -> GroupedData:
    """Rows grouped by keys after one shuffle and one sort, for lists of very many small groups.

    Else Spark starts each list before the shuffle and again after it, and sorts the rows both times. The setting that
    lets it use the sort is put into a session that does not name it; without it only the time differs.
    """
    spark, name = rows.sparkSession, "spark.sql.execution.replaceHashWithSortAgg"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, "true")
    return rows.repartition(keys[0]).sortWithinPartitions(*keys).groupBy(*keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Where the session names none, a temporary folder serves a local master; on a
    cluster that would lose data with an executor, so it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("palimpsest.folder", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("palimpsest.folder", where)
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
