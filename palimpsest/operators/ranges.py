"""Rows of one key in several tasks, where the key has too many for one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed

#: Rows of one key that one task walks in order.
HOT_KEY = 1_000_000


def divided(rows: DataFrame, keys: tuple[str, ...], order: list[str], hot: int = HOT_KEY) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that have at most ``hot`` rows, and the others with ``__key`` and ``__part``.

    Parts are ranges of a key's rows by ``order`` and are numbered in that order. A null key is a key.
    """
    keyed = rows.withColumn("__key", F.struct(*keys))  # structs of nulls are equal, so they join
    large = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot)
    total = large.agg(F.sum("__n")).first()[0]
    if not total:
        return rows, None
    named = F.broadcast(large.select("__key"))  # at most a row for each ``hot`` rows
    # What a range partition holds depends on a sample, so it is written before it is read twice.
    dealt = keyed.join(named, "__key", "left_semi").repartitionByRange(-(-total // hot), *keys, *order).withColumn("__part", F.spark_partition_id())
    return keyed.join(named, "__key", "left_anti").drop("__key"), checkpointed(dealt)
