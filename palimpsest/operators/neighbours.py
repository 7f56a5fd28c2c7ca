"""Nearest vectors without meeting all: hash tables of random projections, several probes, exact re-ranking.

A table's code of a vector says on which sides of ``bits`` random planes it lies. The
index has a row for each vector and table. A query takes the buckets of its user and
sector from the likeliest on (by the squared distances to the planes that it would
have to cross) until they hold ``enough`` vectors for each that is asked for; what
these buckets hold is compared exactly. Where a user's sector holds no more than that,
all its vectors are compared and the result is the exact one; beyond, the work of a
query stays the same however many vectors there are.

Codes are worked out on Arrow batches; everything else is joins on (user, sector, table,
code). A directory of bucket sizes, of at most ``2 ** bits`` rows a table, is all that
every query reads of its user. Vectors of another length than the query's have no
similarity and are not compared; null vectors are not indexed; a vector without length is
0 like anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, doubles, with_norm
from ..storage import bounded_batches
from . import pairs
from .recall import ranked

BUCKET = ["user_id", "sector", "dim", "table", "code"]


@dataclass(frozen=True)
class Projections:
    """Tables of random planes. ``enough``: vectors that a table's buckets hold at least, for each that is asked for."""

    tables: int = 16
    bits: int = 12
    enough: int = 8
    seed: int = 11

    def planes(self, dim: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dim]).standard_normal((dim, self.tables * self.bits))

    def project(self, v: Column) -> Column:
        """By table the signed distances of unit vectors from its planes."""

        bounded_batches()

        @F.pandas_udf("array<array<double>>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            planes: dict[int, np.ndarray] = {}
            for s in batches:
                out = []
                for x in s:
                    x = np.nan_to_num(np.asarray(x, np.float64))
                    p = planes[len(x)] if len(x) in planes else planes.setdefault(len(x), self.planes(len(x)))
                    n = np.linalg.norm(x)
                    out.append(list(((x / n if n else x) @ p).reshape(self.tables, self.bits)))
                yield pd.Series(out, dtype=object)

        return run(doubles(v))

    def code(self, sides: Column) -> Column:
        """The bits of one table as a number."""
        return F.aggregate(sides, F.lit(0), lambda a, x: a * 2 + F.when(x >= 0, 1).otherwise(0))


def index(vectors: DataFrame, by: Projections) -> DataFrame:
    """``vectors`` (user_id, id, sector, v) as rows of hash tables: user_id, sector, dim, table, code, id."""
    rows = vectors.where("v IS NOT NULL").select("user_id", "id", "sector", F.size("v").alias("dim"), by.project(F.col("v")).alias("sides"))
    tables = rows.select("user_id", "id", "sector", "dim", F.posexplode("sides").alias("table", "sides"))
    return tables.select(*BUCKET[:-1], by.code(F.col("sides")).alias("code"), "id")


def candidates(probes: DataFrame, held: DataFrame, by: Projections) -> DataFrame:
    """Distinct (query_id, user_id, sector, id) of the buckets that each probe (query_id, user_id, top_k, qv) takes from the index ``held``."""
    directory = held.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"))
    asked = probes.where("qv IS NOT NULL").select("query_id", "user_id", "top_k", F.size("qv").alias("dim"), by.project(F.col("qv")).alias("sides"))
    asked = asked.select("query_id", "user_id", "top_k", "dim", F.posexplode("sides").alias("table", "sides"))
    places = F.sequence(F.lit(by.bits - 1), F.lit(0), F.lit(-1))
    same = lambda x, place: (x >= 0) == (F.getbit(F.col("code"), place) == 1)
    crossed = F.zip_with("sides", places, lambda x, place: F.when(same(x, place), 0.0).otherwise(x * x))
    cost = F.aggregate(crossed, F.lit(0.0), lambda a, x: a + x)
    ways = asked.join(directory, ["user_id", "dim", "table"]).select("query_id", "top_k", *BUCKET, "n", cost.alias("cost"))
    before = Window.partitionBy("query_id", "sector", "table").orderBy("cost", "code").rowsBetween(Window.unboundedPreceding, -1)
    taken = ways.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < F.col("top_k") * 3 * by.enough)
    return taken.select("query_id", *BUCKET).join(held, BUCKET).select("query_id", "user_id", "sector", "id").distinct()


def near_recall(probes: DataFrame, vectors: DataFrame, by: Projections | None = None, held: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Like ``vector_recall``, for each query and sector its 3 * top_k most similar vectors, of those that the index finds.

    ``held``: a kept ``index`` of the vectors; without it one is made. ``exact`` adds what the
    index has missed: the least similarity that it found for a query and sector bounds a pass over all vectors.
    """
    by = by or Projections()
    found = candidates(probes, index(vectors, by) if held is None else held, by)
    asked = with_norm(probes.select("query_id", "top_k", "qv"), "qv", "nq")
    stored = with_norm(vectors.select("user_id", "sector", "id", "v"), "v", "nv")
    both = found.join(stored, ["user_id", "sector", "id"]).join(asked, "query_id")
    scored = both.select("query_id", "user_id", "top_k", "id", "sector", cosine(F.col("v"), F.col("qv"), (F.col("nv"), F.col("nq"))).alias("similarity")).where("similarity IS NOT NULL")
    near = ranked(scored, ["query_id", "sector"], F.desc("similarity"), "id").where("rank <= top_k * 3")
    if not exact:
        return near
    full = near.groupBy("query_id", "sector").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n"), F.max("top_k").alias("top_k")).where("n = top_k * 3 AND sector IS NOT NULL")
    bounds = full.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("sector", "least"))).alias("bounds"))
    asked = probes.select("query_id", "user_id", "top_k", F.col("qv").alias("v")).join(bounds, "query_id", "left").withColumnRenamed("query_id", "id")
    rest = pairs.best(asked, vectors.select("user_id", "id", "sector", "v"), ["user_id"])
    return ranked(rest, ["query_id", "sector"], F.desc("similarity"), "id").where("rank <= top_k * 3")
