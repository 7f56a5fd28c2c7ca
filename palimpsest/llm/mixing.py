"""Mixing sources to target weights with hash-threshold histograms.

Each document has a hash in [0, 2^60). A source that should give a part of itself
gives the documents below a threshold of that hash: word counts are summed by
source and hash bucket, the bucket in which the running sum passes the budget is
found, and only that bucket is refined by the next bits, until it is one hash
value. A budget above the source's size takes whole passes first and the rest by
threshold, so a larger budget always takes what a smaller one does (the
thresholds are nested). Documents are then filtered, never sorted.

Only column functions are used. Per-source rows (one a source and level) are
broadcast behind a check of their number and bytes, else joined.

Defined cases: null text has size 0; a null source is a source, last in order;
rows that share an id share the hash and are taken together; null ids hash as the
empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
HASH_BITS = 60
LEVEL_BITS = 12
#: Source rows are broadcast up to these; beyond, they are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(base: DataFrame) -> DataFrame:
    """One row a source: its words, its target, whole passes and the rest of the budget.

    ``target = min(MOST * words, level * weight)`` where the level spends the
    whole budget: what resharing the excess by weight, again and again, ends in.
    """
    by_source = base.groupBy("s").agg(F.sum("size").alias("words"))
    ordered = Window.orderBy(F.col("s").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    # Sources in the order in which a rising level fills them.
    filling = Window.orderBy(F.col("words") / F.col("weight"), F.col("s").asc_nulls_last())
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.col("words") * F.lit(float(MOST))
    level = (F.sum("words").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("words").over(before), F.lit(0)) * F.lit(float(MOST))) / F.sum("weight").over(onward)
    return (
        by_source.withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("place", F.row_number().over(filling))
        # The first source that its own level does not fill sets the level of all that follow.
        .withColumn("level", F.min(F.when(most > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)["level"])
        .withColumn("target", F.coalesce(F.least(most, F.col("level") * F.col("weight")), most))
        .withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))
        .select("s", "words", "target", "passes", "rest")
    )


def small(df: DataFrame) -> DataFrame:
    """Mark the per-source table for broadcast if it is small enough."""
    n, size = df.select(F.count(F.lit(1)), F.sum(F.octet_length("s") + 64)).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def thresholds(base: DataFrame) -> DataFrame:
    """``targets`` and, by source, the boundary hash ``at`` and whether documents at it are taken.

    ``base``: s (source), size, h (hash).
    """
    state = checkpointed(targets(base).withColumn("at", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.col("words")))
    level = Window.partitionBy("s").orderBy("bucket")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        open_ = small(state).alias("t")
        sums = (
            base.alias("b")
            .join(open_, F.col("b.s").eqNullSafe(F.col("t.s")) & (F.shiftright("b.h", shift + LEVEL_BITS) == F.col("t.at")))
            .groupBy(F.col("t.s").alias("s"), F.shiftright("b.h", shift).alias("bucket"))
            .agg(F.sum("b.size").alias("inside"), F.any_value("t.below").alias("below"), F.any_value("t.rest").alias("rest"))
            .withColumn("below", F.col("below") + F.sum("inside").over(level) - F.col("inside"))
            # The bucket in which the running sum passes the budget; a source without words has none.
            .where((F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("below") + F.col("inside")))
        )
        state = checkpointed(
            state.alias("t")
            .join(sums.alias("n"), F.col("t.s").eqNullSafe(F.col("n.s")), "left")
            .select("t.s", "t.words", "t.target", "t.passes", "t.rest", F.coalesce("n.bucket", F.lit(-1).cast("long")).alias("at"), F.coalesce("n.below", "t.below").alias("below"), F.coalesce("n.inside", F.lit(0).cast("long")).alias("inside"))
        )
    nearer = F.col("below") + F.col("inside") - F.col("rest") < F.col("rest") - F.col("below")
    return state.withColumn("take_at", nearer)


def times(h: Column, at: Column, take_at: Column, passes: Column) -> Column:
    """How often the mix takes a document."""
    return passes + F.when((h < at) | ((h == at) & take_at), 1).otherwise(0)


def mix_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken."""
    base = checkpointed(docs.select("doc_id", F.col("source").alias("s"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")))
    by = small(thresholds(base)).alias("t")
    taken = F.col("b.size") * times(F.col("b.h"), F.col("t.at"), F.col("t.take_at"), F.col("t.passes"))
    return base.alias("b").join(by, F.col("b.s").eqNullSafe(F.col("t.s"))).select("b.doc_id", "b.size", F.col("t.words").alias("source_size"), "t.target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    s, h, n = fresh(docs, "mix_source"), fresh(docs, "mix_hash"), fresh(docs, "mix_times")
    base = checkpointed(docs.select(F.col("source").alias("s"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")))
    by = small(thresholds(base)).select(F.col("s").alias(s), F.struct("at", "take_at", "passes").alias(n))
    keyed = docs.withColumn(h, hash_of(F.col("doc_id")))
    joined = keyed.join(by, keyed["source"].eqNullSafe(by[s]))
    repeated = F.explode(F.array_repeat(F.lit(1), times(F.col(h), F.col(f"{n}.at"), F.col(f"{n}.take_at"), F.col(f"{n}.passes")).cast("int")))
    return joined.withColumn(h, repeated).select(*[docs[c] for c in docs.columns])
