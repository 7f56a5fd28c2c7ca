"""How memories age, are reinforced, replaced and linked."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vectors as V
from ..functions.embedding import Embed, embedded, hash_embed
from ..storage import checkpointed
from .pairs import nearest
from .recall import ranked


#: Rows of one hour that one task numbers.
HOT_HOUR = 1_000_000


def assign_segments(memories: DataFrame, size: int = 10_000, hot: int = HOT_HOUR) -> DataFrame:
    """Segment numbers in order of creation: ``size`` rows each.

    The global row number comes from row numbers inside ranges of time and the row
    counts of earlier ranges, so no task numbers all rows. A range is an hour; hours of more than ``hot``
    rows are divided further, in the order of creation and id, so rows of one time are divided too.
    """
    rows = memories.withColumn("__hour", F.date_trunc("HOUR", F.col("created_at"))).withColumn("__part", F.lit(0))
    large = rows.groupBy("__hour").agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > hot) & F.col("__hour").isNotNull())
    if total := large.agg(F.sum("__n")).first()[0]:
        hours = F.broadcast(large.select("__hour"))  # at most a row for each ``hot`` rows
        # What a range partition holds depends on a sample, so it is written before it is counted.
        dealt = checkpointed(rows.join(hours, "__hour", "left_semi").repartitionByRange(-(-total // hot), "created_at", "id").withColumn("__part", F.spark_partition_id()))
        rows = rows.join(hours, "__hour", "left_anti").unionByName(dealt)
    counts = rows.groupBy("__hour", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__hour", "__part", (F.sum("__n").over(Window.orderBy("__hour", "__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__hour", "__part").orderBy("created_at", "id"))
    numbered = rows.withColumn("__place", place).join(before, ["__hour", "__part"])
    return numbered.withColumn("segment", F.floor((F.col("__before") + F.col("__place") - 1) / size).cast("int")).drop("__hour", "__part", "__place", "__before")


def sample_per_segment(memories: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """A share of each segment, one row at least; the same rows on each run."""
    w = Window.partitionBy("segment")
    chosen = memories.withColumns({"__n": F.count(F.lit(1)).over(w), "__rank": F.row_number().over(w.orderBy(F.xxhash64("id", F.lit(seed)), "id"))})
    return chosen.where(F.col("__rank") <= F.greatest(F.lit(1), F.floor(F.col("__n") * ratio))).drop("__n", "__rank")


def decayed(memories: DataFrame, as_of: Column) -> DataFrame:
    """Add tier, factor, new_salience and changed."""
    salience, feedback = F.col("salience"), F.coalesce(F.col("feedback_score"), F.lit(0))
    age = F.greatest(F.lit(0.0), F.coalesce(S.days(F.col("last_seen_at"), as_of), F.lit(0.0)))
    boosted = S.clamp(F.when(F.coalesce(salience, F.lit(0.0)) == 0, 0.5).otherwise(salience) * (1 + F.log1p(F.greatest(F.lit(0), feedback))))
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in C.TIER_RATES.items() for x in kv]), F.col("tier"))
    out = memories.withColumn("tier", S.tier(F.col("last_seen_at"), feedback, salience, as_of))
    out = out.withColumn("factor", F.exp(-rate * (age / (boosted + 0.1)))).withColumn("new_salience", S.clamp(boosted * F.col("factor")))
    return out.withColumn("changed", F.abs(F.col("new_salience") - F.coalesce(salience, F.lit(0.0))) > 0.001)


def top_keywords(df: DataFrame, k: int, key: str = "id", text: str = "content") -> DataFrame:
    """The k most frequent canonical tokens of each text, ties by first place, joined by blanks. Texts have one row a key; those without tokens have none."""
    return df.select(key, T.top_words(F.col(text), k).alias("keywords")).where("keywords IS NOT NULL")


def apply_decay(memories: DataFrame, vectors: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Decay all given memories: the memories with their new salience and summary, and the vectors that change.

    Vectors shrink where much is forgotten, and become a fingerprint of the text
    where almost all is. They keep their user.
    """
    aged = decayed(memories, as_of)
    cold = aged.where(F.col("factor") < C.FINGERPRINT_BELOW)
    words = top_keywords(cold, 3).withColumnRenamed("keywords", "new_summary")
    out = aged.join(words, "id", "left").withColumn("fingerprinted", F.col("factor") < C.FINGERPRINT_BELOW)
    # Made before the join, so that no text is shuffled.
    faded = F.when(F.col("factor") < C.FINGERPRINT_BELOW, F.trim(F.concat("id", F.lit("|"), F.coalesce("content", F.lit("")))))
    own = aged.where(F.col("factor") < C.COMPRESS_BELOW).select("id", F.col("primary_sector").alias("sector"), "factor", V.fingerprint(faded).alias("print")).join(vectors, ["id", "sector"], "left")
    shrunk = V.decay_compressed(F.col("v"), F.col("factor"), C.LEAST_DIM, C.MOST_DIM)
    new = F.when(F.col("factor") < C.FINGERPRINT_BELOW, F.col("print")).when(F.size(shrunk) < F.size("v"), shrunk)
    changed = own.select("id", "sector", "user_id", new.alias("v")).where("v IS NOT NULL").withColumn("dim", F.size("v"))
    shrunk_ids = changed.select("id", F.lit(True).alias("vector_changed"))
    out = out.join(shrunk_ids, "id", "left").withColumn("changed", F.col("changed") | F.coalesce("vector_changed", F.lit(False)) | F.col("fingerprinted")).drop("vector_changed")
    return out, changed


def decay_report(aged: DataFrame) -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return aged.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), count(F.col("changed"))("changed"), count(F.col("factor") < C.COMPRESS_BELOW)("compressible"), count(F.col("factor") < C.FINGERPRINT_BELOW)("fingerprinted"))


def reinforced(salience: Column, times: Column) -> Column:
    """A salience after a number of hits: each closes part of the gap to 1, then adds a bonus, at most 1."""
    return F.aggregate(F.sequence(F.lit(1), times), salience, lambda s, _: F.least(F.lit(1.0), s + (1.0 - s) * C.TRACE_RATE + C.HIT_BONUS))


def reinforce(hits: DataFrame, memories: DataFrame, edges: DataFrame | None, as_of: Column) -> DataFrame:
    """Saliences after hits (id) and when they were last seen, ``as_of``: the hit memories, and the neighbours that their waypoints (src_id, dst_id) lead to.

    A hit starts from the decayed salience. A neighbour moves towards the highest
    salience that a hit memory linked to it has reached, less the longer it was not seen.
    """
    n = hits.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("hits"))
    start = S.decayed_salience(F.col("primary_sector"), F.col("salience"), S.days(F.col("last_seen_at"), as_of))
    hit = memories.join(n, "id").select("id", F.col("salience").alias("old_salience"), reinforced(start, F.col("hits")).alias("new_salience"), "hits", as_of.alias("last_seen_at"))
    if edges is None:
        return hit
    source = edges.join(hit.select(F.col("id").alias("src_id"), F.col("new_salience").alias("reached")), "src_id").groupBy("dst_id").agg(F.max("reached").alias("reached"))
    near = memories.join(source.withColumnRenamed("dst_id", "id"), "id").join(n, "id", "left_anti")
    salience = F.coalesce("salience", F.lit(0.0))
    moved = S.clamp(salience + (F.col("reached") - salience) * C.NEIGHBOUR_RATE * F.exp(S.days(F.col("last_seen_at"), as_of) * -C.NEIGHBOUR_DECAY))
    return hit.union(near.select("id", F.col("salience").alias("old_salience"), moved.alias("new_salience"), F.lit(0).alias("hits"), as_of.alias("last_seen_at")))


def regenerated(hits: DataFrame, memories: DataFrame, vectors: DataFrame, embed: Embed = hash_embed, most: int = C.LEAST_DIM) -> DataFrame:
    """New vectors (id, sector, user_id, v, dim) for those of hit memories' primary sectors that have shrunk to ``most`` elements or fewer.

    They are made of the summary, or of the content where there is none.
    """
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("summary", "content") if c in memories.columns], F.lit(""))
    short = vectors.where((F.size("v") > 0) & (F.size("v") <= most)).select("id", "sector")
    hit = memories.join(hits.select("id").distinct(), "id", "left_semi").select("id", "user_id", F.col("primary_sector").alias("sector"), text.alias("text"))
    rows = hit.join(short, ["id", "sector"], "left_semi")
    return rows.select("id", "sector", "user_id", embedded(T.sector_text(F.col("sector"), F.col("text")), embed).alias("v")).withColumn("dim", F.size("v"))


def propagated(salience: Column, weight: Column, source: Column) -> Column:
    return F.least(F.lit(1.0), salience + weight * source * C.TRACE_RATE)


def dedup_on_write(new: DataFrame, memories: DataFrame, vectors: DataFrame, cap: int = 100) -> DataFrame:
    """For each new row (id, user_id, v) the stored memory it repeats, if any: best_id and similarity, else null.

    It is compared with the user's ``cap`` rows of highest salience, latest seen first among equals.
    """
    stored = memories.join(vectors.select("id", "sector", "v"), "id")
    top = ranked(stored, ["user_id"], F.desc_nulls_last("salience"), F.desc_nulls_last("last_seen_at"), "id", "sector").where(F.col("rank") <= cap).select("user_id", "id", "v")
    best = nearest(new.select("id", "user_id", "v"), top, ["user_id"], C.DUPLICATE_SIMILARITY, own=True).select("id", F.col("to").alias("best_id"), F.col("s").alias("similarity"))
    return new.select("id", "user_id").join(best, "id", "left")


def repeats_within(rows: DataFrame) -> DataFrame:
    """Rows (id, user_id, v, created_at) that an earlier row of the user is a near-duplicate of: id, first_id.

    A row repeats the nearest earlier row; ``first_id`` is where following such
    steps ends, a row that repeats none.
    """
    all_ = rows.select("user_id", "id", F.col("created_at").alias("at"), "v")
    step = checkpointed(nearest(all_, all_, ["user_id"], C.DUPLICATE_SIMILARITY, earlier=True).select("id", F.col("to").alias("first_id")))
    while True:  # each round the steps are twice as long
        further = step.select(F.col("id").alias("first_id"), F.col("first_id").alias("next"))
        grown = step.join(further, "first_id", "left")
        if grown.where("next IS NOT NULL").isEmpty():
            return step
        step = checkpointed(grown.select("id", F.coalesce("next", "first_id").alias("first_id")))


def create_waypoints(new: DataFrame, memories: DataFrame, cap: int = 1000, least: float = 0.0, among_new: bool = False) -> DataFrame:
    """A waypoint from each new memory (id, user_id, v) to its nearest among the user's ``cap`` latest others, or to itself.

    ``memories``: id, user_id, v, created_at. ``among_new``: the new ones have
    created_at too and may also lead to those of them that come before by (created_at, id).
    """
    recent = ranked(memories, ["user_id"], F.desc("created_at"), "id").where(F.col("rank") <= cap)
    sims = nearest(new.select("user_id", "id", "v"), recent.select("user_id", "id", "v"), ["user_id"], least, above=True)
    if among_new:
        rows = new.select("user_id", "id", F.col("created_at").alias("at"), "v")
        sims = sims.union(nearest(rows, rows, ["user_id"], least, above=True, earlier=True))
    best = sims.groupBy("id").agg(F.min_by(F.struct(F.col("to").alias("dst_id"), F.col("s").alias("w")), F.struct(-F.col("s"), "to")).alias("b")).select("id", "b.*")
    return new.select("id", "user_id").join(best, "id", "left").select(F.col("id").alias("src_id"), F.coalesce("dst_id", "id").alias("dst_id"), "user_id", F.coalesce("w", F.lit(1.0)).alias("weight"))


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """The mean of a memory's vectors over its sectors, and its short form of 128 elements.

    The vectors of one memory have one length; null vectors do not count. Sums are merged in tasks before the shuffle, a vector a memory.
    """
    mean = vectors.where("v IS NOT NULL").groupBy("id").agg(Summarizer.mean(array_to_vector(V.doubles(F.col("v")))).alias("m")).select("id", vector_to_array("m").alias("mean_vec"))
    return mean.withColumn("mean_dim", F.size("mean_vec")).withColumn("compressed_vec", V.bucket_compressed(F.col("mean_vec"), 128))
