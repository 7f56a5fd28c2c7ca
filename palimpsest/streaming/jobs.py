"""Streams of new memories, hits and turns; scheduled jobs run them with ``availableNow``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.embedding import Embed, hash_embed, vectorise
from ..operators import dynamics, graph, model_stage
from ..operators import sessions as user_sessions
from ..operators import tables as tab
from ..operators.ingest import new_memories
from ..storage import checkpointed

#: How late a row may come, and the gap that ends a session.
LATENESS, GAP = "10 minutes", "30 minutes"


def ingest_batch(new: DataFrame, memories: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch of new rows (id, user_id, v, created_at, and more): the memories to insert, the boosts of those that were repeated, and waypoints of the inserted.

    A row is compared with the stored memories, and with the rows of its user that
    come before it in the batch by (created_at, id) and are not repetitions of stored
    ones. A row that repeats such a row boosts it (or what that one repeats in
    turn) and is not inserted. Waypoints lead to earlier rows and stored memories.
    """
    stored = dynamics.dedup_on_write(new, memories, vectors)
    fresh = new.join(stored.where("best_id IS NULL").select("id"), "id", "left_semi")
    repeats = dynamics.repeats_within(fresh)
    inserts = fresh.join(repeats.select("id"), "id", "left_anti")
    boosted = stored.where("best_id IS NOT NULL").select(F.col("best_id").alias("id")).union(repeats.select("first_id"))
    boosts = boosted.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    known = memories.join(vectors.select("id", "v"), "id").select("id", "user_id", "v", "created_at")
    return inserts, boosts, dynamics.create_waypoints(inserts, known, among_new=True)


def ingest_texts(new: DataFrame, memories: DataFrame, vectors: DataFrame, embed: Embed = hash_embed) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One batch of new texts (id, user_id, content, primary_sector, sectors, created_at): ``ingest_batch`` with the vectors of their primary sectors.

    The inserts have the defaults of new memories; the fourth table is their vectors, one for each sector.
    """
    own = checkpointed(vectorise(new.withColumn("sectors", F.array_union(F.array("primary_sector"), F.coalesce("sectors", F.array()))), embed))
    first = own.select("id", F.col("sector").alias("primary_sector"), "v")
    inserts, boosts, waypoints = ingest_batch(new.join(first, ["id", "primary_sector"]).select(*new.columns, "v"), memories, vectors)
    return new_memories(inserts.drop("v")), boosts, waypoints, own.join(inserts.select("id"), "id", "left_semi")


def stream_ingest(source: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame]], sink: Callable[..., None], checkpoint: str, step: Callable[..., tuple[DataFrame, ...]] = ingest_batch) -> StreamingQuery:
    """Run ``ingest_batch``, or ``ingest_texts`` as ``step``, on each micro-batch; ids that come again within the watermark count once.

    ``tables`` reads the memories and vectors as they are now; ``sink`` gets the
    batch number, so that a batch that is run again can replace what it wrote.
    """
    once = source.withWatermark("created_at", LATENESS).dropDuplicatesWithinWatermark(["id"])

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        sink(number, *step(batch, *tables()))
        batch.unpersist()

    return once.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hit_counts(hits: DataFrame, window: str = "1 hour") -> DataFrame:
    """Hits (event_id, memory_id, ts) of each memory by window; late ones are dropped."""
    return hits.withWatermark("ts", LATENESS).groupBy(F.window("ts", window), F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("hits")).select(F.col("window.start").alias("since"), "id", "hits")


def stream_reinforce(hits: DataFrame, memories: Callable[[], DataFrame], edges: Callable[[], DataFrame | None], sink: Callable[[int, DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Reinforce memories by the hits of closed windows, as of the latest of them."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        if not batch.isEmpty():
            now = F.lit(batch.agg(F.max("since")).first()[0]).cast("timestamp_ntz")
            each = batch.select(F.explode(F.array_repeat("id", F.col("hits").cast("int"))).alias("id"))
            sink(number, dynamics.reinforce(each, memories(), edges(), now))
        batch.unpersist()

    return hit_counts(hits).writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(turns: DataFrame, gap: str = GAP) -> DataFrame:
    """Sessions of turns (id, user_id, ts) that follow one another within the gap; the same for streams and tables."""
    if turns.isStreaming:
        turns = turns.withWatermark("ts", LATENESS)
    rows = turns.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_list(F.struct("ts", "id"))).alias("d"), F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", F.transform("d", lambda x: x["id"]).alias("dialogue_ids"))


def decay_job(memories: DataFrame, vectors: DataFrame, as_of, ratio: float = 0.03, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of the periodic decay: a sample of each segment aged. Gives the memories after it, the changed vectors and a report."""
    sample = dynamics.sample_per_segment(memories, ratio, seed)
    aged, changed = dynamics.apply_decay(sample, vectors, as_of)
    update = aged.where("changed").select("id", F.col("new_salience").alias("salience"))
    return tab.upsert(memories, update, ["id"], mode="merge", columns=["salience"]).select(memories.columns), changed, dynamics.decay_report(aged)


def graph_job(memories: DataFrame, users: DataFrame, extract: Callable[[DataFrame], DataFrame], canonical: DataFrame, vectorise: Callable[[DataFrame], DataFrame], cold: bool = False) -> dict[str, DataFrame]:
    """One run of the periodic graph build over the pending memories of users that have enough of them.

    ``extract`` is the model: it turns the batch into rows (topic_id, user_id,
    memory_id, facts); ``vectorise`` adds v to mentions. Gives facts, mentions,
    links to canonical entities, and the memories with ``fact_joined`` set for the batch.
    """
    batch = graph.graph_batches(memories.where(~F.coalesce(F.col("fact_joined"), F.lit(False))), users, cold=cold)
    facts, mentions = model_stage.flatten_facts(extract(batch))
    named = graph.canonicalise(vectorise(mentions), canonical)
    links = named.select("fact_id", "canonical_id", "user_id").distinct()
    return {"facts": facts, "mentions": named, "links": links, "memories": tab.mark(memories, batch.select("id"), "fact_joined")}


def session_job(memories: DataFrame, users: DataFrame, as_of, summarise, size: int = 200) -> tuple[DataFrame, DataFrame]:
    """One daily run of sessions over the memories before today that are in none: session rows, and the memories marked."""
    open_ = memories.where(~F.coalesce(F.col("session_joined"), F.lit(False)))
    return user_sessions.write_sessions(user_sessions.session_batches(open_, users, tab.day_cutoff(as_of), size=size), summarise, memories)


def profile_job(memories: DataFrame, users: DataFrame, profiles: DataFrame, as_of, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One daily run of profiles: ``extract`` gives (user_id, profile as JSON) of the pending memories, which is merged into the active profile.

    Gives the profiles (user_id, profile) that become active, and the memories marked.
    """
    open_ = memories.where(~F.coalesce(F.col("profile_joined"), F.lit(False)) & (F.col("created_at") < tab.day_cutoff(as_of)))
    open_ = open_.join(users.where("status = 1").select(F.col("id").alias("user_id")), "user_id", "left_semi")
    found = extract(open_)
    old = user_sessions.active_profile(profiles).select("user_id", "profile").join(found.select("user_id"), "user_id", "left_semi")
    return user_sessions.merge_profiles(old, found), tab.mark(memories, open_.select("id"), "profile_joined")
