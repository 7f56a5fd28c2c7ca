"""The whole search: many queries at once, through all recall paths to ranked results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.convert import clamped, clamped_int
from ..operators import graph, ranking, recall
from ..storage import checkpointed


@dataclass(frozen=True)
class GraphConfig:
    """``type``: ``precision`` and ``recall`` stand for fixed settings; only ``custom`` uses the fields, within their bounds."""

    type: str = "precision"
    enable: bool = True
    least_confidence: float = 0.5
    hops: int = 1
    decay: float = 0.8
    per_hop: int = 200
    least_score: float = 0.05

    def settings(self) -> GraphConfig:
        if self.type == "recall":
            return GraphConfig("custom", self.enable, 0.35, 2, 0.85, 300, 0.03)
        if self.type == "precision":
            return GraphConfig("custom", self.enable, 0.6, 1, 0.75, 120, 0.08)
        return GraphConfig("custom", self.enable, clamped(self.least_confidence, 0.5), clamped_int(self.hops, 1, 1, 4), clamped(self.decay, 0.8, 0.1), clamped_int(self.per_hop, 200), clamped(self.least_score, 0.05))


@dataclass(frozen=True)
class SearchConfig:
    bm25: bool = True
    sessions: bool = False
    session_dedup: bool = True
    query_mode: str | None = None
    graph: GraphConfig = field(default_factory=GraphConfig)


def search(queries: DataFrame, tables: dict[str, DataFrame], as_of: Column, config: SearchConfig | None = None) -> DataFrame:
    """Ranked results of all queries: query_id, id, rank, score, source and features.

    ``queries``: query_id, user_id, text, primary_sector, top_k, qv. ``tables``:
    memories and vectors, and for their paths sessions, waypoints, topics, facts,
    fact_entities and relations; texts, if the memories' contents come dealt otherwise.
    """
    config = config or SearchConfig()
    memories, vectors = tables["memories"], tables["vectors"]
    asked = recall.prepare_queries(queries)
    # What each path finds is small and read by all that follow: it is worked out once.
    paths = {"vector": checkpointed(recall.vector_recall(queries, vectors))}
    ks = recall.adaptive_k(paths["vector"], queries)
    docs = checkpointed(recall.term_index(queries, tables.get("texts", memories)))
    if config.bm25:
        # Only memories with a vector can be recalled by words.
        paths["bm25"] = checkpointed(recall.bm25_recall(queries, memories, docs=docs.join(vectors.select("id").distinct(), "id", "left_semi")))
    sessions = None
    if "sessions" in tables:
        sessions = checkpointed(recall.session_recall(queries, tables["sessions"], ks, vectors))
        paths["session"] = sessions.select("query_id", F.explode("dialogue_ids").alias("id"))
    seeds = recall.candidates(**paths).select("query_id", "id")
    waypoints = None
    if "waypoints" in tables:
        weak = ks.where(F.col("avg_sim") < C.WAYPOINT_GATE).select("query_id", (F.col("effective_k") * 2).alias("budget"))
        waypoints = recall.expand_waypoints(seeds.join(weak, "query_id"), tables["waypoints"], F.col("budget"))
        paths["waypoint"] = waypoints
    scores = None
    if "topics" in tables and config.graph.enable:
        g = config.graph.settings()
        found = recall.candidates(**paths).select("query_id", "id").join(ks.select("query_id", "user_id", (F.col("effective_k") * 2).alias("budget")), "query_id")
        scores = graph.expand_graph(checkpointed(found), tables["topics"], tables["facts"], tables["fact_entities"], tables["relations"], memories, hops=g.hops, decay=g.decay, per_hop=g.per_hop, least_confidence=g.least_confidence, least_score=g.least_score)
        scores = checkpointed(scores)
        paths["graph"] = scores
    cands = recall.candidates(**paths)
    rows = ranking.features(cands, asked, memories, vectors, queries, paths["vector"], as_of, waypoints, scores, docs)
    scored = ranking.score(rows)
    if config.query_mode in ("qa", "prefer"):
        best = ranking.promote_answers(scored.select("query_id", "id", "score", "role", "pair_id"), memories)
        scored = best.select("query_id", "id", "score").join(scored.drop("score"), ["query_id", "id"], "left")
    top = ranking.cut(scored, ks)
    if config.sessions and sessions is not None:
        return ranking.attach_sessions(top, scored, sessions, config.session_dedup)
    return top.select("query_id", "id", "rank", "score", "source", "sim_adjust", "overlap", "recency", "waypoint", "tag", "penalty", "keyword", "graph_bonus", "salience", "path")


def augment_conversations(turns: DataFrame, results: DataFrame, memories: DataFrame, k: int = 3) -> DataFrame:
    """For each conversation's query (query_id) its ``k`` best memories as a bullet list."""
    top = results.where(F.col("rank") <= k).join(memories.select("id", "content"), "id")
    listed = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("m"))
    text = F.array_join(F.transform("m", lambda x: F.concat(F.lit("- "), x["content"])), "\n")
    return turns.join(listed.select("query_id", text.alias("context")), "query_id", "left")


def exchange_text(question: Column, answer: Column) -> Column:
    """What an exchange is stored as."""
    return F.concat(F.lit("user:"), question, F.lit("\nassistant:"), answer)
