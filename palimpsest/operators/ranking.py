"""From candidates to ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scoring as S
from ..functions import text as T
from ..functions.vectors import cosine, with_norm
from .recall import ranked
from .tables import latest


def fusion(pairs: DataFrame, vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """Weighted mean over sectors of the cosine of each pair (query_id, id); 0 where there is no vector."""
    asked = with_norm(probes.select("query_id", "primary_sector", "qv"), "qv", "nq")
    held = with_norm(vectors.select("id", "sector", "v"), "v", "nv")
    similarity = cosine(F.col("v"), F.col("qv"), (F.col("nv"), F.col("nq")))
    sims = pairs.select("query_id", "id").join(asked, "query_id").join(held, "id").select("query_id", "id", similarity.alias("s"), S.sector_weight(F.col("primary_sector"), F.col("sector")).alias("w")).where("s IS NOT NULL")
    return sims.groupBy("query_id", "id").agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("fusion"))


def features(cands: DataFrame, queries: DataFrame, memories: DataFrame, vectors: DataFrame, probes: DataFrame, recall: DataFrame, as_of, waypoints: DataFrame | None = None, graph: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """All score features of candidates (query_id, id); those of other users or below the query's least salience go.

    ``docs``: the ``recall.term_index`` of the memories, which saves cutting the candidates' texts into words.
    """
    q = queries.select("query_id", F.col("user_id").alias("query_user"), F.col("primary_sector").alias("query_sector"), F.col("tokens").alias("query_tokens"), (F.col("min_salience") if "min_salience" in queries.columns else F.lit(0.0)).alias("min_salience"))
    best = recall.groupBy("query_id", "id").agg(F.max("similarity").alias("recall_sim"))
    way = waypoints.select("query_id", "id", F.col("weight").alias("way"), "path") if waypoints is not None else cands.select("query_id", "id", F.lit(0.0).alias("way"), F.array("id").alias("path")).limit(0)
    net = graph.select("query_id", "id", F.col("score").alias("graph_score")) if graph is not None else cands.select("query_id", "id", F.lit(0.0).alias("graph_score")).limit(0)
    rows = cands.join(q, "query_id").join(memories, "id").where((F.col("user_id") == F.col("query_user")) & ((F.col("min_salience") == 0) | (F.col("salience") >= F.col("min_salience"))))
    for part in (fusion(cands, vectors, probes), best, way, net):
        rows = rows.join(part, ["query_id", "id"], "left")
    zero = F.lit(0.0)
    content = F.col("content")
    if docs is None:
        memory_tokens = T.token_set(content)
    else:
        rows = rows.join(docs.select("user_id", "id", F.col("length").alias("n_words"), "terms"), ["user_id", "id"], "left")
        memory_tokens = F.when(F.col("n_words") > 0, F.transform("terms", lambda t: t["term"])).otherwise(F.array().cast("array<string>"))
    sim = F.greatest(S.resonance(F.col("primary_sector"), F.col("query_sector")) * F.coalesce("fusion", zero), F.coalesce("recall_sim", zero))
    fine = S.penalty(F.col("query_sector"), F.col("primary_sector"))
    age = S.days(F.col("last_seen_at"), as_of)
    return rows.withColumns(
        {
            "penalty": fine,
            "sim_adjust": sim * fine,
            "overlap": T.token_overlap(F.col("query_tokens"), memory_tokens),
            "keyword": T.keyword_overlap(F.col("query_tokens"), content) * C.KEYWORD_SHARE,
            "recency": S.recency(F.col("last_seen_at"), as_of),
            "tag": T.tag_match(F.col("tags"), F.col("query_tokens")),
            "waypoint": S.clamp(F.coalesce("way", zero)),
            "stored_salience": F.col("salience"),
            "salience": S.decayed_salience(F.col("primary_sector"), F.col("salience"), age),
            "graph_bonus": F.least(F.lit(C.GRAPH_BONUS), F.coalesce("graph_score", zero) * C.GRAPH_BONUS),
            "path": F.coalesce("path", F.array("id")),
        }
    ).drop("query_user", "min_salience", "fusion", "recall_sim", "way", "n_words", "terms")


def score(feature_rows: DataFrame) -> DataFrame:
    base = S.hybrid_score(*[F.col(c) for c in ("sim_adjust", "overlap", "waypoint", "recency", "tag", "keyword")])
    return feature_rows.withColumn("score", S.clamp(base + F.col("graph_bonus")))


def cut(scored: DataFrame, ks: DataFrame) -> DataFrame:
    """Each query's best rows, up to its k."""
    return ranked(scored.join(ks.select("query_id", "effective_k"), "query_id"), ["query_id"], F.desc("score"), "id").where("rank <= effective_k")


def promote_answers(scored: DataFrame, memories: DataFrame) -> DataFrame:
    """The latest answer to each query's best question gets that one's score and a bonus, and comes in if it was not found.

    ``scored``: query_id, id, score, role, pair_id; ``memories``: id, role, pair_id, created_at.
    """
    human = ranked(scored.where("role = 'human'"), ["query_id"], F.desc("score"), "id").where("rank = 1").select("query_id", "pair_id", (F.col("score") + C.QA_BONUS).alias("least"))
    answers = latest(memories.where("role = 'assistant' AND pair_id IS NOT NULL"), ["pair_id"], F.col("created_at"), "id").select("pair_id", "id", F.col("role").alias("answer_role"))
    promoted = human.join(answers, "pair_id").select("query_id", "id", "least", F.col("answer_role"), F.col("pair_id").alias("answer_pair"))
    both = scored.join(promoted, ["query_id", "id"], "full")
    return both.select("query_id", "id", F.greatest("score", "least").alias("score"), F.coalesce("role", "answer_role").alias("role"), F.coalesce("pair_id", "answer_pair").alias("pair_id"))


def session_scores(sessions: DataFrame, scored: DataFrame) -> DataFrame:
    """A score for each session found (query_id, session_id, similarity, dialogue_ids) from its likeness and the memories of it that were found."""
    members = sessions.select("query_id", "session_id", F.explode(F.array_distinct("dialogue_ids")).alias("id")).join(scored.select("query_id", "id", "score", "salience", "tags"), ["query_id", "id"])
    found = members.groupBy("query_id", "session_id").agg(F.avg("score").alias("avg_score"), F.avg("salience").alias("salience"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.count(F.lit(1)).alias("hits"))
    zero = F.lit(0.0)
    all_ = sessions.join(found, ["query_id", "session_id"], "left")
    coverage = F.coalesce(F.col("hits") / F.nullif(F.size("dialogue_ids"), F.lit(0)), zero)
    value = S.clamp(S.clamp(F.coalesce("similarity", zero)) * 0.55 + F.greatest(zero, F.coalesce("avg_score", zero)) * 0.30 + coverage * 0.15)
    return all_.select("query_id", F.concat(F.lit("session:"), F.col("session_id")).alias("id"), value.alias("score"), F.greatest(zero, F.coalesce("salience", zero)).alias("salience"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), coverage.alias("coverage"), F.col("dialogue_ids").alias("path"))


def attach_sessions(top: DataFrame, scored: DataFrame, sessions: DataFrame, dedup: bool = True) -> DataFrame:
    """Put sessions among the results after the cut; with ``dedup`` they replace the memories they cover."""
    if dedup:
        covered = sessions.select("query_id", F.explode("dialogue_ids").alias("id")).distinct()
        top = top.join(covered, ["query_id", "id"], "left_anti")
    extra = session_scores(sessions, scored).select("query_id", "id", "score", "salience")
    united = top.select("query_id", "id", "score", "salience").union(extra)
    return united.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
