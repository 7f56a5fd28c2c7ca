"""Registered queries: graph, turns, sessions, profiles, ingest, model stages and evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SECTORS
from ..functions import sealing
from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import evaluate, graph, ingest, model_stage, recall, table_functions
from ..operators import sessions as ses
from ..operators import tables as tab
from ..sources.views import Tables
from ..storage import checkpointed
from . import registry as R
from .memory_queries import _BM25, r6
from .registry import query


def _seeds(t: Tables) -> DataFrame:
    """Seed entities of each query: those of the facts of its user's three latest topics."""
    topics = recall.ranked(t.topics.select("user_id", F.col("id").alias("topic_id"), "updated_at"), ["user_id"], F.desc("updated_at"), "topic_id").where("rank <= 3")
    facts = topics.join(t.facts.select(F.col("id").alias("fact_id"), "topic_id"), "topic_id").join(t.fact_entities, "fact_id")
    return t.queries.select("query_id", "user_id").join(facts.select("user_id", "canonical_id").distinct(), "user_id")


_SEEDS = """seeds AS (SELECT DISTINCT q.query_id, q.user_id, e.canonical_id FROM m_queries q JOIN (SELECT user_id, id AS topic_id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS r FROM m_topics) t ON t.user_id = q.user_id AND t.r <= 3
 JOIN m_facts f ON f.topic_id = t.topic_id JOIN m_fact_entities e ON e.fact_id = f.id)"""
_EDGES = f"""edges AS (SELECT user_id, a AS node, b AS nxt, coalesce(confidence, 0) * {R.sql_edge_weight('edge_relation')} AS gain FROM (SELECT user_id, source AS a, target AS b, edge_relation, confidence FROM m_relations UNION ALL SELECT user_id, target, source, edge_relation, confidence FROM m_relations) WHERE (confidence IS NULL OR confidence >= 0.5) AND a <> b)"""
_WALK = f"""{_SEEDS}, {_EDGES},
 h1 AS (SELECT * FROM (SELECT s.query_id, s.user_id, e.nxt AS node, [s.canonical_id, e.nxt] AS path, 0.8 + e.gain * 0.8 AS score, row_number() OVER (PARTITION BY s.query_id ORDER BY 0.8 + e.gain * 0.8 DESC, e.nxt, [s.canonical_id, e.nxt]) AS r FROM seeds s JOIN edges e ON e.user_id = s.user_id AND e.node = s.canonical_id) WHERE r <= 200),
 h2 AS (SELECT * FROM (SELECT s.query_id, e.nxt AS node, s.score * 0.8 + e.gain * (0.8::DOUBLE * 0.8::DOUBLE) AS score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score * 0.8 + e.gain * (0.8::DOUBLE * 0.8::DOUBLE) DESC, e.nxt, list_append(s.path, e.nxt)) AS r FROM h1 s JOIN edges e ON e.user_id = s.user_id AND e.node = s.node WHERE NOT list_contains(s.path, e.nxt)) WHERE r <= 200)"""


@query(f"WITH {_WALK} SELECT query_id, node AS canonical_id, round(max(score), 6) AS score FROM (SELECT query_id, node, score FROM h1 UNION ALL SELECT query_id, node, score FROM h2) GROUP BY 1, 2")
def g5_walk(t: Tables) -> DataFrame:
    return graph.walk(_seeds(t), t.relations, hops=2).select("query_id", "canonical_id", r6(F.col("score"), "score"))


_EXPAND = f"""{_EDGES}, seedm AS (SELECT query_id, user_id, unnest(['d' || substr(user_id, 2), 'd' || (CAST(substr(user_id, 2) AS BIGINT) + 20)]) AS id FROM m_queries),
 st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, topic_id) AS r FROM (SELECT DISTINCT s.query_id, s.user_id, t.id AS topic_id, t.updated_at FROM seedm s JOIN (SELECT id, user_id, updated_at, unnest(dialogue_ids) AS m FROM m_topics) t ON t.m = s.id AND t.user_id = s.user_id)) WHERE r <= 20),
 sf AS (SELECT * FROM (SELECT st.query_id, st.user_id, f.id AS fact_id, row_number() OVER (PARTITION BY st.query_id ORDER BY f.confidence DESC, f.occurred_start DESC, f.id) AS r FROM st JOIN m_facts f ON f.topic_id = st.topic_id AND f.user_id = st.user_id) WHERE r <= 40),
 sc AS (SELECT DISTINCT sf.query_id, sf.user_id, e.canonical_id FROM sf JOIN m_fact_entities e USING (fact_id)),
 w AS (SELECT query_id, nxt AS canonical_id, max(score) AS score FROM (SELECT s.query_id, e.nxt, 0.8 + e.gain * 0.8 AS score, row_number() OVER (PARTITION BY s.query_id ORDER BY 0.8 + e.gain * 0.8 DESC, e.nxt, [s.canonical_id, e.nxt]) AS r FROM sc s JOIN edges e ON e.user_id = s.user_id AND e.node = s.canonical_id) WHERE r <= 200 GROUP BY 1, 2),
 tp AS (SELECT w.query_id, q.user_id, f.topic_id, max(w.score) AS score FROM w JOIN m_queries q USING (query_id) JOIN m_fact_entities e ON e.canonical_id = w.canonical_id JOIN m_facts f ON f.id = e.fact_id AND f.user_id = q.user_id GROUP BY 1, 2, 3),
 mm AS (SELECT tp.query_id, t.m AS id, max(tp.score) AS score FROM tp JOIN (SELECT id, user_id, unnest(dialogue_ids) AS m FROM m_topics) t ON t.id = tp.topic_id AND t.user_id = tp.user_id JOIN m_memories x ON x.id = t.m AND x.user_id = tp.user_id GROUP BY 1, 2)"""


@query(f"WITH {_EXPAND} SELECT query_id, id, round({R.sql_clamp('score')}, 6) AS score FROM mm WHERE (query_id, id) NOT IN (SELECT query_id, id FROM seedm)")
def g4_expand_graph(t: Tables) -> DataFrame:
    own = F.concat(F.lit("d"), F.substring("user_id", 2, 9))
    other = F.concat(F.lit("d"), (F.substring("user_id", 2, 9).cast("long") + 20).cast("string"))
    seeds = t.queries.select("query_id", "user_id", F.explode(F.array(own, other)).alias("id"))
    return graph.expand_graph(seeds, t.topics, t.facts, t.fact_entities, t.relations, t.memories).select("query_id", "id", r6(F.col("score"), "score"))


@query("""SELECT user_id, a, b, fact_id, CASE WHEN contains(said, 'because') OR contains(said, 'lead to') THEN 'CAUSES' WHEN contains(said, 'before') OR contains(said, 'after') OR contains(said, 'later') OR contains(said, 'earlier') THEN 'PRECEDES' ELSE 'CO_OCCURS_WITH' END AS edge_relation
 FROM (SELECT f.user_id, x.canonical_id AS a, y.canonical_id AS b, f.id AS fact_id, CASE length(f.id) % 4 WHEN 0 THEN 'it broke because of rain' WHEN 1 THEN 'sold before june' WHEN 2 THEN 'this may lead to delay, later' ELSE 'plain sale' END AS said FROM m_facts f JOIN m_fact_entities x ON x.fact_id = f.id JOIN m_fact_entities y ON y.fact_id = f.id AND x.canonical_id < y.canonical_id)""")
def g3_infer_relations(t: Tables) -> DataFrame:
    k = F.length("id") % 4
    said = F.when(k == 0, "It broke BECAUSE of rain").when(k == 1, "sold before June").when(k == 2, "this may lead to delay, later").otherwise("plain sale")
    return graph.infer_relations(graph.entity_pairs(t.entity_links), t.facts, t.canonical, said).drop("inference_source")


@query("""SELECT user_id, a AS source, b AS target, edge_relation, array_to_string(list_sort(list_distinct(list(fact_id))), ',') AS evidence, arg_max(confidence, (occurred_start, fact_id)) AS confidence
 FROM (SELECT f.user_id, x.canonical_id AS a, y.canonical_id AS b, f.id AS fact_id, f.fact_kind AS edge_relation, f.confidence, f.occurred_start FROM m_facts f JOIN m_fact_entities x ON x.fact_id = f.id JOIN m_fact_entities y ON y.fact_id = f.id AND x.canonical_id < y.canonical_id) GROUP BY 1, 2, 3, 4""")
def a15_g12_merge_relations(t: Tables) -> DataFrame:
    facts = t.facts.select(F.col("id").alias("fact_id"), "user_id", F.col("fact_kind").alias("edge_relation"), "confidence", "occurred_start")
    rows = graph.entity_pairs(t.entity_links, facts=facts).select("user_id", F.col("a").alias("source"), F.col("b").alias("target"), "edge_relation", "fact_id", F.lit("RULE").alias("inference_source"), "confidence", "occurred_start")
    return graph.merge_relations(rows, "occurred_start").select("user_id", "source", "target", "edge_relation", F.array_join("evidence", ",").alias("evidence"), "confidence")


@query("""SELECT source, target, other, total FROM (SELECT source, target, CASE WHEN source = 's3' THEN target ELSE source END AS other, count(*) OVER () AS total, row_number() OVER (ORDER BY confidence DESC NULLS LAST, user_id, source, target) AS r FROM m_relations WHERE source = 's3' OR target = 's3') WHERE r <= 25""")
def g6_entity_relations(t: Tables) -> DataFrame:
    r = graph.relations_filter(t.relations, entity="s3")
    return tab.page(r, [F.col("confidence").desc_nulls_last(), "user_id", "source", "target"], size=25).select("source", "target", "other", "total")


@query("SELECT id, topic_id, confidence, total FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY occurred_start DESC NULLS LAST, id) AS r FROM m_facts WHERE user_id = 'u2' AND fact_kind = 'event') WHERE r BETWEEN 21 AND 40")
def g7_user_facts(t: Tables) -> DataFrame:
    f = graph.facts_filter(t.facts.where("user_id = 'u2'"), kind="event")
    return tab.page(f, [F.col("occurred_start").desc_nulls_last(), "id"], current=2, size=20).select("id", "topic_id", "confidence", "total")


@query("SELECT fact_id, canonical_id, name, total FROM (SELECT e.*, c.name, count(*) OVER (PARTITION BY fact_id) AS total, row_number() OVER (PARTITION BY fact_id ORDER BY canonical_id) AS r FROM m_fact_entities e JOIN m_canonical c ON c.id = e.canonical_id) WHERE r <= 2")
def g8_entities_of_facts(t: Tables) -> DataFrame:
    rows = graph.fact_entities(t.fact_entities, t.canonical)
    return tab.page(rows, ["canonical_id"], size=2, within=["fact_id"]).select("fact_id", "canonical_id", "name", "total")


@query("""SELECT canonical_id, topic_id, n_facts, total FROM (SELECT canonical_id, topic_id, n_facts, count(*) OVER (PARTITION BY canonical_id) AS total, row_number() OVER (PARTITION BY canonical_id ORDER BY n_facts DESC, topic_id) AS r
 FROM (SELECT e.canonical_id, f.topic_id, count(DISTINCT e.fact_id) AS n_facts FROM m_fact_entities e JOIN m_facts f ON f.id = e.fact_id JOIN m_topics t ON t.id = f.topic_id GROUP BY 1, 2)) WHERE r <= 3""")
def g9_topics_of_entities(t: Tables) -> DataFrame:
    rows = graph.entity_topics(t.fact_entities, t.facts, t.topics)
    return tab.page(rows, [F.desc("n_facts"), "topic_id"], size=3, within=["canonical_id"]).select("canonical_id", "topic_id", "n_facts", "total")


@query("SELECT id, content FROM m_memories WHERE id IN (SELECT unnest(dialogue_ids) FROM m_topics WHERE id = 't42')")
def g10_topic_memories(t: Tables) -> DataFrame:
    return graph.topic_memories(t.topics, t.memories, "t42").select("id", "content")


@query("""SELECT id, user_id, rank FROM (SELECT id, m.user_id, row_number() OVER (PARTITION BY m.user_id ORDER BY last_seen_at, id) AS rank, count(*) OVER (PARTITION BY m.user_id) AS n FROM m_memories m WHERE user_id IN (SELECT id FROM m_users WHERE status = 1)) WHERE n >= 30 AND rank <= 100""")
def g1_graph_batches(t: Tables) -> DataFrame:
    rows = t.memories.withColumn("created_at", F.col("last_seen_at"))
    return graph.graph_batches(rows, t.users).select("id", "user_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT id, user_id, rank FROM (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at, id) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT *, salience < 0.6 AS open FROM m_memories) WHERE open AND user_id IN (SELECT id FROM m_users WHERE status = 1)) WHERE n > 10 AND n < 40""")
def g1_cold_batches(t: Tables) -> DataFrame:
    rows = t.memories.where("salience < 0.6").withColumn("created_at", F.col("last_seen_at"))
    return graph.graph_batches(rows, t.users, warm=40, cold=True).select("id", "user_id", F.col("rank").cast("long").alias("rank"))


_CANONICALISE = f"""old AS (SELECT 'c' || id AS id, user_id, 'Name ' || CAST(substr(id, 2) AS BIGINT) // 40 AS name, v FROM m_vectors WHERE CAST(substr(id, 2) AS BIGINT) % 3 = 0), men AS (SELECT id, user_id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 7 = 1 THEN 'new' || CAST(substr(id, 2) AS BIGINT) % 600 ELSE 'name' || CAST(substr(id, 2) AS BIGINT) // 40 END AS key, v FROM m_vectors WHERE CAST(substr(id, 2) AS BIGINT) % 3 <> 0),
 same AS (SELECT user_id, lower(replace(name, ' ', '')) AS key, min(id) AS same_id FROM old GROUP BY 1, 2), opened AS (SELECT m.user_id, m.key, m.v FROM men m LEFT JOIN same s USING (user_id, key) WHERE same_id IS NULL),
 near AS (SELECT user_id, key, arg_min(id, (-s, id)) AS near_id FROM (SELECT o.user_id, o.key, c.id, {R.sql_cosine('o.v', 'c.v')} AS s FROM opened o JOIN old c USING (user_id)) WHERE s >= 0.85 GROUP BY 1, 2),
 lone AS (SELECT o.* FROM opened o LEFT JOIN near n USING (user_id, key) WHERE near_id IS NULL),
 edges AS (SELECT a.user_id, a.key AS x, b.key AS y FROM lone a JOIN lone b ON a.user_id = b.user_id AND a.key <> b.key AND {R.sql_cosine('a.v', 'b.v')} >= 0.85),
 reached(user_id, x, y) AS (SELECT user_id, x, y FROM edges UNION SELECT r.user_id, r.x, e.y FROM reached r JOIN edges e ON e.user_id = r.user_id AND e.x = r.y),
 grp AS (SELECT user_id, x AS key, min(y) AS least_key FROM reached GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_CANONICALISE} SELECT m.id, coalesce(same_id, near_id, 'e' || substr(sha256(user_id || '|OTHER|' || least(key, coalesce(least_key, key))), 1, 24)) AS canonical_id, same_id IS NULL AND near_id IS NULL AS is_new
 FROM men m LEFT JOIN same USING (user_id, key) LEFT JOIN near USING (user_id, key) LEFT JOIN grp USING (user_id, key)""")
def g2_canonicalise(t: Tables) -> DataFrame:
    return graph.canonicalise(*_mentions(t)).select("id", "canonical_id", "is_new")


@query()
def g2_canonicalise_in_order(t: Tables) -> DataFrame:
    """The same mentions one after the other, by id."""
    mentions, stored = _mentions(t)
    return graph.canonicalise_in_order(mentions.withColumn("place", F.substring("id", 2, 18).cast("long")), stored, ["place"]).select("id", "canonical_id", "is_new")


def _mentions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Mentions and stored entities: vectors by id, with names that some share."""
    k = F.substring("id", 2, 18).cast("long")
    v = t.vectors.select("id", "user_id", "v", F.lit("OTHER").alias("entity_type"), k.alias("k"))
    name = F.concat(F.lit("Name "), F.floor(F.col("k") / 40).cast("string"))
    old = v.where("k % 3 = 0").select(F.concat(F.lit("c"), "id").alias("id"), "user_id", name.alias("name"), "entity_type", "v")
    said = F.when(F.col("k") % 7 == 1, F.concat(F.lit("New "), (F.col("k") % 600).cast("string"))).otherwise(F.lower(name))
    return v.where("k % 3 <> 0").select("id", "user_id", said.alias("text"), "entity_type", "v"), old


def _explored(t: Tables) -> tuple[DataFrame, DataFrame]:
    """From every id divisible by 50: parts and suppliers, facts of such orders, topics."""
    seeds = t.canonical.where(F.substring("id", 2, 18).cast("long") % 50 == 0).select(F.col("id").alias("seed"), F.lit("entity").alias("kind"))
    order = F.regexp_extract("id", r"^f(\d+)-", 1).cast("long")
    seeds = seeds.union(t.facts.where(order % 50 == 0).select("id", F.lit("fact"))).union(t.topics.where(F.substring("id", 2, 18).cast("long") % 50 == 0).select("id", F.lit("topic")))
    return graph.explore(seeds, t.entity_links, t.facts, t.topics, t.relations)


_EXPLORE = """s AS (SELECT id AS seed, 'entity' AS of_kind FROM m_canonical WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 0 UNION ALL SELECT id, 'fact' FROM m_facts WHERE CAST(regexp_extract(id, '^f([0-9]+)-', 1) AS BIGINT) % 50 = 0 UNION ALL SELECT id, 'topic' FROM m_topics WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 0),
 ends AS (SELECT source AS seed, target AS node, edge_relation FROM m_relations UNION SELECT target, source, edge_relation FROM m_relations), rel AS (SELECT seed, of_kind, node, edge_relation FROM s JOIN ends USING (seed) WHERE of_kind = 'entity'),
 tf AS (SELECT f.id AS fact, f.topic_id AS topic FROM m_facts f JOIN m_topics t ON t.id = f.topic_id),
 n1 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY node) AS r, count(*) OVER (PARTITION BY seed) AS n FROM (SELECT DISTINCT seed, of_kind, node FROM rel WHERE seed <> node)),
 n2 AS (SELECT *, row_number() OVER (PARTITION BY seed, of_kind ORDER BY node) AS r, count(*) OVER (PARTITION BY seed, of_kind) AS n FROM (SELECT DISTINCT seed, of_kind, fact_id AS node FROM s JOIN m_fact_entities ON canonical_id = seed WHERE of_kind = 'entity' UNION ALL SELECT seed, of_kind, fact FROM s JOIN tf ON topic = seed WHERE of_kind = 'topic')),
 ft AS (SELECT seed, of_kind, node AS fact FROM n2 WHERE r <= 50 AND of_kind = 'entity' UNION ALL SELECT seed, of_kind, seed FROM s WHERE of_kind = 'fact'), ftt AS (SELECT DISTINCT seed, of_kind, fact, topic FROM ft JOIN tf USING (fact)),
 n3 AS (SELECT *, row_number() OVER (PARTITION BY seed, of_kind ORDER BY node) AS r, count(*) OVER (PARTITION BY seed, of_kind) AS n FROM (SELECT DISTINCT seed, of_kind, topic AS node FROM ftt)),
 fe AS (SELECT seed, of_kind, node AS fact FROM n2 WHERE r <= 50 AND of_kind = 'topic' UNION ALL SELECT seed, of_kind, seed FROM s WHERE of_kind = 'fact'), fee AS (SELECT DISTINCT seed, of_kind, fact, canonical_id AS entity FROM fe JOIN m_fact_entities ON fact_id = fact),
 n4 AS (SELECT *, row_number() OVER (PARTITION BY seed, of_kind ORDER BY node) AS r, count(*) OVER (PARTITION BY seed, of_kind) AS n FROM (SELECT DISTINCT seed, of_kind, entity AS node FROM fee))"""


@query(f"WITH {_EXPLORE} SELECT seed, of_kind AS of, seed AS node, of_kind AS kind, 0 AS stage, false AS cut FROM s UNION ALL SELECT seed, of_kind, node, 'entity', 1, n > 50 FROM n1 WHERE r <= 50 UNION ALL SELECT seed, of_kind, node, 'fact', 2, n > 50 FROM n2 WHERE r <= 50 UNION ALL SELECT seed, of_kind, node, 'topic', 3, n > 50 FROM n3 WHERE r <= 50 UNION ALL SELECT seed, of_kind, node, 'entity', 4, n > 50 FROM n4 WHERE r <= 50")
def g11_explore(t: Tables) -> DataFrame:
    return _explored(t)[0]


@query(f"""WITH {_EXPLORE} SELECT DISTINCT * FROM (SELECT seed, of_kind AS of, seed AS a, node AS b, edge_relation AS label FROM rel SEMI JOIN (SELECT seed, node FROM n1 WHERE r <= 50) USING (seed, node) UNION ALL SELECT seed, of_kind, seed, node, 'MENTIONED_IN' FROM n2 WHERE r <= 50 AND of_kind = 'entity' UNION ALL SELECT seed, of_kind, node, seed, 'IN_TOPIC' FROM n2 WHERE r <= 50 AND of_kind = 'topic'
 UNION ALL SELECT x.seed, x.of_kind, fact, topic, 'IN_TOPIC' FROM ftt x JOIN n3 ON n3.seed = x.seed AND n3.of_kind = x.of_kind AND n3.node = x.topic AND r <= 50 UNION ALL SELECT x.seed, x.of_kind, entity, fact, 'MENTIONED_IN' FROM fee x JOIN n4 ON n4.seed = x.seed AND n4.of_kind = x.of_kind AND n4.node = x.entity AND r <= 50)""")
def g11_edges(t: Tables) -> DataFrame:
    return _explored(t)[1]


_PAIRED = """lv AS (SELECT *, s - least(0, min(s) OVER w) AS level FROM (SELECT *, sum(CASE role WHEN 'human' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY conv_id, turn) AS s FROM m_turns) WINDOW w AS (PARTITION BY user_id ORDER BY conv_id, turn)),
 st AS (SELECT *, CASE WHEN role = 'human' THEN level WHEN coalesce(lag(level) OVER (PARTITION BY user_id ORDER BY conv_id, turn), 0) > 0 THEN lag(level) OVER (PARTITION BY user_id ORDER BY conv_id, turn) ELSE 0 END AS stack FROM lv),
 paired AS (SELECT id, user_id, role, conv_id, turn, content, 'pair:' || coalesce(CASE WHEN role <> 'human' AND stack > 0 THEN lag(id) OVER (PARTITION BY user_id, stack ORDER BY conv_id, turn) END, id) AS pair_id FROM st)"""


@query(f"WITH {_PAIRED} SELECT id, pair_id FROM paired")
def w7_pair_turns(t: Tables) -> DataFrame:
    return ses.pair_turns(t.turns, ["conv_id", "turn"]).select("id", "pair_id")


@query(f"WITH {_PAIRED} SELECT pair_id, id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY conv_id DESC, turn DESC, id DESC) AS r FROM paired WHERE role = 'assistant') WHERE r = 1")
def w3_latest_answers(t: Tables) -> DataFrame:
    p = ses.pair_turns(t.turns, ["conv_id", "turn"]).withColumn("at", F.struct("conv_id", "turn"))
    return ses.latest_answer(p, "at").select("pair_id", "id")


@query(f"WITH {_PAIRED} SELECT id FROM paired WHERE role = 'human' AND pair_id NOT IN (SELECT pair_id FROM paired WHERE role = 'assistant')")
def j7_unpaired_humans(t: Tables) -> DataFrame:
    return ses.unpaired_humans(ses.pair_turns(t.turns, ["conv_id", "turn"])).select("id")


@query(f"""WITH {_PAIRED}, sc AS (SELECT conv_id % 10 AS query_id, id, role, pair_id, (conv_id * 31 + turn * 17) % 97 / 97.0::DOUBLE AS score FROM paired WHERE turn % 3 < 2),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc WHERE role = 'human') WHERE r = 1), ans AS (SELECT * FROM (SELECT pair_id, id, row_number() OVER (PARTITION BY pair_id ORDER BY conv_id DESC, turn DESC, id DESC) AS r FROM paired WHERE role = 'assistant') WHERE r = 1),
 pro AS (SELECT b.query_id, a.id, b.score + 0.2 AS least FROM best b JOIN ans a USING (pair_id)) SELECT coalesce(s.query_id, p.query_id) AS query_id, coalesce(s.id, p.id) AS id, round(greatest(s.score, p.least), 6) AS score FROM sc s FULL JOIN pro p ON p.query_id = s.query_id AND p.id = s.id""")
def r10_promote_answers(t: Tables) -> DataFrame:
    from ..operators.ranking import promote_answers

    p = ses.pair_turns(t.turns, ["conv_id", "turn"]).withColumn("created_at", F.struct("conv_id", "turn"))
    score = (F.col("conv_id") * 31 + F.col("turn") * 17) % 97 / F.lit(97.0)
    scored = p.where("turn % 3 < 2").select((F.col("conv_id") % 10).alias("query_id"), "id", "role", "pair_id", score.alias("score"))
    return promote_answers(scored, p).select("query_id", "id", r6(F.col("score"), "score"))


@query("SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at DESC, id DESC) AS r FROM m_memories WHERE salience > 0.5) WHERE r = 1")
def w4_active_profiles(t: Tables) -> DataFrame:
    p = t.memories.select("id", "user_id", (F.col("salience") > 0.5).alias("is_active"), F.col("last_seen_at").alias("updated_at"))
    return ses.active_profile(p).select("user_id", "id")


_BATCHES = "pend AS (SELECT id, user_id, last_seen_at, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at, id) AS r, count(*) OVER (PARTITION BY user_id) AS total FROM m_memories WHERE last_seen_at < TIMESTAMP '2024-01-31 23:59:59' AND user_id IN (SELECT id FROM m_users WHERE status = 1))"


def _pending(t: Tables) -> DataFrame:
    return t.memories.withColumn("created_at", F.col("last_seen_at"))


@query(f"WITH {_BATCHES} SELECT user_id, CAST((r - 1) // 30 AS INT) AS batch, count(*) AS n, string_agg(id, ',' ORDER BY r) AS dialogue FROM pend WHERE total >= 10 GROUP BY 1, 2")
def x1_session_batches(t: Tables) -> DataFrame:
    return ses.session_batches(_pending(t), t.users, tab.day_cutoff(t.as_of), size=30).select("user_id", "batch", "n", F.array_join("dialogue_ids", ",").alias("dialogue"))


@query(f"WITH {_BATCHES} SELECT user_id, count(*) AS n, min(last_seen_at) AS first FROM pend GROUP BY 1")
def x3_profile_batches(t: Tables) -> DataFrame:
    return ses.profile_batches(_pending(t), t.users, tab.day_cutoff(t.as_of)).select("user_id", "n", F.col("since").alias("first"))


@query(f"""WITH {_BATCHES} SELECT user_id, CAST((r - 1) // 30 AS INT) AS batch, count(*) || ' memories' AS summary, 256 AS dim, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS joined FROM pend WHERE total >= 10 GROUP BY 1, 2""")
def x2_write_sessions(t: Tables) -> DataFrame:
    batches = ses.session_batches(_pending(t), t.users, tab.day_cutoff(t.as_of), size=30)
    rows, marked = ses.write_sessions(batches, F.format_string("%d memories", "n"), t.memories)
    joined = marked.groupBy("user_id").agg(F.sum(F.col("session_joined").cast("long")).alias("joined"))
    return rows.join(joined, "user_id").select("user_id", "batch", "summary", F.size("v").alias("dim"), "joined")


@query("""SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) // 1000000 <= 600 THEN 0 ELSE 1 END AS fresh FROM m_hits)) GROUP BY 1, 2""")
def b5_gap_sessions(t: Tables) -> DataFrame:
    rows = t.hits.select(F.col("event_id").alias("id"), "user_id", "ts")
    return ses.gap_sessions(rows, gap_minutes=10).groupBy("user_id", F.col("session_no").cast("long").alias("session_no")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT user_id, id, tags[1] AS lang, 'src/' || tags[2] || '.py' AS path, feedback_score % 3 = 0 AS saved, last_seen_at FROM m_memories), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at DESC, id) AS r FROM m)
 SELECT user_id, 'Active in Unknown Project using ' || array_to_string(list_sort(list_distinct(list(lang))), ', ') || '. Focused on ' || array_to_string(list_sort(list_distinct(list(split_part(path, '/', 2))))[1:3], ', ') || '. (' || count(*) || ' memories, ' || CAST(sum(saved::INT) AS BIGINT) || ' saves). Last active: ' || strftime(max(last_seen_at), '%Y-%m-%d %H:%M:%S') || '.' AS summary FROM r WHERE r <= 100 GROUP BY 1""")
def a10_user_summaries(t: Tables) -> DataFrame:
    path = F.concat(F.lit("src\\"), F.get("tags", F.lit(1)), F.lit(".py"))
    meta = F.to_json(F.struct(F.get("tags", F.lit(0)).alias("language"), path.alias("ide_file_path"), F.when(F.col("feedback_score") % 3 == 0, "save").otherwise("open").alias("ide_event_type")))
    return ses.user_summaries(t.memories.select("id", "user_id", F.col("last_seen_at").alias("created_at"), meta.alias("meta")))


@query("SELECT user_id, tag, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, tag) AS r FROM (SELECT user_id, id AS tag, (CAST(substr(id, 2) AS BIGINT) * 7919) % 1000 / 1000.0::DOUBLE AS w FROM m_memories) WHERE w >= 0.5) WHERE r <= 15")
def x5_compact_tags(t: Tables) -> DataFrame:
    w = F.substring("id", 2, 18).cast("long") * 7919 % 1000 / F.lit(1000.0)
    tags = t.memories.select("user_id", F.col("id").alias("tag"), w.alias("w"))
    return ses.compact_tags(tags, "w", ses.MOST_TAGS, "tag").select("user_id", "tag", r6(F.col("w"), "w"))


@query("""WITH w AS (SELECT user_id, tags[2] AS name, feedback_score >= 4 AS new, max(salience) AS weight FROM m_memories GROUP BY 1, 2, 3)
 SELECT user_id, name, weight, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, name) AS place FROM (SELECT user_id, name, coalesce(max(weight) FILTER (new), max(weight)) AS weight FROM w GROUP BY 1, 2) WHERE weight >= 0.5 QUALIFY place <= 15""")
def x4_merge_profiles(t: Tables) -> DataFrame:
    """Profiles of tags, merged: the newer weight of a tag holds."""

    def profile(rows: DataFrame) -> DataFrame:
        tags = rows.groupBy("user_id", F.get("tags", F.lit(1)).alias("name")).agg(F.max("salience").alias("weight"))
        top = recall.ranked(tags, ["user_id"], F.desc("weight"), "name")
        listed = F.array_sort(F.collect_list(F.struct("rank", "name", "weight")))
        return top.groupBy("user_id").agg(F.to_json(F.struct(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["weight"].alias("weight"))).alias("tags"))).alias("profile"))

    merged = ses.merge_profiles(profile(t.memories.where("feedback_score < 4")), profile(t.memories.where("feedback_score >= 4")))
    tags = F.from_json("profile", "tags array<struct<name:string,weight:double>>")["tags"]
    rows = merged.select("user_id", F.inline(tags))
    # Equal weights keep the order of the lists, which SQL cannot follow: by name here.
    return recall.ranked(rows, ["user_id"], F.desc("weight"), "name", name="place").withColumn("place", F.col("place").cast("long"))


@query("""WITH side AS (SELECT user_id, feedback_score >= 4 AS new, tags[2] AS source, tags[1] AS lang, salience, CAST(substr(id, 2) AS BIGINT) AS k FROM m_memories),
 items AS (SELECT user_id, new, 'pets' AS list, 'code' AS by_key, lang AS name, max(salience) AS weight FROM side GROUP BY ALL
   UNION ALL SELECT user_id, new, 'items', 'type', lang, max(salience) FROM side GROUP BY ALL
   UNION ALL SELECT user_id, new, 'tags', 'name', source, max(salience) FROM side GROUP BY ALL)
 SELECT user_id, list, name, CAST(1 AS BIGINT) AS n, weight FROM (SELECT user_id, list, name, coalesce(max(weight) FILTER (new), max(weight)) AS weight FROM items GROUP BY user_id, list, name)
   WHERE list <> 'tags' OR weight >= 0.5
   QUALIFY list <> 'tags' OR row_number() OVER (PARTITION BY user_id, list ORDER BY weight DESC, name) <= 15""")
def x4_merge_by_path(t: Tables) -> DataFrame:
    """Lists whose items go by different keys: tags by name though their ids differ, items by type, and below ``demographic.extra`` by code though all share a type."""

    def profile(rows: DataFrame, side: str) -> DataFrame:
        def listed(name: str, key: Column, *more: Column) -> DataFrame:
            each = rows.groupBy("user_id", key.alias("k")).agg(F.max("salience").alias("weight"))
            return each.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "k"))), lambda x: F.struct(*[m(x["k"]) for m in more], (-x["w"]).alias("weight"))).alias(name))

        lang, source = F.get("tags", F.lit(0)), F.get("tags", F.lit(1))
        tags = listed("tags", source, lambda k: k.alias("name"), lambda k: F.concat(F.lit(side), k).alias("id"))
        pets = listed("pets", lang, lambda k: k.alias("code"), lambda k: F.lit("pet").alias("type"))
        items = listed("items", lang, lambda k: k.alias("type"), lambda k: F.lit(side).alias("title"))
        made = F.struct("tags", F.struct(F.struct("pets").alias("extra")).alias("demographic"), F.struct("items").alias("attributes"))
        return tags.join(pets, "user_id").join(items, "user_id").select("user_id", F.to_json(made).alias("profile"))

    merged = ses.merge_profiles(profile(t.memories.where("feedback_score < 4"), "old"), profile(t.memories.where("feedback_score >= 4"), "new"))
    item = "array<struct<name:string,code:string,type:string,weight:double>>"
    read = merged.select("user_id", F.from_json("profile", f"tags {item}, demographic struct<extra:struct<pets:{item}>>, attributes struct<items:{item}>").alias("p"))
    lists = {"tags": (F.col("p.tags"), "name"), "pets": (F.col("p.demographic.extra.pets"), "code"), "items": (F.col("p.attributes.items"), "type")}
    rows = [read.select("user_id", F.lit(name).alias("list"), F.explode(c).alias("x")).select("user_id", "list", F.col(f"x.{key}").alias("name"), "x.weight") for name, (c, key) in lists.items()]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("user_id", "list", "name").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


@query("""SELECT id, path, value, value <> '' AS sealed FROM (
 SELECT id, 'demographic.city' AS path, tags[1] AS value FROM m_memories UNION ALL SELECT id, 'tags[0].name', tags[2] FROM m_memories UNION ALL SELECT id, 'tags[1].name', '' FROM m_memories
 UNION ALL SELECT id, 'attributes.said[0]', coalesce(content, '') FROM m_memories UNION ALL SELECT id, 'attributes.said[2][0]', primary_sector FROM m_memories) WHERE value IS NOT NULL""")
def f20_sealed_profiles(t: Tables) -> DataFrame:
    """Profiles whose texts are sealed and opened again: every path, what it held, and whether it was sealed in between."""
    city, name = F.get("tags", F.lit(0)), F.get("tags", F.lit(1))
    tag = lambda text: F.struct(text.alias("name"), F.col("salience").alias("weight"))
    regular = F.to_json(F.struct(F.struct(city.alias("city"), F.lit(30).alias("age")).alias("demographic"), F.array(tag(name), tag(F.lit(""))).alias("tags")))
    quoted = lambda text: F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)
    made = F.concat(F.regexp_replace(regular, r"\}$", ""), F.lit(',"attributes":{"said":['), quoted(F.coalesce("content", F.lit(""))), F.lit(",1,["), quoted(F.col("primary_sector")), F.lit(",2]]}}"))
    key = F.base64(F.unhex(F.sha2("user_id", 256)))
    bound = F.create_map(F.lit("id"), F.col("id"), F.lit("user_id"), F.col("user_id"), F.lit("field"), F.lit("profile"))
    rows = t.memories.select("id", "user_id", made.alias("profile"), key.alias("key"), bound.alias("bound"))
    shut = checkpointed(rows.withColumn("shut", sealing.sealed_json(F.col("profile"), F.col("key"), F.col("bound"))))
    back = shut.withColumn("back", sealing.opened_json(F.col("shut"), F.col("key"), F.col("bound")))
    pairs = back.select("id", F.arrays_zip(sealing.leaves(F.col("back"), F.col("bound")).alias("b"), sealing.leaves(F.col("shut"), F.col("bound")).alias("s")).alias("z"))
    return pairs.select("id", F.explode("z").alias("z")).select("id", F.col("z.b.path").alias("path"), F.col("z.b.text").alias("value"), F.col("z.s.text").startswith(sealing.SEALED).alias("sealed"))


@query()
def s4_html_to_text(t: Tables) -> DataFrame:
    return ingest.html_to_text(t.raw("pages"), "html").select("page_id", "text", "method", "original_length")


@query()
def i1_chunks(t: Tables) -> DataFrame:
    return ingest.chunk(t.raw("documents").select("doc_id", "text"), "text").select("doc_id", "chunk_index", "start", "end", "tokens", "chunk")


@query()
def i2_sections(t: Tables) -> DataFrame:
    return ingest.sections(t.raw("documents").select("doc_id", "text"), "text", 400).select("doc_id", "section_index", "total_sections", "section")


@query()
def i1_chunks_by_sql(t: Tables) -> DataFrame:
    """The chunks of ``i1``, from SQL."""
    return table_functions.register(t.spark).sql("SELECT d.doc_id, c.chunk_index, c.start, c.`end`, c.tokens, c.chunk FROM {docs} d, LATERAL chunk_text(d.text, target => 128) c", docs=t.raw("documents"))


@query()
def i2_sections_by_sql(t: Tables) -> DataFrame:
    """The sections of ``i2``, from SQL."""
    return table_functions.register(t.spark).sql("SELECT d.doc_id, s.section_index, s.total_sections, s.section FROM {docs} d, LATERAL section_text(d.text, 400) s", docs=t.raw("documents"))


@query()
def i3_ingest(t: Tables) -> DataFrame:
    docs = t.memories.select("id", "user_id", F.lit("text").alias("content_type"), "content")
    return ingest.ingest(docs)[0].select("id", "user_id", "strategy", "root_id", "section_index", "total_sections", "primary_sector", "salience")


@query("SELECT id, CASE WHEN n > 200 THEN 'root' ELSE 'single' END AS strategy FROM (SELECT id, len(regexp_extract_all(regexp_replace(content, '[^\\x00-\\x7F]', ' ', 'g'), '[^\\x20\\x09-\\x0D]+')) + len(regexp_extract_all(content, '[^\\x00-\\x7F\\s]')) AS n FROM m_memories)")
def i3_strategies(t: Tables) -> DataFrame:
    docs = t.memories.select("id", "user_id", F.lit("text").alias("content_type"), "content")
    return ingest.ingest(docs)[0].where("strategy <> 'child'").select("id", "strategy")


_LARGE = "big AS (SELECT id, user_id, content, len(regexp_extract_all(regexp_replace(content, '[^\\x00-\\x7F]', ' ', 'g'), '[^\\x20\\x09-\\x0D]+')) + len(regexp_extract_all(content, '[^\\x00-\\x7F\\s]')) AS n FROM m_memories)"


@query(f"WITH {_LARGE} SELECT id, user_id, primary_sector, 1.0::DOUBLE AS salience, 0.1::DOUBLE AS decay_lambda, 1 AS segment, '[Document: TEXT]' || chr(10) || chr(10) || CASE WHEN length(content) <= 200 THEN content ELSE substr(content, 1, 200) || '...' END || chr(10) || chr(10) || '[Full content split across ' AS head FROM (SELECT *, 'reflective' AS primary_sector FROM big) WHERE n > 200")
def i4_roots(t: Tables) -> DataFrame:
    docs = t.memories.select("id", "user_id", F.lit("text").alias("content_type"), "content")
    roots = ingest.ingest(docs)[0].where("strategy = 'root'")
    return roots.select("id", "user_id", "primary_sector", "salience", "decay_lambda", "segment", F.regexp_replace("content", r"\d+ sections\]\z", "").alias("head"))


@query(f"WITH {_LARGE} SELECT id AS src_id, user_id, 1.0::DOUBLE AS weight FROM big WHERE n > 200")
def i5_links(t: Tables) -> DataFrame:
    """Each root has links to its sections, all of weight 1; their number is the root's own."""
    docs = t.memories.select("id", "user_id", F.lit("text").alias("content_type"), "content")
    memories, links = ingest.ingest(docs)
    n = links.groupBy("src_id", "user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst_id").alias("d"), F.min("weight").alias("weight"))
    roots = memories.where("strategy = 'root'").select(F.col("id").alias("src_id"), "total_sections")
    return n.join(roots, "src_id").where("n = total_sections AND d = n").select("src_id", "user_id", "weight")


@query("SELECT id, 0.4 + 0.1 * (CAST(substr(id, 2) AS BIGINT) % 3) AS salience, CASE primary_sector WHEN 'episodic' THEN 0.015 WHEN 'semantic' THEN 0.005 WHEN 'procedural' THEN 0.008 WHEN 'emotional' THEN 0.02 ELSE 0.001 END AS decay_lambda FROM m_memories")
def i6_new_memories(t: Tables) -> DataFrame:
    k = F.substring("id", 2, 18).cast("long") % 3
    others = F.slice(F.filter(F.array(*map(F.lit, SECTORS)), lambda s: s != F.col("primary_sector")), F.lit(1), k.cast("int"))
    rows = t.memories.select("id", "primary_sector", F.concat(F.array("primary_sector"), others).alias("sectors"))
    return ingest.new_memories(rows).select("id", r6(F.col("salience"), "salience"), "decay_lambda")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn)) - 1 AS place, role, text AS content FROM conversations")
def i7_explode_turns(t: Tables) -> DataFrame:
    c = t.raw("conversations").withColumn("role", F.when(F.col("role") == "user", "human").otherwise(F.col("role")))
    batches = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.create_map(x["role"], x["text"])).alias("turns"))
    good, rejects = ingest.explode_turns(batches, "turns")
    back = F.when(F.col("role") == "human", "user").otherwise(F.col("role")).alias("role")
    return good.union(rejects).select("conv_id", F.col("place").cast("long").alias("place"), back, "content")


@query("SELECT id, CASE WHEN length(content) <= 1000 THEN content WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN 'summary of ' || id ELSE substr(content, 1, 1000) END AS essence FROM m_memories")
def i8_essence(t: Tables) -> DataFrame:
    said = F.when(F.substring("id", 2, 18).cast("long") % 2 == 0, F.concat(F.lit("summary of "), "id")).otherwise(" ")
    return t.memories.select("id", ingest.essence(F.col("content"), said).alias("essence"))


_SCORES = "[k * 13 % 101, k * 29 % 101, k * 53 % 101, k * 71 % 101, k * 97 % 23]"


#: Sectors of each document by its stand-in scores.
_CLASSIFIED = f"""WITH s AS (SELECT doc_id, unnest({_SCORES}) AS score, unnest(range(0, 5)) AS i FROM (SELECT doc_id, doc_id AS k FROM documents)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM s), b AS (SELECT doc_id, max(CASE r WHEN 1 THEN score END) AS top, max(CASE r WHEN 2 THEN score END) AS second, max(CASE r WHEN 1 THEN i END) AS best FROM r GROUP BY 1),
 p AS (SELECT *, CASE WHEN top < 20 THEN 'semantic' ELSE ['episodic','semantic','procedural','emotional','reflective'][best + 1] END AS primary_sector FROM b)
 SELECT p.doc_id, primary_sector, coalesce(string_agg(['episodic','semantic','procedural','emotional','reflective'][r.i + 1], ',' ORDER BY r.r) FILTER (r.r > 1 AND r.score >= greatest(30.0, 0.4 * top) AND ['episodic','semantic','procedural','emotional','reflective'][r.i + 1] <> primary_sector), '') AS additional,
 CASE WHEN top <= 0 THEN 0.2 WHEN top < 20 THEN 0.3 ELSE round(least(1.0, (top - second) / 100.0::DOUBLE + 0.5), 2) END AS confidence FROM p JOIN r USING (doc_id) GROUP BY p.doc_id, primary_sector, top, second"""


@query(_CLASSIFIED)
def b1_classify(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    scores = F.array(*[(k * a % m).cast("double") for a, m in ((13, 101), (29, 101), (53, 101), (71, 101), (97, 23))])
    c = t.raw("documents").select("doc_id", model_stage.classify(scores).alias("c"))
    return c.select("doc_id", F.col("c.primary").alias("primary_sector"), F.array_join("c.additional", ",").alias("additional"), "c.confidence")


@query("SELECT 'topic:' || conv_id AS id, user_id, string_agg(id, ',' ORDER BY turn, id) AS dialogue FROM m_turns GROUP BY conv_id, user_id")
def b2_split_topics(t: Tables) -> DataFrame:
    return model_stage.split_topics(t.turns).select("id", "user_id", F.array_join("dialogue_ids", ",").alias("dialogue"))


@query("SELECT x.id, x.user_id, string_agg(x.m, ',' ORDER BY x.p) AS dialogue FROM (SELECT id, user_id, unnest(dialogue_ids) AS m, unnest([0, 1]) AS p FROM m_topics) x JOIN m_memories y ON y.id = x.m AND y.user_id = x.user_id GROUP BY 1, 2")
def b2_accepted_topics(t: Tables) -> DataFrame:
    return model_stage.accepted_topics(t.topics, t.memories)[0].select("id", "user_id", F.array_join("dialogue_ids", ",").alias("dialogue"))


@query("""WITH s AS (SELECT id, user_id, string_split(content, ' ') AS w FROM m_memories), x AS (SELECT id, user_id, regexp_extract(w[i], '^[A-Z][a-z]+') AS text, w[i - 1] AS before FROM s, unnest(range(2, len(w) + 1)) AS u(i))
 SELECT DISTINCT id, user_id, text FROM x WHERE text <> '' AND regexp_matches(before, '[a-z,]$')""")
def b3_mentions(t: Tables) -> DataFrame:
    """The default extraction."""
    return model_stage.mentions(t.memories).select("id", "user_id", "text")


_SAID = """x AS (SELECT t.id AS topic_id, t.user_id, m.id AS memory_id, length(m.content) AS n FROM (SELECT id, user_id, unnest(dialogue_ids) AS m FROM m_topics) t JOIN m_memories m ON m.id = t.m AND m.user_id = t.user_id WHERE m.content IS NOT NULL), y AS (SELECT DISTINCT * FROM x)"""


def _extracted(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A stand-in extractor: one fact a memory of a topic, with one or two entities by the length of the text."""
    flat = t.topics.select(F.col("id").alias("topic_id"), "user_id", F.explode("dialogue_ids").alias("memory_id")).distinct()
    said = flat.join(t.memories.select(F.col("id").alias("memory_id"), "user_id", "content"), ["memory_id", "user_id"]).where("content IS NOT NULL")
    n = F.char_length("content")
    entity = lambda k: F.struct(F.concat(F.lit("Name "), k.cast("string")).alias("text"), F.lit("OTHER").alias("entity_type"))
    facts = F.array(F.struct(F.concat(F.lit("chars "), n.cast("string")).alias("what"), F.lit("conversation").alias("fact_kind"), (n % 10 / 10.0).alias("confidence"), F.when(n % 2 == 0, F.array(entity(n % 5), entity(n % 3 + 10))).otherwise(F.array(entity(n % 5))).alias("entities")))
    return model_stage.flatten_facts(said.select("topic_id", "user_id", "memory_id", facts.alias("facts")))


@query(f"WITH {_SAID} SELECT 'f:' || topic_id || ':' || memory_id || ':0' AS id, user_id, topic_id, 'chars ' || n AS what, n % 10 / 10.0::DOUBLE AS confidence FROM y")
def b3_facts(t: Tables) -> DataFrame:
    return _extracted(t)[0].select("id", "user_id", "topic_id", "what", "confidence")


@query(f"WITH {_SAID} SELECT 'f:' || topic_id || ':' || memory_id || ':0' AS fact_id, user_id, 'Name ' || e AS text, CAST(p AS INT) AS place FROM (SELECT *, n % 5 AS e, 0 AS p FROM y UNION ALL SELECT *, n % 3 + 10, 1 FROM y WHERE n % 2 = 0)")
def b3_entities(t: Tables) -> DataFrame:
    return _extracted(t)[1].select("fact_id", "user_id", "text", "place")


@query("SELECT id, user_id, session_id FROM (SELECT m.id, m.user_id, t.id AS session_id, row_number() OVER (PARTITION BY m.id ORDER BY t.updated_at, t.id) AS r FROM (SELECT id, user_id, updated_at, unnest(dialogue_ids) AS m FROM m_topics) t JOIN m_memories m ON m.id = t.m AND m.user_id = t.user_id) WHERE r = 1")
def b5_one_session_each(t: Tables) -> DataFrame:
    """Topics stand for the sessions of a model."""
    said = t.topics.select(F.col("id").alias("session_id"), "user_id", F.col("updated_at").alias("started"), F.explode("dialogue_ids").alias("id")).join(t.memories.select("id", "user_id"), ["id", "user_id"], "left_semi")
    return model_stage.one_session_each(said).select("id", "user_id", "session_id").distinct()


def _said_again(rows):
    """A stand-in model for sentences: it fails for some, and says nothing for others."""
    if any(len(c) % 5 == 0 for c in rows["content"]):
        raise ValueError("no")
    return pd.DataFrame({"said": [c.replace("e", "E") if len(c) % 3 else " " for c in rows["content"]]})


def _length(rows):
    """A stand-in model that gives the length of a text, and fails for some."""
    n = [None if c is None else len(c) for c in rows["content"]]
    if any(k is not None and k % 5 == 0 for k in n):
        raise ValueError("no")
    return pd.DataFrame({"n": n})


@query("SELECT id, CASE WHEN length(content) % 5 = 0 OR length(content) % 3 = 0 OR trim(content) = '' THEN content ELSE trim(replace(content, 'e', 'E')) END AS text FROM m_memories WHERE content IS NOT NULL")
def b7_kept_on_failure(t: Tables) -> DataFrame:
    """A translation of whole texts keeps the text where the model failed or gave nothing."""
    rows = t.texts.where("content IS NOT NULL").select("id", "content")
    out = model_stage.model_stage(rows, _said_again, "said string")
    return out.select("id", model_stage.kept_on_failure(out, "content", "said").alias("text"))


@query("SELECT query_id, sector, 'q' || n AS text FROM (SELECT query_id, primary_sector AS sector, length(text) % 4 AS n, length(text) % 7 AS k FROM m_queries) WHERE k > 1")
def b7_sentences(t: Tables) -> DataFrame:
    """Sentences a model gave for a sector: those that its own check puts elsewhere, or that are empty, go."""
    n = F.char_length("text")
    found = F.when(n % 7 == 0, F.lit("unknown")).otherwise(F.col("primary_sector"))
    said = F.when(n % 7 == 1, F.lit("  ")).otherwise(F.concat(F.lit("q"), (n % 4).cast("string")))
    return model_stage.accepted_sentences(t.queries.select("query_id", F.col("primary_sector").alias("sector"), found.alias("found"), said.alias("text"))).select("query_id", "sector", "text")


@query("SELECT count(*) AS n, CAST(sum((length(content) % 5 <> 0)::INT) AS BIGINT) AS completed, CAST(sum((length(content) % 5 = 0)::INT) AS BIGINT) AS failed FROM m_memories WHERE content IS NOT NULL")
def a16_stage_counters(t: Tables) -> DataFrame:
    """The counters that a run of a stage leaves behind."""
    rows, seen = model_stage.observed(model_stage.model_stage(t.texts.where("content IS NOT NULL").select("id", "content"), _length, "n long"))
    rows.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([(seen.get["n"], seen.get["completed"], seen.get["failed"])], "n long, completed long, failed long")


@query("""SELECT fact_id, a, b, CASE WHEN rule IS NOT NULL THEN rule WHEN n <= 50 AND mc >= 0.7 THEN mr ELSE 'CO_OCCURS_WITH' END AS edge_relation, CASE WHEN rule IS NOT NULL THEN 'RULE' WHEN n <= 50 AND mc >= 0.7 THEN 'LLM' ELSE 'FALLBACK' END AS inference_source
 FROM (SELECT x.fact_id, x.canonical_id AS a, y.canonical_id AS b, CASE WHEN length(x.canonical_id) % 3 = 0 THEN 'CAUSES' END AS rule, 'KNOWS' AS mr, length(x.fact_id || y.canonical_id) % 10 / 10.0::DOUBLE AS mc, count(*) OVER (PARTITION BY x.fact_id) AS n FROM m_fact_entities x JOIN m_fact_entities y ON x.fact_id = y.fact_id AND x.canonical_id < y.canonical_id)""")
def b4_accept_relations(t: Tables) -> DataFrame:
    p = graph.entity_pairs(t.entity_links).withColumns({"rule": F.when(F.length("a") % 3 == 0, "CAUSES"), "model_relation": F.lit("KNOWS"), "model_confidence": F.length(F.concat("fact_id", "b")) % 10 / F.lit(10.0)})
    return model_stage.accept_relations(p).select("fact_id", "a", "b", "edge_relation", "inference_source")


@query("SELECT user_id, tag, round(count(*) / any_value(n)::DOUBLE, 6) AS weight FROM (SELECT user_id, unnest(tags) AS tag FROM m_memories) JOIN (SELECT user_id, count(*) AS n FROM m_memories GROUP BY 1) USING (user_id) GROUP BY 1, 2")
def b6_profile_hints(t: Tables) -> DataFrame:
    return model_stage.profile_hints(t.memories).select("user_id", "tag", r6(F.col("weight"), "weight"))


@query("SELECT id, 'completed' AS status, length(content) AS n FROM m_memories WHERE length(content) % 5 <> 0 UNION ALL SELECT id, 'failed', -1 FROM m_memories WHERE length(content) % 5 = 0")
def b0_b8_model_stage(t: Tables) -> DataFrame:
    return model_stage.model_stage(t.texts.select("id", "content"), _length, "n long").select("id", "status", F.coalesce("n", F.lit(-1)).alias("n"))


_EVAL = f"ranked AS (SELECT q.query_id, v.id, row_number() OVER (PARTITION BY q.query_id ORDER BY {R.sql_cosine('v.v', 'q.qv')} * {R.sql_penalty('q.primary_sector', 'v.sector')} DESC, v.id) AS rank FROM m_probes q JOIN m_vectors v USING (user_id)), first AS (SELECT query_id, min(rank) FILTER (id = probe_vec OR id = 'd' || (CAST(substr(probe_vec, 2) AS BIGINT) + 20)) AS r FROM m_probes LEFT JOIN ranked USING (query_id) GROUP BY query_id)"


@query(f"WITH {_EVAL} SELECT count(*) AS n_queries, round(avg((coalesce(r, 999) <= 1)::INT), 6) AS recall_at_1, round(avg((coalesce(r, 999) <= 3)::INT), 6) AS recall_at_3, round(avg((coalesce(r, 999) <= 5)::INT), 6) AS recall_at_5, round(avg((coalesce(r, 999) <= 10)::INT), 6) AS recall_at_10, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM first")
def a14_e2_retrieval_metrics(t: Tables) -> DataFrame:
    from ..functions.scoring import penalty

    score = cosine(F.col("v"), F.col("qv")) * penalty(F.col("primary_sector"), F.col("sector"))
    found = t.probes.join(t.vectors.select("id", "user_id", "sector", "v"), "user_id").withColumn("score", score)
    other = F.concat(F.lit("d"), (F.substring("probe_vec", 2, 18).cast("long") + 20).cast("string"))
    gold = t.probes.select("query_id", F.explode(F.array("probe_vec", other)).alias("id"))
    m = evaluate.retrieval_metrics(recall.ranked(found, ["query_id"], F.desc("score"), "id").select("query_id", "id", "rank"), gold)
    return m.select("n_queries", *[r6(F.col(c), c) for c in m.columns[1:]])


@query("""WITH p AS (SELECT doc_id % 5 AS y, (doc_id * 7 % 11) % 5 AS z, doc_id FROM documents) SELECT count(*) AS n, round(avg((y = z)::INT), 6) AS accuracy, round(avg((y = z)::INT), 6) AS exact_match, round(avg(((y = 0) = (z = 0))::INT), 6) AS episodic_accuracy, round(avg(((y = 1) = (z = 1))::INT), 6) AS semantic_accuracy,
 round(avg(((y = 2) = (z = 2))::INT), 6) AS procedural_accuracy, round(avg(((y = 3) = (z = 3))::INT), 6) AS emotional_accuracy, round(avg(((y = 4) = (z = 4))::INT), 6) AS reflective_accuracy FROM p""")
def a13_branch_metrics(t: Tables) -> DataFrame:
    y, z = F.col("doc_id") % 5, F.col("doc_id") * 7 % 11 % 5
    hot = lambda c: F.array(*[(c == i).cast("int") for i in range(5)])
    m = evaluate.branch_metrics(t.raw("documents").select(y.alias("primary"), z.alias("primary_pred"), hot(y).alias("labels"), hot(z).alias("labels_pred")))
    return m.select("n", *[r6(F.col(c), c) for c in m.columns[1:]])


@query(f"""WITH c AS ({_CLASSIFIED}), first AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
 SELECT doc_id AS place, primary_sector AS "primary", list_transform(['episodic', 'semantic', 'procedural', 'emotional', 'reflective'], lambda x: CAST(x = primary_sector OR list_contains(string_split(additional, ','), x) AS INT)) AS labels FROM c JOIN first USING (doc_id)""")
def e1_label_texts(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    scores = F.array(*[(k * a % m).cast("double") for a, m in ((13, 101), (29, 101), (53, 101), (71, 101), (97, 23))])
    return evaluate.label_texts(t.raw("documents").select(k.alias("place"), "text", scores.alias("scores"))).select("place", "primary", "labels")


def _labelled(t: Tables) -> DataFrame:
    """The labelled documents, with quality and toxicity as two of the labels."""
    hot = F.array(F.lit(0), F.col("quality").cast("int"), F.col("toxic").cast("int"), F.lit(0), F.lit(1))
    return t.raw("documents").join(t.raw("labels"), "doc_id").select("text", (F.col("quality") * 2 + F.col("toxic")).alias("primary"), hot.alias("labels"))


@query()
def e3_sector_classifier(t: Tables) -> DataFrame:
    """Trained on the labelled documents and applied to all."""
    return evaluate.score_sectors(evaluate.fit_sectors(_labelled(t), features=1 << 12), t.raw("documents").select("doc_id", "text")).select("doc_id", "primary_pred", r6(F.col("confidence"), "confidence"))


@query()
def e3_held_out_metrics(t: Tables) -> DataFrame:
    """Metrics of both branches on a fifth of the labelled texts that neither fitting nor the choice of iterations has seen."""
    unseen = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(5)) == 0
    scored = evaluate.score_sectors(evaluate.fit_sectors(_labelled(t).where(~unseen), features=1 << 12), _labelled(t).where(unseen))
    return evaluate.branch_metrics(scored)


@query(f"""WITH lastq AS (SELECT 'c' || conv_id AS query_id, user_id, content AS text, 3 AS top_k FROM m_turns WHERE role = 'human' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1), {_BM25.replace('FROM m_queries', 'FROM lastq')},
 told AS (SELECT query_id, string_agg('- ' || content, chr(10) ORDER BY rank) AS context FROM bmr JOIN m_memories USING (id) WHERE rank <= 3 GROUP BY 1)
 SELECT query_id, text, context FROM lastq LEFT JOIN told USING (query_id)""")
def r14_augmented_conversations(t: Tables) -> DataFrame:
    """The last question of each conversation with its three best memories by words."""
    from .search import augment_conversations

    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    asked = t.turns.where("role = 'human'").withColumn("r", last).where("r = 1").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("query_id"), "user_id", F.col("content").alias("text"), F.lit(3).alias("top_k"))
    return augment_conversations(asked.select("query_id", "text"), recall.bm25_recall(asked, t.texts), t.memories)
