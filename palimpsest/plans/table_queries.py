"""Registered queries: tables, filters, joins, counts, pages and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import convert
from ..functions import text as T
from ..functions.vectors import padded, trimmed
from ..operators import graph, recall
from ..operators import tables as tab
from ..sources.views import Tables
from ..constants import SYNONYMS
from .registry import query, sql_canonical, sql_canonical_tokens


@query("SELECT id, user_id, primary_sector, salience, feedback_score, last_seen_at FROM m_memories")
def s1_scan_memories(t: Tables) -> DataFrame:
    return t.memories.select("id", "user_id", "primary_sector", "salience", "feedback_score", "last_seen_at")


@query(r"""SELECT doc_id, length(trim(text)) AS length,
 len(regexp_extract_all(regexp_replace(trim(text), '[^\x00-\x7F]', ' ', 'g'), '[^\x20\x09-\x0D]+')) + len(regexp_extract_all(trim(text), '[^\x00-\x7F\s]')) AS estimated_tokens FROM documents""")
def s5_text_documents(t: Tables) -> DataFrame:
    from ..operators.ingest import text_documents

    d = text_documents(t.raw("documents"), "text")
    return d.select("doc_id", F.col("length").cast("long").alias("length"), F.col("estimated_tokens").cast("long").alias("estimated_tokens"))


@query("""SELECT p_type AS content_type, CASE WHEN contains(lower(p_type), 'pdf') THEN 'pdf' WHEN contains(lower(p_type), 'docx') OR contains(lower(p_type), 'word') THEN 'docx' WHEN contains(lower(p_type), 'html') THEN 'html'
 WHEN contains(lower(p_type), 'markdown') THEN 'markdown' WHEN contains(lower(p_type), 'text') THEN 'text' ELSE 'reject' END AS route, count(*) AS n
 FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'application/PDF' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/markdown' WHEN 3 THEN 'text/plain' WHEN 4 THEN p_type ELSE 'application/msword' END AS p_type FROM part) GROUP BY ALL""")
def s6_content_routes(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 6
    kind = F.when(k == 0, "application/PDF").when(k == 1, "text/html").when(k == 2, "text/markdown").when(k == 3, "text/plain").when(k == 4, F.col("p_type")).otherwise("application/msword")
    good, rejects = tab.route_content(t.raw("part").select(kind.alias("content_type")), "content_type")
    return good.union(rejects.withColumn("route", F.lit("reject"))).groupBy("content_type", "route").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, user_id, salience FROM m_memories WHERE CAST(substr(id, 2) AS BIGINT) % 10 NOT IN (0, 1)
 UNION ALL SELECT CASE WHEN CAST(substr(id, 2) AS BIGINT) % 10 = 1 THEN 'new-' || id ELSE id END, user_id, 1.0 FROM m_memories WHERE CAST(substr(id, 2) AS BIGINT) % 10 IN (0, 1)
 UNION ALL SELECT id, user_id, salience FROM m_memories WHERE CAST(substr(id, 2) AS BIGINT) % 10 = 1""")
def s7_memory_upsert(t: Tables) -> DataFrame:
    m = t.memories.select("id", "user_id", "salience")
    k = F.substring("id", 2, 18).cast("long") % 10
    new = m.where(k.isin(0, 1)).select(F.when(k == 1, F.concat(F.lit("new-"), "id")).otherwise(F.col("id")).alias("id"), "user_id", F.lit(1.0).alias("salience"))
    return tab.upsert(m, new, ["id"])


@query("SELECT id, sector, least(len(v), 96) AS dim, round(list_sum(CAST(v[1:96] AS DOUBLE[])), 5) AS total, 96 AS stored FROM m_vectors")
def s8_store_vectors(t: Tables) -> DataFrame:
    stored = tab.store_vectors(t.vectors.limit(0), t.vectors, 96)
    return stored.select("id", "sector", "dim", F.round(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("v").alias("stored"))


@query("SELECT id, sector, len(v[1:16 + CAST(substr(id, 2) AS BIGINT) % 3]) AS n, round(CAST(v[16] AS DOUBLE), 6) AS x FROM m_vectors")
def s9_trimmed_vectors(t: Tables) -> DataFrame:
    v = t.vectors.withColumn("v", padded(F.col("v"), 128)).withColumn("v", trimmed(F.col("v"), (F.substring("id", 2, 18).cast("long") % 3 + 16).cast("int")))
    return v.select("id", "sector", F.size("v").cast("long").alias("n"), F.round(F.get("v", F.lit(15)).cast("double"), 6).alias("x"))


@query("""SELECT id, name, entity_type FROM m_canonical WHERE entity_type <> 'PRODUCT' UNION ALL SELECT id, 'again ' || name, entity_type FROM m_canonical WHERE entity_type = 'PRODUCT'""")
def s10_insert_or_ignore(t: Tables) -> DataFrame:
    old = t.canonical.where("entity_type <> 'PRODUCT'")
    return tab.upsert(old, t.canonical.withColumn("name", F.concat(F.lit("again "), "name")), ["id"], mode="ignore")


@query("""SELECT id, name, CASE WHEN entity_type = 'LOCATION' THEN 'PLACE' ELSE entity_type END AS entity_type FROM m_canonical""")
def s10_merge_columns(t: Tables) -> DataFrame:
    new = t.canonical.where("entity_type = 'LOCATION'").select("id", F.lit("ignored").alias("name"), F.lit("PLACE").alias("entity_type"))
    return tab.upsert(t.canonical, new, ["id"], mode="merge", columns=["entity_type"])


@query("SELECT id, user_id, salience FROM m_memories WHERE salience >= 0.5 AND user_id <> 'u4' AND feedback_score < 7 AND primary_sector <> 'emotional'")
def p1_conditions(t: Tables) -> DataFrame:
    return tab.filter_conditions(t.memories, ["salience >= 0.5", "m.user_id != %s", "feedback_score < 7", "primary_sector != 'emotional'"], ["u4"]).select("id", "user_id", "salience")


@query("SELECT id, row_number() OVER (ORDER BY confidence DESC NULLS FIRST, n_facts NULLS LAST, id) AS place FROM (SELECT source || '>' || target || '@' || user_id AS id, confidence, n_facts FROM m_relations) ORDER BY place LIMIT 200")
def p2_order_spec(t: Tables) -> DataFrame:
    r = t.relations.select(F.concat("source", F.lit(">"), "target", F.lit("@"), "user_id").alias("id"), "confidence", "n_facts")
    order = tab.order_columns(r, ["r.confidence desc", "n_facts", "id"])
    top = r.orderBy(*order).limit(200)
    return top.select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("SELECT tenant_key, project_key, user_key, id, status FROM m_users WHERE project_key <> 'BUILDING' AND status = 1")
def p3_resolve_users(t: Tables) -> DataFrame:
    asked = t.users.where("status = 1").select("tenant_key", F.when(F.col("project_key") != "BUILDING", F.col("project_key")).alias("project_key"), "user_key")
    found, _ = tab.resolve_users(asked, t.users)
    return found.select("tenant_key", "project_key", "user_key", "id", "status")


@query("SELECT id, status FROM (SELECT * FROM m_users WHERE status = 1 ORDER BY user_key DESC, id LIMIT 20 OFFSET 5)")
def p4_find_users(t: Tables) -> DataFrame:
    return tab.find_users(t.users, status=1, order=["user_key desc"], limit=20, offset=5).select("id", "status")


@query("SELECT f.id, f.confidence, t.name FROM m_facts f JOIN m_topics t ON t.id = f.topic_id WHERE fact_kind = 'event' AND confidence BETWEEN 0.3 AND 0.6 AND lower(t.name) LIKE '%urgent%'")
def p5_facts_filter(t: Tables) -> DataFrame:
    f = t.facts.join(t.topics.select(F.col("id").alias("topic_id"), F.col("name").alias("what")), "topic_id")
    return graph.facts_filter(f, kind="event", low=0.3, high=0.6, keyword="Urgent").select("id", "confidence", F.col("what").alias("name"))


@query("SELECT user_id, source, target, CASE WHEN source = 'p7' THEN target ELSE source END AS other, edge_relation, confidence FROM m_relations WHERE (source = 'p7' OR target = 'p7') AND edge_relation IN ('CAUSES', 'PART_OF') AND confidence >= 0.1")
def p6_relations_filter(t: Tables) -> DataFrame:
    return graph.relations_filter(t.relations, entity="p7", kinds=["CAUSES", "PART_OF"], low=0.1).select("user_id", "source", "target", "other", "edge_relation", "confidence")


@query("SELECT DISTINCT q.query_id, x.id AS topic_id FROM (SELECT id, user_id, unnest(dialogue_ids) AS m FROM m_topics) x JOIN m_queries q ON x.user_id = q.user_id AND x.m = 'd' || substr(q.user_id, 2)")
def p7_topics_of(t: Tables) -> DataFrame:
    ids = t.queries.select("query_id", "user_id", F.concat(F.lit("d"), F.substring("user_id", 2, 9)).alias("id"))
    return graph.topics_of(t.topics, ids).select("query_id", "topic_id")


@query("SELECT id, created_at FROM (SELECT id, last_seen_at AS created_at, feedback_score % 2 = 0 AS done FROM m_memories) WHERE NOT done AND created_at < TIMESTAMP '2024-01-31 23:59:59'")
def p9_pending(t: Tables) -> DataFrame:
    m = t.memories.withColumns({"created_at": F.col("last_seen_at"), "fact_joined": F.col("feedback_score") % 2 == 0})
    return tab.pending(m, "fact_joined", tab.day_cutoff(t.as_of)).select("id", "created_at")


@query("SELECT event_id, date_trunc('day', ts) - INTERVAL 1 SECOND AS cutoff FROM events")
def p10_day_cutoff(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", tab.day_cutoff(F.col("ts")).alias("cutoff"))


@query("SELECT id, user_id, content, primary_sector FROM m_memories JOIN m_vectors USING (id, user_id)")
def p11_public_memory(t: Tables) -> DataFrame:
    m = t.memories.join(t.vectors.select("id", "v"), "id")
    return tab.public_memory(m).select("id", "user_id", "content", "primary_sector")


@query("SELECT m.id, v.sector, m.salience, v.dim FROM m_memories m JOIN m_vectors v ON m.id = v.id WHERE v.v IS NOT NULL")
def j1_memories_with_vectors(t: Tables) -> DataFrame:
    return tab.memories_with_vectors(t.memories, t.vectors).select("id", "sector", "salience", "dim")


@query("SELECT fact_id, canonical_id, name, entity_type FROM m_fact_entities JOIN m_canonical ON canonical_id = id")
def j2_fact_entities(t: Tables) -> DataFrame:
    return graph.fact_entities(t.fact_entities, t.canonical).select("fact_id", "canonical_id", "name", "entity_type")


@query("""SELECT e.canonical_id, f.topic_id, count(DISTINCT e.fact_id) AS n_facts, max(t.name) AS topic_name, max(coalesce(len(t.dialogue_ids), 0)) AS n_memories
 FROM m_fact_entities e JOIN m_facts f ON f.id = e.fact_id JOIN m_topics t ON t.id = f.topic_id GROUP BY 1, 2""")
def j3_entity_topics(t: Tables) -> DataFrame:
    return graph.entity_topics(t.fact_entities, t.facts, t.topics).withColumn("n_memories", F.col("n_memories").cast("long"))


@query("SELECT x.fact_id, x.canonical_id AS a, y.canonical_id AS b FROM m_fact_entities x JOIN m_fact_entities y ON x.fact_id = y.fact_id AND x.canonical_id < y.canonical_id")
def j6_entity_pairs(t: Tables) -> DataFrame:
    return graph.entity_pairs(t.entity_links)


@query("SELECT fact_id, count(*) AS pairs FROM (SELECT x.fact_id FROM m_fact_entities x JOIN m_fact_entities y ON x.fact_id = y.fact_id AND x.canonical_id < y.canonical_id) GROUP BY 1 HAVING count(*) <= 3")
def j6_capped_pairs(t: Tables) -> DataFrame:
    return graph.entity_pairs(t.entity_links, most=3).groupBy("fact_id").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT fact_id, count(*) AS n FROM m_fact_entities GROUP BY 1 HAVING count(*) > 2")
def j6_facts_with_many_entities(t: Tables) -> DataFrame:
    """What ``entity_pairs`` would make more pairs of than allowed."""
    return graph.entity_counts(t.fact_entities).where("n > 2")


@query("SELECT user_id, count(*) AS n FROM m_memories WHERE salience > 0.3 GROUP BY 1")
def a1_count_by_user(t: Tables) -> DataFrame:
    return tab.count_by_user(t.memories, ["salience > 0.3"])


@query("SELECT id, user_id, total FROM (SELECT id, user_id, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY salience DESC, id) AS r FROM m_memories) WHERE r BETWEEN 6 AND 10")
def a2_page_of_each_user(t: Tables) -> DataFrame:
    return tab.page(t.memories, [F.desc("salience"), "id"], current=2, size=5, within=["user_id"]).select("id", "user_id", "total")


@query("SELECT DISTINCT e.canonical_id, f.user_id FROM m_fact_entities e JOIN m_facts f ON f.id = e.fact_id")
def a4_distinct_entities(t: Tables) -> DataFrame:
    return t.fact_entities.join(t.facts.select(F.col("id").alias("fact_id"), "user_id"), "fact_id").select("canonical_id", "user_id").distinct()


@query("""SELECT query_id, topic_id, max(score) AS score FROM (SELECT q.query_id, f.topic_id, f.confidence AS score FROM m_queries q JOIN m_facts f ON f.user_id = q.user_id WHERE f.topic_id IS NOT NULL) GROUP BY 1, 2""")
def a5_propagate_max(t: Tables) -> DataFrame:
    scores = t.queries.select("query_id", "user_id").join(t.facts.select("user_id", F.col("id").alias("fact_id"), F.col("confidence").alias("score")), "user_id")
    return graph.propagate_max(scores, t.facts.select(F.col("id").alias("fact_id"), "topic_id"), "fact_id", "topic_id")


@query("SELECT id, updated_at, (SELECT count(*) FROM m_topics WHERE user_id = 'u4') AS total FROM (SELECT * FROM m_topics WHERE user_id = 'u4' ORDER BY updated_at DESC NULLS LAST, id LIMIT 15 OFFSET 15)")
def o1_topic_page(t: Tables) -> DataFrame:
    return tab.page(t.topics.where("user_id = 'u4'"), [F.col("updated_at").desc_nulls_last(), "id"], current=2, size=15).select("id", "updated_at", "total")


@query("SELECT id, content FROM m_memories WHERE id IN ('d3', 'd17', 'd100')")
def o5_find_by_ids(t: Tables) -> DataFrame:
    return tab.get(t.memories, ["d3", "d17", "d100"]).select("id", "content")


@query("""SELECT query_id, id, bool_or(k = 0) AS from_bm25, bool_or(k = 1) AS from_vector, bool_or(k = 2) AS from_session, bool_or(k = 3) AS from_waypoint, bool_or(k = 4) AS from_graph, ['bm25','vector','session','waypoint','graph'][min(k) + 1] AS source
 FROM (SELECT query_id, 'd' || (CAST(substr(query_id, 2) AS BIGINT) + 1) AS id, 2 AS k FROM m_queries UNION ALL SELECT query_id, probe_vec, 1 FROM m_queries UNION ALL SELECT query_id, probe_vec, 4 FROM m_queries) GROUP BY 1, 2""")
def u1_candidates(t: Tables) -> DataFrame:
    q = t.queries
    session = q.select("query_id", F.concat(F.lit("d"), (F.substring("query_id", 2, 18).cast("long") + 1).cast("string")).alias("id"))
    vector = q.select("query_id", F.col("probe_vec").alias("id"))
    return recall.candidates(session=session, vector=vector, graph=vector)


@query("SELECT id FROM m_memories WHERE id NOT IN (SELECT unnest(dialogue_ids) FROM m_topics)")
def u3_not_covered(t: Tables) -> DataFrame:
    return t.memories.join(t.topics.select(F.explode("dialogue_ids").alias("id")).distinct(), "id", "left_anti").select("id")


@query("""SELECT kind, n FROM (SELECT 'kept' AS kind, count(*) AS n FROM (SELECT DISTINCT text, lang, source FROM documents) UNION ALL SELECT 'repeated', (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)))""")
def u4_dedup_counts(t: Tables) -> DataFrame:
    kept, repeated = tab.dedup_records(t.raw("documents"), ["text", "lang", "source"], "doc_id")
    return kept.agg(F.lit("kept").alias("kind"), F.count(F.lit(1)).alias("n")).union(repeated.agg(F.lit("repeated"), F.count(F.lit(1))))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS first_place FROM documents QUALIFY doc_id <> min(doc_id) OVER (PARTITION BY text, lang)")
def u4_repeated_records(t: Tables) -> DataFrame:
    return tab.dedup_records(t.raw("documents"), ["text", "lang"], "doc_id")[1].select("doc_id", "first_place")


def _waypoints(t: Tables) -> DataFrame:
    return t.topics.select(F.get("dialogue_ids", F.lit(0)).alias("src_id"), F.get("dialogue_ids", F.lit(1)).alias("dst_id"), "user_id").distinct()


_SQL_WAYPOINTS = "SELECT DISTINCT dialogue_ids[1] AS src_id, dialogue_ids[2] AS dst_id, user_id FROM m_topics"


@query(f"""SELECT 'memories' AS table_name, id AS row_id FROM m_memories WHERE salience >= 0.2 UNION ALL SELECT 'vectors', id FROM m_vectors WHERE id NOT IN (SELECT id FROM m_memories WHERE salience < 0.2)
 UNION ALL SELECT 'waypoints', src_id || '>' || dst_id || '@' || user_id FROM ({_SQL_WAYPOINTS}) WHERE src_id NOT IN (SELECT id FROM m_memories WHERE salience < 0.2) AND dst_id NOT IN (SELECT id FROM m_memories WHERE salience < 0.2)""")
def u5_delete_cascade(t: Tables) -> DataFrame:
    """The rows that stay in each table."""
    left = tab.delete_memories({"memories": t.memories, "vectors": t.vectors, "waypoints": _waypoints(t)}, t.memories.where("salience < 0.2"))
    names = {"memories": F.col("id"), "vectors": F.col("id"), "waypoints": F.concat("src_id", F.lit(">"), "dst_id", F.lit("@"), "user_id")}
    return reduce(DataFrame.union, [x.select(F.lit(name).alias("table_name"), names[name].alias("row_id")) for name, x in left.items()])


def _owned(t: Tables) -> dict[str, DataFrame]:
    """All tables that have rows of users, by the views that stand for them."""
    links = t.fact_entities.join(t.facts.select(F.col("id").alias("fact_id"), "user_id"), "fact_id")
    return {
        "memories": t.memories, "vectors": t.vectors, "waypoints": _waypoints(t), "users": t.users.select(F.col("id").alias("user_id")), "sessions": t.topics, "user_profiles": t.users.where("status = 1").select(F.col("id").alias("user_id")),
        "graph_topics": t.topics, "graph_facts": t.facts, "graph_canonical_entities": t.relations.select("user_id", F.col("source").alias("id")).distinct(), "graph_entities": links, "graph_fact_entities": links, "graph_relations": t.relations,
    }


_SQL_LINKS = "SELECT e.*, f.user_id FROM m_fact_entities e JOIN m_facts f ON f.id = e.fact_id"
_SQL_OWNED = {
    "memories": "SELECT user_id FROM m_memories", "vectors": "SELECT user_id FROM m_vectors", "waypoints": _SQL_WAYPOINTS, "users": "SELECT id AS user_id FROM m_users", "sessions": "SELECT user_id FROM m_topics", "user_profiles": "SELECT id AS user_id FROM m_users WHERE status = 1",
    "graph_topics": "SELECT user_id FROM m_topics", "graph_facts": "SELECT user_id FROM m_facts", "graph_canonical_entities": "SELECT DISTINCT user_id, source FROM m_relations", "graph_entities": _SQL_LINKS, "graph_fact_entities": _SQL_LINKS, "graph_relations": "SELECT user_id FROM m_relations",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS table_name, CAST(sum((user_id IN ('u1', 'u2'))::INT) AS BIGINT) AS lost, CAST(sum((user_id NOT IN ('u1', 'u2'))::INT) AS BIGINT) AS stay FROM ({sql})" for name, sql in _SQL_OWNED.items()))
def u6_clear_users(t: Tables) -> DataFrame:
    """Rows of two users gone from all tables, and those that stay."""
    users = t.users.where(F.col("id").isin("u1", "u2")).select(F.col("id").alias("user_id"))
    left, lost = tab.clear_users(_owned(t), users)
    stay = reduce(DataFrame.union, [x.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("stay")) for name, x in left.items()])
    return lost.join(stay, "table_name").select("table_name", F.col("n").alias("lost"), "stay")


@query("SELECT id, id IN (SELECT unnest(dialogue_ids) FROM m_topics WHERE name = '1-URGENT') AS session_joined FROM m_memories")
def u7_mark(t: Tables) -> DataFrame:
    ids = t.topics.where("name = '1-URGENT'").select(F.explode("dialogue_ids").alias("id"))
    return tab.mark(t.memories, ids, "session_joined").select("id", "session_joined")


@query("""SELECT id, user_id, is_active AND user_id NOT IN ('u5', 'u6') AS is_active FROM (SELECT 'old-' || id AS id, user_id, salience > 0.9 AS is_active FROM m_memories) UNION ALL SELECT 'new-' || u, u, true FROM (VALUES ('u5'), ('u6')) v(u)""")
def u8_rotate_profiles(t: Tables) -> DataFrame:
    old = t.memories.select(F.concat(F.lit("old-"), "id").alias("id"), "user_id", (F.col("salience") > 0.9).alias("is_active"))
    new = t.users.where(F.col("id").isin("u5", "u6")).select(F.concat(F.lit("new-"), "id").alias("id"), F.col("id").alias("user_id"))
    return tab.rotate_profiles(old, new).select("id", "user_id", "is_active")


@query("SELECT event_id, coalesce(CASE WHEN json_type(props) = 'OBJECT' THEN props END, '{}') AS props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f19_json(t: Tables) -> DataFrame:
    safe = convert.json_object(F.col("props"))
    return t.raw("events").select("event_id", safe.alias("props"), F.get_json_object(safe, "$.k").cast("long").alias("k"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN (epoch_us(ts) // 1000000) * 1000 WHEN 2 THEN epoch_us(ts) // 1000 WHEN 3 THEN (epoch_us(ts) // 1000000) * 1000 ELSE 7 END AS ms FROM events""")
def f21_epoch_ms(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 5
    value = F.when(k == 0, ms.cast("string")).when(k == 1, F.floor(ms / 1000).cast("string")).when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("no time")
    return t.raw("events").select("event_id", convert.epoch_ms(value, F.lit(7).cast("long")).alias("ms"))


@query("SELECT id, entity_type || '|' || lower(regexp_replace(name, '[\\s!-/:-@\\[-`{-~]', '', 'g')) AS key FROM m_canonical")
def f22_entity_keys(t: Tables) -> DataFrame:
    return t.canonical.select("id", T.entity_key(F.col("entity_type"), F.col("name")).alias("key"))


@query("SELECT s_suppkey, 'What: ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' | Who: Ann' ELSE '' END AS text FROM supplier")
def f23_fact_text(t: Tables) -> DataFrame:
    return t.raw("supplier").select("s_suppkey", T.fact_text(what=F.col("s_name"), who=F.when(F.col("s_suppkey") % 2 == 0, "Ann").otherwise(""), why=F.lit(None).cast("string")).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN split_part(url, '/', -1) ELSE split_part(replace('c:/docs/' || page_id || '.txt', '\\', '/'), '/', -1) END AS file FROM pages")
def f24_basename(t: Tables) -> DataFrame:
    path = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("c:\\docs\\"), F.col("page_id").cast("string"), F.lit(".txt")))
    return t.raw("pages").select("page_id", T.basename(path).alias("file"))


@query("SELECT user_id, source, target, CASE WHEN edge_relation = 'CAUSES' THEN 'CAUSES' WHEN edge_relation = 'PRECEDES' THEN 'CO_OCCURS_WITH' WHEN edge_relation = 'PART_OF' THEN 'RELATED_TO' ELSE edge_relation END AS r FROM m_relations")
def f26_edge_relation(t: Tables) -> DataFrame:
    from ..constants import EDGE_WEIGHTS

    e = F.col("edge_relation")
    given = F.when(e == "CAUSES", "causes").when(e == "PRECEDES", " ").when(e == "PART_OF", "no such").otherwise(e)
    return t.relations.select("user_id", "source", "target", T.edge_relation(given, list(EDGE_WEIGHTS)).alias("r"))


@query("SELECT id, [CAST(primary_sector = 'episodic' AS INT), CAST(primary_sector = 'semantic' AS INT), CAST(primary_sector = 'procedural' AS INT), CAST(primary_sector = 'emotional' AS INT), CAST(primary_sector IN ('reflective') AS INT)]::VARCHAR AS hot FROM m_memories")
def f27_multi_hot(t: Tables) -> DataFrame:
    from ..constants import SECTORS

    hot = T.multi_hot(F.array("primary_sector"), SECTORS)
    return t.memories.select("id", F.concat(F.lit("["), F.array_join(hot.cast("array<string>"), ", "), F.lit("]")).alias("hot"))


@query("SELECT query_id, '[sector:' || s || ']' || chr(10) || text AS text, s AS sector FROM m_queries, (SELECT unnest(['episodic', 'semantic', 'procedural', 'emotional', 'reflective']) AS s)")
def f17_sector_texts(t: Tables) -> DataFrame:
    q = recall.prepare_queries(t.queries).withColumn("sector", F.explode("sectors"))
    return q.select("query_id", T.sector_text(F.col("sector"), F.col("text")).alias("text"), "sector")


@query("SELECT id, CASE WHEN length(content) <= 200 THEN content ELSE substr(content, 1, 200) || '...' END AS summary FROM m_memories")
def f18_truncated(t: Tables) -> DataFrame:
    return t.memories.select("id", T.truncated(F.col("content"), 200).alias("summary"))


@query("SELECT id, user_id, content, content IS NOT NULL AND content <> '' AND user_id <> 'u7' AS sealed FROM m_memories")
def j8_f20_encrypted_contents(t: Tables) -> DataFrame:
    """Contents sealed with their users' keys and opened again; one user has no key."""
    key = F.when(F.col("id") != "u7", F.base64(F.unhex(F.sha2("id", 256))))
    users = t.users.select("id", key.alias("encryption_key")).union(t.users.where("id = 'u0'").select(F.lit("u0"), F.base64(F.unhex(F.sha2(F.lit("u0"), 256)))))
    aad = {"content": F.to_json(F.struct("id", "user_id"))}
    memories = t.memories.select("id", "user_id", "content")
    sealed = tab.seal(memories, users.dropDuplicates(["id"]), aad)
    opened = tab.unseal(sealed, users.dropDuplicates(["id"]), aad)
    return opened.select("id", "user_id", "content").join(sealed.select("id", F.col("content").alias("stored")), "id").select("id", "user_id", "content", F.coalesce(F.col("stored") != F.col("content"), F.lit(False)).alias("sealed"))


@query(f"SELECT query_id, array_to_string(list_sort(list_distinct(list(w))), ' ') AS doc FROM (SELECT query_id, unnest(list_append(CASE c {' '.join(f"WHEN '{line[0]}' THEN {sorted(line)}" for line in SYNONYMS)} ELSE [c] END, z)) AS w FROM (SELECT query_id, z, {sql_canonical('z')} AS c FROM (SELECT query_id, unnest({sql_canonical_tokens('text')}) AS z FROM m_queries))) GROUP BY 1")
def f6_search_documents(t: Tables) -> DataFrame:
    return t.queries.select("query_id", T.search_document(F.col("text")).alias("doc"))


@query("SELECT id, array_to_string(list_filter(['intj', 'ESFP', lang, 'ENTJ', source], lambda x: upper(x) IN ('INTJ', 'ESFP', 'ENTJ')), ',') AS kept FROM (SELECT id, tags[1] AS lang, tags[2] AS source FROM m_memories)")
def x6_known_personalities(t: Tables) -> DataFrame:
    from ..operators.sessions import known_personalities

    given = F.array(F.lit("intj"), F.lit("ESFP"), F.get("tags", F.lit(0)), F.lit("ENTJ"), F.get("tags", F.lit(1)))
    return t.memories.select("id", F.array_join(known_personalities(given), ",").alias("kept"))
