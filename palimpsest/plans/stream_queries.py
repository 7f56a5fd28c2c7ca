"""Registered queries: streaming definitions on the tables as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import recall
from ..sources.views import Tables
from ..streaming import jobs
from . import registry as R
from .memory_queries import r6
from .registry import query


@query("""SELECT user_id, min(ts) AS started, CAST(count(*) AS BIGINT) AS n, string_agg(id, ',' ORDER BY ts, id) AS dialogue FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS s FROM
 (SELECT 'e' || event_id AS id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM m_hits)) GROUP BY user_id, s""")
def t4_sessions(t: Tables) -> DataFrame:
    rows = t.hits.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), "user_id", "ts")
    return jobs.sessions(rows).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n", F.array_join("dialogue_ids", ",").alias("dialogue"))


@query("SELECT date_trunc('hour', ts) AS since, memory_id AS id, count(*) AS hits FROM m_hits GROUP BY 1, 2")
def t2_hit_counts(t: Tables) -> DataFrame:
    return jobs.hit_counts(t.hits).withColumn("since", F.col("since").cast("timestamp_ntz"))


_ARRIVALS = f"""mem AS (SELECT m.id, m.user_id, m.salience, m.last_seen_at, v.v FROM m_memories m JOIN m_vectors v ON v.id = m.id WHERE CAST(substr(m.id, 2) AS BIGINT) % 3 > 0), new AS (SELECT id || '+' AS id, user_id, v, TIMESTAMP '2024-02-01' + to_minutes((CAST(substr(id, 2) AS BIGINT) % 7)::INT) AS at FROM m_vectors),
 top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY salience DESC, last_seen_at DESC, id) AS r FROM mem), hit AS (SELECT n.id, arg_min(s.id, (-{R.sql_cosine('n.v', 's.v')}, s.id)) AS best_id FROM new n JOIN top s ON s.user_id = n.user_id AND s.r <= 100 AND {R.sql_cosine('n.v', 's.v')} >= 0.95 GROUP BY 1),
 fresh AS MATERIALIZED (SELECT * FROM new ANTI JOIN hit USING (id)), step AS MATERIALIZED (SELECT a.id, arg_min(b.id, (-{R.sql_cosine('a.v', 'b.v')}, b.id)) AS before FROM fresh a JOIN fresh b ON a.user_id = b.user_id AND (b.at, b.id) < (a.at, a.id) AND {R.sql_cosine('a.v', 'b.v')} >= 0.95 GROUP BY 1),
 follow(id, first_id) AS (SELECT id, before FROM step UNION ALL SELECT f.id, s.before FROM follow f JOIN step s ON s.id = f.first_id), firsts AS (SELECT id, first_id FROM follow WHERE first_id NOT IN (SELECT id FROM step)),
 ins AS MATERIALIZED (SELECT * FROM fresh ANTI JOIN step USING (id)), recent AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at DESC, id) AS r FROM mem),
 sims AS (SELECT n.id, r.id AS dst_id, {R.sql_cosine('n.v', 'r.v')} AS w FROM ins n JOIN recent r ON r.user_id = n.user_id AND r.r <= 1000 UNION ALL SELECT n.id, o.id, {R.sql_cosine('n.v', 'o.v')} FROM ins n JOIN ins o ON o.user_id = n.user_id AND (o.at, o.id) < (n.at, n.id)),
 way AS (SELECT id, arg_min(dst_id, (-w, dst_id)) AS dst_id FROM sims WHERE w > 0 GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_ARRIVALS} SELECT 'insert' AS kind, id AS a, user_id AS b FROM ins UNION ALL SELECT 'boost', id, CAST(count(*) AS VARCHAR) FROM (SELECT best_id AS id FROM hit UNION ALL SELECT first_id FROM firsts) GROUP BY 2 UNION ALL SELECT 'waypoint', ins.id, coalesce(dst_id, ins.id) FROM ins LEFT JOIN way ON way.id = ins.id""")
def t1_ingest_batch(t: Tables) -> DataFrame:
    """All vectors come as new rows; two of three memories are stored already."""
    k = F.substring("id", 2, 18).cast("long")
    memories = t.memories.where(k % 3 > 0).withColumn("created_at", F.col("last_seen_at"))
    at = F.timestamp_add("MINUTE", (k % 7).cast("int"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    new = t.vectors.select(F.concat("id", F.lit("+")).alias("id"), "user_id", "v", at.alias("created_at"))
    inserts, boosts, waypoints = jobs.ingest_batch(new, memories, t.vectors)
    out = inserts.select(F.lit("insert").alias("kind"), F.col("id").alias("a"), F.col("user_id").alias("b"))
    return out.union(boosts.select(F.lit("boost"), "id", F.col("n").cast("string"))).union(waypoints.select(F.lit("waypoint"), "src_id", "dst_id"))


@query()
def t3_decay_job(t: Tables) -> DataFrame:
    """A sample of each segment, drawn by a hash that SQL does not have."""
    rows = t.memories.withColumn("segment", (F.substring("id", 2, 18).cast("long") / 100).cast("int"))
    after, _, _ = jobs.decay_job(rows, t.vectors, t.as_of)
    return after.select("id", r6(F.col("salience"), "salience"))


_OPEN = "open AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at, id) AS r, count(*) OVER (PARTITION BY user_id) AS total FROM m_memories WHERE feedback_score % 2 = 1 AND user_id IN (SELECT id FROM m_users WHERE status = 1))"


@query(f"WITH {_OPEN} SELECT id, feedback_score % 2 = 0 OR id IN (SELECT id FROM open WHERE total >= 10 AND last_seen_at < TIMESTAMP '2024-01-31 23:59:59') AS session_joined FROM m_memories")
def t3_session_job(t: Tables) -> DataFrame:
    memories = t.memories.withColumns({"created_at": F.col("last_seen_at"), "session_joined": F.col("feedback_score") % 2 == 0})
    return jobs.session_job(memories, t.users, t.as_of, F.format_string("%d memories", F.size("dialogue_ids")))[1].select("id", "session_joined")


@query(f"WITH {_OPEN.replace('% 2 = 1', '> 0')} SELECT 'f:' || user_id || ':' || id || ':0' AS fact_id, user_id, 'e' || substr(sha256(user_id || '|OTHER|' || 'name' || tags[2]), 1, 24) AS canonical_id FROM open WHERE total >= 30 AND r <= 100 AND tags[2] IS NOT NULL AND regexp_full_match(tags[2], '[a-z0-9]+')")
def t3_graph_job(t: Tables) -> DataFrame:
    """A stand-in model finds one fact a memory, with its source as the entity; no two of these have like vectors."""
    memories = t.memories.withColumns({"created_at": F.col("last_seen_at"), "fact_joined": F.col("feedback_score") == 0})

    def extract(batch: DataFrame) -> DataFrame:
        entity = F.struct(F.concat(F.lit("name "), F.get("tags", F.lit(1))).alias("text"), F.lit("OTHER").alias("entity_type"))
        fact = F.struct(F.lit("said").alias("what"), F.array(entity).alias("entities"))
        named = batch.where(F.get("tags", F.lit(1)).rlike("^[a-z0-9]+$"))
        return named.select(F.col("user_id").alias("topic_id"), "user_id", F.col("id").alias("memory_id"), F.array(fact).alias("facts"))

    def vectorise(mentions: DataFrame) -> DataFrame:
        h = F.xxhash64("text")
        unit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.pmod(F.xxhash64(h, i), F.lit(201)) - 100).cast("double"))
        return mentions.withColumn("v", unit)

    none = t.vectors.limit(0).select("id", "user_id", F.lit("").alias("name"), F.lit("OTHER").alias("entity_type"), "v")
    return jobs.graph_job(memories, t.users, extract, none, vectorise)["links"]


@query("""WITH w AS (SELECT user_id, tags[2] AS name, feedback_score % 2 = 1 AS new, max(salience) AS weight FROM m_memories GROUP BY 1, 2, 3), n AS (SELECT DISTINCT user_id FROM m_memories WHERE feedback_score % 2 = 1 AND user_id IN (SELECT id FROM m_users WHERE status = 1))
 SELECT user_id, name, coalesce(max(weight) FILTER (new), max(weight)) AS weight FROM w JOIN n USING (user_id) GROUP BY 1, 2 HAVING coalesce(max(weight) FILTER (new), max(weight)) >= 0.5""")
def t3_profile_job(t: Tables) -> DataFrame:
    """Profiles of tags: what is pending is merged into what is active."""

    def extract(rows: DataFrame) -> DataFrame:
        tags = rows.groupBy("user_id", F.get("tags", F.lit(1)).alias("name")).agg(F.max("salience").alias("weight"))
        top = recall.ranked(tags, ["user_id"], F.desc("weight"), "name").where(F.col("rank") <= 50)
        return top.groupBy("user_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("name", "weight"))).alias("tags"))).alias("profile"))

    memories = t.memories.withColumns({"created_at": F.col("last_seen_at"), "profile_joined": F.col("feedback_score") % 2 == 0})
    old = extract(memories.where("profile_joined")).select(F.concat(F.lit("p"), "user_id").alias("id"), "user_id", "profile", F.lit(True).alias("is_active"), t.as_of.alias("updated_at"))
    merged, _ = jobs.profile_job(memories, t.users, old, t.as_of, extract)
    return merged.select("user_id", F.inline(F.from_json("profile", "tags array<struct<name:string,weight:double>>")["tags"]))
