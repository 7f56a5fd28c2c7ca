"""Memory tables as views over the star schema and text tables.

Each view is given once as DataFrame code and once as SQL (``SQL_VIEWS``), which
the registered queries' SQL is built on.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SECTORS

AS_OF = "2024-02-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer partitions than there are cores, dealt over the cores; larger ones stay as they are.

    For tables of texts, which take much work a byte.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def sector(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SECTORS)), (k % 5 + 1).cast("int"))


def _id(letter: str, column: str) -> Column:
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def _user(column: str) -> Column:
    return F.concat(F.lit("u"), (F.col(column) % 20).cast("string"))


class Tables:
    """The tables of a folder and the views over them, made when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of = F.lit(AS_OF).cast("timestamp_ntz")

    def raw(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    @cached_property
    def documents(self) -> DataFrame:
        """For work on whole texts."""
        return spread(self.raw("documents"))

    @cached_property
    def users(self) -> DataFrame:
        c, n = self.raw("customer"), self.raw("nation")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            _id("u", "c_custkey").alias("id"), F.col("n_name").alias("tenant_key"), F.col("c_mktsegment").alias("project_key"), F.col("c_name").alias("user_key"), F.when(F.col("c_custkey") % 10 == 9, 0).otherwise(1).alias("status")
        )

    @cached_property
    def memories(self) -> DataFrame:
        return self._memories(self.raw("documents"))

    @cached_property
    def texts(self) -> DataFrame:
        """The memories, for work on their whole contents."""
        return self._memories(self.documents)

    @staticmethod
    def _memories(documents: DataFrame) -> DataFrame:
        hours = F.make_dt_interval(hours=(F.col("doc_id") % 720).cast("int"))
        return documents.select(
            _id("d", "doc_id").alias("id"),
            _user("doc_id").alias("user_id"),
            F.lit(None).cast("string").alias("role"),
            F.col("text").alias("content"),
            sector(F.col("doc_id")).alias("primary_sector"),
            F.array("lang", "source").alias("tags"),
            (F.col("doc_id") * 37 % 100 / F.lit(100.0)).alias("salience"),
            (F.col("doc_id") % 9).alias("feedback_score"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + hours).alias("last_seen_at"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        t = self.raw("conversations").where(F.col("role").isin("user", "assistant"))
        return t.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), _user("conv_id").alias("user_id"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("role"), "conv_id", "turn", F.col("text").alias("content"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(_id("d", "vec_id").alias("id"), sector(F.col("label")).alias("sector"), _user("vec_id").alias("user_id"), F.col("embedding").alias("v"), F.lit(64).alias("dim"))

    @cached_property
    def topics(self) -> DataFrame:
        def memory(k: Column) -> Column:
            return F.concat(F.lit("d"), (F.col("o_custkey") % 20 + k % 10 * 20).cast("string"))

        key = F.col("o_orderkey")
        return self.raw("orders").select(_id("t", "o_orderkey").alias("id"), _user("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name"), F.array(memory(key), memory(key * 7 + 3)).alias("dialogue_ids"), F.col("o_orderdate").alias("updated_at"))

    @cached_property
    def _lines(self) -> DataFrame:
        l, o = self.raw("lineitem"), self.raw("orders")
        return l.join(o, l.l_orderkey == o.o_orderkey)

    @cached_property
    def facts(self) -> DataFrame:
        status = F.col("l_linestatus")  # its maximum, as booleans: aggregates of numbers need no sort
        g = self._lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("d"), F.max(status == "O").alias("open"), F.max(status > "O").alias("later"), F.min("l_shipdate").alias("occurred_start"), F.min("o_custkey").alias("o_custkey"))
        return g.select(_fact_id().alias("id"), _id("t", "l_orderkey").alias("topic_id"), _user("o_custkey").alias("user_id"), (F.col("d") * 10).alias("confidence"), F.when(F.col("open") & ~F.col("later"), "event").otherwise("conversation").alias("fact_kind"), "occurred_start")

    @cached_property
    def canonical(self) -> DataFrame:
        of = (("part", "p", "p_partkey", "p_name", "PRODUCT"), ("supplier", "s", "s_suppkey", "s_name", "ORGANIZATION"), ("nation", "n", "n_nationkey", "n_name", "LOCATION"))
        parts = [self.raw(t).select(_id(a, k).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("entity_type")) for t, a, k, n, kind in of]
        return parts[0].union(parts[1]).union(parts[2])

    @cached_property
    def entity_links(self) -> DataFrame:
        """Entities that facts name, each as often as it is named."""
        return self.raw("lineitem").select(_fact_id().alias("fact_id"), F.explode(F.array(_id("p", "l_partkey"), _id("s", "l_suppkey"))).alias("canonical_id"))

    @cached_property
    def fact_entities(self) -> DataFrame:
        return self.entity_links.distinct()

    @cached_property
    def relations(self) -> DataFrame:
        kind = (F.col("l_partkey") + F.col("l_suppkey")) % 4
        g = self._lines.groupBy((F.col("o_custkey") % 20).alias("u"), "l_partkey", "l_suppkey").agg(F.max("l_discount").alias("d"), F.count(F.lit(1)).alias("n_facts"))
        return g.select(
            _id("u", "u").alias("user_id"),
            _id("p", "l_partkey").alias("source"),
            _id("s", "l_suppkey").alias("target"),
            F.when(kind == 0, "CAUSES").when(kind == 1, "PRECEDES").when(kind == 2, "PART_OF").otherwise("CO_OCCURS_WITH").alias("edge_relation"),
            F.when(kind != 1, F.col("d") * 10).alias("confidence"),
            "n_facts",
        )

    @cached_property
    def hits(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type").isin("view", "click"))
        return e.select("event_id", _user("user_id").alias("user_id"), F.concat(F.lit("d"), (F.col("user_id") + F.col("event_id") % 2 * 20).cast("string")).alias("memory_id"), "ts")

    @cached_property
    def queries(self) -> DataFrame:
        item = F.col("item_id")
        return self.raw("benchmark").select(_id("q", "item_id").alias("query_id"), _user("item_id").alias("user_id"), "text", sector(item).alias("primary_sector"), F.lit(5).alias("top_k"), F.concat(F.lit("d"), (item * 7 % 500).cast("string")).alias("probe_vec"))

    @cached_property
    def probes(self) -> DataFrame:
        """Queries with the vector they ask with, the same for each sector."""
        return self.queries.join(self.vectors.select(F.col("id").alias("probe_vec"), F.col("v").alias("qv")), "probe_vec")


def _fact_id() -> Column:
    return F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))


def sql_sector(k: str) -> str:
    return f"['episodic','semantic','procedural','emotional','reflective'][({k}) % 5 + 1]"


SQL_VIEWS = {
    "m_users": "SELECT 'u' || c_custkey AS id, n_name AS tenant_key, c_mktsegment AS project_key, c_name AS user_key, CASE WHEN c_custkey % 10 = 9 THEN 0 ELSE 1 END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "m_memories": f"SELECT 'd' || doc_id AS id, 'u' || doc_id % 20 AS user_id, CAST(NULL AS VARCHAR) AS role, text AS content, {sql_sector('doc_id')} AS primary_sector, [lang, source] AS tags, (doc_id * 37 % 100) / 100.0::DOUBLE AS salience, doc_id % 9 AS feedback_score, TIMESTAMP '2024-01-01' + to_hours((doc_id % 720)::INT) AS last_seen_at FROM documents",
    "m_turns": "SELECT 'c' || conv_id || '-' || turn AS id, 'u' || conv_id % 20 AS user_id, CASE role WHEN 'user' THEN 'human' ELSE role END AS role, conv_id, turn, text AS content FROM conversations WHERE role IN ('user', 'assistant')",
    "m_vectors": f"SELECT 'd' || vec_id AS id, {sql_sector('label')} AS sector, 'u' || vec_id % 20 AS user_id, embedding AS v, 64 AS dim FROM embeddings",
    "m_topics": "SELECT 't' || o_orderkey AS id, 'u' || o_custkey % 20 AS user_id, o_orderpriority AS name, ['d' || (o_custkey % 20 + 20 * (o_orderkey % 10)), 'd' || (o_custkey % 20 + 20 * ((o_orderkey * 7 + 3) % 10))] AS dialogue_ids, o_orderdate AS updated_at FROM orders",
    "m_facts": "SELECT 'f' || l_orderkey || '-' || l_linenumber AS id, 't' || l_orderkey AS topic_id, 'u' || min(o_custkey) % 20 AS user_id, max(l_discount) * 10 AS confidence, CASE WHEN max(l_linestatus) = 'O' THEN 'event' ELSE 'conversation' END AS fact_kind, min(l_shipdate) AS occurred_start FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber",
    "m_canonical": "SELECT 'p' || p_partkey AS id, p_name AS name, 'PRODUCT' AS entity_type FROM part UNION ALL SELECT 's' || s_suppkey, s_name, 'ORGANIZATION' FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name, 'LOCATION' FROM nation",
    "m_fact_entities": "SELECT 'f' || l_orderkey || '-' || l_linenumber AS fact_id, 'p' || l_partkey AS canonical_id FROM lineitem UNION SELECT 'f' || l_orderkey || '-' || l_linenumber, 's' || l_suppkey FROM lineitem",
    "m_relations": "SELECT 'u' || o_custkey % 20 AS user_id, 'p' || l_partkey AS source, 's' || l_suppkey AS target, ['CAUSES','PRECEDES','PART_OF','CO_OCCURS_WITH'][(l_partkey + l_suppkey) % 4 + 1] AS edge_relation, CASE WHEN (l_partkey + l_suppkey) % 4 <> 1 THEN max(l_discount) * 10 END AS confidence, count(*) AS n_facts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey % 20, l_partkey, l_suppkey",
    "m_hits": "SELECT event_id, 'u' || user_id % 20 AS user_id, 'd' || (user_id + event_id % 2 * 20) AS memory_id, ts FROM events WHERE event_type IN ('view', 'click')",
    "m_queries": f"SELECT 'q' || item_id AS query_id, 'u' || item_id % 20 AS user_id, text, {sql_sector('item_id')} AS primary_sector, 5 AS top_k, 'd' || (item_id * 7 % 500) AS probe_vec FROM benchmark",
    "m_probes": "SELECT q.*, v.v AS qv FROM m_queries q JOIN m_vectors v ON v.id = q.probe_vec",
}


def with_views(sql: str) -> str:
    """Put the views that ``sql`` uses in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bm_[a-z_]+\b", text):
            if name in SQL_VIEWS and name not in needed:
                need(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    views = ",\n".join(f"{name} AS MATERIALIZED ({SQL_VIEWS[name]})" for name in needed)
    if not views:
        return sql
    sql = sql.strip()
    recursive = re.match(r"WITH RECURSIVE\s", sql, re.I)
    rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}" + (f",\n{rest}" if rest != sql else f"\n{sql}")
