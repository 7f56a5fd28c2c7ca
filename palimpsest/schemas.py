"""Schemas of the memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "memories": "id string, user_id string, role string, pair_id string, content string, summary string, primary_sector string, sectors array<string>, tags array<string>, meta string, profile_joined boolean, session_joined boolean, fact_joined boolean, segment int, created_at timestamp_ntz, updated_at timestamp_ntz, last_seen_at timestamp_ntz, salience double, decay_lambda double, version int, mean_dim int, mean_vec array<float>, compressed_vec array<float>, feedback_score double",
    "vectors": "id string, sector string, user_id string, v array<float>, dim int",
    "waypoints": "src_id string, dst_id string, user_id string, weight double, created_at timestamp_ntz, updated_at timestamp_ntz",
    "users": "id string, tenant_key string, project_key string, user_key string, status int, encryption_key string, created_at timestamp_ntz",
    "sessions": "id string, user_id string, summary string, dialogue_ids array<string>, key_facts array<string>, v array<float>, created_at timestamp_ntz",
    "user_profiles": "id string, user_id string, profile string, is_active boolean, updated_at timestamp_ntz",
    "graph_topics": "id string, user_id string, name string, keywords array<string>, dialogue_ids array<string>, v array<float>, updated_at timestamp_ntz",
    "graph_facts": "id string, user_id string, topic_id string, fact_kind string, what string, who string, place string, why string, confidence double, occurred_start timestamp_ntz, occurred_end timestamp_ntz, v array<float>",
    "graph_canonical_entities": "id string, user_id string, name string, entity_type string, v array<float>, is_active boolean",
    "graph_entities": "id string, user_id string, fact_id string, text string, entity_type string, canonical_id string",
    "graph_fact_entities": "fact_id string, canonical_id string, user_id string, updated_at timestamp_ntz",
    "graph_relations": "user_id string, source string, target string, edge_relation string, confidence double, inference_source string, evidence array<string>, updated_at timestamp_ntz",
    "queries": "query_id string, user_id string, text string, primary_sector string, sectors array<string>, top_k int, min_salience double, query_mode string, vecs map<string, array<float>>",
}


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by its schema; columns that the files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
