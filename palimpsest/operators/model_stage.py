"""Stages around a model: batches of rows in, rows out, failures kept.

The model is a function the caller gives; each stage has a default without one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import SECTORS
from ..functions.scoring import clamp
from ..storage import bounded_batches

Fn = Callable[[pd.DataFrame], pd.DataFrame]


def model_stage(df: DataFrame, fn: Fn, schema: str, on_error: str = "keep") -> DataFrame:
    """Run ``fn`` on batches. It returns one row for each, in order, with the columns of ``schema``.

    Added are these columns, status and error. A batch that fails is tried row by
    row, and leaves as one batch again; rows that fail have nulls and their error, or are dropped (``drop``), or
    stop the job (``raise``).
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    full = df.limit(0).selectExpr("*", *[f"CAST(NULL AS {c.strip().split(None, 1)[1]}) AS {c.strip().split()[0]}" for c in schema.split(",")], "CAST(NULL AS STRING) AS status", "CAST(NULL AS STRING) AS error").schema

    def given(rows: pd.DataFrame) -> pd.DataFrame:
        got = fn(rows)
        if len(got) != len(rows):
            raise ValueError("the model gave another number of rows")
        return got if list(got.columns) == names else got[names]

    def tried(b: pd.DataFrame) -> pd.DataFrame | None:
        """The rows of a batch that failed one by one; what they give is put together once."""
        got, at, errors = [], [], []
        for i in range(len(b)):
            try:
                got.append(given(b.iloc[i : i + 1]))
                at.append(i)
                errors.append(None)
            except Exception as e:
                errors.append(f"{type(e).__name__}: {e}")
        if on_error == "drop":
            if not got:
                return None
            return pd.concat([b.iloc[at].reset_index(drop=True), pd.concat(got, ignore_index=True)], axis=1).assign(status="completed", error=None)
        values = pd.concat(got, ignore_index=True).set_axis(at) if got else pd.DataFrame(columns=names, dtype=object)
        # Numbers and truth values beside nulls stay what they are as objects; as floats, long ones would not.
        values = values.astype({c: object for c in names if values[c].dtype.kind in "iub"}).reindex(range(len(b)))
        failed = ~values.index.isin(at)
        for c in names:
            if values[c].dtype == object:
                values[c] = values[c].mask(failed, None)
        status = pd.Series("completed", values.index, dtype=object).mask(failed, "failed")
        return pd.concat([b.reset_index(drop=True), values], axis=1).assign(status=status, error=pd.Series(errors, dtype=object))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield pd.concat([b.reset_index(drop=True), given(b).reset_index(drop=True)], axis=1).assign(status="completed", error=None)
            except Exception:
                if on_error == "raise":
                    raise
                if (rows := tried(b)) is not None:
                    yield rows

    bounded_batches(df.sparkSession)
    return df.mapInPandas(run, full)


def observed(df: DataFrame, name: str = "stage") -> tuple[DataFrame, Observation]:
    """The stage's rows, and counts of them by status that are there once an action has run over the rows."""
    seen = Observation(name)
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s)
    return df.observe(seen, F.count(F.lit(1)).alias("n"), count("completed"), count("failed")), seen


def classify(scores: Column, forced: Column | None = None) -> Column:
    """From sector scores (0 to 100, an array in the order of SECTORS) a struct: primary, additional, confidence.

    The best sector is primary, or semantic with confidence 0.3 if it scores under
    20; others count from 30, and from 40 % of the best. Confidence comes from the
    lead over the second. A forced sector is primary whatever it scores.
    """
    pairs = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    name = lambda e: F.element_at(F.array(*map(F.lit, SECTORS)), e["i"] + 1)
    top, second = -F.element_at(pairs, 1)["s"], -F.element_at(pairs, 2)["s"]
    more = F.transform(F.filter(F.slice(pairs, 2, len(SECTORS)), lambda e: -e["s"] >= F.greatest(F.lit(30.0), top * 0.4)), name)
    weak = top < 20
    primary = F.when(weak, "semantic").otherwise(name(F.element_at(pairs, 1)))
    sure = F.when(top <= 0, 0.2).when(weak, 0.3).otherwise(F.round(F.least(F.lit(1.0), (top - second) / 100.0 + 0.5), 2))
    if forced is not None:
        known = forced.isin(*SECTORS)
        primary, sure = F.when(known, forced).otherwise(primary), F.when(known, 1.0).otherwise(sure)
    return F.struct(primary.alias("primary"), F.array_except(more, F.array(primary)).alias("additional"), clamp(sure).alias("confidence"))


def split_topics(conversations: DataFrame) -> DataFrame:
    """The default topic split: one topic for each conversation, with its turns in order."""
    return conversations.groupBy("user_id", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id"))).alias("d")).select(F.concat(F.lit("topic:"), F.col("conv_id").cast("string")).alias("id"), "user_id", F.transform("d", lambda x: x["id"]).alias("dialogue_ids"))


def accepted_topics(topics: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics a model gave (id, user_id, dialogue_ids) with the memories that the user has, and the ids that they do not."""
    flat = topics.select("id", "user_id", F.posexplode("dialogue_ids").alias("place", "memory_id"))
    own = memories.select(F.col("id").alias("memory_id"), "user_id")
    good = flat.join(own, ["memory_id", "user_id"], "left_semi").groupBy("id", "user_id").agg(F.array_sort(F.collect_list(F.struct("place", "memory_id"))).alias("d"))
    return good.select("id", "user_id", F.transform("d", lambda x: x["memory_id"]).alias("dialogue_ids")), flat.join(own, ["memory_id", "user_id"], "left_anti")


def mentions(memories: DataFrame, text: str = "content") -> DataFrame:
    """The default fact extraction: capitalised words that do not begin a sentence, as mentions of entities."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<=[a-z,] )[A-Z][a-z]+"), 0))
    return memories.select("id", "user_id", F.explode(found).alias("text")).withColumn("entity_type", F.lit("OTHER"))


def flatten_facts(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and entity mentions of what a model found in the memories of topics (topic_id, user_id, memory_id, facts).

    ``facts`` is an array of structs (what, fact_kind, confidence, entities; more
    fields may follow), ``entities`` an array of structs (text, entity_type).
    Facts: id, user_id, topic_id and the fields. Mentions: fact_id, user_id, text,
    entity_type and the place in the fact; those without text go.
    """
    rows = extracted.select("topic_id", "user_id", "memory_id", F.posexplode("facts").alias("at", "f"))
    rows = rows.withColumn("id", F.concat_ws(":", F.lit("f"), "topic_id", "memory_id", F.col("at").cast("string")))
    facts = rows.select("id", "user_id", "topic_id", "memory_id", "f.*").drop("entities")
    mentioned = rows.select(F.col("id").alias("fact_id"), "user_id", F.posexplode("f.entities").alias("place", "e"))
    return facts, mentioned.select("fact_id", "user_id", "e.text", "e.entity_type", "place").where(F.coalesce(F.trim("text"), F.lit("")) != "")


def accepted_sentences(rows: DataFrame) -> DataFrame:
    """Sentences a model gave for a sector (sector, found, text) that are not empty and that a classifier found in it."""
    return rows.where((F.coalesce(F.trim("text"), F.lit("")) != "") & (F.col("found") == F.col("sector")))


def accept_relations(pairs: DataFrame, gate: int = 50, least: float = 0.7) -> DataFrame:
    """Relations of pairs after rules and a model (rule, model_relation, model_confidence): rule, else a sure model, else co-occurrence.

    Facts with more than ``gate`` pairs are not given to a model.
    """
    from pyspark.sql import Window

    few = F.count(F.lit(1)).over(Window.partitionBy("fact_id")) <= gate
    sure = few & (F.col("model_confidence") >= least) & F.col("model_relation").isNotNull()
    row = pairs.withColumn("sure", F.coalesce(sure, F.lit(False)))
    return row.withColumns({"edge_relation": F.when(F.col("rule").isNotNull(), F.col("rule")).when(F.col("sure"), F.col("model_relation")).otherwise("CO_OCCURS_WITH"), "inference_source": F.when(F.col("rule").isNotNull(), "RULE").when(F.col("sure"), "LLM").otherwise("FALLBACK"), "confidence": F.when(F.col("rule").isNull(), F.col("model_confidence"))}).drop("sure")


def one_session_each(rows: DataFrame) -> DataFrame:
    """Sessions a model gave (session_id, user_id, started, id): each memory stays in the first only."""
    from .recall import ranked

    return ranked(rows, ["user_id", "id"], "started", "session_id").where("rank = 1").drop("rank")


def profile_hints(memories: DataFrame) -> DataFrame:
    """The default profile extraction: a user's tags by their share of the memories."""
    n = memories.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    tags = memories.select("user_id", F.explode("tags").alias("tag")).groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("k"))
    return tags.join(n, "user_id").select("user_id", "tag", (F.col("k") / F.col("n")).alias("weight"))


def kept_on_failure(df: DataFrame, original: str, result: str) -> Column:
    """The result of a stage, and the original where it failed or gave nothing."""
    return F.coalesce(F.when(F.col("status") == "completed", F.nullif(F.trim(result), F.lit(""))), F.col(original))
