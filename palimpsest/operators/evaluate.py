"""Labelled sets, retrieval and classifier metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SECTORS
from ..functions import text as T
from ..functions.embedding import Embed, embedded, hash_embed
from ..functions.scoring import penalty
from ..functions.vectors import cosine
from .model_stage import classify
from .recall import BROADCAST_BYTES, ranked


def read_labelled(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """Labelled texts from csv, json (an array), jsonl, parquet or arrow (IPC files or streams, which need a ``schema``); ``split`` is the file's name without its ending."""
    if fmt == "csv":
        df = spark.read.csv(path, header=True, schema=schema)
    elif fmt in ("json", "jsonl"):
        df = spark.read.json(path, multiLine=fmt == "json", schema=schema)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "arrow":
        if schema is None:
            raise ValueError("Arrow files need a schema")
        split = _split(F.col("path")).alias("split")
        return spark.read.format("binaryFile").load(path).select("content", split).mapInArrow(_arrow_rows, f"{schema}, split string")
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return df.withColumn("split", _split(F.input_file_name()))


def _split(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)\.[^./]+$", 1)


def _arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for files in batches:
        for content, split in zip(files["content"], files["split"], strict=True):
            data = pa.py_buffer(content.as_py())
            reader = pa.ipc.open_file(data) if bytes(data[:6]) == b"ARROW1" else pa.ipc.open_stream(data)
            found = (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "get_batch") else reader
            for rows in found:
                yield rows.append_column("split", pa.array([split.as_py()] * len(rows), pa.string()))


def read_eval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Memories and queries of a JSON file; every gold id must be a memory's."""
    df = spark.read.json(path, multiLine=True)
    memories = df.select(F.explode("memories").alias("m")).select("m.*")
    queries = df.select(F.explode("queries").alias("q")).select("q.*")
    lost = queries.select(F.explode("gold_ids").alias("id")).join(memories.select("id"), "id", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"gold ids without a memory: {sorted(r['id'] for r in lost)}")
    return memories, queries


def retrieval_metrics(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall@k (any gold id found) and mean reciprocal rank over all queries of ``gold`` (query_id, id); ``results``: query_id, id, rank."""
    first = gold.join(results, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    return first.agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks], F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("mrr"))


def evaluate(memories: DataFrame, queries: DataFrame, embedders: dict[str, Embed] | None = None, top_k: int = 10) -> DataFrame:
    """Retrieval metrics for each embedder over a labelled set (id, text, sector; queries with gold_ids).

    The set is given to be compared with whole, so each memory meets all queries. Queries are
    broadcast behind a check of their size; beyond it, both sides are dealt over ``parts`` keys.
    """
    n, size = queries.select(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-(n * 4096 + (size or 0)) // BROADCAST_BYTES))
    out = None
    for name, embed in (embedders or {"hash": hash_embed}).items():
        m = memories.select("id", F.col("sector").alias("memory_sector"), embedded(T.sector_text(F.col("sector"), F.col("text")), embed).alias("v"))
        q = queries.select(F.col("id").alias("query_id"), F.col("sector").alias("query_sector"), embedded(T.sector_text(F.col("sector"), F.col("text")), embed).alias("qv"))
        # Each part of the queries meets all memories.
        m = m.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        q = q.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        scored = m.join(F.broadcast(q) if parts == 1 else q, "part").select("query_id", "id", (cosine(F.col("v"), F.col("qv")) * penalty(F.col("query_sector"), F.col("memory_sector"))).alias("score"))
        results = ranked(scored, ["query_id"], F.desc("score"), "id").where(F.col("rank") <= top_k)
        gold = queries.select(F.col("id").alias("query_id"), F.explode("gold_ids").alias("id"))
        part = retrieval_metrics(results, gold).withColumn("backend", F.lit(name))
        out = part if out is None else out.union(part)
    return out


def write_eval(metrics: DataFrame, path: str) -> None:
    """A report of few rows: JSON lines, and a markdown table in ``report.md``; Spark writes both, wherever ``path`` is."""
    rows = metrics.coalesce(1)
    rows.write.mode("overwrite").json(f"{path}/json")
    cells = F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in metrics.columns]), " | "), F.lit(" |"))
    head = metrics.sparkSession.createDataFrame([(0, f"| {' | '.join(metrics.columns)} |"), (1, f"|{'---|' * len(metrics.columns)}")], "place int, value string")
    table = head.union(rows.select(F.lit(2), cells)).coalesce(1).sortWithinPartitions("place")
    table.select("value").write.mode("overwrite").text(f"{path}/report.md")


def branch_metrics(df: DataFrame) -> DataFrame:
    """Accuracy of the primary sector, share of rows with all labels right, and accuracy of each label (primary, primary_pred; labels, labels_pred as arrays)."""
    hit = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.agg(F.count(F.lit(1)).alias("n"), hit(F.col("primary") == F.col("primary_pred")).alias("accuracy"), hit(F.col("labels") == F.col("labels_pred")).alias("exact_match"), *[hit(F.get("labels", F.lit(i)) == F.get("labels_pred", F.lit(i))).alias(f"{s}_accuracy") for i, s in enumerate(SECTORS)])


def label_texts(df: DataFrame) -> DataFrame:
    """Label distinct texts (place, text, scores): sector, further sectors and a 0/1 vector of all, in order of sector and place."""
    first = ranked(df, ["text"], "place").where("rank = 1").drop("rank").withColumn("c", classify(F.col("scores")))
    sectors = F.concat(F.array("c.primary"), F.col("c.additional"))
    order = F.array_position(F.array(*map(F.lit, SECTORS)), F.col("primary"))
    out = first.select("place", "text", F.coalesce("c.primary", F.lit("semantic")).alias("primary"), T.multi_hot(sectors, SECTORS).alias("labels"))
    return out.orderBy(order, "place")


#: What the losses of the primary sector and of the labels weigh together, and iterations that are tried one after the other.
LOSS_WEIGHTS, ITERATIONS = (0.7, 0.3), (10, 20, 40)


def fit_sectors(df: DataFrame, features: int = 1 << 14, weights: tuple[float, float] = LOSS_WEIGHTS, validation: float = 0.1, iterations: tuple[int, ...] = ITERATIONS, patience: int = 1):
    """A classifier of labelled texts (text, primary as 0 to 4, labels as an array of 5): one model of the primary sector and one for each label.

    A share of the texts, chosen by hash, is held out. The models are fitted with more and more
    iterations while the weighted loss of both branches on the held-out texts falls; after ``patience``
    steps without a lower one the best are taken. Without held-out rows the most iterations are.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF

    held = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(10_000)) < int(validation * 10_000)
    rows = df.withColumn("tokens", T.canonical_tokens(F.col("text"))).withColumn("label", F.col("primary").cast("double")).withColumn("held", held)
    prepare = Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features")]).fit(rows.where("NOT held"))
    x = prepare.transform(rows).select("features", "label", "labels", "held").persist()
    train, valid = x.where("NOT held"), x.where("held")
    best, least, worse = None, None, 0
    steps = iterations if not valid.isEmpty() else iterations[-1:]
    for most in steps:
        primary = LogisticRegression(maxIter=most, family="multinomial").fit(train)
        branches = [LogisticRegression(maxIter=most).fit(train.withColumn("label", F.get("labels", F.lit(i)).cast("double"))) for i in range(len(SECTORS))]
        model = prepare, primary, branches
        loss = weighted_loss(_shares(model, valid), weights).first()["loss"] if len(steps) > 1 else None
        if best is None or loss < least:
            best, least, worse = model, loss, 0
        elif (worse := worse + 1) >= patience:
            break
    x.unpersist()
    return best


def weighted_loss(scored: DataFrame, weights: tuple[float, float] = LOSS_WEIGHTS) -> DataFrame:
    """The mean log losses of both branches and their weighted sum (label, shares; labels, probabilities)."""
    log = lambda p: -F.log(F.greatest(p, F.lit(1e-12)))
    primary = log(F.coalesce(F.get("shares", F.col("label").cast("int")), F.lit(0.0)))
    each = F.zip_with("labels", "probabilities", lambda y, p: log(F.when(y == 1, p).otherwise(1 - p)))
    rows = scored.select(primary.alias("p"), (F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size("labels")).alias("b"))
    return rows.agg(F.avg("p").alias("primary_loss"), F.avg("b").alias("label_loss")).withColumn("loss", weights[0] * F.col("primary_loss") + weights[1] * F.col("label_loss"))


def _shares(model, x: DataFrame) -> DataFrame:
    """Add shares (of each primary sector) and probabilities (of each label) to rows with ``features``.

    The models are applied to batches as one matrix. (Chains of their own UDFs in
    one stage cannot always be sent to tasks.)
    """
    _, primary, branches = model
    of_sector, of_label = primary.coefficientMatrix.toArray(), np.stack([b.coefficients.toArray() for b in branches])
    sector_base, label_base = primary.interceptVector.toArray(), np.array([b.intercept for b in branches])

    @F.pandas_udf("shares array<double>, probabilities array<double>")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for vectors in batches:  # the parts of sparse vectors
            rows = []
            for at, values in zip(vectors["indices"], vectors["values"], strict=True):
                margin = of_sector[:, at] @ values + sector_base
                share = np.exp(margin - margin.max())
                p = 1 / (1 + np.exp(-(of_label[:, at] @ values + label_base)))
                rows.append(((share / share.sum()).tolist(), p.tolist()))
            yield pd.DataFrame(rows, columns=["shares", "probabilities"])

    return x.withColumn("predicted", predict("features")).select(*x.columns, "predicted.*")


def score_sectors(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add primary_pred, confidence, probabilities and labels_pred; the primary sector's label is always set."""
    x = model[0].transform(df.withColumn("tokens", T.canonical_tokens(F.col("text"))))
    confidence = F.array_max("shares")
    scored = _shares(model, x.select(*df.columns, "features")).withColumns({"confidence": confidence, "primary_pred": (F.array_position("shares", confidence) - 1).cast("int")})
    labels = F.transform("probabilities", lambda p, i: ((p >= threshold) | (i == F.col("primary_pred"))).cast("int"))
    return scored.select(*df.columns, "primary_pred", "confidence", "probabilities", labels.alias("labels_pred"))
