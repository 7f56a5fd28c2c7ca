"""Quality by importance resampling.

Two generative models of hashed n-grams (tokens and pairs of tokens, in
``BUCKETS`` buckets) are counted: one over all documents, one over the target
documents, those labelled good and not toxic. A document's log importance weight is
the sum over its n-grams of the log ratio of the two. (``length`` gives instead that
of a stretch of so many n-grams like its own, whatever its length.) Adding
Gumbel noise and taking the k largest keys samples k documents without
replacement in proportion to their weights. The k-th key is found by counting
keys in buckets and refining the one it lies in; nothing is sorted.

The counts of all documents cover every row. The target model takes at most about
``MAX_TARGETS`` labelled rows, drawn by a hash of the id (the documented bound of
the labelled sample). The noise is a function of the id, so reruns agree.

Defined cases: a text that is null or has no token has weight 0 (ratio 1); rows
with equal ids have equal noise, null ids that of the empty id; keys equal to the
k-th are all taken; without target rows all weights are 0; an empty table gives an
empty result. Long texts are read whole, in slices. Other columns stay, and a column
of the output's name is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpointed, slices
from .mixing import hash_of

BUCKETS = 1 << 14
MAX_TARGETS = 20_000
#: Share of the documents that are sampled.
SHARE = 0.5
#: Keys are counted as whole numbers of this size, after a shift that makes them positive.
STEP, SHIFT = 1e-8, 4e9
KEY_BITS, LEVEL_BITS = 60, 12
CACHED_WORDS = 100_000

TOKEN = re.compile(r"\w+|[^\w\s]+")


class Tokens(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def buckets_of(texts: list[str], hashes: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of the texts, one after another, and how many each text has."""
    found = [TOKEN.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in found], dtype=np.int64)
    h = np.fromiter((x for w in found for x in map(hashes.__getitem__, w)), np.uint64, int(sizes.sum()))
    if len(hashes) > CACHED_WORDS:
        hashes.clear()
    owner = np.repeat(np.arange(len(texts)), sizes)
    inner = owner[1:] == owner[:-1]
    pairs = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inner] >> np.uint64(20)) % np.uint64(BUCKETS)
    both = np.concatenate([h % np.uint64(BUCKETS), pairs]).astype(np.int64)
    owners = np.concatenate([owner, owner[1:][inner]])
    order = np.argsort(owners, kind="stable")
    return both[order], np.bincount(owners, minlength=len(texts))


def gram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """n-grams by bucket over all rows; each task sends one row a bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, hashes = np.zeros(BUCKETS, np.int64), Tokens()
        for b in batches:
            for part in slices([t or "" for t in b[text]]):
                total += np.bincount(buckets_of(part, hashes)[0], minlength=BUCKETS)
        full = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": full.astype(np.int32), "n": total[full]})

    out = np.zeros(BUCKETS)
    for r in bounded(docs).select(text).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of each bucket."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    n = good.count()
    if n > MAX_TARGETS:
        good = good.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) < int(MAX_TARGETS / n * (1 << 30)))
    target = gram_counts(docs.join(F.broadcast(good), "doc_id", "left_semi"))
    if not target.sum():
        return np.zeros(BUCKETS)
    raw = gram_counts(docs)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def with_weights(docs: DataFrame, ratios: np.ndarray, text: str = "text", out: str = "weight", length: int | None = None) -> DataFrame:
    """Add a struct (n_grams, log_weight) to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("n_grams long, log_weight double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = Tokens()
        for s in batches:
            n, w = [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in slices([t or "" for t in s]):
                found, sizes = buckets_of(part, hashes)
                sums = np.bincount(np.repeat(np.arange(len(part)), sizes), shared.value[found], len(part))
                n.append(sizes)
                w.append(sums if length is None else length * sums / np.maximum(sizes, 1))
            yield pd.DataFrame({"n_grams": np.concatenate(n), "log_weight": np.concatenate(w)})

    return bounded(docs).withColumn(out, weigh(F.col(text)))


def gumbel(doc_id: Column) -> Column:
    uniform = (hash_of(doc_id).cast("double") + 0.5) / float(1 << 60)
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest value of the non-negative long column ``key``, by refining counts; the driver holds one level's buckets."""
    prefix, above = 0, 0
    for shift in range(KEY_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = keys.where(F.shiftright("key", shift + LEVEL_BITS) == prefix)
        for r in sorted(inside.groupBy(F.shiftright("key", shift).alias("b")).count().collect(), reverse=True):
            prefix = r["b"]
            if above + r["count"] >= k:
                break
            above += r["count"]
    return prefix


def importance_report(docs: DataFrame, labels: DataFrame, share: float = SHARE, length: int | None = None) -> DataFrame:
    """Per row: doc_id, n_grams, log_weight, gumbel_key, selected."""
    weighed = with_weights(docs.select("doc_id", "text"), fit(docs, labels), length=length)
    scored = weighed.select("doc_id", "weight.*").withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id")))
    scored = checkpointed(scored.withColumn("key", ((F.col("gumbel_key") + SHIFT) / STEP).cast("long")))
    k = round(share * scored.count())
    least = kth_largest(scored.select("key"), k) if k else 1 << 62
    return scored.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("key") >= least).alias("selected"))
