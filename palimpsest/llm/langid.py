"""Language identification by word-first backoff.

The model holds, for each learned language, the log frequency of words and of
character n-grams of 5 letters down to 1. A known word scores by its own
frequencies; an unseen word by the longest order of n-grams of which it has a
known one. A text's score in a language is the sum over its words.

Learning takes labelled rows whose ``crc32(doc_id as text) mod 4`` is not 2: of each
language at most about ``max_docs`` of them, drawn by a hash of the id (the
documented bound of the training sample), and of each language the
``max_entries`` most frequent words and n-grams that are met ``min_count`` times.
All are parameters; None and 1 keep all. A language with few rows is learned beside one with most of them.
Prediction reads the text alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text if nothing was learned (an empty table, or none with a label). Ties
go to the first language by name. A row with a null id is neither learned from nor
held out; equal rows count and are judged each. Other columns stay, and a column of
the output's name is replaced by it. Texts are read whole, in slices.
"""

from __future__ import annotations

import copy
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, checkpointed, slices

#: Of each language: rows learned from, and words as well as n-grams kept.
MAX_DOCS, MAX_ENTRIES = 5_000, 15_000
#: A word or n-gram met less often is not known, unless ``fit`` is given another bound (1 keeps all).
MIN_COUNT = 2
#: Frequency of what a language does not have; the same for languages with few rows and with many.
FLOOR = 1e-7
ORDERS = (5, 4, 3, 2, 1)
#: Words counted for the score: the posterior of this many words like the text's mean word.
SCORE_WORDS = 12
#: Unseen words whose score a worker keeps; then they are forgotten.
CACHED_WORDS = 40_000
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    return [g for i in range(len(marked) - order + 1) if (g := marked[i : i + order]) not in "<>"]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Sparse:
    """Rows of (language, value), one row an entry; what a row does not name is 0. Grows by ``add``.

    Where a full table is not much larger, ``table`` (languages by rows) holds the same values and is what is added up.
    """

    #: Cells of the full table for each value, at most.
    FULL = 4

    def __init__(self, at: np.ndarray, lang: np.ndarray, value: np.ndarray, rows: int, langs: int) -> None:
        """``at``: the row of each value, in ascending order."""
        self.size = np.bincount(at, minlength=rows)
        self.start = np.cumsum(self.size) - self.size
        self.lang, self.value = lang.astype(np.int32), value.astype(np.float32)
        self.rows, self.used = rows, len(lang)
        self.table = None
        if langs * rows <= self.FULL * len(lang):
            self.table = np.zeros((langs, rows), np.float32)
            self.table[self.lang, at] = self.value

    def sums(self, ids: np.ndarray, groups: np.ndarray, n: int, langs: int) -> np.ndarray:
        """Rows ``ids`` added up by group: an array of n by langs."""
        if self.table is not None:
            return np.stack([np.bincount(groups, of_lang[ids], n) for of_lang in self.table], 1)
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + sizes, sizes)
        cell = np.repeat(groups, sizes) * langs + self.lang[at]
        return np.bincount(cell, self.value[at], n * langs).reshape(n, langs)

    def add(self, scores: np.ndarray) -> None:
        """Add rows: an array of rows by languages."""
        at, lang = np.nonzero(scores)
        size, end = np.bincount(at, minlength=len(scores)), self.rows + len(scores)
        if self.table is not None:
            if end > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros((len(self.table), max(1024, self.rows // 8, end - self.rows)), np.float32)], 1)
            self.table[:, self.rows : end] = scores.T
        self.start, self.size = (_room(x, end) for x in (self.start, self.size))
        self.lang, self.value = (_room(x, self.used + len(lang)) for x in (self.lang, self.value))
        self.start[self.rows : end], self.size[self.rows : end] = self.used + np.cumsum(size) - size, size
        self.lang[self.used : self.used + len(lang)], self.value[self.used : self.used + len(lang)] = lang, scores[at, lang]
        self.rows, self.used = end, self.used + len(lang)

    def cut(self, rows: int) -> None:
        """Back to the first ``rows`` rows."""
        self.used = int(self.start[rows]) if rows < self.rows else self.used
        self.rows = rows


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x), 1024) - len(x), x.dtype)])


class Model:
    """Log frequencies by language above that of what it does not have, which is the same for all; so only
    the languages that have an entry are kept, and the model grows with its entries, not times languages.
    ``words`` and ``grams`` give rows of the tables."""

    def __init__(self, langs: list[str], words: pd.DataFrame, grams: pd.DataFrame) -> None:
        self.langs = langs
        self.words, self.word_logs = self._logs(words, pd.Series(0, words.index))
        self.grams, self.gram_logs = self._logs(grams, grams["entry"].str.len() if len(grams) else pd.Series(dtype=int))

    def _logs(self, counts: pd.DataFrame, group: pd.Series) -> tuple[dict[str, int], Sparse]:
        """Frequencies are shares of a language's entries of the same group."""
        lang, n = counts["lang"].map({x: k for k, x in enumerate(self.langs)}).to_numpy(int), counts["n"].to_numpy(float)
        group = group.to_numpy(int)
        cell = group * len(self.langs) + lang
        share = n / np.maximum(np.bincount(cell, n)[cell], 1) if len(n) else n
        entries = sorted(set(counts["entry"]))
        index = {e: k for k, e in enumerate(entries)}
        at = counts["entry"].map(index).to_numpy(int)
        order = np.lexsort((lang, at))
        return index, Sparse(at[order], lang[order], np.log1p(share / FLOOR)[order], len(entries), len(self.langs))

    def word(self, word: str) -> np.ndarray:
        """Scores of a word: its own, or those of the longest order of n-grams of which one is known."""
        if (k := self.words.get(word)) is not None:
            return self.word_logs.sums(np.array([k]), np.array([0]), 1, len(self.langs))[0]
        return self.unseen([word])[0]

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that the model does not have, an array of words by languages."""
        known, sizes, row = [], np.zeros(len(words), np.int64), self.grams.get
        for at, word in enumerate(words):
            marked = f"<{word}>"
            for order in ORDERS:
                if found := [k for i in range(len(marked) - order + 1) if (k := row(marked[i : i + order])) is not None]:
                    known += found
                    sizes[at] = len(found)
                    break
        sums = self.gram_logs.sums(np.array(known, np.int64), np.repeat(np.arange(len(words)), sizes), len(words), len(self.langs))
        return sums / np.maximum(sizes, 1)[:, None]


class Rows(dict):
    """Row numbers of words in a table of scores: the known words, then unseen ones as they are met."""

    def __init__(self, model: Model) -> None:
        super().__init__(model.words)
        self.model, self.scores = model, copy.copy(model.word_logs)  # arrays are replaced when they grow, never written below the known rows

    def __missing__(self, word: str) -> int:
        self.learn([word])
        return self[word]

    def learn(self, words: list[str]) -> None:
        """Take up unseen words, all at once."""
        self.update(zip(words, range(self.scores.rows, self.scores.rows + len(words)), strict=True))
        self.scores.add(self.model.unseen(words))

    def trim(self) -> None:
        """Forget the unseen words once they are many; called between texts."""
        if len(self) > len(self.model.words) + CACHED_WORDS:
            self.clear()
            self.update(self.model.words)
            self.scores.cut(len(self.model.words))


def predict(rows: Rows, texts: list[str | None]) -> pd.DataFrame:
    """lang_pred and score of each text."""
    model = rows.model
    found = [words_of(t) for t in texts]
    found = [w if any(map(str.isalpha, w)) or any(c.isalpha() for x in w for c in x) else [] for w in found]
    pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    full = [i for i, w in enumerate(found) if w]
    if full and model.langs:
        if unseen := list(dict.fromkeys(w for i in full for w in found[i] if w not in rows)):
            rows.learn(unseen)
        ids = np.fromiter((k for i in full for k in map(rows.__getitem__, found[i])), np.int64)
        sizes = np.array([len(found[i]) for i in full])
        total = rows.scores.sums(ids, np.repeat(np.arange(len(full)), sizes), len(full), len(model.langs))
        best = total.argmax(1)
        mean = total / sizes[:, None] * np.minimum(sizes, SCORE_WORDS)[:, None]
        pred[full] = np.array(model.langs, object)[best]
        score[full] = 1 / np.exp(mean - mean[np.arange(len(full)), best][:, None]).sum(1)
    rows.trim()
    return pd.DataFrame({"lang_pred": pred, "score": np.clip(score, 0, 1)})


def _emptied(found: dict[str, Counter[str]]) -> Iterator[pd.DataFrame]:
    """The counts as rows; none stay in ``found``."""
    for lang, c in found.items():
        if c:  # Spark cannot take a frame without rows
            yield pd.DataFrame({"lang": lang, "entry": list(c), "n": list(c.values())})
    found.clear()


def fit(docs: DataFrame, max_docs: int | None = MAX_DOCS, max_entries: int | None = MAX_ENTRIES, min_count: int = MIN_COUNT) -> Model:
    """Learn from labelled, not held-out rows of ``docs`` (doc_id, text, lang)."""
    rows = bounded(docs).select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").count().collect()  # one row a language
    langs = sorted(r["lang"] for r in sizes)
    if max_docs is not None and any(r["count"] > max_docs for r in sizes):
        share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1 << 30, max_docs * (1 << 30) // r["count"]))])
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter[str]] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                c = found.setdefault(lang, Counter())
                for t in texts:
                    c.update(words_of(t))
            if sum(map(len, found.values())) > CACHED_WORDS:
                yield from _emptied(found)
        yield from _emptied(found)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                c: Counter[str] = Counter()
                for word, k in zip(part["entry"], part["n"], strict=True):
                    for order in ORDERS:
                        for g in grams_of(word, order):
                            c[g] += k
                    if len(c) > CACHED_WORDS:
                        yield from _emptied({lang: c})
                        c = Counter()
                yield from _emptied({lang: c})

    schema = "lang string, entry string, n long"
    words = checkpointed(rows.select("lang", "text").mapInPandas(count, schema).groupBy("lang", "entry").agg(F.sum("n").alias("n")))
    grams = words.mapInPandas(cut, schema).groupBy("lang", "entry").agg(F.sum("n").alias("n"))
    top = [x.where(F.col("n") >= min_count) for x in (words, grams)]
    if max_entries is not None:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "entry"))
        top = [x.withColumn("rank", rank).where(F.col("rank") <= max_entries).drop("rank") for x in top]
    return Model(langs, *[x.toPandas() for x in top])


def with_language(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add a struct (lang_pred, score) to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = Rows(shared.value)
        for s in batches:
            parts = [predict(rows, x) for x in slices([t or "" for t in s])]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": pd.Series(dtype=object), "score": pd.Series(dtype=float)})

    # Else a condition on the column predicts every text for itself, and again for the column, in a second worker beside the first.
    return bounded(docs).withColumn(out, language.asNondeterministic()(F.col(text)))


def language_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    model, docs = fit(docs), docs.select("doc_id", "text")
    return with_language(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")
