"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and the acceptor again.

Words that differ by one inserted, deleted or replaced character are near. Near words
are the pairs that acceptor, transducer and acceptor accept together: both read the
same prefix, one edge of the transducer edits, and from the two states reached both read
the same suffix. The suffixes that two states share are found once, however many
prefixes lead to them; as the acceptor is minimised, these are many.

The vocabulary is dealt by initial state. A pair whose shorter word has L characters
shares its first L / 2 or, if the edit is before them, its last ones; so words of a
length (and of the next) with the same first half make one acceptor, which edits after
that half, and those with the same last half another, which edits before it: each pair
is accepted in exactly one. Partitions with more than ``MOST_WORDS`` words are divided
by the place of the edit, again and again, each part with a longer common prefix or
suffix. One place leaves at most two unlike characters, so there this ends.

Words are counted in tasks before they are shuffled; a task holds ``COUNTED`` distinct words.

Defined cases: a null text has no words; a null id stands as the empty text; equal rows
count each; an empty table gives an empty result; texts are read whole; columns beside
id and text are not read, so their names cannot clash. Equal counts: the first word in
code-point order. Only A-Z are lower-cased.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, bounded

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Characters and occurrences that a word has at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A word's form has so many times its occurrences.
TIMES = 5
#: Words of one acceptor; more are divided.
MOST_WORDS = 20_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Keys that are sent to every task.
BROADCAST_ROWS = 200_000

State = tuple[bool, dict[str, int]]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", slip_every: int | None = None) -> DataFrame:
    """The words of all texts (word, n), of any length and number.

    With ``slip_every`` a word loses a character where that number divides the CRC-32 of ``<key>:<word>``: planted misspellings.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(met.keys()), pa.string()), pa.array(list(met.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for k in range(len(batch)):
                at, whole = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                runs = Counter(map(itemgetter(0), RUN.finditer(whole.encode().lower().decode())))
                start = zlib.crc32(f"{at}:".encode())
                for run, n in runs.items():
                    if slip_every and (h := zlib.crc32(run.encode(), start)) % slip_every == 0:
                        i = h % len(run)
                        run = run[:i] + run[i + 1 :]
                    met[run] += n
                if len(met) > COUNTED:
                    yield given()
                    met.clear()
        yield given()

    texts = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    return bounded(texts).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def acceptor(words: list[str]) -> tuple[list[State], int]:
    """The least deterministic automaton that accepts exactly ``words``, which come sorted: its states and the initial one."""
    states: list[State] = []
    known: dict[tuple, int] = {}
    open_: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
    last = ""

    def closed() -> int:
        (final,), edges = open_.pop()
        state = known.setdefault((final, tuple(edges.items())), len(states))
        if state == len(states):
            states.append((final, edges))
        return state

    def close_to(depth: int) -> None:
        while len(open_) > depth + 1:
            symbol = last[len(open_) - 2]
            state = closed()
            open_[-1][1][symbol] = state

    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        close_to(common)
        open_.extend(([False], {}) for _ in word[common:])
        open_[-1][0][0] = True
        last = word
    close_to(0)
    return states, closed()


def near_pairs(words: list[str], length: int, places: int) -> Iterator[tuple[str, str]]:
    """Pairs of ``words`` (sorted) that one edit at one of the first ``places`` characters makes of each other.

    The shorter of a pair has ``length`` characters. Each pair comes once: an edit is where the two first differ.
    """
    states, start = acceptor(words)
    found: dict[tuple[int, int], list[str]] = {}

    def shared(x: int, y: int) -> list[str]:
        """Suffixes that both states accept."""
        if (x, y) not in found:
            out, todo = [], [(x, y, "")]
            while todo:
                p, q, suffix = todo.pop()
                (p_final, p_edges), (q_final, q_edges) = states[p], states[q]
                if p_final and q_final:
                    out.append(suffix)
                todo.extend((p_edges[a], q_edges[a], suffix + a) for a in p_edges.keys() & q_edges.keys())
            found[x, y] = out
        return found[x, y]

    todo = [(start, "")]
    while todo:
        state, prefix = todo.pop()
        edges = list(states[state][1].items())
        for i, (a, x) in enumerate(edges):
            for suffix in shared(x, state):  # the transducer drops a
                if not suffix.startswith(a):
                    yield prefix + suffix, prefix + a + suffix
            for b, y in edges[i + 1 :]:  # it puts b for a
                for suffix in shared(x, y):
                    if len(prefix) + 1 + len(suffix) == length:
                        yield prefix + a + suffix, prefix + b + suffix
        if len(prefix) + 1 < places:
            todo.extend((x, prefix + a) for a, x in edges)


PARTITION = ["length", "low", "high", "head", "tail"]


def _in_ranges(rows: DataFrame, *ranges: tuple[Column, Column]) -> DataFrame:
    """``rows`` (word, n, length) once for each range of places (from, to before) that an edit can be in; a pair's shorter word has ``length`` characters."""
    each = rows.select("word", "n", "length", F.explode(F.array(*[F.struct(low.cast("int").alias("low"), high.cast("int").alias("high")) for low, high in ranges])).alias("range"))
    low, high = F.col("range.low"), F.col("range.high")
    head, tail = F.substring("word", F.lit(1), low), F.right("word", F.greatest(F.col("length") - high, F.lit(0)))
    return each.select("word", "n", "length", low.alias("low"), high.alias("high"), head.alias("head"), tail.alias("tail"))


def partitions(words: DataFrame, kept: Kept, least_length: int = LEAST_LENGTH, most: int = MOST_WORDS) -> DataFrame:
    """``words`` (word, n) once for each acceptor that they belong to, of at most ``most`` words where an edit has more than one place."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1))
    of_length = words.select("word", "n", lengths.alias("length")).where(F.col("length") >= least_length)
    half = F.floor(F.col("length") / 2)
    rows = _in_ranges(of_length, (half, F.col("length") + 1), (F.lit(0), half))
    done = []
    while True:
        large = kept.table(rows.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("words")).where((F.col("words") > most) & (F.col("high") - F.col("low") > 1)).select(*PARTITION))
        n = large.count()
        if not n:
            break
        large = F.broadcast(large) if n <= BROADCAST_ROWS else large
        done.append(rows.join(large, PARTITION, "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        rows = kept.table(_in_ranges(rows.join(large, PARTITION, "left_semi").drop("head", "tail"), (F.col("low"), middle), (middle, F.col("high"))))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def near_words(words: DataFrame, kept: Kept, least_length: int = LEAST_LENGTH, most: int = MOST_WORDS) -> DataFrame:
    """By word that is near another: word, n_near, and its near word of most occurrences, near and near_n. ``words``: word, n; all of at least ``least_length`` characters."""

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (rest[PARTITION] == rest[PARTITION].iloc[-1]).all(axis=1) if len(rest) else []
            if len(rest) and not last.all():
                yield composed(rest[~last])
                rest = rest[last]
        if rest is not None and len(rest):
            yield composed(rest)

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {}
        for (length, low, high, head, tail), group in rows.groupby(PARTITION, sort=False):
            if len(group) < 2:
                continue
            n = dict(zip(group["word"], group["n"], strict=True))
            cores = sorted(w[low : len(w) - len(tail)] for w in n)
            for u, v in near_pairs(cores, length - low - len(tail), high - low):
                u, v = head + u + tail, head + v + tail
                for a, b in ((u, v), (v, u)):
                    best = out.setdefault(a, [0, -1, ""])
                    best[0] += 1
                    if (-n[b], b) < (-best[1], best[2]):
                        best[1:] = n[b], b
        return pd.DataFrame([(w, *x) for w, x in out.items()], columns=["word", "n_near", "near_n", "near"])

    sorted_rows = partitions(words, kept, least_length, most).repartition(*PARTITION).sortWithinPartitions(*PARTITION)
    found = sorted_rows.mapInPandas(compose, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.rank")).alias("near_n"))


def roots(forms: DataFrame, kept: Kept) -> DataFrame:
    """``forms`` (word, form) with ``root``, where following forms ends. Each step doubles how far a word looks."""
    at = kept.table(forms.select("word", "form", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = kept.table(at.join(ahead, "root", "left").select("word", "form", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", slip_every: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, most: int = MOST_WORDS) -> DataFrame:
    """Per word of the texts: word, form (the near word that it is a variant of, or null), root (of its group), n, n_near, form_n."""
    work, result = Kept(docs.sparkSession), Kept(docs.sparkSession)
    counted = word_counts(docs, key, text, slip_every)
    words = work.table(counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count)))
    near = work.table(near_words(words, work, least_length, most))
    is_form = F.col("near_n") >= times * F.col("n")
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    named = work.table(named)
    by_root = roots(named.where("form IS NOT NULL").select("word", "form"), work).select("word", "root")
    out = result.table(named.join(by_root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    work.drop()
    return out


def spelling_report(docs: DataFrame) -> DataFrame:
    return spelling_groups(docs, slip_every=199)
