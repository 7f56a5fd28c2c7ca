"""Benchmark decontamination with a stored positional inverted index.

The index of the documents is a table. A row is a segment of documents: the sorted
hashes of its terms, each with its posting list of positions, and where its texts
begin. Only terms that some test item has are posted, by a filter of bounded size.

The test set becomes a table of distinct windows. Its terms are joined with the
lengths of their posting lists over all segments: a window with a term that no
document has drops out, and the others get their terms in order, from the rarest on.
Then, segment by segment, the list of each window's rarest term, moved to the
window's start, is intersected with the moved lists of its other terms. What is left
are exact matches. ``near`` keeps, from the same lists, windows whose terms all lie
in a stretch of a few words more, in any order: proximity matches.

Windows are sent to the tasks in blocks of ``BLOCK_WINDOWS``; each block reads the
index once and is then let go, so memory does not grow with the test set. Texts are
known by 128-bit hashes of the whole text: what was found joins back to every row
that has the text, and nothing else of the documents is shuffled.

Defined cases: a null document or item has no words and is never hit or matched; an
item whose id is null counts as the empty id; items that share an id are one item;
every input row gives one output row, whatever ids repeat or are null; an empty
table of documents gives an empty result, an empty test set no hits; long texts are
indexed whole, as a segment of their own. Other columns stay, and a column of the
output's name is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import BitFilter, Kept, WordHashes, bounded, fresh, slices

WINDOW = 13
#: A document is contaminated if hit words are at least one in so many.
ONE_IN = 20
#: Windows that a task holds at a time, and (window, position) pairs that it looks at together.
BLOCK_WINDOWS, PAIRS = 1 << 16, 1 << 20

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: For each byte whether it is in a word (w) or between words, before A-Z become small letters.
_BYTES = bytes(0x77 if WORD.match(bytes([b]).lower()) else 0x20 for b in range(256))
SEGMENT = "terms binary, sizes binary, positions binary, starts binary, keys binary"


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case (other letters stay as they are)."""
    return WORD.findall(text.encode().lower()) if text else []


def n_words(text: Column) -> Column:
    """The number of words, 0 for null: places where a byte of a word follows one between words."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([0 if t is None else (b" " + t.translate(_BYTES)).count(b" w") for t in s], dtype="int64")

    return count(text.cast("binary"))


class Segment:
    """The positional index of some documents: the position lists of terms (64-bit hashes, sorted)."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, positions: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> None:
        self.terms, self.positions, self.starts, self.keys = terms, positions, starts, keys
        self.ends = np.cumsum(sizes, dtype=np.int64)
        #: (term, position) of all postings as one sorted list of numbers.
        self.postings = np.repeat(np.arange(len(terms), dtype=np.int64), sizes) << 32 | positions

    @classmethod
    def of_texts(cls, texts: list[str], keys: np.ndarray, hashes: WordHashes, wanted: BitFilter) -> Segment:
        found = [words_of(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in found], dtype=np.int64)  # a place is left free after each document
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = np.fromiter((x for w in found for x in map(hashes.__getitem__, w)), np.uint64, int(sizes.sum()) - len(found)).view(np.int64)
        hashes.trim()
        place = np.arange(len(h)) + np.repeat(np.arange(len(found)), sizes - 1)
        known = wanted.has(h)
        h, place = h[known], place[known]
        order = np.argsort(h, kind="stable")
        terms, counts = np.unique(h, return_counts=True)
        return cls(terms, counts, place[order], starts, keys)

    def row(self) -> tuple[bytes, ...]:
        return (self.terms.tobytes(), np.diff(self.ends, prepend=0).astype(np.int32).tobytes(), self.positions.astype(np.int32).tobytes(), self.starts.astype(np.int64).tobytes(), self.keys.tobytes())

    @classmethod
    def of_row(cls, terms: bytes, sizes: bytes, positions: bytes, starts: bytes, keys: bytes) -> Segment:
        return cls(np.frombuffer(terms, np.int64), np.frombuffer(sizes, np.int32), np.frombuffer(positions, np.int32), np.frombuffer(starts, np.int64), np.frombuffer(keys, np.int64).reshape(-1, 2))

    def local(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of terms in this segment; -1 for those it does not have."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def any_in(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether terms (by number) have a posting in [low, high)."""
        base = term << 32
        return (term >= 0) & (np.searchsorted(self.postings, base | np.maximum(high, 0)) > np.searchsorted(self.postings, base | np.maximum(low, 0)))


class Phrases:
    """A block of windows: their terms, and the order in which to take these."""

    def __init__(self, ids: list[int], terms: list[list[int]], orders: list[list[int]]) -> None:
        n, width = len(ids), max(map(len, terms), default=1)
        self.ids, self.sizes = np.array(ids, np.int64), np.array([len(t) for t in terms], np.int64)
        self.vocabulary, flat = np.unique(np.array([x for t in terms for x in t], np.int64), return_inverse=True)
        self.at, self.order = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
        inside = np.arange(width) < self.sizes[:, None]
        self.at[inside], self.order[inside] = flat, [x for o in orders for x in o]
        #: Windows by their rarest term.
        self.rarest = self.at[np.arange(n), self.order[:, 0]]
        self.by_rarest = np.argsort(self.rarest, kind="stable")
        self.edges = np.searchsorted(self.rarest[self.by_rarest], np.arange(len(self.vocabulary) + 1))


def _anchors(phrases: Phrases, segment: Segment, local: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a window and a position of its rarest term, some at a time."""
    for v in np.flatnonzero((local >= 0) & (np.diff(phrases.edges) > 0)):
        k = local[v]
        places = segment.postings[segment.ends[k - 1] if k else 0 : segment.ends[k]] & 0xFFFFFFFF
        windows = phrases.by_rarest[phrases.edges[v] : phrases.edges[v + 1]]
        step = max(1, PAIRS // len(places))
        for i in range(0, len(windows), step):
            part = windows[i : i + step]
            yield np.repeat(part, len(places)), np.tile(places, len(part))


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs in runs of about ``PAIRS``."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def exact(phrases: Phrases, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
    """All (window, start) of exact matches: moved posting lists intersected, from the rarest term on."""
    local, out = segment.local(phrases.vocabulary), []
    for window, place in _gathered(_anchors(phrases, segment, local)):
        start = place - phrases.order[window, 0]
        window, start = window[start >= 0], start[start >= 0]
        for k in range(1, phrases.at.shape[1]):
            offset = phrases.order[window, k]
            term = local[phrases.at[window, offset]]
            key = term << 32 | (start + offset)
            at = np.minimum(np.searchsorted(segment.postings, key), len(segment.postings) - 1)
            fits = (k >= phrases.sizes[window]) | ((term >= 0) & (segment.postings[at] == key))
            window, start = window[fits], start[fits]
            if not len(window):
                break
        out.append((window, start))
    return _joined(out)


def near(phrases: Phrases, segment: Segment, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """All (window, start) of stretches of ``slop`` more words than the window, in one document, that begin with one of its terms and hold all of them, in any order."""
    local, out = segment.local(phrases.vocabulary), []
    for window, place in _gathered(_anchors(phrases, segment, local)):
        width = phrases.sizes[window] + slop
        for k in range(1, phrases.at.shape[1]):  # a term that is not around the rarest one rules the pair out
            term = local[phrases.at[window, phrases.order[window, k]]]
            fits = (k >= phrases.sizes[window]) | segment.any_in(term, place - width + 1, place + width)
            window, place, width = window[fits], place[fits], width[fits]
        for back in range(int(width.max(initial=0))):  # where the stretch may begin
            start = place - back
            fits = (start >= 0) & (back < width)
            begins = np.zeros(len(window), bool)
            for k in range(phrases.at.shape[1]):
                term = local[phrases.at[window, phrases.order[window, k]]]
                inside = k < phrases.sizes[window]
                fits &= ~inside | segment.any_in(term, start, start + width)
                begins |= inside & segment.any_in(term, start, start + 1)
            fits &= begins
            if fits.any():
                w, s = window[fits], start[fits]
                # All terms must be in the document that the stretch begins in.
                end = np.append(segment.starts[1:], np.iinfo(np.int32).max)[segment.document(s)]
                whole = np.ones(len(w), bool)
                for k in range(phrases.at.shape[1]):
                    term = local[phrases.at[w, phrases.order[w, k]]]
                    whole &= (k >= phrases.sizes[w]) | segment.any_in(term, s, np.minimum(s + phrases.sizes[w] + slop, end))
                out.append((w[whole], s[whole]))
    window, start = _joined(out)
    pairs = np.unique(np.stack([window, start], axis=1), axis=0) if len(window) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _runs(mask: np.ndarray) -> list[int]:
    """Begin and end of each run of true values, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.tolist()


def matches(phrases: Phrases, segment: Segment, slop: int | None = None) -> list[tuple[int, int, list[int], list[int]]]:
    """For each text with a match its key, the hit word spans (begin, end, begin, ...) and the windows found."""
    window, start = exact(phrases, segment) if slop is None else near(phrases, segment, slop)
    document = segment.document(start)
    order = np.argsort(document, kind="stable")
    window, start, document = window[order], start[order], document[order]
    out = []
    for i, j in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([np.flatnonzero(np.diff(document, prepend=-1)), [len(document)]])), strict=True):
        d = document[i]
        begin = start[i:j] - segment.starts[d]
        end = begin + phrases.sizes[window[i:j]] + (slop or 0)
        depth = np.zeros(int(end.max()) + 1, np.int64)
        np.add.at(depth, begin, 1)
        np.add.at(depth, end, -1)
        a, b = segment.keys[d].tolist()
        out.append((a, b, _runs(np.cumsum(depth)[:-1] > 0), phrases.ids[np.unique(window[i:j])].tolist()))
    return out


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the test items: terms (hashes in order) and the ids of the items that have them."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                h = np.fromiter(map(hashes.__getitem__, words_of(text)), np.uint64).view(np.int64)
                found = [h[i : i + window] for i in range(max(1, len(h) - window + 1))] if len(h) else []
                yield pd.DataFrame({"item_id": pd.Series([item] * len(found), dtype=object), "terms": pd.Series(found, dtype=object)})
            hashes.trim()

    tests = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where(F.col("text").isNotNull())
    return bounded(tests).mapInPandas(cut, "item_id string, terms array<long>").groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def build_index(texts: DataFrame, wanted: BitFilter) -> DataFrame:
    """Segments of ``texts`` (text, key_a, key_b) with the postings of the wanted terms."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            keys, at = batch[["key_a", "key_b"]].to_numpy(np.int64), 0
            for part in slices(list(batch["text"])):
                segment = Segment.of_texts(part, keys[at : at + len(part)], hashes, wanted)
                at += len(part)
                if len(segment.positions):
                    yield pd.DataFrame([segment.row()], columns=[c.split()[0] for c in SEGMENT.split(", ")])

    return bounded(texts).mapInPandas(build, SEGMENT)


def list_lengths(index: DataFrame) -> DataFrame:
    """How many postings each term has (term, n)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for terms, sizes in zip(batch["terms"], batch["sizes"], strict=True):
                yield pd.DataFrame({"term": np.frombuffer(terms, np.int64), "n": np.frombuffer(sizes, np.int32).astype(np.int64)})

    return index.select("terms", "sizes").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def possible_windows(windows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Windows (id, terms) all of whose terms are posted, with their offsets from the rarest term on (order)."""
    rows = windows.select("id", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")).join(lengths, "term")
    ordered = rows.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "offset"))).alias("o")).where(F.size("o") == F.col("size"))
    return ordered.select("id", F.transform("o", lambda x: x["offset"]).alias("order")).join(windows.select("id", "terms"), "id")


HIT = "key_a long, key_b long, spans array<int>, windows array<long>"


def _found(index: DataFrame, windows: DataFrame, slop: int | None, kept: Kept) -> DataFrame:
    """Matches by text: key_a, key_b, spans and windows; a row for each block of windows."""
    spark = index.sparkSession
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    parts = []
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).select("id", "terms", "order").toPandas()
        shared = spark.sparkContext.broadcast(Phrases(*[list(rows[c]) for c in ("id", "terms", "order")]))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    yield pd.DataFrame(matches(shared.value, Segment.of_row(*row), slop), columns=["key_a", "key_b", "spans", "windows"])

        found = index.mapInPandas(search, HIT).dropDuplicates(["key_a", "key_b"])
        parts.append(kept.table(found))
        shared.destroy()
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _merged(spans: pd.Series) -> pd.Series:
    """One list of spans of several."""

    def one(lists: list) -> list[int]:
        if len(lists) == 1:
            return list(lists[0])
        mask = np.zeros(max((x[-1] for x in lists if len(x)), default=0), bool)
        for x in lists:
            for i in range(0, len(x), 2):
                mask[x[i] : x[i + 1]] = True
        return _runs(mask)

    return spans.map(one)


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "hits", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Add a struct (n_words, spans, items) to every row; ``items`` has item_id and text.

    ``slop``: instead of exact matches, stretches with so many words more.
    """
    kept, work = Kept(docs.sparkSession), Kept(docs.sparkSession)
    windows = work.table(windows_of(items, window).withColumn("id", F.monotonically_increasing_id()))
    wanted = BitFilter.of(windows.select(F.explode("terms").alias("term")).distinct(), "term")
    keys = {"key_a": F.xxhash64(F.col(text)), "key_b": F.xxhash64(F.col(text), F.lit(1))}
    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), *[k.alias(c) for c, k in keys.items()])
    index = work.table(build_index(texts, wanted))
    possible = work.table(possible_windows(windows, list_lengths(index)))
    found = _found(index, possible, slop, work)
    named = found.select("key_a", "key_b", F.explode("windows").alias("id")).join(windows.select("id", "items"), "id").select("key_a", "key_b", F.explode("items").alias("item")).distinct()
    named = named.groupBy("key_a", "key_b").agg(F.sort_array(F.collect_list("item")).alias("items"))
    spans = found.groupBy("key_a", "key_b").agg(F.collect_list("spans").alias("spans")).select("key_a", "key_b", _merged("spans").alias("spans"))
    hits = kept.table(spans.join(named, ["key_a", "key_b"]))
    work.drop()
    names = {c: fresh(docs, c) for c in (*keys, "spans", "items")}
    hits = hits.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = bounded(docs).join(hits, (keys["key_a"] == F.col(names["key_a"])) & (keys["key_b"] == F.col(names["key_b"])), "left")
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    hit = F.struct(n_words(F.col(text)).alias("n_words"), F.coalesce(names["spans"], none[0]).alias("spans"), F.coalesce(names["items"], none[1]).alias("items"))
    return joined.withColumn(out, hit).drop(*[n for n in names.values() if n != out])


def n_hit(hits: Column) -> Column:
    """Words inside the spans."""
    at = F.sequence(F.lit(0), F.size(hits["spans"]) - 2, F.lit(2))
    width = F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a + F.get(hits["spans"], i + 1) - F.get(hits["spans"], i))
    return F.when(F.size(hits["spans"]) > 0, width).otherwise(F.lit(0).cast("long"))


def contaminated(hits: Column) -> Column:
    n = n_hit(hits)
    return (n > 0) & (n * ONE_IN >= hits["n_words"])


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    d = docs.select("doc_id", "text")
    hits = F.col("hits")
    return with_hits(d, items).select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        n_hit(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(hits).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    hits = fresh(docs, "hits")
    return with_hits(docs, items, out=hits).where(~contaminated(F.col(hits))).select(*docs.columns)
