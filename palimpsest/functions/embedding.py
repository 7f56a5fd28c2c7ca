"""Hash embeddings: words, letter triples and word pairs as signed features.

Works without a model; any function from texts to vectors can stand in its place.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..constants import SECTOR_WEIGHTS, SYNONYMS
from ..storage import bounded_batches
from .text import sector_text
from .words import _MOST_KNOWN, Known, canonical, canonical_words

Embed = Callable[[list[str]], np.ndarray]
DIM = 256
#: Weights beside a word's own: of its letter triples, of word pairs, of places, of the second hash; words that have a place.
TRIPLES, PAIRS, PLACES, SECOND, PLACED = 0.4, 1.4, 0.5, 0.5, 50

_LINE = {line[0]: line for line in SYNONYMS}
#: Seed, factor and shift of the two hashes; a shift of 0 is FNV-1a.
_HASHES = ((0x811C9DC5, 16777619, 0), (0xDEADBEEF, 0x5BD1E995, 13))
#: Words of texts that are worked out at once; one longer text is worked out by itself.
_WORDS_AT_ONCE = 50_000


def _hash(text: str, h: int, factor: int, shift: int) -> int:
    """Multiply and mix over code points, in 32 bits, from the state ``h`` on."""
    for c in text:
        h = (h ^ ord(c)) * factor & 0xFFFFFFFF
        if shift:
            h ^= h >> shift
    return h


def _hash_on(states: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, factor: int, shift: int) -> np.ndarray:
    """``_hash`` of many strings at once: each goes on from its state over its own stretch of ``points``."""
    order = np.argsort(-lengths, kind="stable")
    h, starts = states[order], starts[order]
    left = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # how many strings are longer than k
    for k, n in enumerate(left):
        x = (h[:n] ^ points[starts[:n] + k]) * np.uint64(factor) & np.uint64(0xFFFFFFFF)
        h[:n] = x ^ x >> np.uint64(shift) if shift else x
    out = np.empty_like(h)
    out[order] = h
    return out


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys by their first place, and their weights added up in the order in which they stand."""
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(first)
    return unique[order], np.bincount(inverse, weights, len(unique))[order]


class _Grown(dict):
    """The words that a word counts as: itself and its synonyms."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > _MOST_KNOWN:
            self.clear()
        self[word] = found = (word, *map(canonical, _LINE.get(word, (word,))))
        return found


def _embed_some(texts: list[list[str]], grown: _Grown, dim: int, sector: str) -> np.ndarray:
    """Vectors of texts, given as their words; each has some. Words, triples and pairs are hashed once, as arrays."""
    scale = {s: a for s, (a, _) in SECTOR_WEIGHTS.items()}.get(sector, 1.0)
    number: defaultdict[str, int] = defaultdict(count().__next__)
    met, kinds, totals, weights = [], [], [], []
    for words in texts:
        n = Counter(x for w in words for x in grown[w])
        total = sum(n.values())
        weight = {k: (k / total * math.log(1 + total / k) + 1) * scale for k in set(n.values())}
        met += map(number.__getitem__, n)
        kinds.append(len(n))
        totals.append(total)
        weights += map(weight.__getitem__, n.values())
    row, met = np.arange(len(texts)), np.array(met)
    size = np.fromiter(map(len, number), np.int64, len(number))
    starts = np.cumsum(size) - size
    points = np.frombuffer("".join(number).encode("utf-32-le"), "<u4").astype(np.uint64)

    def hashes(kind: str, starts: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        return [_hash_on(np.full(len(starts), _hash(f"{sector}|{kind}|", *h), np.uint64), points, starts, size, *h[1:]) for h in _HASHES]

    # Words and letter triples: (text, feature) by its first place in the text.
    inner = np.maximum(size - 2, 0)
    at = _stretches(starts, inner)
    _, first, triple = np.unique(points[at] << np.uint64(42) | points[at + 1] << np.uint64(21) | points[at + 2], return_index=True, return_inverse=True)
    known = [np.concatenate(x) for x in zip(hashes("tok", starts, size), hashes("c3", at[first], np.full(len(first), 3)), strict=True)]
    sizes = 1 + inner[met]
    is_word = np.zeros(int(sizes.sum()), bool)
    is_word[np.cumsum(sizes) - sizes] = True
    feature = np.empty(len(is_word), np.int64)
    feature[is_word], feature[~is_word] = met, len(size) + triple[_stretches((np.cumsum(inner) - inner)[met], inner[met])]
    weight = np.repeat(np.array(weights), sizes)
    weight[~is_word] *= TRIPLES
    at, weight = _summed(np.repeat(np.repeat(row, kinds), sizes) << 32 | feature, weight)
    parts = [(at >> 32, *[h[at & 0xFFFFFFFF] for h in known], weight)]
    # Pairs of neighbouring words.
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(lengths.sum()))
    text, place = np.repeat(row, lengths), _stretches(np.zeros(len(texts), np.int64), lengths)
    first = np.flatnonzero(place < np.repeat(lengths, lengths) - 1)
    if len(first):
        pairs, pair = np.unique(words[first] << 32 | words[first + 1], return_inverse=True)
        at, weight = _summed(text[first] << 32 | pair, PAIRS * scale / (1 + place[first] * 0.1))
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        between, none = np.array([ord("_")], np.uint64), np.zeros(len(size), np.int64)
        hashed = []
        for begun, h in zip(hashes("bi", starts, size), _HASHES, strict=True):
            begun = _hash_on(begun, between, none, none + 1, *h[1:])
            hashed.append(_hash_on(begun[a], points, starts[b], size[b], *h[1:])[at & 0xFFFFFFFF])
        parts.append((at >> 32, *hashed, weight))
    row, a, b, weight = map(np.concatenate, zip(*parts, strict=True))
    row = row * dim
    signed = np.where(a & np.uint64(1), -weight, weight)
    # Places of the first words follow in the same sums.
    placed = np.minimum(lengths, PLACED)
    text, i = np.repeat(np.arange(len(texts)), placed), _stretches(np.zeros(len(texts), np.int64), placed)
    share = np.array([PLACES * scale / math.log(1 + total) for total in totals])[text]
    slots = [np.stack([row + (x % np.uint64(dim)).astype(np.int64) for x in (a, b)], axis=1), np.stack([text * dim + (i + k) % dim for k in (0, 1)], axis=1)]
    added = [np.stack([signed, signed * SECOND], axis=1), share[:, None] * _angles(dim)[i]]
    out = np.bincount(np.concatenate(slots).ravel(), np.concatenate(added).ravel(), len(texts) * dim).reshape(-1, dim)
    for v in out:
        n = np.linalg.norm(v)
        v /= n if n else 1.0
    return out.astype(np.float32)


@cache
def _angles(dim: int) -> np.ndarray:
    """Sine and cosine of each place."""
    angles = [i / 10000 ** (2 * (i % dim) / dim) for i in range(PLACED)]
    return np.array([(math.sin(x), math.cos(x)) for x in angles])


@cache
def _tables() -> tuple[Known, _Grown]:
    """What a worker knows of words already met; both are bounded."""
    return Known(), _Grown()


def hash_embed(texts: list[str], dim: int = DIM, sector: str = "semantic") -> np.ndarray:
    """The vectors of texts, some of them at a time."""
    out, (known, grown) = np.full((len(texts), dim), 1 / math.sqrt(dim), np.float32), _tables()
    some, held = {}, 0
    for i, text in enumerate(texts):
        if words := canonical_words(text, known):
            some[i] = words
            held += len(words)
        if some and (held >= _WORDS_AT_ONCE or i == len(texts) - 1):
            out[list(some)] = _embed_some(list(some.values()), grown, dim, sector)
            some, held = {}, 0
    return out


def embed_text(text: str, dim: int = DIM, sector: str = "semantic") -> np.ndarray:
    return hash_embed([text], dim, sector)[0]


def embedded(text: Column, embed: Embed = hash_embed) -> Column:
    """The vector of a text column; null texts embed as the empty text."""

    bounded_batches()

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(embed([t or "" for t in s])), dtype=object)

    return run(text)


def vectorise(memories: DataFrame, embed: Embed = hash_embed) -> DataFrame:
    """One vector for each memory and sector (id, sector, user_id, v, dim), of the text with the sector before it."""
    rows = memories.select("id", "user_id", "content", F.explode(F.array_distinct("sectors")).alias("sector"))
    return rows.select("id", "sector", "user_id", embedded(sector_text(F.col("sector"), F.coalesce("content", F.lit(""))), embed).alias("v")).withColumn("dim", F.size("v"))
