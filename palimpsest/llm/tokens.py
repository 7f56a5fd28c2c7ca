"""Token counts by a compiled finite-state tokenizer.

The vocabulary of a byte-pair encoder whose words carry an end mark is compiled
into a deterministic transducer over bytes. Its state keeps what the rest of a
word can still depend on: the longest suffix that begins some token and, for
each place in that suffix, the last token of the encoding up to there and how
many tokens that encoding has. A transition carries the change in the number of
emitted tokens, so the counts along a word add up to its token count. States are
made when first reached (the full automaton is far larger than what texts visit).

A text is cut into chunks of fixed length, each chunk gives a state map, and maps
compose associatively, so a document's count is the last of a parallel prefix scan
over its chunks (the other prefixes are not asked for, and not made). A map is kept in closed form: white space takes every state to the start state, so
only a chunk's head (before its first white space) depends on the state the chunk
is entered in, and only its tail decides the state it is left in.

Defined cases: null text counts as the empty text (0 tokens); special strings are
one token each; every input row gives one output row, repeated and null ids
included; an empty table gives an empty result; long texts are read whole. Other
columns stay, and a column of the output's name is replaced by it.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, utf8_bytes

CHUNK_CHARS = 1 << 12
#: Words and states kept by a worker; beyond that the tables are emptied and filled anew.
MAX_WORDS = 300_000
MAX_STATES = 150_000
HALF = 1 << 15

# The white space of the tokenizer's normalizer and its word pattern.
WHITE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def _category_class(initial: str, below: int, start: int = 0) -> str:
    """A character class body of all code points in [start, below) whose category begins with ``initial``."""
    out, run = [], None
    for c in range(start, below + 1):
        if c < below and unicodedata.category(chr(c))[0] == initial:
            run = c if run is None else run
        elif run is not None:
            out.append(f"{re.escape(chr(run))}-{re.escape(chr(c - 1))}")
            run = None
    return "".join(out)


class Transducer:
    """Deterministic transducer of a byte-pair vocabulary with end-of-word marks."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str) -> None:
        self.end = end
        self.letters = _byte_letters()
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}
        #: Tokens inside a word, tokens that end a word (here without the mark), and all that some token begins with.
        self.inner = {t for t in vocab if not self._ends(t)}
        self.final = {t[: -len(end)] for t in vocab if self._ends(t)}
        self.heads = {""} | {t[:i] for t in self.inner for i in range(1, len(t))} | {t[:i] for t in self.final for i in range(1, len(t))}
        self.joins: dict[tuple[str, str, bool], bool] = {}
        self._clear()

    def _ends(self, token: str) -> bool:
        return token.endswith(self.end) and len(token) > len(self.end)

    def _clear(self) -> None:
        #: A state: (suffix, last token at each place of the suffix, token counts there relative to the end).
        self.keys: list[tuple] = []
        self.index: dict[tuple, int] = {}
        #: By state and symbol (256 more for a word's last byte), an edge: next state << 16 | change of the count + HALF.
        self.next: list[dict[int, int]] = []
        self.start = self._state(("", ("",), (0,)))

    def _state(self, key: tuple) -> int:
        k = self.index.get(key)
        if k is None:
            k = self.index[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return k

    def _stands(self, left: str, right: str, last: bool) -> bool:
        """Whether the encoder leaves the two tokens side by side as they are."""
        known = self.joins.get((left, right, last))
        if known is None:
            if len(self.joins) > 4 * MAX_STATES:
                self.joins.clear()
            parts = [*left, *right]
            if last:
                parts[-1] += self.end
            known = self.joins[left, right, last] = self.encode(parts) == [left, right + self.end * last]
        return known

    def encode(self, parts: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ranks = [self.rank.get(p, sys.maxsize) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < sys.maxsize:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            for i in (at - 1, at):
                if 0 <= i < len(ranks):
                    ranks[i] = self.rank.get((parts[i], parts[i + 1]), sys.maxsize)
        return parts

    def _last_token(self, key: tuple, grown: str, last: bool) -> tuple[str, int]:
        """The encoding's last token after one more symbol, and the change of the token count."""
        _, lasts, counts = key
        tokens = self.final if last else self.inner
        for at, before in enumerate(lasts):  # the place where the token begins; one fits
            if before is not None and (t := grown[at:]) in tokens and (before == "" or self._stands(before, t, last)):
                return t, counts[at] + 1
        raise ValueError(f"the vocabulary cannot spell {grown[-1]!r}")

    def _edge(self, state: int, byte: int) -> int:
        """Build a transition inside a word."""
        suffix, lasts, counts = key = self.keys[state]
        grown = suffix + self.letters[byte]
        token, change = self._last_token(key, grown, False)
        cut, heads = 0, self.heads
        while grown[cut:] not in heads:
            cut += 1
        suffix = grown[cut:]
        places = [(x, y - change) if suffix[i:] in heads else (None, 0) for i, (x, y) in enumerate(zip((*lasts, token)[cut:], (*counts, change)[cut:], strict=True))]
        edge = self.next[state][byte] = self._state((suffix, *zip(*places, strict=True))) << 16 | change + HALF
        return edge

    def _last_edge(self, state: int, byte: int) -> int:
        """Build the transition of a word's last byte, which leads to the start."""
        key = self.keys[state]
        change = self._last_token(key, key[0] + self.letters[byte], True)[1]
        edge = self.next[state][byte + 256] = self.start << 16 | change + HALF
        return edge

    def count(self, word: bytes) -> int:
        """Tokens of one word: the emitted counts along its path."""
        if len(self.keys) > MAX_STATES:
            self._clear()
        state, emitted, edges = self.start, 0, self.next
        for byte in word[:-1]:
            edge = edges[state].get(byte) or self._edge(state, byte)
            state = edge >> 16
            emitted += (edge & 0xFFFF) - HALF
        edge = edges[state].get(word[-1] + 256) or self._last_edge(state, word[-1])
        return emitted + (edge & 0xFFFF) - HALF


class StateMap(NamedTuple):
    """What a chunk does to the tokenizer's state, for every state it may be entered in."""

    reset: bool  # the chunk has white space, so its end does not depend on its entry
    head: str  # before the first white space; the whole chunk if there is none
    emitted: int  # tokens between the first and the last white space
    tail: str  # after the last white space


class WordCounts(dict):
    """Token counts of words already met."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        n = self[word] = self.transducer.count(word.encode())
        return n


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, spec: dict, chunk_chars: int = CHUNK_CHARS) -> None:
        model = spec["model"]
        self.words = WordCounts(Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"]))
        self.chunk_chars = chunk_chars
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.white = re.compile(f"[{WHITE}]")
        self.astral = re.compile("[\U00010000-\U0010ffff]")
        letters, numbers = (_category_class(c, 0x10000) for c in "LN")
        self.pattern = re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")

    @property
    def wide_pattern(self) -> re.Pattern:
        if not hasattr(self, "_wide"):
            letters, numbers = (_category_class(c, sys.maxunicode + 1) for c in "LN")
            self._wide = re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")
        return self._wide

    def _of(self, text: str) -> int:
        pattern = self.wide_pattern if self.astral.search(text) else self.pattern
        return sum(map(self.words.__getitem__, pattern.findall(text)))

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter (no rule looks at neighbours)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def chunk_map(self, chunk: str) -> StateMap:
        first = self.white.search(chunk)
        if first is None:
            return StateMap(False, chunk, 0, "")
        end = len(chunk)
        while not self.white.match(chunk, end - 1):
            end -= 1
        return StateMap(True, chunk[: first.start()], self._of(chunk[first.end() : end]), chunk[end:])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if not a.reset:
            return StateMap(b.reset, a.head + b.head, b.emitted, b.tail)
        if not b.reset:
            return StateMap(True, a.head, a.emitted, a.tail + b.head)
        return StateMap(True, a.head, a.emitted + self._of(a.tail + b.head) + b.emitted, b.tail)

    def whole(self, maps: list[StateMap]) -> StateMap | None:
        """The map of all chunks in a logarithmic number of rounds: in each, neighbours are composed side by side."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else None

    def _plain(self, text: str) -> int:
        text = self.normal(text)
        cut = range(0, len(text), self.chunk_chars)
        m = self.whole([self.chunk_map(text[i : i + self.chunk_chars]) for i in cut])
        return self._of(m.head) + m.emitted + self._of(m.tail) if m else 0

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)


@lru_cache(maxsize=4)
def load(path: str) -> Counter:
    """Compile the tokenizer file once a process."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or not spec["model"].get("end_of_word_suffix"):
        raise ValueError("only byte-level BPE vocabularies with an end-of-word mark can be compiled")
    return Counter(spec)


def with_token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the token count of ``text`` to every row; ``tokenizer_path`` is a file that each worker has (an installed package's)."""

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = load(tokenizer_path)
        for s in batches:
            yield pd.Series([counter.count(t) for t in s], dtype="int64")

    return bounded(docs).withColumn(out, counts(F.col(text)))


def token_report(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    d = docs.select("doc_id", "text")
    n = fresh(d, "n_tokens")
    return with_token_counts(d, tokenizer_path, out=n).select(
        "doc_id", utf8_bytes(F.col("text")).alias("n_bytes"), F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit")
    )
