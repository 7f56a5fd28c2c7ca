"""Secret scans: fixed patterns, and guess costs of values in credential context.

Patterns find assignments, access keys and hex strings. Beyond those, each value
that stands after a credential's name is priced by the cheapest way to guess it:
a dynamic program over all its segmentations into words, dates, repeats, keyboard
walks and brute-force spans, each of which may begin and end anywhere. A value that
takes 10^``LEAST_GUESSES`` guesses or more is a span of kind ``guess``; pattern spans
are kept whatever it says. What costs more than that is not followed further, so a
cost is exact up to this bound. (Values of fewer than six characters cannot reach it,
nor can it matter how a block of more characters repeats that is no word.)

Words are those of passwords in common use and those of the corpus itself, counted
over all documents: a word that is one in n of all words takes n guesses. Words of
less than one in ``RAREST`` are not used, which also bounds the dictionary.

Positions are code points, ends exclusive. Defined cases: null text is the empty
text, without spans; a span that several kinds find is listed by each; long texts
and values are read whole; an empty table gives an empty result; other columns stay,
and a column of the output's name is replaced by it.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpointed

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

#: Shorter values cannot take enough guesses.
CONTEXT = re.compile(r"""(?:pass(?:word|phrase|code|wd)?|pwd|pin|secret|token|credentials?|(?:api|access|private|auth)[_\x20-]?key|auth|login)["']?\s{0,8}[:=]\s{0,8}["']?([^\s"',;<>]{6,})""", re.IGNORECASE | re.ASCII)
#: Log10 of the guesses from which a value counts as a secret.
LEAST_GUESSES = 8.0
#: Log10 cost of starting another segment.
JOINT = 0.3
#: A corpus word is used if it is at least one in so many of all words.
RAREST = 1_000_000
#: A repeated block without a word in it has fewer guesses than the least only up to this length.
LONGEST_BLOCK = 8

# Frequent password words, in order of frequency.
COMMON = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login princess sunshine shadow football baseball superman "
    "batman trustno1 hello freedom whatever secret summer winter spring autumn love iloveyou jesus michael jordan harley hunter "
    "ranger soccer hockey killer george charlie andrew thomas jessica pepper daniel access flower cheese computer internet test "
    "guest root user default changeme example sample demo temp server database system network private public token key pass word "
    "company office home money orange purple yellow green blue black white silver golden diamond"
).split()
# Letters written as digits or signs.
LEET = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
# Rows of a keyboard, and orders people count in.
LINES = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "01234567890")
#: Keys next to each other: same line, one step; or a line further, at most one place to the side.
NEXT = {(a, b) for line in LINES for x, y in zip(line, line[1:], strict=False) for a, b in ((x, y), (y, x))} | {
    (a, b) for up, low in zip(LINES[:3], LINES[1:4], strict=True) for i, x in enumerate(up) for y in low[max(0, i - 1) : i + 1] for a, b in ((x, y), (y, x))
}
YEAR, MONTH, DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Forms of dates and how many there are, in powers of ten.
DATES = [(re.compile(form), math.log10(n)) for form, n in ((YEAR, 150), (f"{YEAR}[-/._]?{MONTH}", 150 * 12), (f"{YEAR}[-/._]?{MONTH}[-/._]?{DAY}", 150 * 365), (rf"(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._]{YEAR}", 150 * 365), (r"(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._]\d\d", 150 * 365))]
LONGEST_DATE = 10
PLAIN = {w: math.log10(i + 2) for i, w in enumerate(COMMON)}
_TWO = math.log10(2)


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


class Words:
    """Dictionary words with the log10 of their guesses."""

    def __init__(self, costs: dict[str, float] | None = None) -> None:
        self.costs = dict(costs or {})
        for w, cost in PLAIN.items():
            self.costs[w] = min(cost, self.costs.get(w, math.inf))
        self.longest = max(map(len, self.costs))

    def cost(self, written: str) -> float:
        """Of a word as it is written: capitals, and signs for letters, multiply its guesses; infinite if it is none."""
        low = written.lower()
        cost = self.costs.get(low)
        signs = 0
        if cost is None:
            plain = "".join(LEET.get(c, c) for c in low)
            cost = self.costs.get(plain)
            if cost is None:
                return math.inf
            signs = sum(a != b for a, b in zip(low, plain, strict=True))
        n, capitals = len(written), sum(c.isupper() for c in written)
        ways = 1 if not capitals else 2 if capitals in (1, n) else math.comb(n, min(capitals, n - capitals))
        return cost + math.log10(ways) + signs * _TWO


class Starts:
    """Where a run of any length may have begun, and what it had cost until there.

    The guesses of a run double with each power of two that its length passes, so a
    later start that had cost no more hides the earlier ones.
    """

    def __init__(self) -> None:
        self.at: list[int] = []
        self.costs: list[float] = []

    def add(self, at: int, cost: float) -> None:
        if cost < LEAST_GUESSES:
            while self.costs and self.costs[-1] >= cost:
                self.at.pop()
                self.costs.pop()
            self.at.append(at)
            self.costs.append(cost)

    def cheapest(self, end: int) -> float:
        best, k = math.inf, 0
        if self.at:
            farthest = (end - self.at[0] - 1).bit_length()
            for k in range((end - self.at[-1] - 1).bit_length(), farthest + 1):
                i = bisect.bisect_left(self.at, end - (1 << k))
                if i < len(self.at):
                    best = min(best, self.costs[i] + k * _TWO)
        return best


def doubled(length: int) -> float:
    """Log10 of the least power of two that is not below a length."""
    return (length - 1).bit_length() * _TWO


def guess_cost(value: str, words: Words | None = None) -> float:
    """Log10 of the guesses of the cheapest segmentation, at most ``LEAST_GUESSES``."""
    words = words or Words()
    n, low = len(value), value.lower()
    best = [0.0] + [math.inf] * n
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _brute(c))
    sizes = range(1, min(n // 2, max(LONGEST_BLOCK, words.longest)) + 1)
    walk, repeats = Starts(), {}
    walk_since, since = 0, dict.fromkeys(sizes, 0)
    reach = max(words.longest, LONGEST_DATE) + 1

    def begin(i: int) -> float:
        """The cost up to a segment that begins at ``i``."""
        return best[i] + (JOINT if i else 0.0)

    for end in range(1, n + 1):
        cost = min(best[end], best[end - 1] + brute[end] - brute[end - 1])  # a brute-force span goes on letter by letter
        for i in range(max(0, end - words.longest), end - 2):
            if begin(i) < cost:
                cost = min(cost, begin(i) + words.cost(value[i:end]))
        if end > 1 and (low[end - 2], low[end - 1]) not in NEXT:
            walk, walk_since = Starts(), end - 1
        if end - 3 >= walk_since:  # where a walk begins, how far it goes
            walk.add(end - 3, begin(end - 3) + math.log10(47))
            cost = min(cost, walk.cheapest(end))
        for size in sizes:
            if size >= end:
                break
            if value[end - 1] != value[end - 1 - size]:
                since[size] = end - size
                if size in repeats:
                    del repeats[size]
                continue
            i = end - size * (3 if size == 1 else 2)
            if i >= since[size]:  # the block once, and how often
                starts = repeats.setdefault(size, {}).setdefault(end % size, Starts())
                block = min(brute[i + size] - brute[i] if size <= LONGEST_BLOCK else math.inf, words.cost(value[i : i + size]) if size > 2 else math.inf)
                starts.add(i // size, begin(i) + block)  # starts and ends of one remainder, counted in blocks
                cost = min(cost, starts.cheapest(end // size))
        best[end] = min(cost, LEAST_GUESSES)
        for form, guesses in DATES if value[end - 1].isdigit() else ():
            for i in range(max(0, end - LONGEST_DATE), end - 3):
                if value[i].isdigit() and form.fullmatch(value, i, end):
                    best[end] = min(best[end], begin(i) + guesses)
        if end >= reach and not walk.at and not any(s.at for by in repeats.values() for s in by.values()) and min(best[end - reach + 1 : end + 1]) >= LEAST_GUESSES:
            return LEAST_GUESSES  # nothing that is cheap enough goes on
    return best[n]


class Scanner:
    """Finds the spans of texts; values already priced are remembered."""

    def __init__(self, words: Words | None = None) -> None:
        self.secret = lru_cache(maxsize=4096)(lambda value: guess_cost(value, words) >= LEAST_GUESSES)

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """All spans as (start, kind, end), in order of start and then kind."""
        if not text:
            return []
        out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        if ":" in text or "=" in text:
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
            out += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if self.secret(m[1])]
        return sorted(out)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def corpus_words(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Words of three letters or more, in lower case, that are at least one in ``RAREST`` of all, with the log10 of one in how many."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{3,}"), 0)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = checkpointed(found)
    n = found.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: math.log10(n / r["n"]) for r in found.where(F.col("n") * RAREST >= n).collect()}


def with_secrets(docs: DataFrame, words: Words | None = None, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add a struct (n_assign, n_access, n_hex, base_sha256, spans) to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(words or Words())

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        spans = Scanner(shared.value).spans
        for s in batches:
            rows = []
            for t in s:
                found = spans(t)
                base = [x for x in found if x[1] < 3]
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return bounded(docs).withColumn(out, scan(F.col(text)))


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    docs = docs.select("doc_id", "text")
    return with_secrets(docs, Words(corpus_words(docs))).select("doc_id", "secrets.*")
