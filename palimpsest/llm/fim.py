"""Fill-in-the-middle: texts cut at random unit boundaries and put in another order, by a learned rank index.

The unit of a cut is a run of letters or any other single character. Of each text all
boundary offsets are found, and an index of them is learned: segments of a piecewise
linear function from rank to offset, each as long as no boundary is off by more than
``ERROR``, and one byte a boundary for what is left. A cut at a rank is predicted from
its segment, and the byte corrects it exactly. The index depends on the text alone, so one
can be kept and serve any number of rounds, each with another seed.

The index is learned in Arrow batches on numpy; cuts, forms and outputs are column
functions, so that texts reach Python once and do not come back.

Defined cases: a null text counts as empty; an empty text, and one with a marker in it,
stays plain; a null key hashes as the empty text; equal rows are cut alike; an
empty table gives an empty result; texts are read whole, one at a time; other columns
stay, and one of the output's name is replaced by it. Offsets and lengths count code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 texts, how many are cut; of 100 of these, how many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Most that a segment may be off, in code points: with the rounding it fits a byte.
ERROR = 100
#: Slopes are whole multiples of 2^-SLOPE_BITS, so that both sides round alike; a segment has at most as many ranks.
SLOPE_BITS = 20
INDEX = "n long, ranks array<int>, offsets array<int>, slopes array<long>, residuals binary"


def boundaries(text: str) -> np.ndarray:
    """Offsets at which a unit starts, and the length of the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((codes | np.uint32(32)) - np.uint32(97)) < 26
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[:1] = True
    return np.append(np.flatnonzero(starts), len(codes))


def segments(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """First ranks and slopes of the segments: each is as long as one line through its first point stays within ``error``."""
    firsts, slopes, at = [], [], 0
    while at < len(offsets):
        low, high, end, step = -np.inf, np.inf, at + 1, 128
        while end < len(offsets) and end - at < 1 << SLOPE_BITS:
            far = np.arange(end - at, min(end + step, len(offsets), at + (1 << SLOPE_BITS)) - at)
            rise = offsets[end : end + len(far)] - offsets[at]
            highs = np.minimum.accumulate(np.minimum((rise + error) / far, high))
            lows = np.maximum.accumulate(np.maximum((rise - error) / far, low))
            held = int((lows <= highs).argmin()) if lows[-1] > highs[-1] else len(far)
            if held:
                low, high = lows[held - 1], highs[held - 1]
            end += held
            if held < len(far):
                break
            step *= 2
        firsts.append(at)
        slopes.append(round((low + high) / 2 * (1 << SLOPE_BITS)) if end > at + 1 else 0)
        at = end
    return np.array(firsts, np.int64), np.array(slopes, np.int64)


def learned(text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """The rank index of a text: units, and of the segments first ranks, first offsets and slopes, and the residuals."""
    offsets = boundaries(text)
    firsts, slopes = segments(offsets)
    lengths = np.diff(np.append(firsts, len(offsets)))
    rank = np.arange(len(offsets)) - np.repeat(firsts, lengths)
    predicted = np.repeat(offsets[firsts], lengths) + (rank * np.repeat(slopes, lengths) >> SLOPE_BITS)
    residuals = offsets - predicted + 128
    if residuals.min() < 0 or residuals.max() > 255:
        raise ArithmeticError("a residual does not fit its byte")
    return len(offsets) - 1, firsts.astype(np.int32), offsets[firsts].astype(np.int32), slopes, residuals.astype(np.uint8).tobytes()


def _indexes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([learned(t) for t in texts], columns=["n", "ranks", "offsets", "slopes", "residuals"])


def with_rank_index(docs: DataFrame, text: str = "text", out: str = "rank_index") -> DataFrame:
    """Add the learned index of the unit boundaries of each text: n, ranks, offsets, slopes, residuals."""
    index = F.pandas_udf(_indexes, INDEX)
    return bounded(docs).withColumn(out, index(F.coalesce(F.col(text), F.lit(""))))


def offset_at(index: Column, rank: Column) -> Column:
    """The offset of the boundary ``rank``, 0 to n: predicted by its segment, corrected by its residual."""
    segment = F.size(F.filter(index["ranks"], lambda first: first <= rank))
    ahead = rank - F.element_at(index["ranks"], segment)
    predicted = F.element_at(index["offsets"], segment) + F.shiftright(ahead * F.element_at(index["slopes"], segment), SLOPE_BITS)
    residual = F.conv(F.hex(F.substring(index["residuals"], (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long") - 128
    return (predicted + residual).cast("int")


def _draw(key: Column, seed: int, k: int) -> Column:
    """The k-th number of 32 bits, from 1, that a key and a seed draw."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _has_marker(text: Column) -> Column:
    return text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)


def with_fim(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, index: str | None = None, out: str = "fim") -> DataFrame:
    """Add ``out``: form, text (the output), n (units), prefix_chars and middle_chars (null if plain).

    ``cut`` and ``suffix_first`` are in hundredths. ``index`` names a column of ``with_rank_index``; without it one is learned.
    """
    made = index or fresh(docs, "fim_index")
    indexed = docs if index else with_rank_index(docs, text, made)
    whole, ranks, n = F.coalesce(F.col(text), F.lit("")), F.col(made), F.col(made)["n"]
    first, second, form, parts = (fresh(indexed, f"fim_{x}") for x in ("first", "second", "form", "parts"))
    a, b = (F.pmod(_draw(F.col(key), seed, k), n + 1) for k in (1, 2))
    plain = (n == 0) | _has_marker(whole) | (_draw(F.col(key), seed, 3) % 100 >= cut)
    kind = F.when(plain, PLAIN).when(_draw(F.col(key), seed, 4) % 100 < suffix_first, SPM).otherwise(PSM)
    drawn = indexed.withColumns({first: F.least(a, b), second: F.greatest(a, b), form: kind})
    at = drawn.withColumns({first: offset_at(ranks, F.col(first)), second: offset_at(ranks, F.col(second))})
    cuts = at.withColumn(parts, F.struct(F.substring(whole, F.lit(1), F.col(first)).alias("p"), F.substring(whole, F.col(first) + 1, F.col(second) - F.col(first)).alias("m"), F.substring(whole, F.col(second) + 1, F.length(whole)).alias("s")))
    p, m, s = (F.col(parts)[x] for x in "pms")
    put = F.when(F.col(form) == PLAIN, whole).when(F.col(form) == PSM, F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)).otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    moved = F.col(form) != PLAIN
    result = F.struct(F.col(form).alias("form"), put.alias("text"), n.alias("n"), F.when(moved, F.col(first)).cast("long").alias("prefix_chars"), F.when(moved, F.col(second) - F.col(first)).cast("long").alias("middle_chars"))
    return cuts.select(*[c for c in docs.columns if c.lower() != out.lower()], result.alias(out))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A moved text has no markers, so each of the three stands once."""

    def between(after: str | None, before: str | None) -> Column:
        x = output if before is None else F.substring_index(output, before, 1)
        return F.substring_index(x, after, -1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)


def fim_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = with_fim(docs.select("doc_id", "text"))
    again = restored(F.col("fim.text"), F.col("fim.form"))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.text", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))
