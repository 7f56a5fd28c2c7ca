"""Words: tokens, stems, synonyms, overlaps and templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import STEMS, SYNONYMS
from ..storage import bounded_batches
from .words import TOKEN, Known, Segment, canonical_words, pairs

_CANONICAL = {w: line[0] for line in SYNONYMS for w in line}
_LINES = {line[0]: sorted(line) for line in SYNONYMS}


def _map(pairs: dict, value=F.lit) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), value(v))])


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case, and runs of CJK characters. Other letters split words."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), F.lower)


def cjk_tokens(text: Column) -> Column:
    """Tokens with CJK runs cut into pairs of neighbouring characters (a segmenter can be put in their place)."""
    pairs = F.transform(tokens(text), lambda t: F.when(t.rlike("^[一-鿿]{2,}$"), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))).otherwise(F.array(t)))
    return F.flatten(pairs)


def is_ascii_word(t: Column) -> Column:
    return t.rlike("^[A-Za-z0-9]+$")


def stem(t: Column) -> Column:
    """Words of more than three letters lose their ending if three letters or more stay."""
    out = F.when((F.length(t) <= 3) | ~is_ascii_word(t), t)
    for ending, left in STEMS:
        cut = F.regexp_replace(t, f"(?:{ending})$", left)
        out = out.when(t.rlike(f"{ending}$") & (F.length(cut) >= 3), cut)
    return out.otherwise(t)


def canonical_token(t: Column) -> Column:
    """The first word of its line of synonyms, looked up before and after stemming."""
    low, of = F.when(is_ascii_word(t), F.lower(t)).otherwise(t), _map(_CANONICAL)
    short = F.when(is_ascii_word(t), stem(low)).otherwise(low)
    return F.coalesce(F.try_element_at(of, low), F.try_element_at(of, short), short)


def canonical_tokens(text: Column, segment: Segment = pairs) -> Column:
    """All canonical tokens in order, without single ASCII characters; CJK runs are cut by ``segment``.

    Runs on Arrow batches: a worker works out each different token once, which
    nested lambdas would do again for every place.
    """

    bounded_batches()

    @F.pandas_udf("array<string>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Known(segment)
        for s in batches:
            yield pd.Series([canonical_words(t, known) for t in s], dtype=object)

    return words(text)


def top_words(text: Column, k: int, segment: Segment = pairs) -> Column:
    """The k most frequent canonical tokens, ties by first place, joined by blanks; null if there is none."""
    bounded_batches()

    @F.pandas_udf("string")
    def top(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Known(segment)
        for s in batches:
            yield pd.Series([" ".join(w for w, _ in Counter(words).most_common(k)) if (words := canonical_words(t, known)) else None for t in s], dtype=object)

    return top(text)


def matched_terms(text: Column, user: Column, wanted: Broadcast | None, segment: Segment = pairs) -> Column:
    """The number of canonical tokens, and which of those ``wanted`` by the user (a set for each user; None: all tokens) occur how often: a struct (length, words, tfs), words joined by blanks."""

    bounded_batches()

    @F.pandas_udf("length int, words string, tfs array<int>")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = Known(segment)
        for texts, users in batches:
            lengths, found, tfs = [], [], []
            for t, u in zip(texts, users, strict=True):
                words = canonical_words(t, known)
                lengths.append(len(words))
                counts = Counter(words if wanted is None else filter(wanted.value.get(u, frozenset()).__contains__, words))
                found.append(" ".join(counts))
                tfs.append(list(counts.values()))
            yield pd.DataFrame({"length": pd.Series(lengths, dtype="int32"), "words": pd.Series(found, dtype=object), "tfs": pd.Series(tfs, dtype=object)})

    return count(text, user)


def met_terms(text: Column, wanted: Column, segment: Segment = pairs) -> Column:
    """Which of the ``wanted`` tokens (joined by blanks) a text has: a struct (words, inside) of those among its canonical tokens, and those that occur anywhere in it as they are written."""

    bounded_batches()

    @F.pandas_udf("words array<string>, inside array<string>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = Known(segment)
        for texts, wants in batches:
            asked = {w: [(a, re.fullmatch(TOKEN, a)) for a in w.split()] for w in wants.unique()}
            words, inside = [], []
            for t, w in zip(texts, wants, strict=True):
                runs = set(re.findall(TOKEN, t)) if t else set()
                own, held = {x for r in runs for x in known[r]}, "\n".join(runs)  # a token of one run can occur in runs only
                words.append([a for a, _ in asked[w] if a in own])
                inside.append([a for a, run in asked[w] if a in (held if run else t or "")])
            yield pd.DataFrame({"words": pd.Series(words, dtype=object), "inside": pd.Series(inside, dtype=object)})

    return find(text, wanted)


def token_set(text: Column) -> Column:
    return F.array_distinct(canonical_tokens(text))


def estimate_tokens(text: Column) -> Column:
    """Words of the ASCII part by white space, and one for each other character that is not white space."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_count(F.regexp_replace(text, "[^\\x00-\\x7F]", " "), F.lit("[^\\x20\\x09-\\x0D]+"))
    return words + F.regexp_count(text, F.lit("[^\\x00-\\x7F\\s]"))


def synonyms(t: Column) -> Column:
    """The line of synonyms of a token, sorted; itself if it has none."""
    c = canonical_token(t)
    return F.coalesce(F.try_element_at(_map(_LINES, lambda v: F.array(*map(F.lit, v))), c), F.array(c))


def search_document(text: Column) -> Column:
    """Distinct canonical tokens and their synonyms, sorted and joined by blanks."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(token_set(text), lambda t: F.array_union(F.array(t), synonyms(t)))))), " ")


def or_query(text: Column) -> Column:
    """``"a" OR "b"`` of the distinct canonical tokens, sorted."""
    return F.array_join(F.transform(F.array_sort(token_set(text)), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def token_overlap(query: Column, memory: Column) -> Column:
    """Share of the query's distinct tokens that the memory has; 0 for no tokens."""
    return F.coalesce(F.size(F.array_intersect(query, memory)) / F.nullif(F.size(F.array_distinct(query)), F.lit(0)), F.lit(0.0))


def keyword_overlap(query: Column, content: Column | None, inside: Column | None = None) -> Column:
    """Share of the query's tokens that occur anywhere in the text, as they are written; tokens with ``_`` count double.

    ``inside``, the tokens of ``met_terms``, can take the text's place for a query of distinct tokens.
    """
    weight = lambda t: F.when(F.contains(t, F.lit("_")), 2.0).otherwise(1.0)
    total = F.aggregate(query, F.lit(0.0), lambda a, t: a + weight(t))
    held = F.filter(query, lambda t: F.contains(content, t)) if inside is None else F.array_intersect(query, inside)
    found = F.aggregate(held, F.lit(0.0), lambda a, t: a + weight(t))
    return F.coalesce(found / F.nullif(total, F.lit(0.0)), F.lit(0.0))


def tag_match(tags: Column, query: Column) -> Column:
    """2 for a tag that is a query token, else 1 for each token that holds it or that it holds; over twice the tags, at most 1."""
    low = F.transform(query, F.lower)

    def points(tag: Column) -> Column:
        t = F.lower(tag)
        return F.when(F.array_contains(low, t), 2).otherwise(F.size(F.filter(low, lambda q: F.contains(q, t) | F.contains(t, q))))

    total = F.aggregate(F.filter(tags, F.isnotnull), F.lit(0), lambda a, t: a + points(t))
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.least(F.lit(1.0), total / (F.size(tags) * 2))).otherwise(0.0)


def sector_text(sector: Column, text: Column) -> Column:
    return F.concat(F.lit("[sector:"), sector, F.lit("]\n"), text)


def truncated(text: Column, most: int) -> Column:
    """The text, or its first characters and an ellipsis."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def clean_entity(text: Column) -> Column:
    """Without white space and punctuation, in lower case."""
    return F.lower(F.regexp_replace(text, r"[\s!-/:-@\[-`{-~，。！？；：、（）《》【】“”‘’…—]", ""))


def entity_key(kind: Column, text: Column) -> Column:
    return F.concat(F.upper(kind), F.lit("|"), clean_entity(text))


def fact_text(**parts: Column) -> Column:
    """``What: … | Who: …`` of the parts that are not empty, in the order given."""
    return F.concat_ws(" | ", *[F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{name.capitalize()}: "), c)) for name, c in parts.items()])


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def edge_relation(name: Column, known: list[str]) -> Column:
    """Upper case; empty is CO_OCCURS_WITH and an unknown name RELATED_TO."""
    up = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(up == "", "CO_OCCURS_WITH").when(up.isin(known), up).otherwise("RELATED_TO")


def multi_hot(sectors: Column, names: tuple[str, ...]) -> Column:
    return F.array(*[F.array_contains(sectors, n).cast("int") for n in names])
