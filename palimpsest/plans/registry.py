"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..sources.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function from ``Tables`` to a DataFrame under its name."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return put


#: The time that stands for now in SQL.
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def sql_map(table: dict, key: str, otherwise: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v!r}" if not isinstance(v, str) else f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {key} {cases} ELSE {otherwise} END"


def sql_tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+|[一-鿿]+'), lambda z: lower(z))"


def sql_stem(t: str) -> str:
    out = f"CASE WHEN length({t}) <= 3 THEN {t}"
    for ending, left in C.STEMS:
        cut = f"regexp_replace({t}, '(?:{ending})$', '{left}')"
        out += f" WHEN regexp_matches({t}, '(?:{ending})$') AND length({cut}) >= 3 THEN {cut}"
    return f"{out} ELSE {t} END"


_FIRST = {w: line[0] for line in C.SYNONYMS for w in line}


def sql_canonical(t: str) -> str:
    words = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _FIRST.items()) + "}"
    return f"coalesce({words}[{t}], {words}[{sql_stem(t)}], {sql_stem(t)})"


def sql_canonical_tokens(text: str) -> str:
    return f"list_filter(list_transform({sql_tokens(text)}, lambda y: {sql_canonical('y')}), lambda x: length(x) > 1)"


def sql_cosine(a: str, b: str) -> str:
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"


def sql_days(since: str, now: str = NOW) -> str:
    return f"(epoch_us({now}) - epoch_us({since})) / 1e6 / 86400.0"


def sql_clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def sql_decayed(sector: str, salience: str, since: str) -> str:
    left = f"exp(-{sql_map(C.DECAY_RATES, sector, 'NULL')} * {sql_days(since)})"
    return f"coalesce({sql_clamp(f'{salience} * {left} + {C.FLOOR_SALIENCE} * (1 - {left})')}, {salience})"


def sql_recency(since: str) -> str:
    return f"coalesce(exp(-{C.RECENCY_RATE} * greatest(0.0, {sql_days(since)} * 24)), 0)"


def sql_penalty(q: str, m: str) -> str:
    rows = " ".join(f"WHEN '{a}' THEN {sql_map(row, m, repr(C.DEFAULT_PENALTY))}" for a, row in C.PENALTY.items())
    return f"CASE WHEN {q} = {m} THEN 1.0 ELSE CASE {q} {rows} ELSE {C.DEFAULT_PENALTY} END END"


def sql_resonance(m: str, q: str) -> str:
    rows = " ".join(f"WHEN '{a}' THEN {sql_map(dict(zip(C.SECTORS, row, strict=True)), q, 'NULL')}" for a, row in zip(C.SECTORS, C.RESONANCE, strict=True))
    return f"CASE {m} {rows} END"


def sql_sector_weight(primary: str, sector: str) -> str:
    rows = " ".join(f"WHEN '{s}' THEN CASE WHEN {primary} = '{s}' THEN {a} ELSE {b} END" for s, (a, b) in C.SECTOR_WEIGHTS.items())
    return f"CASE {sector} {rows} ELSE 0.5 END"


def sql_tier(since: str, feedback: str, salience: str) -> str:
    recent = f"greatest(0.0, {sql_days(since)}) < {C.RECENT_DAYS}"
    return f"CASE WHEN {recent} AND ({feedback} > 5 OR {salience} > 0.7) THEN 'hot' WHEN {recent} OR {salience} > 0.4 THEN 'warm' ELSE 'cold' END"


def sql_overlap(q: str, m: str) -> str:
    return f"coalesce(len(list_intersect({q}, {m})) / nullif(len({q}), 0)::DOUBLE, 0)"


def sql_keyword(q: str, content: str) -> str:
    return f"coalesce(len(list_filter({q}, lambda w: contains({content}, w)))::DOUBLE / nullif(len({q}), 0), 0)"


def sql_tag_match(tags: str, q: str) -> str:
    t = "lower(g)"
    points = f"CASE WHEN list_contains({q}, {t}) THEN 2 ELSE len(list_filter({q}, lambda w: contains(w, {t}) OR contains({t}, w))) END"
    return f"CASE WHEN len({tags}) > 0 THEN least(1.0, coalesce(list_sum(list_transform(list_filter({tags}, lambda g: g IS NOT NULL), lambda g: {points})), 0)::DOUBLE / (len({tags}) * 2)) ELSE 0.0 END"


def sql_edge_weight(relation: str) -> str:
    return sql_map(C.EDGE_WEIGHTS, f"upper({relation})", str(C.EDGE_WEIGHTS["RELATED_TO"]))
