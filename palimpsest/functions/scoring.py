"""Scores, decay and look-ups by sector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; null stays null."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def boosted(similarity: Column) -> Column:
    return 1.0 - F.exp(similarity * -C.BOOST)


def hybrid_score(similarity: Column, overlap: Column, waypoint: Column, recency: Column, tags: Column, keywords: Column) -> Column:
    w = C.SCORE_WEIGHTS
    return sigmoid(boosted(similarity) * w["similarity"] + overlap * w["overlap"] + waypoint * w["waypoint"] + recency * w["recency"] + tags * w["tags"] + keywords)


def _nested(table: dict[str, dict[str, float]]) -> Column:
    inner = lambda row: F.create_map(*[F.lit(x) for kv in row.items() for x in kv])
    return F.create_map(*[x for k, row in table.items() for x in (F.lit(k), inner(row))])


def penalty(query_sector: Column, memory_sector: Column) -> Column:
    return F.when(query_sector == memory_sector, 1.0).otherwise(F.coalesce(F.try_element_at(F.try_element_at(_nested(C.PENALTY), query_sector), memory_sector), F.lit(C.DEFAULT_PENALTY)))


def resonance(memory_sector: Column, query_sector: Column) -> Column:
    """Sectors that are not known count as semantic."""
    known = lambda s: F.when(s.isin(*C.SECTORS), s).otherwise("semantic")
    table = {a: dict(zip(C.SECTORS, row, strict=True)) for a, row in zip(C.SECTORS, C.RESONANCE, strict=True)}
    return F.element_at(F.element_at(_nested(table), known(memory_sector)), known(query_sector))


def sector_weight(primary: Column, sector: Column) -> Column:
    table = {s: {"is": a, "other": b} for s, (a, b) in C.SECTOR_WEIGHTS.items()}
    return F.coalesce(F.try_element_at(F.try_element_at(_nested(table), sector), F.when(primary == sector, "is").otherwise("other")), F.lit(0.5))


def decay_rate(sector: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in C.DECAY_RATES.items() for x in kv]), sector)


def seconds(earlier: Column, later: Column) -> Column:
    """Seconds between two timestamps without zone, with their fraction."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def days(earlier: Column, later: Column) -> Column:
    return seconds(earlier, later) / 86400.0


def decayed_salience(sector: Column, salience: Column, age_days: Column, place: Column | None = None, of: Column | None = None) -> Column:
    """What is left of a salience; a later place among segments slows the loss. Unknown sectors keep theirs."""
    rate = decay_rate(sector)
    if place is not None and of is not None:
        rate = F.when(of > 0, rate * (1.0 - F.sqrt(place / of))).otherwise(rate)
    left = F.exp(-rate * age_days)
    return F.when(rate.isNull() | age_days.isNull(), salience).otherwise(clamp(salience * left + C.FLOOR_SALIENCE * (1.0 - left)))


def recency(last_seen: Column, as_of: Column) -> Column:
    hours = F.greatest(F.lit(0.0), seconds(last_seen, as_of)) / 3600.0
    return F.when(last_seen.isNull(), 0.0).otherwise(F.exp(hours * -C.RECENCY_RATE))


def tier(last_seen: Column, feedback: Column, salience: Column, as_of: Column) -> Column:
    recent = F.greatest(F.lit(0.0), F.coalesce(days(last_seen, as_of), F.lit(0.0))) < C.RECENT_DAYS
    salience = F.coalesce(salience, F.lit(0.0))
    high = (F.coalesce(feedback, F.lit(0)) > 5) | (salience > 0.7)
    return F.when(recent & high, "hot").when(recent | (salience > 0.4), "warm").otherwise("cold")


def edge_weight(relation: Column) -> Column:
    """By name in either case; unknown relations weigh as RELATED_TO."""
    table = F.create_map(*[F.lit(x) for kv in C.EDGE_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(relation)), F.lit(C.EDGE_WEIGHTS["RELATED_TO"]))
