"""Pairing of turns, sessions, user profiles and activity summaries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bounded_batches
from .ranges import HOT_KEY, divided
from .recall import ranked
from .tables import latest, mark

# Limits of a compact profile, and what names an item of a list.
DEEPEST, MOST_KEYS, MOST_ITEMS, MOST_HABITS, MOST_TAGS, LEAST_CONFIDENCE = 6, 60, 50, 10, 15, 0.5
IDENTITY = ("id", "key", "name", "code", "type", "label")
IDENTITY_BY_PATH = {"tags": ("name",), "preferences.habits": ("name",), "demographic.extra.*": ("id", "key", "name", "code", "label")}
PERSONALITIES = ("INTJ", "INTP", "ENTJ", "ENTP", "INFJ", "INFP", "ENFJ", "ENFP", "ISTJ", "ISFJ", "ESTJ", "ESFJ", "ISTP", "ISFP", "ESTP", "ESFP")


def pair_turns(turns: DataFrame, order: list[str], keys: tuple[str, ...] = ("user_id",), hot: int = HOT_KEY) -> DataFrame:
    """Give each question (role human) and the answer that takes it a common ``pair_id``.

    An answer takes the latest question that has none yet, so questions and answers
    match like brackets: at equal depth, an answer belongs to the question before
    it. Answers without a question begin a pair of their own. ``order`` is total within a
    key. Keys with more than ``hot`` turns are divided into ranges of turns.
    """
    few, many = divided(turns, keys, order, hot)
    w = Window.partitionBy(*keys).orderBy(*order)
    t = few.withColumn("__sum", F.sum(_step()).over(w))
    t = t.withColumn("__level", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(w)))
    t = t.withColumn("__stack", _stack(F.col("__level"), F.coalesce(F.lag("__level").over(w), F.lit(0))))
    depth = Window.partitionBy(*keys, "__stack").orderBy(*order)
    out = _with_pair(t, F.lag("id").over(depth)).select(*turns.columns, "pair_id")
    return out if many is None else out.union(_pair_ranges(many, order).select(*turns.columns, "pair_id"))


def _step() -> Column:
    """A question opens, anything else closes."""
    return F.when(F.col("role") == "human", 1).otherwise(-1)


def _stack(level: Column, before: Column) -> Column:
    """The depth at which a turn opens or closes; 0 where nothing is open."""
    return F.when(F.col("role") == "human", level).when(before > 0, before).otherwise(0)


def _with_pair(turns: DataFrame, opened: Column) -> DataFrame:
    partner = F.when((_step() < 0) & (F.col("__stack") > 0), opened)
    return turns.withColumn("pair_id", F.concat(F.lit("pair:"), F.coalesce(partner, "id")))


def _pair_ranges(turns: DataFrame, order: list[str]) -> DataFrame:
    """Pairs of turns whose keys are divided (``__key``, ``__part``).

    A range changes the depth by its sum, and the least depth so far by its least sum. These
    compose, so what is before a range comes from one row of each earlier range. Likewise an answer
    that finds no question at its depth in its range takes the last one of an earlier range.
    """
    within = Window.partitionBy("__key", "__part").orderBy(*order)
    t = turns.withColumn("__sum", F.sum(_step()).over(within)).withColumn("__low", F.min("__sum").over(within)).withColumn("__low_before", F.lag("__low").over(within))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = t.groupBy("__key", "__part").agg(F.sum(_step()).alias("__total"), F.min("__low").alias("__least"))
    ends = ends.withColumn("__base", F.coalesce(F.sum("__total").over(earlier), F.lit(0)))
    ends = ends.withColumn("__floor", F.least(F.lit(0), F.min(F.col("__base") + F.col("__least")).over(earlier)))
    t = t.join(ends.drop("__total", "__least"), ["__key", "__part"])
    level = F.col("__base") + F.col("__sum") - F.least("__floor", F.col("__base") + F.col("__low"))
    before = F.col("__base") + F.col("__sum") - _step() - F.least("__floor", F.col("__base") + F.col("__low_before"))
    t = t.withColumn("__stack", _stack(level, before))
    last = t.where("__stack > 0").groupBy("__key", "__part", "__stack").agg(F.max_by("id", F.struct(*order)).alias("__last"))
    carried = last.select("__key", "__part", "__stack", F.lag("__last").over(Window.partitionBy("__key", "__stack").orderBy("__part")).alias("__carried"))
    depth = Window.partitionBy("__key", "__part", "__stack").orderBy(*order)
    t = t.withColumn("__place", F.row_number().over(depth)).withColumn("__opened", F.lag("id").over(depth))
    return _with_pair(t.join(carried, ["__key", "__part", "__stack"], "left"), F.when(F.col("__place") == 1, F.col("__carried")).otherwise(F.col("__opened")))


def latest_answer(memories: DataFrame, order: str = "created_at") -> DataFrame:
    return latest(memories.where("role = 'assistant' AND pair_id IS NOT NULL"), ["pair_id"], F.col(order), "id")


def unpaired_humans(turns: DataFrame) -> DataFrame:
    """Questions whose pair has no answer."""
    answered = turns.where("role = 'assistant'").select("pair_id").distinct()
    return turns.where("role = 'human'").join(answered, "pair_id", "left_anti")


def active_profile(profiles: DataFrame) -> DataFrame:
    return latest(profiles.where("is_active"), ["user_id"], F.col("updated_at"), "id")


def _pending(memories: DataFrame, users: DataFrame, cutoff: Column) -> DataFrame:
    """Memories of active users before the cutoff."""
    return memories.where(F.col("created_at") < cutoff).join(users.where("status = 1").select(F.col("id").alias("user_id")), "user_id", "left_semi")


def session_batches(memories: DataFrame, users: DataFrame, cutoff: Column, least: int = 10, size: int = 200) -> DataFrame:
    """The dialogue of each active user with at least ``least`` pending memories, in order of time, cut into batches of at most ``size``."""
    rows = _pending(memories, users, cutoff).select("user_id", "created_at", "id")
    enough = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= least).select("user_id")
    numbered = ranked(rows.join(enough, "user_id", "left_semi"), ["user_id"], "created_at", "id")
    batch = numbered.groupBy("user_id", F.floor((F.col("rank") - 1) / size).cast("int").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("d"))
    return batch.select("user_id", "batch", "n", F.transform("d", lambda x: x["id"]).alias("dialogue_ids"))


def profile_batches(memories: DataFrame, users: DataFrame, cutoff: Column) -> DataFrame:
    """How many memories of each active user are pending, and since when."""
    return _pending(memories, users, cutoff).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("since"))


def write_sessions(batches: DataFrame, summary: Column, memories: DataFrame, embed=None) -> tuple[DataFrame, DataFrame]:
    """Session rows of batches (user_id, batch, dialogue_ids) with the vector of their summary, and the memories with ``session_joined`` set for those in a session."""
    from ..functions.embedding import embedded, hash_embed

    rows = batches.select(F.concat("user_id", F.lit(":"), F.xxhash64("dialogue_ids").cast("string")).alias("id"), "user_id", "batch", summary.alias("summary"), "dialogue_ids")
    rows = rows.withColumn("v", embedded(F.col("summary"), embed or hash_embed))
    return rows, mark(memories, batches.select(F.explode("dialogue_ids").alias("id")), "session_joined")


def gap_sessions(turns: DataFrame, ts: str = "ts", gap_minutes: int = 30, hot: int = HOT_KEY) -> DataFrame:
    """Add ``session_id``: a turn that comes later than the gap after the user's turn before it begins a session.

    Users with more than ``hot`` turns are divided into ranges of time, whose sessions are numbered on from those before.
    """
    few, many = divided(turns, ("user_id",), [ts, "id"], hot)
    fresh = lambda before: F.when(F.timestamp_diff("SECOND", before, F.col(ts)) <= gap_minutes * 60, 0).otherwise(1)
    w = Window.partitionBy("user_id").orderBy(ts, "id")
    out = few.withColumn("__new", fresh(F.lag(ts).over(w))).withColumn("session_no", F.sum("__new").over(w)).select(*turns.columns, "session_no")
    if many is not None:
        within, parts = Window.partitionBy("__key", "__part").orderBy(ts, "id"), Window.partitionBy("__key").orderBy("__part")
        ends = many.groupBy("__key", "__part").agg(F.max(ts).alias("__end"))
        t = many.join(ends.select("__key", "__part", F.lag("__end").over(parts).alias("__end")), ["__key", "__part"])
        t = t.withColumn("__new", fresh(F.when(F.row_number().over(within) == 1, F.col("__end")).otherwise(F.lag(ts).over(within))))
        begun = t.groupBy("__key", "__part").agg(F.sum("__new").alias("__n"))
        begun = begun.select("__key", "__part", (F.sum("__n").over(parts) - F.col("__n")).alias("__begun"))
        t = t.withColumn("__no", F.sum("__new").over(within)).join(begun, ["__key", "__part"])
        out = out.union(t.withColumn("session_no", F.col("__begun") + F.col("__no")).select(*turns.columns, "session_no"))
    return out.withColumn("session_id", F.concat("user_id", F.lit(":"), F.col("session_no").cast("string")))


def user_summaries(memories: DataFrame, most: int = 100) -> DataFrame:
    """A sentence on each user's latest activity, from the JSON in ``meta``; lists are sorted."""
    rows = ranked(memories, ["user_id"], F.desc_nulls_last("created_at"), "id").where(F.col("rank") <= most)
    field = lambda name: F.nullif(F.get_json_object("meta", f"$.{name}"), F.lit(""))
    file = F.element_at(F.split(F.translate(field("ide_file_path"), "\\", "/"), "/"), -1)
    each = lambda c: F.array_sort(F.collect_set(c))
    s = rows.groupBy("user_id").agg(each(field("ide_project_name")).alias("p"), each(field("language")).alias("l"), each(file).alias("f"), F.count(F.lit(1)).alias("n"), F.sum(F.when(field("ide_event_type") == "save", 1).otherwise(0)).alias("saves"), F.max("created_at").alias("last"))
    said = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)
    text = F.format_string("Active in %s using %s. Focused on %s. (%d memories, %d saves). Last active: %s.", said(F.col("p"), "Unknown Project"), said(F.col("l"), "General"), said(F.slice("f", 1, 3), "various files"), "n", "saves", F.coalesce(F.date_format("last", "yyyy-MM-dd HH:mm:ss"), F.lit("Recently")))
    return s.select("user_id", text.alias("summary"))


def compact_tags(tags: DataFrame, value: str, most: int, name: str) -> DataFrame:
    """Each user's best items of at least LEAST_CONFIDENCE."""
    return ranked(tags.where(F.col(value) >= LEAST_CONFIDENCE), ["user_id"], F.desc(value), name).where(F.col("rank") <= most)


def known_personalities(values: Column) -> Column:
    return F.filter(values, lambda v: F.upper(v).isin(*PERSONALITIES))


class Profiles:
    """Merging and compacting of profile objects; ``by_path`` says which keys name the items of which lists.

    A path is the keys that lead to a list, joined by dots, whatever lists they pass
    through; one that ends in ``.*`` stands for all paths that begin with what is before it. A
    path that is spelled out goes before one with ``.*``, and the longer of these first.
    """

    def __init__(self, by_path: dict[str, tuple[str, ...]] | None = None, default: tuple[str, ...] = IDENTITY) -> None:
        table = IDENTITY_BY_PATH if by_path is None else by_path
        self.default = default
        self.exact = {p: keys for p, keys in table.items() if not p.endswith(".*")}
        self.starts = sorted(((p[:-2], keys) for p, keys in table.items() if p.endswith(".*")), key=lambda x: -len(x[0]))

    @staticmethod
    def below(path: str, key: str) -> str:
        return f"{path}.{key}" if path else key

    def keys(self, path: str) -> tuple[str, ...]:
        if path in self.exact:
            return self.exact[path]
        return next((keys for start, keys in self.starts if path.startswith(start)), self.default)

    def name(self, item: object, path: str) -> tuple:
        """Items of a list with the same name are one: objects that share an identity, or else equal values."""
        if isinstance(item, dict):
            for key in self.keys(path):
                v = item.get(key)
                if isinstance(v, (int, float)) or (isinstance(v, str) and v.strip()):
                    return "object", key, str(v).strip().lower() if isinstance(v, str) else str(v)
        return "value", item.strip().lower() if isinstance(item, str) else json.dumps(item, sort_keys=True)

    def merge(self, old: object, new: object, path: str = "") -> object:
        """Objects key by key, lists item by item; otherwise the new value, unless it is null."""
        if new is None or old is None:
            return old if new is None else new
        if isinstance(old, dict) and isinstance(new, dict):
            return {k: self.merge(old.get(k), new.get(k), self.below(path, k)) for k in [*old, *(k for k in new if k not in old)]}
        if isinstance(old, list) and isinstance(new, list):
            return self.union([*old, *new], path)
        return new

    def union(self, items: list, path: str) -> list:
        out: dict[tuple, object] = {}
        for x in items:
            name = self.name(x, path)
            out[name] = self.merge(out.get(name), x, path) if name[0] == "object" else out.get(name, x)
        return list(out.values())

    def trimmed(self, value: object, depth: int = 0, path: str = "") -> object:
        """Without empty parts, and within limits of depth, keys and items."""
        if depth >= DEEPEST:
            return None
        if isinstance(value, dict):
            full = [(k, x) for k, v in value.items() if (x := self.trimmed(v, depth + 1, self.below(path, k))) not in (None, "", [], {})]
            return dict(full[:MOST_KEYS])
        if isinstance(value, list):
            return self.union([x for v in value if (x := self.trimmed(v, depth + 1, path)) not in (None, "", [], {})], path)[:MOST_ITEMS]
        return value.strip() and value if isinstance(value, str) else value

    def compact(self, profile: dict) -> dict:
        out = self.trimmed(profile)
        preferences = out.get("preferences") if isinstance(out.get("preferences"), dict) else {}
        return out | {"preferences": preferences | {"habits": _best(preferences.get("habits"), "confidence", MOST_HABITS)}, "tags": _best(out.get("tags"), "weight", MOST_TAGS)}


def _best(items: object, key: str, most: int) -> list:
    def weight(x: dict) -> float:
        try:
            return float(x.get(key))
        except (TypeError, ValueError):
            return 0.0

    rows = [x for x in items if isinstance(x, dict) and weight(x) >= LEAST_CONFIDENCE] if isinstance(items, list) else []
    return sorted(rows, key=weight, reverse=True)[:most]


def _object(text: object) -> dict:
    try:
        value = json.loads(text) if isinstance(text, str) else {}
    except ValueError:
        value = {}
    return value if isinstance(value, dict) else {}


def merge_profiles(old: DataFrame, new: DataFrame, by_path: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Profiles (user_id, profile as JSON) of both, merged and made compact; each side has one row a user. ``by_path``: other identity keys than ``IDENTITY_BY_PATH``."""
    profiles = Profiles(by_path)
    both = old.select("user_id", F.col("profile").alias("old")).join(new.select("user_id", F.col("profile").alias("new")), "user_id", "full")

    bounded_batches(both.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([json.dumps(profiles.compact(profiles.merge(_object(x), _object(y))), ensure_ascii=False, sort_keys=True) for x, y in zip(a, b, strict=True)], dtype=object)

    return both.select("user_id", run("old", "new").alias("profile"))


def compact_profiles(profiles: DataFrame) -> DataFrame:
    return merge_profiles(profiles, profiles.limit(0))
