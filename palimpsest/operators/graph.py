"""Topics, facts, entities and their relations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scoring as S
from ..functions.convert import clamped, clamped_int
from ..functions.text import entity_key
from ..functions.vectors import cosine, doubles, with_norm
from ..storage import bounded_batches, checkpointed, sorted_groups
from . import pairs
from .recall import ranked, sieved, small
from .tables import page


def facts_filter(facts: DataFrame, topic_id: str | None = None, kind: str | None = None, low: float | None = None, high: float | None = None, keyword: str | None = None, searched: tuple[str, ...] = ("what", "who", "place", "why")) -> DataFrame:
    if topic_id is not None:
        facts = facts.where(F.col("topic_id") == topic_id)
    if kind is not None:
        facts = facts.where(F.col("fact_kind") == kind)
    if low is not None:
        facts = facts.where(F.col("confidence") >= low)
    if high is not None:
        facts = facts.where(F.col("confidence") <= high)
    if keyword:
        any_ = F.lit(False)
        for c in searched:
            if c in facts.columns:
                any_ = any_ | F.coalesce(F.contains(F.lower(c), F.lit(keyword.lower())), F.lit(False))
        facts = facts.where(any_)
    return facts


def relations_filter(relations: DataFrame, entity: str | None = None, kinds: list[str] | None = None, low: float | None = None, high: float | None = None, related: str | None = None, sources: list[str] | None = None, fact: str | None = None) -> DataFrame:
    """Relations with the entity at either end; ``other`` is the end that it is not.

    ``related`` names a second entity at either end, ``sources`` are the inference sources allowed, ``fact`` is among the evidence.
    """
    if related is not None:
        relations = relations.where((F.col("source") == related) | (F.col("target") == related))
    if sources:
        relations = relations.where(F.col("inference_source").isin(sources))
    if fact is not None:
        relations = relations.where(F.array_contains("evidence", fact))
    if entity is not None:
        relations = relations.where((F.col("source") == entity) | (F.col("target") == entity)).withColumn("other", F.when(F.col("source") == entity, F.col("target")).otherwise(F.col("source")))
    if kinds:
        relations = relations.where(F.col("edge_relation").isin(kinds))
    if low is not None:
        relations = relations.where(F.col("confidence") >= low)
    if high is not None:
        relations = relations.where(F.col("confidence") <= high)
    return relations


def topics_of(topics: DataFrame, ids: DataFrame) -> DataFrame:
    """Topics that hold any of the memories ``ids`` (id, and other keys such as query_id): one row for each key and topic."""
    keys = [c for c in ids.columns if c != "id"]
    return _by_memory(topics).join(ids, ["id", *[k for k in keys if k == "user_id"]]).select(*keys, *[c for c in ("topic_id", "user_id", "updated_at") if c not in keys]).distinct()


def _by_memory(topics: DataFrame) -> DataFrame:
    """A row for each topic and memory that it holds: topic_id, user_id, updated_at, id."""
    return topics.select(F.col("id").alias("topic_id"), "user_id", "updated_at", F.explode(F.array_distinct("dialogue_ids")).alias("id"))


def latest_topics(topics: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """``topics_of`` memories (query_id, user_id, id) of the user, each query's ``most`` latest; topics of one time go by id.

    A query's latest are among those of its memories: each memory keeps its ``most`` latest topics, before queries meet them.
    """
    latest = [F.desc_nulls_last("updated_at"), "topic_id"]
    first = F.dense_rank().over(Window.partitionBy("user_id", "id").orderBy(*latest))  # a topic that is told twice counts once
    near = _by_memory(topics).withColumn("rank", first).where(F.col("rank") <= most).drop("rank")
    met = ids.select("query_id", "user_id", "id").join(near, ["user_id", "id"]).drop("id").distinct()
    return ranked(met, ["query_id"], *latest).where(F.col("rank") <= most)


def fact_entities(links: DataFrame, canonical: DataFrame) -> DataFrame:
    """Links with the name and type of their canonical entity; links without one go."""
    return links.join(canonical.select(F.col("id").alias("canonical_id"), "name", "entity_type"), "canonical_id")


def entity_topics(links: DataFrame, facts: DataFrame, topics: DataFrame) -> DataFrame:
    """For each entity its topics, with the number of facts and of memories."""
    rows = links.join(facts.select(F.col("id").alias("fact_id"), "topic_id"), "fact_id").join(topics.select(F.col("id").alias("topic_id"), "name", "dialogue_ids"), "topic_id")
    return rows.groupBy("canonical_id", "topic_id").agg(F.countDistinct("fact_id").alias("n_facts"), F.max("name").alias("topic_name"), F.max(F.coalesce(F.size("dialogue_ids"), F.lit(0))).alias("n_memories"))


def topic_memories(topics: DataFrame, memories: DataFrame, topic_id: str) -> DataFrame:
    ids = topics.where(F.col("id") == topic_id).select(F.explode("dialogue_ids").alias("id")).distinct()
    return memories.join(ids, "id", "left_semi")


#: Entities of one fact that one task pairs with all others of the fact.
PAIRED_AT_ONCE = 512


def entity_counts(links: DataFrame) -> DataFrame:
    """How many entities each fact has (n)."""
    return links.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"))


def entity_pairs(links: DataFrame, most: int | None = None, at_once: int = PAIRED_AT_ONCE, facts: DataFrame | None = None) -> DataFrame:
    """Pairs of entities (a < b) of one fact, each once; ``most`` leaves out facts with more pairs, which is counted before they are made.

    The entities of a fact become one row, which meets the columns of ``facts`` (by fact_id), where given, before
    pairs are made of it. A fact with more than ``at_once`` links is dealt over several tasks: each of
    its entities is a first end in one part and a second end in all of them.
    """
    links = links.select("fact_id", "canonical_id").where("fact_id IS NOT NULL AND canonical_id IS NOT NULL")
    large = checkpointed(entity_counts(links).where(F.col("n") > at_once).select("fact_id", F.ceil(F.col("n") / at_once).cast("int").alias("parts")))
    names = ["fact_id", "a", "b", *(c for c in (facts.columns if facts is not None else ()) if c != "fact_id")]
    if large.isEmpty():
        return _few_pairs(links, most, facts).select(*names)
    named = small(large, "fact_id")
    few = _few_pairs(links.join(named, "fact_id", "left_anti"), most, facts)
    part = F.pmod(F.xxhash64("canonical_id"), F.col("parts").cast("long")).cast("int")
    blocks = links.join(named, "fact_id").groupBy("fact_id", "parts", part.alias("part")).agg(F.collect_set("canonical_id").alias("entities"))
    if most is not None:
        n = F.sum(F.size("entities"))
        blocks = blocks.join(blocks.groupBy("fact_id").agg(n.alias("n")).where(F.col("n") * (F.col("n") - 1) / 2 <= most).select("fact_id"), "fact_id", "left_semi")
    others = blocks.select("fact_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("entities").alias("others"))
    many = _ends(blocks.select("fact_id", "part", "entities").join(others, ["fact_id", "part"]), "entities", "others").select("fact_id", "a", "b")
    if facts is not None:
        many = many.join(small(facts.join(named, "fact_id", "left_semi"), "fact_id"), "fact_id")
    return few.select(*names).unionByName(many.select(*names))


def _few_pairs(links: DataFrame, most: int | None, facts: DataFrame | None) -> DataFrame:
    """Pairs of facts that a task holds whole."""
    sets = sorted_groups(links, "fact_id").agg(F.collect_set("canonical_id").alias("entities")).where(F.size("entities") > 1)
    if most is not None:
        sets = sets.where(F.size("entities") * (F.size("entities") - 1) / 2 <= most)
    return _ends(sets if facts is None else sets.join(facts, "fact_id"), "entities", "entities")


def _ends(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Each row with each a of one list and each b of another that comes after it."""
    return rows.withColumn("a", F.explode(first)).withColumn("b", F.explode(second)).where("a < b")


def infer_relation(text: Column, kind_a: Column, kind_b: Column) -> Column:
    """The first rule whose words the fact has and whose entity types fit, else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for relation, kind, words in C.RELATION_RULES:
        said = F.lit(False)
        for w in words:
            said = said | F.contains(low, F.lit(w))
        if kind:
            said = said & (kind_a == kind) & (kind_b == kind)
        out = F.when(said, relation) if out is None else out.when(said, relation)
    return out


def infer_relations(pairs: DataFrame, facts: DataFrame, canonical: DataFrame, text: Column) -> DataFrame:
    """Relations of entity pairs by rule, with the fact as evidence; pairs without a rule co-occur."""
    kinds = canonical.select("id", "entity_type")
    rows = pairs.join(facts.select(F.col("id").alias("fact_id"), "user_id", text.alias("said")), "fact_id").join(kinds.select(F.col("id").alias("a"), F.col("entity_type").alias("ka")), "a").join(kinds.select(F.col("id").alias("b"), F.col("entity_type").alias("kb")), "b")
    rule = infer_relation(F.col("said"), F.col("ka"), F.col("kb"))
    return rows.select("user_id", "a", "b", "fact_id", F.coalesce(rule, F.lit("CO_OCCURS_WITH")).alias("edge_relation"), F.when(rule.isNotNull(), "RULE").otherwise("FALLBACK").alias("inference_source"))


def merge_relations(rows: DataFrame, order: str) -> DataFrame:
    """One edge for each (user, ends, relation): all evidence, and source and confidence of its latest row.

    Rows are sorted by a number made of the edge first: few users and alike names make texts slow to compare.
    """
    edge = ["user_id", "source", "target", "edge_relation"]
    last = F.max_by(F.struct("inference_source", "confidence"), F.struct(order, "fact_id")).alias("last")
    merged = sorted_groups(rows.withColumn("__edge", F.xxhash64(*edge)), "__edge", *edge).agg(F.collect_set("fact_id").alias("evidence"), last)
    return merged.select(*edge, F.sort_array("evidence").alias("evidence"), "last.inference_source", "last.confidence")


def propagate_max(scores: DataFrame, bridge: DataFrame, key: str, to: str) -> DataFrame:
    """Carry scores (query_id, ``key``, score) over a bridge (``key``, ``to``): the highest that reaches each end."""
    return scores.join(bridge.select(key, to).where(F.col(to).isNotNull()), key).groupBy("query_id", to).agg(F.max("score").alias("score"))


def usable_edges(relations: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """Relations that walks may follow (user_id, source, target, loss); loss is the gain below 0."""
    usable = relations.where((F.col("confidence").isNull() | (F.col("confidence") >= least_confidence)) & (F.col("source") != F.col("target")))
    loss = -(F.coalesce("confidence", F.lit(0.0)) * S.edge_weight(F.coalesce("edge_relation", F.lit("RELATED_TO"))))
    return usable.select("user_id", "source", "target", loss.alias("loss"))


def adjacency(relations: DataFrame, most: int, parallel: int, least_confidence: float = 0.5) -> DataFrame:
    """The best edges of each entity (user_id, node), both ways: ``edges``, a list of (loss, to) with the best first, where loss is the gain below 0.

    At most ``parallel`` edges between two entities and ``most`` of an entity are kept, so a row is
    bounded however many relations the entity has.
    """
    return best_edges(usable_edges(relations, least_confidence), most, parallel)


def best_edges(usable: DataFrame, most: int, parallel: int, only: DataFrame | None = None) -> DataFrame:
    """``adjacency`` of usable edges; with ``only``, of those entities (user_id, node), and no edge of others is sorted."""
    ends = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("to"))
    edges = usable.select("user_id", "loss", F.explode(F.array(ends("source", "target"), ends("target", "source"))).alias("e")).select("user_id", "e.node", "e.to", "loss")
    if only is not None:
        edges = edges.join(small(only, "node"), ["user_id", "node"], "left_semi")
    edges = ranked(edges, ["user_id", "node", "to"], "loss").where(F.col("rank") <= parallel).drop("rank")
    edges = ranked(edges, ["user_id", "node"], "loss", "to").where(F.col("rank") <= most)
    return edges.groupBy("user_id", "node").agg(F.array_sort(F.collect_list(F.struct("loss", "to"))).alias("edges"))


def walk(seeds: DataFrame, relations: DataFrame, hops: int = 1, decay: float = 0.8, per_hop: int = 200, least_confidence: float = 0.5, least_score: float = 0.05) -> DataFrame:
    """Scores of the entities that bounded walks from seeds (query_id, user_id, canonical_id) reach.

    Walks follow relations of the user both ways, never return to their own path,
    and each query keeps its ``per_hop`` best states a hop. From one state at most ``per_hop`` edges
    can be among these, and its path meets at most ``hops`` - 1 others, each by at most ``per_hop`` edges that
    count; so the ``hops * per_hop`` best edges of an entity are all that is kept of it, and edges are sorted
    only of entities that a hop leaves from. Settings out of bounds
    (hops 1 to 4, decay 0.1 to 1, confidence 0 to 1) count as the nearest bound.
    """
    hops, decay, least_confidence = clamped_int(hops, 1, 1, 4), clamped(decay, 0.8, 0.1), clamped(least_confidence, 0.5)
    per_hop = clamped_int(per_hop, 200)
    seeds = checkpointed(seeds.select("query_id", "user_id", "canonical_id"))  # read for users and for states
    usable = usable_edges(relations.join(small(seeds.select("user_id").distinct(), "user_id"), "user_id", "left_semi"), least_confidence)
    if hops > 1:
        usable = checkpointed(usable)  # read in each hop
    states = seeds.select("query_id", "user_id", F.col("canonical_id").alias("node"), F.array("canonical_id").alias("path"), F.lit(1.0).alias("score"))
    found = None
    for hop in range(1, hops + 1):
        near = best_edges(usable, hops * per_hop, per_hop, states.select("user_id", "node").distinct())
        ahead = F.slice(F.filter("edges", lambda e: ~F.array_contains("path", e["to"])), 1, per_hop)
        grown = states.join(near, ["user_id", "node"]).select("query_id", "user_id", "path", "score", F.explode(ahead).alias("e"))
        score = F.col("score") * decay + -F.col("e.loss") * decay**hop
        grown = grown.select("query_id", "user_id", F.col("e.to").alias("node"), F.concat("path", F.array("e.to")).alias("path"), score.alias("score")).where(F.col("score") >= least_score)
        states = ranked(grown, ["query_id"], F.desc("score"), "node", "path").where(F.col("rank") <= per_hop).drop("rank")
        if hop < hops:
            states = checkpointed(states)  # read for the entities that the next hop leaves from, for its states and for the result
        part = states.select("query_id", F.col("node").alias("canonical_id"), "score")
        found = part if found is None else found.union(part)
    return found.groupBy("query_id", "canonical_id").agg(F.max("score").alias("score"))


def expand_graph(seeds: DataFrame, topics: DataFrame, facts: DataFrame, links: DataFrame, relations: DataFrame, memories: DataFrame, limit: int = 20, **params) -> DataFrame:
    """Memories that topics, facts and related entities lead to from seeds (query_id, user_id, id): id and score.

    ``limit`` bounds the seed topics, and twice it the seed facts, of each query; a column
    ``budget`` of the seeds, constant in a query, takes its place. Both take the latest, as the tables order them.
    """
    budget = F.greatest(F.lit(1), F.col("budget")) if "budget" in seeds.columns else F.lit(clamped_int(limit, 20))
    users = seeds.select("query_id", "user_id", budget.alias("budget")).distinct()
    seeds = seeds.select("query_id", "user_id", "id")
    most = users.agg(F.max("budget")).first()[0] or 1
    seed_topics = latest_topics(topics, seeds, most).join(users.select("query_id", "budget"), "query_id").where(F.col("rank") <= F.col("budget")).drop("rank")
    seed_facts = ranked(seed_topics.select("query_id", "user_id", "topic_id", "budget").join(facts.select("user_id", "topic_id", F.col("id").alias("fact_id"), "confidence", "occurred_start"), ["user_id", "topic_id"]), ["query_id"], F.desc_nulls_last("confidence"), F.desc_nulls_last("occurred_start"), "fact_id").where(F.col("rank") <= 2 * F.col("budget"))
    start = seed_facts.join(links, "fact_id").select("query_id", "user_id", "canonical_id").distinct()
    entities = walk(start, relations, **params)
    own = facts.select("user_id", F.col("id").alias("fact_id"), "topic_id")
    reached = entities.join(users.drop("budget"), "query_id").join(links, "canonical_id").join(own, ["user_id", "fact_id"]).groupBy("query_id", "user_id", "topic_id").agg(F.max("score").alias("score"))
    flat = topics.select("user_id", F.col("id").alias("topic_id"), F.explode("dialogue_ids").alias("id"))
    out = reached.join(flat, ["user_id", "topic_id"]).groupBy("query_id", "user_id", "id").agg(F.max("score").alias("score")).join(memories.select("id", "user_id"), ["id", "user_id"], "left_semi")
    return out.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", S.clamp(F.col("score")).alias("score"))


def graph_batches(memories: DataFrame, users: DataFrame, warm: int = 30, least: int = 10, most: int = 100, cold: bool = False) -> DataFrame:
    """The oldest pending memories of active users with enough of them: ``warm`` or more, or in a cold pass between ``least`` and ``warm``."""
    pending = memories.join(users.where("status = 1").select(F.col("id").alias("user_id")), "user_id", "left_semi")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    pending = pending.withColumn("pending", n).where((F.col("pending") > least) & (F.col("pending") < warm) if cold else F.col("pending") >= warm)
    return ranked(pending, ["user_id"], "created_at", "id").where(F.col("rank") <= most)


def canonicalise(mentions: DataFrame, canonical: DataFrame, block: Column | None = None) -> DataFrame:
    """Canonical entity of each mention (user_id, text, entity_type, v): equal key, else the nearest one that is near enough, else a new one.

    A key without an entity of its own takes the nearest entity of any of its
    mentions. Keys that are left are grouped where their mentions are near enough to
    one another, and each group is a new entity, named by its least key. ``block``
    (of the mentions, constant in a key) bounds which left keys are compared; by
    default all of a user and type are.
    """
    m = mentions.withColumn("key", entity_key(F.col("entity_type"), F.col("text"))).withColumn("block", F.col("entity_type") if block is None else block)
    c = canonical.withColumn("key", entity_key(F.col("entity_type"), F.col("name")))
    same = c.groupBy("user_id", "key").agg(F.min("id").alias("same_id"))
    open_ = m.join(same, ["user_id", "key"], "left_anti").select("user_id", "block", F.col("key").alias("id"), "v").distinct()
    near = pairs.nearest(open_.drop("block"), c.select("user_id", "id", "v"), ["user_id"], C.CANONICAL_SIMILARITY, own=True)
    best = checkpointed(near.select("user_id", F.col("id").alias("key"), F.col("to").alias("near_id")))  # read for what is left and for the result
    left = open_.join(best.withColumnRenamed("key", "id"), ["user_id", "id"], "left_anti")
    groups = least_of_group(pairs.links(left, ["user_id", "block"], C.CANONICAL_SIMILARITY).select("user_id", "a", "b").distinct())
    new = F.concat(F.lit("e"), F.sha2(F.concat("user_id", F.lit("|"), F.coalesce("group", "key")), 256).substr(1, 24))
    out = m.join(same, ["user_id", "key"], "left").join(best, ["user_id", "key"], "left").join(groups, ["user_id", "key"], "left")
    return out.withColumn("canonical_id", F.coalesce("same_id", "near_id", new)).withColumn("is_new", F.coalesce("same_id", "near_id").isNull()).drop("same_id", "near_id", "key", "group", "block")


def canonicalise_in_order(mentions: DataFrame, canonical: DataFrame, order: list[str]) -> DataFrame:
    """Like ``canonicalise``, but one mention after the other in ``order``, which is total within a user: each may join an entity that an earlier one began.

    A mention takes the entity of its key, stored or begun; else the most similar of all
    that are similar enough, the stored before those begun and the earlier of these on a
    tie; else it begins one. What is stored is joined as a table; only mentions that no stored key names
    are walked, a user's in one task, row by row: it keeps the vectors of the entities that the
    user has begun, not the mentions. Null vectors are like nothing.
    """
    m = mentions.withColumn("key", entity_key(F.col("entity_type"), F.col("text"))).withColumn("v", doubles(F.col("v")))
    c = canonical.withColumn("key", entity_key(F.col("entity_type"), F.col("name")))
    same = c.groupBy("user_id", "key").agg(F.min("id").alias("same_id"))
    named = m.join(same, ["user_id", "key"], "left")
    held = with_norm(c.where("v IS NOT NULL").select("user_id", F.col("id").alias("near_id"), F.col("v").alias("v2")), "v2", "n2")
    asked = with_norm(named.where("same_id IS NULL AND v IS NOT NULL").select("user_id", "v").distinct(), "v", "n")
    near = asked.join(held, "user_id").select("user_id", "v", "near_id", cosine(F.col("v"), F.col("v2"), (F.col("n"), F.col("n2"))).alias("s")).where(F.col("s") >= C.CANONICAL_SIMILARITY)
    best = near.groupBy("user_id", "v").agg(F.min(F.struct((-F.col("s")).alias("rank"), "near_id")).alias("best")).select("user_id", "v", "best.near_id", (-F.col("best.rank")).alias("near_s"))
    stored = named.where("same_id IS NOT NULL").select(*mentions.columns, F.col("same_id").alias("canonical_id"), F.lit(False).alias("is_new"))
    open_ = named.where("same_id IS NULL").drop("same_id").join(best, ["user_id", "v"], "left")

    columns = mentions.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, by_key, begun, ids, n = None, {}, np.zeros((0, 0)), [], 0
        for batch in batches:
            out, new = [], []
            for r in batch.itertuples():
                if r.user_id != user:
                    user, by_key, begun, ids, n = r.user_id, {}, np.zeros((0, 0)), [], 0
                v = None if r.v is None else np.asarray(r.v, np.float64)
                length = 0.0 if v is None else float(np.linalg.norm(v))
                unit = v / length if length else None
                found, fresh = by_key.get(r.key), True
                if found is None:
                    found, s, fresh = r.near_id if isinstance(r.near_id, str) else None, r.near_s if isinstance(r.near_id, str) else -1.0, False
                    if unit is not None and n and begun.shape[1] == len(unit):
                        like = begun[:n] @ unit
                        k = int(like.argmax())
                        if like[k] >= C.CANONICAL_SIMILARITY and like[k] > s:
                            found, fresh = ids[k], True
                if found is None:
                    found, fresh = "e" + hashlib.sha256(f"{user}|{r.key}".encode()).hexdigest()[:24], True
                    by_key[r.key] = found
                    if unit is not None and (not n or begun.shape[1] == len(unit)):
                        if n == len(begun):
                            begun = np.concatenate([begun.reshape(n, len(unit)), np.zeros((max(64, n), len(unit)))])
                        begun[n], n = unit, n + 1
                        ids.append(found)
                out.append(found)
                new.append(fresh)
            yield batch[columns].assign(canonical_id=out, is_new=new)

    bounded_batches(mentions.sparkSession)
    kinds = ", ".join(f"`{x}` {m.schema[x].dataType.simpleString()}" for x in mentions.columns)
    walked = open_.repartition("user_id").sortWithinPartitions("user_id", *order).mapInPandas(walk, f"{kinds}, canonical_id string, is_new boolean")
    return stored.unionByName(walked)


def least_of_group(links: DataFrame) -> DataFrame:
    """The least key (group) that links (user_id, a, b) lead to from each key, itself included.

    Each round a key takes the least of what its neighbours and their labels know,
    so labels travel twice as far as in the round before.
    """
    both = links.select("user_id", "a", "b").union(links.select("user_id", "b", "a")).distinct()
    both = checkpointed(both)
    labels = both.groupBy("user_id", F.col("a").alias("key")).agg(F.least(F.min("a"), F.min("b")).alias("group"))
    while True:
        labels = checkpointed(labels)  # each round reads the one before several times
        known = labels.select("user_id", F.col("key").alias("b"), F.col("group").alias("g"))
        reached = both.join(known, ["user_id", "b"]).groupBy("user_id", F.col("a").alias("key")).agg(F.min("g").alias("g"))
        up = labels.select("user_id", F.col("key").alias("group"), F.col("group").alias("above"))
        grown = labels.join(reached, ["user_id", "key"]).join(up, ["user_id", "group"], "left").select("user_id", "key", F.least("group", "g", "above").alias("group"))
        if labels.join(grown.withColumnRenamed("group", "now"), ["user_id", "key"]).where("`group` <> now").isEmpty():
            return labels
        labels = grown


def explore(seeds: DataFrame, links: DataFrame, facts: DataFrame, topics: DataFrame, relations: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around seeds (seed, and kind: entity, fact or topic; without it all are entities).

    An entity leads to related entities, to its facts and to their topics; a fact to
    its entities and its topic; a topic to its facts and to their entities. Each
    stage of a seed keeps its ``most`` first nodes; ``cut`` tells that it had more.
    Links may be repeated. Of links, facts and relations, only those that a stage asks for are
    shuffled, and what is found of them is kept once for nodes and edges.
    """
    most = clamped_int(most, 50)
    if "kind" not in seeds.columns:
        seeds = seeds.withColumn("kind", F.lit("entity"))
    seeds = seeds.select("seed", F.col("kind").alias("of")).distinct()

    def stage(rows: DataFrame, kind: str, k: int) -> DataFrame:
        """The first nodes of each seed, and the stage's number; the seed itself is no new node."""
        w = Window.partitionBy("seed", "of")
        rows = rows.select("seed", "of", "node").where(~((F.col("of") == kind) & (F.col("seed") == F.col("node")))).distinct()
        rows = rows.withColumns({"rank": F.row_number().over(w.orderBy("node")), "n": F.count(F.lit(1)).over(w)})
        return rows.where(F.col("rank") <= most).select("seed", "of", "node", F.lit(kind).alias("kind"), F.lit(k).alias("stage"), (F.col("n") > most).alias("cut"))

    topic_of = facts.select(F.col("id").alias("fact"), F.col("topic_id").alias("topic"))
    pairs = links.select(F.col("fact_id").alias("fact"), F.col("canonical_id").alias("entity"))
    end = lambda x, y: F.struct(F.col(x).alias("seed"), F.col(y).alias("node"))
    ends = relations.select(F.explode(F.array(end("source", "target"), end("target", "source"))).alias("e"), "edge_relation").select("e.*", "edge_relation")
    entity, fact, topic = (seeds.where(F.col("of") == kind) for kind in ("entity", "fact", "topic"))
    few, fact = small(entity, "seed"), checkpointed(fact)  # facts of seeds are read for topics, for entities and for edges

    def named(rows: DataFrame, column: str) -> DataFrame:
        return rows.withColumnRenamed(column, "node")

    related = checkpointed(few.join(ends, "seed").distinct())
    start = seeds.select("seed", "of", F.col("seed").alias("node"), F.col("of").alias("kind"), F.lit(0).alias("stage"), F.lit(False).alias("cut"))
    around = stage(related, "entity", 1)
    of_entities = checkpointed(stage(named(few.join(pairs, few["seed"] == pairs["entity"]), "fact"), "fact", 2))
    told = of_entities.select("seed", "of", F.col("node").alias("fact")).union(fact.select("seed", "of", "seed"))
    asked = told.select("fact").union(topic.select("seed"))
    topic_of = checkpointed(sieved(topic_of, asked, "fact", "topic").join(topics.select(F.col("id").alias("topic")), "topic", "left_semi"))
    of_topics = checkpointed(stage(named(topic.join(topic_of, topic["seed"] == topic_of["topic"]), "fact"), "fact", 2))
    fact_nodes = of_entities.union(of_topics)
    of_facts = told.join(topic_of, "fact")
    inner = of_topics.select("seed", "of", F.col("node").alias("fact")).union(fact.select("seed", "of", "seed"))
    in_facts = checkpointed(inner.join(sieved(pairs, inner.select("fact"), "fact"), "fact").distinct())
    inside = stage(named(in_facts, "entity"), "entity", 4)
    topic_nodes = stage(named(of_facts, "topic"), "topic", 3)
    nodes = reduce(DataFrame.union, [start, around, fact_nodes, topic_nodes, inside])

    def kept(edges: DataFrame, b: DataFrame) -> DataFrame:
        """Edges (seed, of, a, b, label) whose end is a node of the stage."""
        return edges.join(b.select("seed", "of", F.col("node").alias("b")), ["seed", "of", "b"], "left_semi").select("seed", "of", "a", "b", "label")

    edges = kept(related.select("seed", "of", F.col("seed").alias("a"), F.col("node").alias("b"), F.col("edge_relation").alias("label")), around)
    edges = edges.union(of_entities.select("seed", "of", "seed", "node", F.lit("MENTIONED_IN")))
    edges = edges.union(of_topics.select("seed", "of", F.col("node"), F.col("seed"), F.lit("IN_TOPIC")))
    edges = edges.union(kept(of_facts.select("seed", "of", F.col("fact").alias("a"), F.col("topic").alias("b"), F.lit("IN_TOPIC").alias("label")), topic_nodes))
    reached = kept(in_facts.select("seed", "of", F.col("fact").alias("a"), F.col("entity").alias("b"), F.lit("MENTIONED_IN").alias("label")), inside)
    return nodes, edges.union(reached.select("seed", "of", F.col("b"), F.col("a"), "label")).distinct()


__all__ = ["canonicalise", "entity_counts", "entity_pairs", "entity_topics", "expand_graph", "explore", "fact_entities", "facts_filter", "graph_batches", "infer_relations", "merge_relations", "page", "propagate_max", "relations_filter", "topic_memories", "topics_of", "walk"]
