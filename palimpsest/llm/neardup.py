"""Near-duplicate detection: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full sets.

A document's set is its distinct 4-word shingles. Documents with equal sets form
a class at once. A class has a signature of ``SLOTS`` minima, ``BITS`` bits each;
the first ``CHUNKS * CHUNK_SLOTS`` slots are split into chunks. Two signatures
that differ in at most ``GUARANTEED`` of these slots have, by pigeonhole, a chunk
with at most one error, and each chunk is indexed once for every slot that may be
wrong, so such pairs always meet in a bucket: ``GUARANTEED`` is the threshold of the join.
(A pair that is just similar enough, at 0.8, is beyond it and in no bucket with a
chance of about 2 in 100 000; above 0.8, less.) What meets is decided by exact
intersection of the shingle sets. Before that, pairs go that differ in more than
``MAX_DISTANCE`` slots of the whole signature, or in more than ``SKETCH_DISTANCE`` of a
finer sketch: at 0.8 a chance of less than one in 10^11. ``exact`` leaves both out.

No bucket is expanded into all its pairs. First each class is compared with one
other: of the members that lead its buckets (those in the largest company, as the
original of many copies is) the one it shares most buckets with. That joins large
groups of copies by one link a member. Then, within buckets, only members of
different components are compared, the members outside the bucket's largest
component with all others, in blocks of bounded size: by the sizes of their sets
and the shingles that no other class in question has, by a finer sketch, and by
their sets cut to 32 bits, which lose no link. Where these members are very many
(documents that share a passage but are not alike) they too are dealt into parts, and
each two parts meet in a block of their own, so that every pair of a bucket is compared.

Defined cases: a document without words has an empty set, no links, and is its own
component; one with fewer than four words has the whole sequence as its only
shingle; each row is judged by its own text, whatever ids repeat; a null id is
never the smallest, and kept if its component has no other; an empty table gives an
empty result; long texts are read whole; other columns stay with the rows that are
kept, whatever their names. Classes and shingles are known by 64-bit hashes.

Each text is cut into shingles once; the sets are kept as a table until the links are
decided. Joins on what many pairs share (a bucket, or the original of many copies)
deal its rows over parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import BitFilter, Kept, WordHashes, bounded, fresh, slices

SHINGLE = 4
#: Links are pairs with 100 * intersection >= PERCENT * union.
PERCENT = 80
SLOTS, BITS = 128, 16
CHUNKS, CHUNK_SLOTS = 8, 5
GUARANTEED = 2 * CHUNKS - 1
MAX_DISTANCE = 64
#: For classes that share a bucket with others, a finer sketch: slots of 8 bits, and in how many a link may differ.
SKETCH, SKETCH_DISTANCE = 512, 170
#: Members outside a bucket's largest component, and members of that component, in one block.
SPREAD, BLOCK = 1024, 1024
#: Rows of one key that a task joins.
HOT = 2048
#: Keys with so many rows that are sent to every task.
BROADCAST_ROWS = 200_000
#: Shingles hashed at a time for a signature.
PART = 1024
#: Texts unpacked and sets sketched at a time.
SKETCHED = 512

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None], hashes: WordHashes, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    out = []
    for part in slices([t or "" for t in texts]):
        found = [t.encode().lower().split() for t in part]
        words = np.fromiter((h for w in found for h in map(hashes.__getitem__, w)), np.uint64)
        at = 0
        for w in found:
            own = words[at : at + len(w)]
            at += len(w)
            width = min(size, len(w))
            n = len(w) - width + 1 if width else 0
            h = np.full(n, width, np.uint64)
            for k in range(width):
                h = _mixed(h + own[k : k + n])
            out.append(np.unique(h))
        hashes.trim()
    return out


def minima(shingles: np.ndarray, slots: int) -> np.ndarray:
    least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), PART):
        least = np.minimum(least, (shingles[i : i + PART] * _FACTORS[:slots, None] + _TERMS[:slots, None]).min(axis=1))
    return _mixed(least)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SLOTS`` minima, ``BITS`` bits of each."""
    return (minima(shingles, SLOTS) >> np.uint64(64 - BITS)).astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    return (minima(shingles, SKETCH) >> np.uint64(56)).astype(np.uint8)


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of the first key that each row of ``a`` has in common with ``b``; -1 if there is none."""
    same = (a[:, : CHUNKS * CHUNK_SLOTS] == b[: CHUNKS * CHUNK_SLOTS]).reshape(len(a), CHUNKS, CHUNK_SLOTS)
    near = same.sum(2) >= CHUNK_SLOTS - 1
    chunk = near.argmax(1)
    # In that chunk the slot that differs; the first if all agree.
    wrong = same[np.arange(len(a)), chunk].argmin(1)
    return np.where(near.any(1), chunk * CHUNK_SLOTS + wrong, -1)


def bucket_keys(signatures: np.ndarray, chunks: np.ndarray | None = None) -> np.ndarray:
    """For each signature (a row) a key for each chunk and each slot of it that may be wrong."""
    parts = signatures[:, : CHUNKS * CHUNK_SLOTS].reshape(len(signatures), CHUNKS, CHUNK_SLOTS).astype(np.uint64)
    out = []
    for c in range(CHUNKS):
        for wrong in range(CHUNK_SLOTS):
            key = np.full(len(parts), 1 + c * CHUNK_SLOTS + wrong, np.uint64)
            for k in range(CHUNK_SLOTS):
                if k != wrong:
                    key = _mixed(key + parts[:, c, k] * _ODD + np.uint64(1))
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def _unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), SLOTS)


def with_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and ``class`` (hash of the set, null if it is empty), n_shingles, signature and shingles.

    A task gives the shingles of each class once, and null for its other rows.
    """
    others = [c for c in docs.columns if c != text]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            rest, at = batch.select(others), 0
            texts = (t or "" for k in range(0, len(batch), SKETCHED) for t in batch.column(text).slice(k, SKETCHED).to_pylist())
            for part in slices(texts):
                sets = shingle_sets(part, hashes)
                sizes = pa.array([len(x) for x in sets], pa.int64())
                signatures = pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary())
                classes = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) if len(x) else None for x in sets]
                given = [x if c is not None and not (c in seen or seen.add(c)) else None for c, x in zip(classes, sets, strict=True)]
                ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in given])])
                values = np.concatenate([x for x in given if x is not None] or [np.zeros(0, np.uint64)]).view(np.int64)
                shingles = pa.ListArray.from_arrays(pa.array([None if x is None else int(e) for x, e in zip(given, ends, strict=False)] + [int(ends[-1])], pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([*rest.slice(at, len(part)).columns, pa.array(classes, pa.int64()), sizes, signatures, shingles], [*others, "class", "n_shingles", "signature", "shingles"])
                at += len(part)

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    return bounded(docs).mapInArrow(sign, ", ".join([*kinds, "class long", "n_shingles long", "signature binary", "shingles array<long>"]))


def _keyed(classes: DataFrame, carry: list[str]) -> DataFrame:
    """One row for each bucket key of each row of ``classes``; ``place`` counts the keys of a signature."""

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(bucket_keys(_unpacked(s)))) if len(s) else pd.Series([], dtype=object)

    return classes.select(F.posexplode(keys("signature")).alias("place", "key"), *carry)


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series((_unpacked(a) != _unpacked(b)).sum(1).astype(np.int32) if len(a) else [], dtype="int32")


def _comparable(a: Column, b: Column) -> Column:
    """Sizes that a link allows."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _hot(counts: DataFrame, key: str, kept: Kept) -> DataFrame:
    """Of ``counts`` (key, n) the keys with more than ``HOT`` rows, and how many parts these are dealt over."""
    return kept.table(counts.where(F.col("n") > HOT).select(key, F.ceil(F.col("n") / HOT).cast("int").alias("__parts")))


def _dealt_join(rows: DataFrame, side: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a ``key``. Rows of ``hot`` keys are dealt over parts by ``by``."""
    n = hot.count()
    if not n:
        return rows.join(side, key)
    hot = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts.cast("long")).cast("int")).drop("__parts")
    repeated = side.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(repeated, [key, "__part"]).drop("__part")


def _close(pairs: DataFrame, classes: DataFrame, exact: bool, kept: Kept) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures can belong to a link; many pairs may have the same a."""
    a, b = (classes.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "ab")
    hot = _hot(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a", kept)
    both = _dealt_join(pairs.join(b, "b"), a, "a", "b", hot).where(_comparable(F.col("na"), F.col("nb")))
    return (both if exact else both.where(_distance("sa", "sb") <= MAX_DISTANCE)).select("a", "b")


def sets_of(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Shingle sets (class, shingles) of ``classes`` (class), one row a class.

    A filter of bounded size keeps most other sets from being shuffled.
    """
    wanted = BitFilter.of(classes, "class")

    @F.pandas_udf("boolean")
    def may_be(c: pd.Series) -> pd.Series:
        return pd.Series(wanted.has(c.to_numpy(np.int64)))

    found = members.where("shingles IS NOT NULL").select("class", "shingles").where(may_be("class")).dropDuplicates(["class"])
    return found.join(classes, "class", "left_semi")


def linked(pairs: DataFrame, sets: DataFrame, kept: Kept) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) that are links, by their full sets."""
    a, b = (sets.select(F.col("class").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    hot = {x: _hot(pairs.groupBy(x).agg(F.count(F.lit(1)).alias("n")), x, kept) for x in "ab"}
    return _dealt_join(_dealt_join(pairs, b, "b", "a", hot["b"]), a, "a", "b", hot["a"]).where(both * 100 >= (F.size("sa") + F.size("sb") - both) * PERCENT).select("a", "b")


def with_shared(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``n_shared``, the shingles of a class that another of the given sets has too, its sketch, and ``short``, its set cut to 32 bits. Classes that cannot be in a link go."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SKETCHED):
                part = batch.slice(at, SKETCHED)
                found = [np.asarray(x.values).view(np.uint64) for x in part.column("shingles")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), pa.array([sketch(x).tobytes() for x in found], pa.binary()), pa.array([np.unique(x.astype(np.uint32)).tobytes() for x in found], pa.binary())],
                    ["class", "sketch", "short"],
                )

    alone = sets.select("class", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("class")).where("n = 1")
    n = alone.groupBy("class").agg(F.count(F.lit(1)).alias("alone"))
    out = classes.join(sets.select("class", "shingles").mapInArrow(sketched, "class long, sketch binary, short binary"), "class").join(n, "class", "left")
    return out.withColumn("n_shared", F.col("n_shingles") - F.coalesce("alone", F.lit(0))).drop("alone").where(F.col("n_shared") * 100 >= F.col("n_shingles") * PERCENT)


def components(links: DataFrame, kept: Kept) -> DataFrame:
    """Label the nodes of ``links`` (a, b) with the least node of their component: alternating large and small stars."""

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.select(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = kept.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while (now := state(edges)) != before:
        before = now
        # Large star: each neighbour above a node is hung on the node's least neighbour (or itself).
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its lower neighbours are hung on the least of these.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        lower = edges.join(least, "u")
        edges = kept.table(lower.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return edges.select(F.col("u").alias("class"), F.col("v").alias("label"))


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``label`` by ``class``; a class without links is its own label."""
    return df.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))


def _across(rows: DataFrame, classes: DataFrame, hot: DataFrame, exact: bool = False) -> DataFrame:
    """Close pairs of different labels from bucket rows (key, place, class, label).

    Members outside a bucket's largest component are dealt into parts (one, if ``SPREAD`` holds them), those of it into
    blocks. Cell (p, q) compares part p with part q, from p on, and with block q.
    """
    by_label = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    by_key = by_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("members")).where("labels > 1")
    spread = F.col("members") - F.col("most.n")
    parts = F.when(spread <= SPREAD, 1).otherwise(F.ceil(spread / max(1, SPREAD // 2)))  # a cell holds two parts
    by_key = by_key.select("key", F.col("most.label").alias("main"), parts.cast("int").alias("parts"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("blocks"))
    in_main = F.col("label") == F.col("main")
    part = F.pmod(F.xxhash64("class"), F.when(in_main, F.col("blocks")).otherwise(F.col("parts")).cast("long")).cast("int")
    marked = _dealt_join(rows, by_key, "key", "class", hot).withColumn("part", part)
    of_main = F.expr("transform(sequence(0, parts - 1), p -> struct(p AS p, part AS q))")
    first = F.expr("transform(filter(sequence(0, greatest(parts, blocks) - 1), q -> q < blocks OR q >= part), q -> struct(part AS p, q AS q))")
    second = F.expr("transform(filter(sequence(0, part), p -> p < part), p -> struct(p AS p, part AS q))")
    cells = F.explode(F.when(in_main, of_main).otherwise(F.concat(first, second)))
    dealt = marked.join(classes, "class").select("key", cells.alias("cell"), "part", "class", "place", "label", "main", "n_shingles", "n_shared", "signature", "sketch", "short")
    dealt = dealt.select("key", "cell.p", "cell.q", *dealt.columns[2:])
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "class")
    return dealt.mapInPandas(lambda batches: _pairs_in_blocks(batches, exact), "a long, b long").distinct()


def _pairs_in_blocks(batches: Iterator[pd.DataFrame], exact: bool) -> Iterator[pd.DataFrame]:
    """Rows come sorted by block; a block's rows are few (``BLOCK`` and ``SPREAD``) and may run over batches."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rest):
            continue
        last = (rest[["key", "p", "q"]] == rest[["key", "p", "q"]].iloc[-1]).all(axis=1)
        full, rest = rest[~last], rest[last]
        yield from _pairs(full, exact)
    if rest is not None:
        yield from _pairs(rest, exact)


def _pairs(rows: pd.DataFrame, exact: bool) -> Iterator[pd.DataFrame]:
    if not len(rows):
        return
    signatures, ids, labels, sizes = _unpacked(rows["signature"]), rows["class"].to_numpy(), rows["label"].to_numpy(), rows["n_shingles"].to_numpy()
    shared, places = rows["n_shared"].to_numpy(), rows["place"].to_numpy()
    short = [np.frombuffer(x, np.uint32) for x in rows["short"]]
    sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), SKETCH)
    main, part = rows["main"].to_numpy(), rows["part"].to_numpy()
    cell = np.stack([rows[x].to_numpy() for x in ("key", "p", "q")])
    edges = np.concatenate([[0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1, [len(ids)]])
    a, b = [], []
    for lo, hi in zip(edges, edges[1:], strict=False):
        p, q = cell[1:, lo]
        in_main = labels[lo:hi] == main[lo:hi]
        for i in np.flatnonzero(~in_main & (part[lo:hi] == p)) + lo:
            # A pair of one part counts once, as does a pair of two parts, which meet only here.
            j = np.flatnonzero(in_main | ((part[lo:hi] == q) & ((ids[lo:hi] > ids[i]) | (p < q)))) + lo
            most = np.minimum(shared[j], shared[i])
            j = j[(labels[j] != labels[i]) & (100 * most >= PERCENT * (sizes[j] + sizes[i] - most))]
            j = j[first_common(signatures[j], signatures[i]) == places[i]]  # a pair counts in the first bucket that it shares
            if not exact:
                j = j[(sketches[j] != sketches[i]).sum(1) <= SKETCH_DISTANCE]
            # What the cut sets share is at least what the sets do, but for shingles that fell together.
            both = np.array([np.intersect1d(short[i], short[k], assume_unique=True).size + min(sizes[i] - len(short[i]), sizes[k] - len(short[k])) for k in j], np.int64)
            j = j[100 * both >= PERCENT * (sizes[j] + sizes[i] - both)]
            a.append(np.minimum(ids[i], ids[j]))
            b.append(np.maximum(ids[i], ids[j]))
    if a:
        yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()


def class_labels(classes: DataFrame, members: DataFrame, kept: Kept, exact: bool = False) -> DataFrame:
    """Component labels of ``classes`` (class, n_shingles, signature); classes without links are left out. ``members`` has their sets (class, shingles)."""
    keys = _keyed(classes, ["class"])
    sizes = kept.table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    hot = _hot(sizes.withColumnRenamed("members", "n"), "key", kept)
    keys = kept.table(_dealt_join(keys, sizes, "key", "class", hot).select("key", "class", "members", "place"))
    company = keys.groupBy("class").agg(F.sum("members").alias("company"))
    led = keys.select("key", "class").join(company, "class")
    leads = led.groupBy("key").agg(F.max(F.struct("company", "class")).alias("lead")).select("key", F.col("lead.class").alias("lead"))
    shared = _dealt_join(led.select("key", "class"), leads, "key", "class", hot).where("class <> lead").groupBy("lead", "class").agg(F.count(F.lit(1)).alias("n"))
    first = shared.groupBy(F.col("class").alias("b")).agg(F.max(F.struct("n", F.col("lead").alias("a"))).alias("best")).select("best.a", "b")
    first = kept.table(first)
    # Two that are each other's choice are one pair; which end is shared by many does not change.
    first = kept.table(_close(first, classes, exact, kept).groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min("a").alias("a"), F.min_by("b", "a").alias("b")).select("a", "b"))
    links = [kept.table(linked(first, sets_of(_ends(first), members), kept))]
    labels = components(links[0], kept)
    rows = _labelled(keys.select("key", "class", "place"), labels)
    several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rows = kept.table(_dealt_join(rows, several, "key", "class", hot))
    sets = kept.table(sets_of(rows.select("class").distinct(), members), hashes=True)
    able = kept.table(with_shared(classes, sets), hashes=True)
    rows = rows.join(able.select("class"), "class", "left_semi")
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = kept.table(_across(rows, able, hot, exact)).join(done, ["a", "b"], "left_anti")
    links.append(kept.table(linked(more, sets, kept)))
    return labels if links[1].isEmpty() else components(reduce(DataFrame.union, links), kept)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()


def with_components(docs: DataFrame, exact: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, class, n_shingles, label (of the component) and component_id."""
    kept, work = Kept(docs.sparkSession), Kept(docs.sparkSession)
    signed = work.table(with_sets(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")), hashes=True)
    members = signed.select("doc_id", "text_hash", "class", "n_shingles")
    classes = work.table(signed.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")))
    labels = class_labels(classes.drop("least"), signed, work, exact)
    by_class = _labelled(classes.select("class", "least"), labels)
    by_label = by_class.groupBy("label").agg(F.min("least").alias("component_id"))
    named = by_class.join(by_label, "label").select("class", "label", "component_id")
    found = members.join(named, "class", "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    found = kept.table(found.select("doc_id", "text_hash", "class", "n_shingles", "label", "component_id"))
    work.drop()
    return found


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    found = with_components(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, one with the least id, and all rows without words."""
    found = with_components(docs).where(F.col("class").isNotNull())
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("r")).select("r.*")
    no_id, doc_id, text_hash, row = (fresh(docs, f"near_{x}") for x in ("no_id", "id", "text", "row"))
    key = [F.col(no_id), F.col(doc_id), F.col(text_hash)]
    kept = first.select(F.col("no_id").alias(no_id), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(doc_id), F.col("text_hash").alias(text_hash))
    words = F.length(F.trim(F.translate(F.col("text"), "\t\n\x0b\x0c\r", "     "))) > 0
    keyed = docs.withColumns({no_id: F.col("doc_id").isNull(), doc_id: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_hash: F.xxhash64("text")})
    chosen = keyed.where(words).join(kept, [no_id, doc_id, text_hash])
    chosen = chosen.withColumn(row, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))).where(F.col(row) == 1)
    return chosen.select(docs.columns).union(docs.where(~F.coalesce(words, F.lit(False))))
