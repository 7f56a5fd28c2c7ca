"""Sharding by histogram sort.

Documents are ordered by a key whose high bits hash the text, so equal texts lie
together, and whose low bits hash the id. Splitters that cut the order into
shards of equal bytes are found by counting exact bytes below candidate
boundaries across all partitions: each round probes finer boundaries, and only
within the buckets where a cut still misses its tolerance. A shard's cut stays
between two texts while that is within ``GROUP_TOLERANCE`` of a shard; a larger
group of copies is cut inside. Then rows are exchanged once, to pieces of a shard
that are numbered from the row counts of the same histogram.

Defined cases: null text has size 1 (no bytes, plus one), CRC 0 and a key of its
own; rows with equal ids and texts share a key and stay together; null ids are an
id; an empty table gives an empty result; long texts count whole. Columns of the
input that are named like a new one stay, with ``_`` behind their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, utf8_bytes

SHARDS = 8
NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
ID_BITS = 24
FIRST_SHIFT, SHIFTS = 48, (40, 32, 24, 16, 8, 0)
#: How far a cut may miss its place, in parts of a shard: at a boundary between texts, and of single documents.
GROUP_TOLERANCE, TOLERANCE = 0.025, 0.001
#: A piece is numbered in one task: at most about so many rows, and at least so many pieces a shard.
PIECE_ROWS, LEAST_PIECES = 2_000_000, 32
#: How far a cut between pieces may miss its place, in parts of a piece.
PIECE_TOLERANCE = 0.25


def size_of(text: Column) -> Column:
    return utf8_bytes(text) + 1


def key_of(text: Column, doc_id: Column) -> Column:
    """63 bits: 39 of the text's hash, 24 of the id's."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - 63 + ID_BITS), ID_BITS) + F.shiftrightunsigned(F.xxhash64(doc_id), 64 - ID_BITS)


class Cuts:
    """Splitters of the key order: piece k has the keys from ``keys[k - 1]`` up to ``keys[k]``, and ``rows[k]`` rows are below it."""

    def __init__(self, keys: list[int], rows: list[int], pieces: int, shards: int) -> None:
        self.keys, self.rows, self.pieces, self.shards = keys, rows, pieces, shards

    def offsets(self) -> list[int]:
        """For each piece, its shard's rows in earlier pieces."""
        below = [0, *self.rows]
        return [below[k] - below[k - k % self.pieces] for k in range(len(below))]


def _histogram(base: DataFrame, shift: int, within: tuple[int, list[int]] | None) -> pd.DataFrame:
    """Bytes and rows by bucket, the key without its last ``shift`` bits; only inside the given coarser buckets."""
    if within:
        coarse, buckets = within
        chosen = base.sparkSession.createDataFrame([(b,) for b in buckets], "bucket long")
        base = base.join(F.broadcast(chosen), F.shiftright("key", coarse) == chosen["bucket"], "left_semi")
    sums = base.groupBy(F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return sums.toPandas().sort_values("bucket", ignore_index=True)


def find_cuts(base: DataFrame, shards: int = SHARDS) -> Cuts:
    """Find the splitters; ``base`` has key and size. The driver holds at most 2^15 buckets, and 2^8 for each cut that is still open."""
    counts = _histogram(base, FIRST_SHIFT, None)
    total, n = int(counts["size"].sum()), int(counts["n"].sum())
    pieces = max(LEAST_PIECES, -(-n // (shards * PIECE_ROWS)))
    count = shards * pieces
    done: dict[int, tuple[int, int]] = {}
    #: Open cuts: the bucket they lie in, and bytes and rows below it.
    open_ = {k: (0, 0, 0) for k in range(1, count)} if n else {}
    shift, before = FIRST_SHIFT, 63
    for finer in (*SHIFTS, None):
        buckets, sizes, rows = (counts[c].to_numpy(np.int64) if len(counts) else np.zeros(0, np.int64) for c in ("bucket", "size", "n"))
        parents = buckets >> (before - shift)
        still = {}
        for k, (parent, below, below_n) in open_.items():
            place = k * total / count
            lo, hi = np.searchsorted(parents, [parent, parent + 1])
            sums = below + np.cumsum(sizes[lo:hi])
            i = min(int(np.searchsorted(sums, place, side="right")), hi - lo - 1)
            at = below if i == 0 else int(sums[i - 1])
            at_n = below_n + int(rows[lo : lo + i].sum())
            bucket, end, end_n = int(buckets[lo + i]), int(sums[i]), at_n + int(rows[lo + i])
            miss, edge = min((abs(place - at), (bucket << shift, at_n)), (abs(place - end), ((bucket + 1) << shift, end_n)))
            outer = k % pieces == 0
            allowed = (GROUP_TOLERANCE if shift == ID_BITS else TOLERANCE) * total / shards if outer else PIECE_TOLERANCE * total / count
            if miss <= allowed or finer is None:
                done[k] = edge
            else:
                still[k] = (bucket, at, at_n)
        open_ = still
        if not open_ or finer is None:
            break
        counts = _histogram(base, finer, (shift, sorted({b for b, _, _ in open_.values()})))
        before, shift = shift, finer
    keys, rows_below = [], []
    for k in range(1, count):
        edge = done.get(k, (0, 0))
        if k % pieces:  # a piece's cut stays inside its shard and after the one before
            edge = max(edge, done.get(k - k % pieces, (0, 0)), (keys[-1], rows_below[-1]) if keys else (0, 0))
            edge = min(edge, done.get(k - k % pieces + pieces, edge))
        keys.append(edge[0])
        rows_below.append(edge[1])
    return Cuts(keys, rows_below, pieces, shards)


def _piece(cuts: Cuts):
    keys = np.array(cuts.keys, dtype=np.int64)

    @F.pandas_udf("int")
    def piece(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for key in batches:
            yield pd.Series(np.searchsorted(keys, key.to_numpy(np.int64), side="right").astype(np.int32))

    return piece


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to every row of ``docs`` (doc_id, text)."""
    taken = {c.lower() for c in docs.columns} | set(NEW)
    for c in docs.columns:
        if c.lower() in NEW:
            name = c
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            docs = docs.withColumnRenamed(c, name)
    text, doc_id = docs["text"], docs["doc_id"]
    keyed = docs.withColumns({"size": size_of(text), "text_crc32": F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long"), "shard": key_of(text, doc_id)})
    return numbered(keyed, shards, docs.columns)


def numbered(keyed: DataFrame, shards: int, keep: list[str]) -> DataFrame:
    """Exchange rows once; ``keyed`` has size, text_crc32 and, as ``shard``, the key."""
    cuts = find_cuts(checkpointed(keyed.select(F.col("shard").alias("key"), "size")), shards)
    piece, offset = fresh(keyed, "piece"), fresh(keyed, "offset")
    order = Window.partitionBy(piece).orderBy("shard", "doc_id", "text_crc32", "size")
    rows = keyed.withColumn(piece, _piece(cuts)(F.col("shard"))).withColumn("slot", F.row_number().over(order))
    # One row a piece; pieces have millions of rows, so these are few.
    offsets = keyed.sparkSession.createDataFrame(list(enumerate(cuts.offsets())), f"{piece} int, {offset} long")
    return rows.join(F.broadcast(offsets), piece).select(
        *keep,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col(piece) / cuts.pieces).cast("int").alias("shard"),
        (F.col(offset) + F.col("slot") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard. Texts are left behind before the exchange."""
    text = F.col("text")
    keyed = docs.select("doc_id", size_of(text).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), key_of(text, F.col("doc_id")).alias("shard"))
    return numbered(keyed, shards, ["doc_id"])
