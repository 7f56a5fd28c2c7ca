"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bounded_batches, checkpointed, shared_folder

#: Texts handed to numpy at a time, in characters; one longer text is a slice of its own.
SLICE_CHARS = 250_000
#: Bytes of a row group of a table of hashes.
HASH_GROUP = 16 << 20

__all__ = ["BitFilter", "Kept", "WordHashes", "bounded", "checkpointed", "fresh", "shared_folder", "slices", "table", "utf8_bytes"]


class Kept:
    """Tables of a step in the shared folder: columns compressed, sizes known. They are removed as soon as ``drop`` says so, or when the program ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []
        atexit.register(self.drop)

    def table(self, df: DataFrame, hashes: bool = False) -> DataFrame:
        """Cut the lineage with a table. ``hashes`` says that rows are wide and mostly hashes: small row groups, and no compression, which has large buffers outside the heap and nothing to gain."""
        path = f"{shared_folder(self.spark)}/palimpsest-{uuid.uuid4().hex}"
        write = df.write.option("compression", "none").option("parquet.block.size", HASH_GROUP) if hashes else df.write
        write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            with contextlib.suppress(Exception):  # the session may be over
                jvm = self.spark.sparkContext._jvm
                at = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class WordHashes(dict):
    """64-bit hashes of words already met."""

    MOST = 50_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        """Start anew once the table is large; called between texts."""
        if len(self) > self.MOST:
            self.clear()


class BitFilter:
    """Which 64-bit numbers may be among a set: one bit for each remainder, in a bounded number of bytes. It never denies a member."""

    MOST_BITS = 1 << 27

    def __init__(self, bits: int, shared) -> None:
        self.bits, self.shared = bits, shared

    @classmethod
    def of(cls, df: DataFrame, column: str) -> BitFilter:
        """Of the numbers of a column, sent to all tasks."""
        bits = min(cls.MOST_BITS, 1 << max(15, (16 * df.count()).bit_length()))
        bit = F.pmod(F.col(column), F.lit(bits)) + 1
        rows = df.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
        mask = np.zeros(bits // 8, np.uint8)
        for r in rows:
            mask[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
        return cls(bits, df.sparkSession.sparkContext.broadcast(mask))

    def has(self, numbers: np.ndarray) -> np.ndarray:
        at = np.mod(numbers, self.bits)
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """``df`` as it is, in a session that hands rows to Python in batches of bounded bytes and not of 10 000 rows of any length."""
    bounded_batches(df.sparkSession)
    return df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever case is used."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def utf8_bytes(text: Column) -> Column:
    """Length in UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def slices(texts: Iterable[str]) -> Iterator[list[str]]:
    """Cut a batch into runs of at most ``SLICE_CHARS`` characters, so that memory is bounded by the longest text."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > SLICE_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
