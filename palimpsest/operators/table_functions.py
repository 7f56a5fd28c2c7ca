"""Chunks and sections as table functions, for SQL with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..storage import bounded_batches
from .ingest import SECTION_CHARS, chunks_of, sections_of


class ChunkText:
    """``chunk_text(text, target, overlap)``: the rows of ``ingest.chunk``; a null text is one empty chunk."""

    def eval(self, text: str | None, target: int = 128, overlap: float = 0.1) -> Iterator[tuple]:
        for i, (chunk, start, end, tokens) in enumerate(chunks_of(text or "", target, float(overlap))):
            yield i, chunk, start, end, tokens


class SectionText:
    """``section_text(text, size)``: the rows of ``ingest.sections``."""

    def eval(self, text: str | None, size: int = SECTION_CHARS) -> Iterator[tuple]:
        found = sections_of(text or "", size)
        for i, section in enumerate(found):
            yield i, section, len(found)


def register(spark: SparkSession) -> SparkSession:
    """Make ``chunk_text`` and ``section_text`` known to the session's SQL; rows reach Python in Arrow batches."""
    bounded_batches(spark)
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_index int, chunk string, `start` int, `end` int, tokens int", useArrow=True))
    spark.udtf.register("section_text", udtf(SectionText, returnType="section_index int, section string, total_sections int", useArrow=True))
    return spark
