"""Documents and chat turns into memories."""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..storage import bounded_batches

#: Token count from which a document gets a root and sections; characters of a section and of a root's summary.
LARGE_TOKENS, SECTION_CHARS, SUMMARY_CHARS = 200, 150, 200
MARKS = ".!?;。！？；"
_CJK_OR_OTHER = re.compile(r"[^\x00-\x7F\s]")
_PIECE = re.compile(rf"[^{MARKS}\n]*[{MARKS}\n]?")
_SENTENCE = re.compile(r"(?<=[.;!?。；！？])\s*")


class _Text(html.parser.HTMLParser):
    """Text of a page without scripts and styles; block elements end lines."""

    BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article header footer ul ol table".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.muted = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.muted += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.muted -= tag in ("script", "style") and self.muted > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.parts.append(data)


def _plain(page: str | None) -> str | None:
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    return "\n".join(line for x in "".join(parser.parts).split("\n") if (line := " ".join(x.split())))


def html_to_text(df: DataFrame, col: str) -> DataFrame:
    """Add text, method and original_length."""

    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_plain)

    return df.withColumns({"text": run(F.col(col)), "method": F.lit("html"), "original_length": F.char_length(col)})


def text_documents(df: DataFrame, col: str) -> DataFrame:
    """Trimmed text with its length and an estimate of its tokens."""
    body = F.trim(F.coalesce(F.col(col), F.lit("")))
    return df.withColumns({"body": body, "length": F.char_length(body), "estimated_tokens": T.estimate_tokens(body)})


def token_estimate(text: str) -> int:
    """As ``text.estimate_tokens``."""
    return len(re.sub(r"[^\x00-\x7F]", " ", text).split()) + len(_CJK_OR_OTHER.findall(text))


def chunks_of(text: str, target: int = 128, overlap: float = 0.1) -> list[tuple[str, int, int, int]]:
    """(text, start, end, tokens) of chunks of about ``target`` tokens, made of sentences; each begins with the last tenth of the one before."""
    total = token_estimate(text)
    if total <= target:
        return [(text, 0, len(text), total)]
    sample = text[:1000]
    room = target * (len(sample) / (token_estimate(sample) or len(sample) / 4))
    shared = int(room * overlap)
    out, held, start = [], "", 0
    for sentence in (s for p in re.split(r"\n\n+", text) for s in _SENTENCE.split(p)):
        grown = f"{held} {sentence}" if held else sentence
        if held and len(grown) > room:
            out.append((held, start, start + len(held), token_estimate(held)))
            tail = held[-shared:] if 0 < shared < len(held) else held
            held = f"{tail} {sentence}"
            start += len(held) - len(tail) - 1
        else:
            held = grown
    if held:
        out.append((held, start, start + len(held), token_estimate(held)))
    return out


def _packed(pieces: Iterator[str], size: int, glue: str) -> Iterator[str]:
    """Pieces joined as long as they fit."""
    held = ""
    for p in pieces:
        if held.strip() and len(held) + len(p) > size:
            if glue or p.strip(MARKS + " \n"):
                yield held.strip()
                held = p
            else:  # a mark stays with its sentence
                yield (held + p).strip()
                held = ""
        else:
            held = held + glue + p if held else p
    if held.strip():
        yield held.strip()


def sections_of(text: str, size: int = SECTION_CHARS) -> list[str]:
    """Paragraphs packed up to ``size`` characters; longer ones are cut at sentence marks, then by length. Sections of marks alone go."""
    if len(text) <= size:
        return [text]
    out: list[str] = []
    for block in _packed((p for p in text.split("\n\n") if p.strip()), size, "\n\n"):
        if len(block) <= size:
            out.append(block)
            continue
        for part in _packed((m[0] for m in _PIECE.finditer(block) if m[0].strip()), size, ""):
            out += [part[i : i + size].strip() for i in range(0, len(part), size)] if len(part) > size + 1 else [part]
    return [s for s in out if s.strip(MARKS + " \n")]


def chunk(df: DataFrame, text: str, target: int = 128, overlap: float = 0.1) -> DataFrame:
    """One row a chunk: chunk_index, chunk, start, end, tokens."""

    bounded_batches(df.sparkSession)

    @F.pandas_udf("array<struct<chunk:string,start:int,end:int,tokens:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("chunk", "start", "end", "tokens"), c, strict=True)) for c in chunks_of(t or "", target, overlap)])

    return df.select("*", F.posexplode(run(F.col(text))).alias("chunk_index", "c")).select("*", "c.*").drop("c")


def section_list(text: Column, size: int = SECTION_CHARS) -> Column:
    """The sections of a text, in order."""
    bounded_batches()

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: sections_of(t or "", size))

    return run(text)


def sections(df: DataFrame, text: str, size: int = SECTION_CHARS) -> DataFrame:
    """One row a section: section_index, total_sections, section."""
    return df.withColumn("s", section_list(F.col(text), size)).select("*", F.posexplode("s").alias("section_index", "section")).withColumn("total_sections", F.size("s")).drop("s")


def new_memories(df: DataFrame) -> DataFrame:
    """Defaults of new rows (primary_sector, sectors): salience by the number of further sectors, decay by sector, zero feedback."""
    extra = F.greatest(F.lit(0), F.size(F.array_except("sectors", F.array("primary_sector"))))
    rates = F.create_map(*[F.lit(x) for kv in C.DECAY_RATES.items() for x in kv])
    return df.withColumns({"salience": F.greatest(F.lit(0.0), F.least(F.lit(1.0), extra * 0.1 + 0.4)), "decay_lambda": F.coalesce(F.try_element_at(rates, F.col("primary_sector")), F.lit(0.02)), "feedback_score": F.lit(0.0), "version": F.lit(1)})


def ingest(docs: DataFrame, force_root: bool = False, large: int = LARGE_TOKENS, size: int = SECTION_CHARS, summary: int = SUMMARY_CHARS) -> tuple[DataFrame, DataFrame]:
    """Memories and waypoints of documents (id, user_id, content_type, content).

    Short documents are one memory. Long ones are a root, which holds a summary and
    has no vector, has a decay rate of its own and is in segment 1, and a memory for each
    section, with a waypoint from the root. Other memories get their segment later.
    """
    tokens = T.estimate_tokens(F.col("content"))
    docs = docs.withColumn("estimated_tokens", tokens)
    is_large = F.lit(force_root) | (F.col("estimated_tokens") > large)
    none, rate = F.lit(None).cast("string"), F.lit(C.DECAY_RATES["semantic"])
    single = docs.where(~is_large).select("id", "user_id", "content", F.lit("semantic").alias("primary_sector"), F.lit(0.4).alias("salience"), F.lit("single").alias("strategy"), none.alias("root_id"), F.lit(0).alias("section_index"), F.lit(0).alias("total_sections"), rate.alias("decay_lambda"), F.lit(None).cast("int").alias("segment"))
    # The parts stay with their document, so its root knows their number without a join.
    long = docs.where(is_large).withColumn("parts", section_list(F.col("content"), size)).withColumn("n", F.size("parts"))
    parts = long.select("id", "user_id", F.posexplode("parts").alias("section_index", "section"), F.col("n").alias("total_sections"))
    root_text = F.concat(F.lit("[Document: "), F.upper("content_type"), F.lit("]\n\n"), T.truncated(F.col("content"), summary), F.lit("\n\n[Full content split across "), F.col("n").cast("string"), F.lit(" sections]"))
    roots = long.select("id", "user_id", root_text.alias("content"), F.lit("reflective").alias("primary_sector"), F.lit(1.0).alias("salience"), F.lit("root").alias("strategy"), none.alias("root_id"), F.lit(-1).alias("section_index"), F.col("n").alias("total_sections"), F.lit(0.1).alias("decay_lambda"), F.lit(1).alias("segment"))
    child_id = F.concat("id", F.lit("#"), F.col("section_index").cast("string"))
    children = parts.select(child_id.alias("id"), "user_id", F.col("section").alias("content"), F.lit("semantic").alias("primary_sector"), F.lit(0.4).alias("salience"), F.lit("child").alias("strategy"), F.col("id").alias("root_id"), "section_index", "total_sections", rate.alias("decay_lambda"), F.lit(None).cast("int").alias("segment"))
    links = children.select(F.col("root_id").alias("src_id"), F.col("id").alias("dst_id"), "user_id", F.lit(1.0).alias("weight"))
    return single.unionByName(roots).unionByName(children), links


def explode_turns(batches: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``[{role: text}, …]`` in order, and the turns of other roles as rejects."""
    rows = batches.select("*", F.posexplode(col).alias("place", "turn")).drop(col).select("*", F.explode("turn").alias("role", "content")).drop("turn")
    good = F.coalesce(F.col("role").isin("human", "assistant"), F.lit(False))
    return rows.where(good), rows.where(~good)


def essence(text: Column, summary: Column | None = None, most: int = 1000) -> Column:
    """Short texts as they are; else the summary, and where there is none the first characters."""
    cut = F.substring(text, 1, most)
    return F.when(F.char_length(text) <= most, text).otherwise(cut if summary is None else F.coalesce(F.nullif(F.trim(summary), F.lit("")), cut))
