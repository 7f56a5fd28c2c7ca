"""URL filters: rules indexed by their rarest literal token.

A rule is a site (host and start of the path, with all subdomains) or a pattern:
literal text with ``*`` for anything, ``^`` for a separator or the end, ``||`` at the
start for the start of a host name, ``|`` at either end for the end of the URL.
Every rule becomes a regular expression and a set of literal tokens: runs of
letters and digits that the rule closes off on both sides, so each URL that it fits
has them as whole tokens. Tokens are counted over the URLs, each rule is filed under
the one that fewest URLs have, the tokens of a URL fetch their rules, and only
those run. Rules that close off no token are filed under the empty token, which
every URL has.

Of sites the longest (host and path; then the longer host, then ``block``) wins. Where
none fits, a URL is blocked if a blocking pattern fits and no allowing one does.

Rules are a table like any other: compiled by column functions, broadcast behind a
check of their number and bytes. Beyond that, URLs and index are joined by token, and
tokens of very many URLs are dealt over parts. A row's candidates meet by (key, URL,
input partition), one row of partial results a row and task.

Defined cases: a null URL, or one without ``://``, has an empty host and path, and is
judged by patterns alone; a null URL fits none and is allowed. Letters A-Z count as
lower case in hosts and for patterns, not in the paths of sites. Sites with a null or
empty host, or a path that does not start with ``/``, and null or empty patterns fit
nothing; a rule given twice is one. Equal rows are judged each; an empty table gives an
empty result; very long URLs are read whole; columns of the input that are not asked for
are left out, so their names cannot clash.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITE_COLUMNS, PATTERN_COLUMNS = ("host", "path", "verdict"), ("pattern", "verdict")
ALLOW, BLOCK = "allow", "block"
TOKEN = "[a-z0-9]+"
#: A token of a rule that nothing can lengthen: neither an unknown (``*``) nor a letter or digit beside it.
CLOSED = "(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"
#: The index is broadcast up to these; beyond, it is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: URLs of one token that a task joins, where the index is not broadcast.
HOT = 1_000_000


def rule_table(spark: SparkSession, rows: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """A few rules as a local table."""

    def text(x: str | None) -> str:
        return "CAST(NULL AS STRING)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join(f"({', '.join(map(text, r))})" for r in rows) or f"({', '.join([text(None)] * len(columns))})"
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, after the empty one."""
    return F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct(F.regexp_extract_all(lowered(url), F.lit(TOKEN), 0)), F.array().cast("array<string>")))


def _quoted(text: Column, but: str = "") -> Column:
    signs = r"\\$.|?*+()\[\]{}\-^".replace(but, "")
    return F.regexp_replace(text, f"([{signs}])", r"\\$1")


def compiled(sites: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row a rule: rule, site (or else a pattern), verdict, host_length, regex, literals."""
    host = lowered(F.col("host"))
    place = F.concat(host, F.col("path"))
    of_sites = sites.where((F.length("host") > 0) & F.col("path").startswith("/")).select(
        place.alias("rule"), F.lit(True).alias("site"), "verdict", F.length("host").alias("host_length"),
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), _quoted(place)).alias("regex"), F.concat(lowered(place), F.lit("*")).alias("marked"),
    )
    pattern = lowered(F.col("pattern"))
    body = F.regexp_replace(F.regexp_replace(pattern, r"^\|{1,2}", ""), r"\|$", "")
    pieces, at_end = F.split(body, r"\*"), pattern.endswith("|")

    def piece(text: Column, i: Column) -> Column:
        """Regex of what stands between two unknowns. The first place where it fits serves best (but at the end), so none is tried twice."""
        quoted = F.replace(_quoted(text, "^"), F.lit("^"), F.lit(r"(?:[^a-z0-9_.%\-]|\z)"))
        here, last = i == 0, at_end & (i == F.size(pieces) - 1)
        anchored = F.when(last, F.concat(quoted, F.lit(r"\z"))).otherwise(quoted)
        of_host = F.when(last, F.concat(F.lit(r"(?:[^/?#]*\.)?"), anchored)).otherwise(F.concat(F.lit(r"(?>(?:[^/?#]*?\.)??"), quoted, F.lit(")")))
        anywhere = F.when(last, F.concat(F.lit(".*"), anchored)).otherwise(F.concat(F.lit("(?>.*?"), quoted, F.lit(")")))
        return F.when(here & pattern.startswith("||"), F.concat(F.lit(r"[a-z0-9+.\-]*://"), of_host)).when(here & pattern.startswith("|"), anchored).otherwise(anywhere)

    regex = F.concat(F.lit("(?s)^"), F.array_join(F.transform(pieces, piece), ""))
    marked = F.concat(F.when(pattern.startswith("|"), "").otherwise("*"), body, F.when(pattern.endswith("|"), "").otherwise("*"))
    of_patterns = patterns.where(F.length(body) > 0).select(
        F.col("pattern").alias("rule"), F.lit(False).alias("site"), "verdict", F.lit(0).alias("host_length"), regex.alias("regex"), marked.alias("marked")
    )
    rules = of_sites.union(of_patterns).where(F.col("verdict").isin(ALLOW, BLOCK)).distinct()
    return rules.withColumn("literals", F.array_distinct(F.regexp_extract_all("marked", F.lit(CLOSED), 0))).drop("marked")


def small(df: DataFrame, width: Column) -> bool:
    n, size = df.select(F.count(F.lit(1)), F.sum(width)).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def indexed(rules: DataFrame, urls: DataFrame, light: bool) -> DataFrame:
    """``rules`` with ``token``, the literal that fewest of ``urls`` (url) have, and ``n_urls``; ties go to the first token. ``light``: rules may be broadcast."""
    asked = rules.select(F.explode("literals").alias("token")).distinct()
    met = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(F.broadcast(asked) if light else asked, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n_urls"))
    by_literal = rules.select("rule", "site", "verdict", F.explode("literals").alias("token")).join(F.broadcast(met) if light else met, "token", "left")
    rarest = by_literal.groupBy("rule", "site", "verdict").agg(F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n_urls"), "token")).alias("r"))
    found = rules.drop("literals").join(F.broadcast(rarest) if light else rarest, ["rule", "site", "verdict"], "left")
    return found.select(*[c for c in rules.columns if c != "literals"], F.coalesce("r.token", F.lit("")).alias("token"), F.col("r.n_urls").alias("n_urls"))


def _fetched(rows: DataFrame, index: DataFrame, light: bool) -> DataFrame:
    """``rows`` (with token and url) beside the rules that are filed under the token; those of a token without rules stay."""
    if light:
        return rows.join(F.broadcast(index), "token", "left")
    # The empty token is in every URL.
    hot = index.groupBy("token").agg(F.max(F.coalesce("n_urls", F.lit(HOT * 64))).alias("n")).where(F.col("n") > HOT).select("token", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("url"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    dealt = rows.join(hot, "token", "left").withColumn("part", part).drop("parts")
    repeated = index.join(hot, "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(repeated, ["token", "part"], "left").drop("part")


def judged(pages: DataFrame, sites: DataFrame, patterns: DataFrame, keys: Sequence[str] = ("page_id",), url: str = "url") -> DataFrame:
    """Per row of ``pages``: ``keys``, url, host, path, rule (the site), pattern (that decided, where no site did) and verdict.

    ``sites``: host, path, verdict. ``patterns``: pattern, verdict.
    """
    names = {f"k{i}": k for i, k in enumerate(keys)}
    rules = compiled(sites, patterns)
    light = small(rules, F.octet_length("regex") * 2 + 64)
    urls = pages.select(*[F.col(k).alias(x) for x, k in names.items()], F.col(url).alias("url"), F.spark_partition_id().alias("from"))
    index = indexed(rules, urls.select("url"), light).withColumnRenamed("verdict", "says")
    # A first entry that is no token counts the row once, whatever its tokens fetch.
    itself = F.concat(F.lit("/"), F.xxhash64("url", *names).cast("string"))
    tokens = urls.select("*", F.posexplode(F.concat(F.array(itself), tokens_of(F.col("url")))).alias("at", "token"))
    place, whole = F.concat(host_of(F.col("url")), path_of(F.col("url"))), lowered(F.col("url"))
    fits = F.rlike(F.when(F.col("site"), place).otherwise(whole), F.col("regex"))
    won = F.struct(F.length("rule").alias("length"), "host_length", (F.col("says") == BLOCK).alias("blocks"), "rule", "says")
    found = _fetched(tokens, index, light).withColumn("fits", F.coalesce(fits, F.lit(False)))
    by_row = found.groupBy(*names, "url", "from").agg(
        F.count(F.when(F.col("at") == 0, 1)).cast("int").alias("n"),
        F.max(F.when(F.col("fits") & F.col("site"), won)).alias("won"),
        *[F.min(F.when(F.col("fits") & ~F.col("site") & (F.col("says") == v), F.col("rule"))).alias(v) for v in (ALLOW, BLOCK)],
    )
    by_pattern = F.when(F.col(ALLOW).isNull() & F.col(BLOCK).isNotNull(), BLOCK).otherwise(ALLOW)
    out = by_row.select(
        *[F.col(x) for x in names], "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("won.rule").alias("rule"),
        F.when(F.col("won").isNull(), F.coalesce(ALLOW, BLOCK)).alias("pattern"), F.coalesce("won.says", by_pattern).alias("verdict"), F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("each"),
    )
    return out.drop("each").withColumnsRenamed(names)


def without_blocked(pages: DataFrame, sites: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is not blocked."""
    blocked = judged(pages.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct(), sites, patterns, keys=()).where(F.col("verdict") == BLOCK)
    return pages.join(blocked.select(F.col("url").alias(url)), url, "left_anti").select(pages.columns)
