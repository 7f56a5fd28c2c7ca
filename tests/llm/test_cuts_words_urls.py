"""Fill-in-the-middle, spelling variants and URL filters against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import fim, queries, spelling, url_rules
from palimpsest.llm.common import Kept, table

from .conftest import rows

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
UPPER = {c: c + 32 for c in range(65, 91)}


# Fill-in-the-middle


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    return doc_id, len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def fim_rows(df):
    return Counter((r["doc_id"], r["fim"]["n"], r["fim"]["form"], r["fim"]["prefix_chars"], r["fim"]["middle_chars"], r["fim"]["text"]) for r in df.collect())


def test_fim_like_brute_force(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    assert fim_rows(fim.with_fim(docs)) == Counter(brute_fim(*r) for r in docs.collect())


def test_fim_on_odd_rows(spark, clashing, none):
    texts = ["<", "a<P>b", "<M", "x<S", "<<<>>>", "😀a😀b", "ÀéB", "a" * 70_000 + " " + "b " * 9_000, "\n\r\x00 z", "İi ſ K"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts * 6)], "doc_id long, text string")
    assert fim_rows(fim.with_fim(more)) == Counter(brute_fim(r["doc_id"], r["text"]) for r in more.collect())
    made = fim.with_fim(clashing.withColumns({"fim_index": F.lit("x"), "rank_index": F.lit("y"), "FIM": F.lit("z")}))
    assert fim_rows(made) == Counter(brute_fim(r[0], r[1]) for r in rows())
    assert made.columns == [*clashing.columns, "fim_index", "rank_index", "fim"]
    assert fim.fim_report(none).collect() == []


def test_fim_is_undone(spark):
    rand = random.Random(5)
    texts = ["".join(rand.choice("<>PSMab é\n") for _ in range(rand.randrange(40))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fim.with_fim(docs, cut=100, suffix_first=50)
    got = made.select("text", "fim.form", fim.restored(F.col("fim.text"), F.col("fim.form")).alias("again")).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} and all(r["text"] == r["again"] for r in got)
    for r in fim.fim_report(docs).collect():
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_kept_index_serves_other_seeds(spark, odd):
    index = Kept(spark).table(fim.with_rank_index(odd))
    for seed in (2, 3):
        again = fim.with_fim(index, seed=seed, index="rank_index")
        assert fim_rows(again) == fim_rows(fim.with_fim(odd, seed=seed))
        assert "rank_index" in again.columns


def test_rank_index_is_error_bounded():
    rand = np.random.default_rng(7)
    for text in ("", "a", "ab cd", "x" * 5_000 + " y" * 5_000 + "word and other words " * 900, "".join(rand.choice(list("ab ,é"), 30_000))):
        offsets = fim.boundaries(text)
        assert offsets.tolist() == [m.start() for m in UNIT.finditer(text)] + [len(text)]
        n, firsts, starts, slopes, residuals = fim.learned(text)
        assert n + 1 == len(offsets) == len(residuals) and firsts[0] == 0
        for rank in range(n + 1):
            k = int(np.searchsorted(firsts, rank, "right")) - 1
            predicted = int(starts[k]) + ((rank - int(firsts[k])) * int(slopes[k]) >> fim.SLOPE_BITS)
            assert abs(offsets[rank] - predicted) <= fim.ERROR + 1 and predicted + residuals[rank] - 128 == offsets[rank]
        for at, after in zip(firsts, firsts[1:], strict=False):  # no line through the first point holds one boundary more
            far = np.arange(1, after - at + 1)
            rise = offsets[at + 1 : after + 1] - offsets[at]
            assert ((rise - fim.ERROR) / far).max() > ((rise + fim.ERROR) / far).min()


# Spelling variants


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def neighbours(words):
    """By word its near words, by what they are without one character."""
    near, gaps = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
            if (shorter := w[:i] + w[i + 1 :]) in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute_spelling(docs, slip=199, least=6, count=5):
    met = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            met[run[: h % len(run)] + run[h % len(run) + 1 :] if slip and h % slip == 0 else run] += 1
    words = {w: n for w, n in met.items() if len(w) >= least and n >= count}
    near, form = neighbours(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelling_rows(df):
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling_like_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute_spelling([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert any(x[1] for x in want) and spelling_rows(queries.op12_spelling(spark, sf)) == want


def test_spelling_on_odd_rows(spark, odd, clashing, none):
    assert spelling_rows(spelling.spelling_report(none)) == set()
    for docs in (odd, clashing.withColumns({x: F.lit(1) for x in ("word", "n", "key", "near")})):
        assert spelling_rows(spelling.spelling_report(docs)) == brute_spelling([(r[0], r[1]) for r in rows()])


def many_words(seed, size, letters="abé"):
    rand = random.Random(seed)
    return ["".join(rand.choice(letters) for _ in range(rand.randrange(1, 10))) for _ in range(size)]


@pytest.mark.parametrize(("seed", "least", "most"), [(1, 6, 20_000), (2, 6, 4), (3, 1, 3), (4, 6, 1)])
def test_divided_partitions_lose_no_pair(spark, seed, least, most):
    rand = random.Random(seed)
    words = sorted(set(many_words(seed, 1_500)))
    text = " ".join(w for w in words for _ in range(rand.choice((1, 2, 5, 30, 200))))
    text += " abcdefghij" * 5 + " abcdefghijk" * 40 + " abcdefghijkl" * 300 + " Abcdefghijxl" * 5
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = spelling_rows(spelling.spelling_groups(docs, slip_every=7, least_length=least, most=most))
    want = brute_spelling([(1, text)], slip=7, least=least)
    assert got == want and any(x[2] != x[1] and x[1] for x in want)


def test_acceptor_is_least_and_exact():
    words = sorted(set(many_words(9, 400)))
    states, start = spelling.acceptor(words)

    def language_of(k):
        final, edges = states[k]
        return ({""} if final else set()) | {a + s for a, x in edges.items() for s in language_of(x)}

    languages = [frozenset(language_of(k)) for k in range(len(states))]
    assert languages[start] == set(words) and len(set(languages)) == len(states)


def test_each_pair_is_accepted_once():
    words = sorted({w for w in many_words(11, 900) if len(w) in (6, 7)})
    pairs = list(spelling.near_pairs(words, 6, 7))
    want = {(u, v) for i, u in enumerate(words) for v in words[i + 1 :] if one_edit(u, v) and 6 in (len(u), len(v))}
    assert len(pairs) == len(want) and {tuple(sorted(p)) for p in pairs} == want


# URL filters


def brute_site(url, sites):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(UPPER), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h.translate(UPPER) + p, v) for h, p, v in sites if h and (p or "").startswith("/") and (host == h.translate(UPPER) or host.endswith("." + h.translate(UPPER))) and path.startswith(p)]
    return host, path, *(max(fits)[3:] if fits else (None, None))


def brute_pattern(url, pattern):
    """Whether a pattern fits, by walking both."""
    if url is None or not pattern.strip("|"):
        return False
    url, pattern = url.translate(UPPER), pattern.translate(UPPER)
    begins = [0]
    if pattern.startswith("||"):
        m = re.match(r"[a-z0-9+.\-]*://([^/?#]*)", url)
        begins = [m.start(1)] + [m.start(1) + i + 1 for i, c in enumerate(m[1]) if c == "."] if m else []
    elif not pattern.startswith("|"):
        begins = range(len(url) + 1)
    ends = pattern.endswith("|")
    body = re.sub(r"^\|{1,2}", "", pattern)
    body = body.removesuffix("|")

    at = set(begins)
    for c in body:
        if c == "*":
            at = set(range(min(at), len(url) + 1)) if at else set()
        elif c == "^":
            at = {i + 1 for i in at if i < len(url) and not re.match(r"[a-z0-9_.%\-]", url[i])} | ({len(url)} & at)
        else:
            at = {i + 1 for i in at if i < len(url) and url[i] == c}
    return len(url) in at if ends else bool(at)


def brute_urls(pages, sites, patterns):
    out = Counter()
    for key, url in pages:
        host, path, rule, verdict = brute_site(url, sites)
        fits = {v: sorted(p for p, x in patterns if p and x == v and brute_pattern(url, p)) for v in ("allow", "block")}
        pattern = None if rule else next(iter(fits["allow"] + fits["block"]), None)
        out[key, url, host, path, rule, pattern, verdict or ("block" if fits["block"] and not fits["allow"] else "allow")] += 1
    return out


def url_rows(df):
    return Counter(tuple(r) for r in df.select("page_id", "url", "host", "path", "rule", "pattern", "verdict").collect())


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://org/", "HTTP://A.Example.ORG/es/x", "http://example.org/ES/x", "http://example.org/en/1", "http://example.org/en/19?x", "http://notexample.org/en/1",
    "http://x.example.org/en/2#/en/1", "http://example.com/de", "http://example.com/de/", "http://example.com/fr/?casino", "a://b://com/de/", "http://example.com:80/de/", "http://net/Login", "http://net/login?x", "http://net/loginx",
    "http://net/a.zip", "http://net/a.zip\n", "http://net/a.ZIP", "http://net/a.zip?", "http://ads.net/", "http://x.ads.net/é", "http://loads.net/", "http://net/?ads.", "http://docs.net/casino", "http://net/Casinos", "http://blog.net/x?page=2",
    "http://blog.net/x\n?page=2", "http://net/?blog.&page=1", "http://a-pills.net", "http://net/?u=1&sessionid=5", "http://net/xsessionid=5", "http://net/é😀/cart", "http://net/" + "a/" * 20_000 + "cart/", "http://net/[(+)]{}$\\",
]
ODD_PATTERNS = [*queries.PATTERNS, ("[(+)]{}$\\", "block"), ("*", "nothing"), ("", "block"), ("|", "block"), (None, "block"), ("|a://", "block"), ("^^", "allow"), ("casino", "block"), ("É😀", "block"), ("a*b*c*d", "block"), ("a*/*a*/b", "block"), ("||e*m^", "block"), ("||net*/login|", "block"), ("|http:*.zip|", "block"), ("^cart/|", "block")]
ODD_SITES = [*queries.SITES, ("Example.ORG", "/es/", "block"), ("", "/", "block"), (None, "/", "block"), ("net", None, "block"), ("net", "x", "block"), ("example.org", "/en/19", "allow"), ("x.example.org", "/en/", "allow"), ("org", "/", "block")]


@pytest.fixture(params=["broadcast", "joined", "dealt"])
def way(request, monkeypatch):
    if request.param != "broadcast":
        monkeypatch.setattr(url_rules, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(url_rules, "HOT", 3 if request.param == "dealt" else 10**6)


def test_urls_like_brute_force(spark, way):
    sites, patterns = url_rules.rule_table(spark, ODD_SITES, url_rules.SITE_COLUMNS), url_rules.rule_table(spark, ODD_PATTERNS, url_rules.PATTERN_COLUMNS)
    pages = [(i % 7 or None, u) for i, u in enumerate(ODD_URLS * 2)] + [(None, "http://ads.net/")] * 5
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    df = df.withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "token", "k0", "n", "regex", "from")})
    assert url_rows(url_rules.judged(df, sites, patterns)) == brute_urls(pages, ODD_SITES, [p for p in ODD_PATTERNS if p[1] in ("allow", "block")])


def test_urls_of_the_table(spark, sf):
    pages = [(r["page_id"], r["url"]) for r in table(spark, sf, "pages").collect()]
    want = brute_urls(pages, queries.SITES, queries.PATTERNS)
    got = queries.op13_url_filter(spark, sf)
    assert Counter(tuple(r) for r in got.collect()) == Counter({(k[0], *k[2:]): n for k, n in want.items()})


def test_rules_are_filed_under_their_rarest_token(spark):
    patterns = url_rules.rule_table(spark, [("||shop.example^cart^", "block"), ("art", "block"), ("/rare/common*", "block")], url_rules.PATTERN_COLUMNS)
    rules = url_rules.compiled(url_rules.rule_table(spark, [("example.org", "/en/1", "block")], url_rules.SITE_COLUMNS), patterns)
    urls = spark.createDataFrame([("http://shop.example/cart",), ("http://shop.example/rare",), ("http://x.example/rare/rare",), ("http://example.org/en/12/rare",)], "url string")
    for light in (True, False):
        got = {r["rule"]: (r["token"], r["n_urls"]) for r in url_rules.indexed(rules, urls, light).collect()}
        assert got == {"||shop.example^cart^": ("cart", 1), "art": ("", None), "/rare/common*": ("rare", 3), "example.org/en/1": ("en", 1)}


def test_without_blocked(spark, none):
    sites, patterns = url_rules.rule_table(spark, queries.SITES, url_rules.SITE_COLUMNS), url_rules.rule_table(spark, [], url_rules.PATTERN_COLUMNS)
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(ODD_URLS * 2)], "id long, URL string, verdict string")
    kept = url_rules.without_blocked(df, sites, patterns, url="URL")
    assert kept.columns == df.columns
    assert sorted(r["id"] for r in kept.collect()) == sorted(i for i, u in enumerate(ODD_URLS * 2) if brute_site(u, queries.SITES)[3] != "block")
    assert url_rules.judged(spark.createDataFrame([], "page_id long, url string"), sites, patterns).collect() == []
