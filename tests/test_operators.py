"""Operators on rows made by hand."""

from __future__ import annotations

import base64
import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.constants import SECTORS
from palimpsest.functions import convert, embedding
from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.functions import vectors as V
from palimpsest.operators import dynamics, evaluate, graph, ingest, model_stage, ranking, recall
from palimpsest.operators import sessions as ses
from palimpsest.operators import tables as tab
from palimpsest.plans.search import GraphConfig
from palimpsest.sources.views import Tables
from palimpsest.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "want"), [("stories", "story"), ("running", "runn"), ("players", "player"), ("named", "nam"), ("cats", "cat"), ("bus", "bus"), ("ring", "ring"), ("sing", "sing")])
def test_stems(spark, word, want):
    assert one(spark, T.stem(F.lit(word))) == want


def test_canonical_tokens_like_python(spark):
    text = "Meetings and calls: the customers asked 3 questions, I like todo-lists. 会议记录 Über"
    got = one(spark, T.canonical_tokens(F.lit(text)))
    columns = one(spark, F.transform(T.cjk_tokens(F.lit(text)), T.canonical_token))
    assert got == [w for w in columns if len(w) > 1] and "meeting" in got and got[-4:] == ["会议", "议记", "记录", "ber"]
    flagged = one(spark, T.canonical_tokens(F.lit("我们的ok"), lambda run: [("我们", "rr"), ("的", "uj")]))
    assert flagged == ["我们", "ok"]
    assert one(spark, T.cjk_tokens(F.lit("会议记录 ok"))) == ["会议", "议记", "记录", "ok"]
    assert one(spark, T.canonical_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, T.search_document(F.lit("bugs"))) == "bug issue problem"


def test_overlaps(spark):
    q = F.array(F.lit("api_key"), F.lit("dark"))
    assert one(spark, T.keyword_overlap(q, F.lit("my api_key"))) == pytest.approx(2 / 3)
    assert one(spark, T.token_overlap(q, F.array(F.lit("dark")))) == 0.5
    assert one(spark, T.token_overlap(F.array().cast("array<string>"), q)) == 0
    assert one(spark, T.tag_match(F.array(F.lit("Dark"), F.lit("key")), q)) == pytest.approx(3 / 4)
    assert one(spark, T.tag_match(F.lit(None).cast("array<string>"), q)) == 0


def test_hybrid_score(spark):
    got = one(spark, S.hybrid_score(*[F.lit(x) for x in (0.8, 0.5, 0.3, 0.9, 0.25, 0.05)]))
    raw = 0.35 * (1 - math.exp(-2.4)) + 0.2 * 0.5 + 0.15 * 0.3 + 0.1 * 0.9 + 0.2 * 0.25 + 0.05
    assert got == pytest.approx(1 / (1 + math.exp(-raw)))


def test_cosine_edges(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, V.cosine(a, F.array(F.lit(1.0)))) is None


def test_padding_and_trimming(spark):
    v = F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")
    assert one(spark, V.padded(v, 4)) == [1, 2, 0, 0] and one(spark, V.padded(v, 1)) == [1]
    assert one(spark, V.trimmed(V.padded(v, 4), F.lit(2))) == [1, 2]


def test_decay_edges(spark):
    got = one(spark, S.decayed_salience(F.lit("unknown"), F.lit(0.4), F.lit(9.0)))
    assert got == 0.4
    slow = one(spark, S.decayed_salience(F.lit("emotional"), F.lit(1.0), F.lit(30.0), F.lit(9.0), F.lit(9.0)))
    assert slow == 1.0
    assert one(spark, S.recency(F.lit(None).cast("timestamp_ntz"), F.lit("2024-01-01").cast("timestamp_ntz"))) == 0


def test_limits():
    assert convert.clamped(9.9, 0.5) == 1.0 and convert.clamped("x", 0.5) == 0.5 and convert.clamped(None, 0.8, 0.1) == 0.8
    assert convert.clamped_int(99, 1, 1, 4) == 4 and convert.clamped_int(None, 200) == 200 and convert.clamped_int(0, 5) == 1


def test_encryption(spark):
    key, other = (base64.b64encode(bytes([n]) * 32).decode() for n in (1, 2))
    aad = F.lit('{"id":"m1"}')
    df = spark.createDataFrame([("héllo " * 40,), ("",), (None,), ("not sealed",)], "t string")
    df = df.withColumn("sealed", convert.encrypted(F.col("t"), F.lit(key), aad)).persist()
    again = df.select("t", "sealed", convert.encrypted(F.col("sealed"), F.lit(key), aad).alias("twice"), convert.decrypted(F.col("sealed"), F.lit(key), aad).alias("open"), convert.decrypted(F.col("sealed"), F.lit(other), aad).alias("wrong")).collect()
    for r in again:
        assert r["open"] == r["t"] and r["twice"] == r["sealed"] and r["wrong"] == r["sealed"]
    assert again[0]["sealed"] != again[0]["t"] and "\n" not in again[0]["sealed"]


def test_json_and_times(spark):
    assert one(spark, convert.json_array(F.lit('["a", "b"]'))) == ["a", "b"]
    for bad in ("null", "{", None, "3"):
        assert one(spark, convert.json_array(F.lit(bad).cast("string"))) in ([], None) or bad == "3"
        assert one(spark, convert.json_object(F.lit(bad).cast("string"))) == "{}"
    default = F.lit(7).cast("long")
    for value, want in (("1700000000", 1700000000000), ("1700000000000", 1700000000000), ("2024-01-01T00:00:00Z", 1704067200000), ("", 7), ("soon", 7), (None, 7)):
        assert one(spark, convert.epoch_ms(F.lit(value).cast("string"), default)) == want


def test_conditions(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", None)], "n int, s string, f boolean")
    assert tab.filter_conditions(df, ["n >= 1", "t.s = 'a'", "f = true"]).count() == 1
    assert tab.filter_conditions(df, ["n != %s"], [1]).count() == 1
    for bad in ("x = 1", "n ~ 1"):
        with pytest.raises(ValueError):
            tab.filter_conditions(df, [bad])
    assert [r["n"] for r in tab.order_by_spec(df, ["f desc"]).collect()] == [2, 1]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "id string, x int, y int")
    new = spark.createDataFrame([("b", 9, 9), ("c", 3, 3)], "id string, x int, y int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tab.upsert(old, new, ["id"])) == [("a", 1, 1), ("b", 9, 9), ("c", 3, 3)]
    assert rows(tab.upsert(old, new, ["id"], "ignore")) == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]
    assert rows(tab.upsert(old, new, ["id"], "merge", ["x"])) == [("a", 1, 1), ("b", 9, 2), ("c", 3, 3)]


def test_pairing_like_a_stack(spark):
    rng = random.Random(1)
    turns = [(f"t{i}", f"u{i % 3}", rng.choice(["human", "assistant"]), i) for i in range(300)]
    want, open_ = {}, {}
    for t, user, role, _ in turns:
        stack = open_.setdefault(user, [])
        if role == "human":
            stack.append(t)
            want[t] = f"pair:{t}"
        else:
            want[t] = f"pair:{stack.pop() if stack else t}"
    df = spark.createDataFrame(turns, "id string, user_id string, role string, n int")
    assert {r["id"]: r["pair_id"] for r in ses.pair_turns(df.repartition(5), ["n"]).collect()} == want


def test_bm25_prefers_rare_words(spark):
    docs = spark.createDataFrame([("a", "u", "cat cat dog"), ("b", "u", "dog bird"), ("c", "u", "fish"), ("d", "v", "cat")], "id string, user_id string, content string")
    q = spark.createDataFrame([("q", "u", "cat bird", 5)], "query_id string, user_id string, text string, top_k int")
    got = [r["id"] for r in recall.bm25_recall(q, docs).orderBy("rank").collect()]
    assert set(got) == {"a", "b"}


def test_waypoint_paths(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.1), ("c", "a", 1.0), ("c", "d", 0.1), ("b", "e", 5.0)], "src_id string, dst_id string, weight double")
    seeds = spark.createDataFrame([("q", "a")], "query_id string, id string")
    got = {r["id"]: (round(r["weight"], 3), r["path"]) for r in recall.expand_waypoints(seeds, edges).collect()}
    assert got == {"b": (0.8, ["a", "b"]), "c": (0.64, ["a", "b", "c"]), "e": (0.64, ["a", "b", "e"])}


def test_walk_keeps_the_best(spark):
    rel = spark.createDataFrame([("u", "a", "b", "SAME_AS", 1.0), ("u", "a", "c", "RELATED_TO", 0.6), ("u", "b", "d", None, None), ("u", "d", "a", "KNOWS", 0.2), ("u", "a", "a", "KNOWS", 1.0)], "user_id string, source string, target string, edge_relation string, confidence double")
    seeds = spark.createDataFrame([("q", "u", "a")], "query_id string, user_id string, canonical_id string")
    hop = {r["canonical_id"]: r["score"] for r in graph.walk(seeds, rel).collect()}
    assert hop == pytest.approx({"b": 1.6, "c": 0.8 + 0.6 * 0.3 * 0.8})
    two = {r["canonical_id"]: r["score"] for r in graph.walk(seeds, rel, hops=2).collect()}
    assert two["d"] == pytest.approx(1.6 * 0.8) and set(two) == {"b", "c", "d"}
    assert {r["canonical_id"] for r in graph.walk(seeds, rel, per_hop=1).collect()} == {"b"}


def test_canonical_entities(spark):
    old = spark.createDataFrame([("c1", "u", "New York", "LOCATION", [1.0, 0.0]), ("c2", "u", "Paris", "LOCATION", [0.0, 1.0])], "id string, user_id string, name string, entity_type string, v array<double>")
    new = spark.createDataFrame([("u", "new york!", "LOCATION", [0.0, 1.0]), ("u", "Lutetia", "LOCATION", [0.1, 1.0]), ("u", "Oslo", "LOCATION", [-1.0, 0.2]), ("u", "oslo", "LOCATION", [-1.0, 0.2])], "user_id string, text string, entity_type string, v array<double>")
    got = {r["text"]: (r["canonical_id"], r["is_new"]) for r in graph.canonicalise(new, old).collect()}
    assert got["new york!"] == ("c1", False) and got["Lutetia"] == ("c2", False)
    assert got["Oslo"] == got["oslo"] and got["Oslo"][1]


def test_promotion(spark):
    scored = spark.createDataFrame([("q", "h", 0.7, "human", "p"), ("q", "x", 0.8, "assistant", None)], "query_id string, id string, score double, role string, pair_id string")
    mem = spark.createDataFrame([("old", "assistant", "p", 1), ("new", "assistant", "p", 2)], "id string, role string, pair_id string, created_at int")
    got = {r["id"]: r["score"] for r in ranking.promote_answers(scored, mem).collect()}
    assert got == pytest.approx({"h": 0.7, "x": 0.8, "new": 0.9})


def test_profiles_merge(spark):
    old = {"demographic": {"city": "Rome", "age": 30}, "preferences": {"habits": [{"name": "Tea", "confidence": 0.6}, {"name": "run", "confidence": 0.2}]}, "tags": [{"name": "A", "weight": 0.9}], "extra": {"n": {"o": {"p": {"q": {"r": {"s": 1}}}}}}}
    new = {"demographic": {"city": "Oslo", "age": None}, "preferences": {"habits": [{"name": "tea", "confidence": 0.9}]}, "tags": [{"name": "b", "weight": 0.95}, {"name": "low", "weight": 0.1}], "empty": [""]}
    a, b = (spark.createDataFrame([("u", json.dumps(x))], "user_id string, profile string") for x in (old, new))
    got = json.loads(ses.merge_profiles(a, b).first()["profile"])
    assert got["demographic"] == {"city": "Oslo", "age": 30}
    assert got["preferences"]["habits"] == [{"name": "tea", "confidence": 0.9}]
    assert [t["name"] for t in got["tags"]] == ["b", "A"] and "empty" not in got


def test_sections_and_chunks():
    text = "One two three. " * 40 + "\n\n" + "Short one.\n\n...\n\nx" + "y" * 500
    parts = ingest.sections_of(text, 150)
    assert all(p.strip(".!? ") for p in parts) and max(map(len, parts)) <= 151
    assert "".join("".join(parts).split()).replace(".", "") == "".join(text.split()).replace(".", "")
    assert ingest.sections_of("short", 150) == ["short"]
    chunks = ingest.chunks_of(" ".join(f"Word{i} goes here." for i in range(200)), 40)
    assert len(chunks) > 5 and all(c[3] <= 60 for c in chunks) and chunks[1][0][:4] in chunks[0][0]
    assert ingest.chunks_of("", 40) == [("", 0, 0, 0)]


def test_ingest(spark):
    docs = spark.createDataFrame([("a", "u", "txt", "short text"), ("b", "u", "md", "Many words here. " * 100)], "id string, user_id string, content_type string, content string")
    memories, links = ingest.ingest(docs)
    rows = {r["id"]: r for r in memories.collect()}
    children = [k for k, r in rows.items() if r["strategy"] == "child"]
    assert rows["a"]["strategy"] == "single" and rows["b"]["content"].startswith("[Document: MD]\n\n") and f"across {len(children)} sections]" in rows["b"]["content"]
    assert sorted(r["dst_id"] for r in links.collect()) == sorted(children)


def test_segments_and_samples(spark):
    rows = spark.createDataFrame([(f"m{i:03d}", i) for i in range(250)], "id string, n int").withColumn("created_at", F.expr("timestampadd(MINUTE, n * 7, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    seg = dynamics.assign_segments(rows.repartition(7), 100)
    assert {r["id"]: r["segment"] for r in seg.collect()} == {f"m{i:03d}": i // 100 for i in range(250)}
    a, b = (sorted(r["id"] for r in dynamics.sample_per_segment(seg.repartition(k), 0.03).collect()) for k in (2, 5))
    assert a == b and len(a) == 3 + 3 + 1


def test_near_duplicates_on_write(spark):
    mem = spark.createDataFrame([("m1", "u", 0.9), ("m2", "u", 0.1)], "id string, user_id string, salience double").withColumn("last_seen_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    vec = spark.createDataFrame([("m1", "semantic", [1.0, 0.0]), ("m2", "semantic", [0.0, 1.0])], "id string, sector string, v array<double>")
    new = spark.createDataFrame([("n1", "u", [1.0, 0.01]), ("n2", "u", [0.7, 0.7]), ("n3", "u", [0.0, 1.0])], "id string, user_id string, v array<double>")
    assert {r["id"]: r["best_id"] for r in dynamics.dedup_on_write(new, mem, vec, cap=1).collect()} == {"n1": "m1", "n2": None, "n3": None}


def test_embeddings(spark):
    a, b, c = embedding.hash_embed(["I like dark themes", "I love night mode", "quarterly tax report"])
    assert np.allclose(np.linalg.norm([a, b, c], axis=1), 1, atol=1e-5) and a @ b > a @ c
    assert np.allclose(embedding.embed_text(""), 1 / 16)
    df = spark.createDataFrame([("m", "u", "text", ["semantic", "semantic", "episodic"])], "id string, user_id string, content string, sectors array<string>")
    assert embedding.vectorise(df).count() == 2


def _embedded_one_by_one(text, dim, sector):
    """Each feature as a string of its own, hashed letter by letter."""
    from collections import Counter

    from palimpsest.constants import SECTOR_WEIGHTS, SYNONYMS
    from palimpsest.functions.words import Known, canonical, canonical_words

    def hashed(feature, h, factor, shift):
        for c in feature:
            h = (h ^ ord(c)) * factor & 0xFFFFFFFF
            h ^= h >> shift if shift else 0
        return h

    lines = {line[0]: line for line in SYNONYMS}
    words = canonical_words(text, Known())
    grown = [x for w in words for x in (w, *map(canonical, lines.get(w, (w,))))]
    scale, features, v = SECTOR_WEIGHTS.get(sector, (1.0,))[0], Counter(), np.zeros(dim)
    for word, n in Counter(grown).items():
        weight = (n / len(grown) * math.log(1 + len(grown) / n) + 1) * scale
        features[f"{sector}|tok|{word}"] += weight
        for i in range(len(word) - 2):
            features[f"{sector}|c3|{word[i : i + 3]}"] += weight * embedding.TRIPLES
    for i, (a, b) in enumerate(zip(words, words[1:], strict=False)):
        features[f"{sector}|bi|{a}_{b}"] += embedding.PAIRS * scale / (1 + i * 0.1)
    for feature, weight in features.items():
        h = hashed(feature, 0x811C9DC5, 16777619, 0)
        signed = -weight if h & 1 else weight
        v[h % dim] += signed
        v[hashed(feature, 0xDEADBEEF, 0x5BD1E995, 13) % dim] += signed * embedding.SECOND
    for i in range(min(len(words), embedding.PLACED)):
        angle = i / 10000 ** (2 * (i % dim) / dim)
        v[i % dim] += embedding.PLACES * scale / math.log(1 + len(grown)) * math.sin(angle)
        v[(i % dim + 1) % dim] += embedding.PLACES * scale / math.log(1 + len(grown)) * math.cos(angle)
    return (v / np.linalg.norm(v)).astype(np.float32) if words else np.full(dim, 1 / math.sqrt(dim), np.float32)


@pytest.mark.parametrize("at_once", [3, 50_000])
def test_embeddings_of_many_texts_like_one_by_one(at_once, monkeypatch):
    """The same floats, whether features are hashed as arrays over many texts or letter by letter."""
    monkeypatch.setattr(embedding, "_WORDS_AT_ONCE", at_once)
    texts = ["", "I love night mode; the meetings, the Meetings!", "aa", "漢字漢字 theme and 漢", "!", "y" * 700, "love prefer love task todo when", "ab " * 60]
    for dim, sector in ((256, "semantic"), (16, "reflective"), (70, "other")):
        want = np.stack([_embedded_one_by_one(t, dim, sector) for t in texts])
        assert np.array_equal(embedding.hash_embed(texts, dim, sector), want)
        assert np.array_equal(embedding.embed_text(texts[1], dim, sector), want[1])
    assert embedding.hash_embed([]).shape == (0, embedding.DIM)


def test_embeddings_hash_no_feature_alone(monkeypatch):
    """Only what features begin with is hashed letter by letter, however many words there are."""
    calls, plain = [], embedding._hash
    monkeypatch.setattr(embedding, "_hash", lambda *a: calls.append(a) or plain(*a))
    embedding.hash_embed([f"some words with number w{i} and x{i * 7}" for i in range(300)])
    assert len(calls) <= 6


def test_classification(spark):
    got = one(spark, model_stage.classify(F.array(*[F.lit(float(x)) for x in (80, 40, 31, 5, 33)])))
    assert (got["primary"], got["additional"], got["confidence"]) == ("episodic", ["semantic", "reflective"], 0.9)
    weak = one(spark, model_stage.classify(F.array(*[F.lit(0.0)] * 5)))
    assert (weak["primary"], weak["confidence"]) == ("semantic", 0.2)
    forced = one(spark, model_stage.classify(F.array(*[F.lit(float(x)) for x in (80, 40, 31, 5, 33)]), F.lit("emotional")))
    assert forced["primary"] == "emotional"


def test_model_stage_keeps_failures(spark):
    def fn(rows):
        if (rows["n"] == 3).any():
            raise RuntimeError("bad row")
        return rows.assign(m=rows["n"] * 2)[["m"]]

    df = spark.createDataFrame([(i,) for i in range(6)], "n long")
    got = {r["n"]: (r["m"], r["status"], r["error"]) for r in model_stage.model_stage(df, fn, "m long").collect()}
    assert got[3] == (None, "failed", "RuntimeError: bad row") and got[2] == (4, "completed", None) and len(got) == 6
    assert model_stage.model_stage(df, fn, "m long", on_error="drop").count() == 5
    rows, seen = model_stage.observed(model_stage.model_stage(df, fn, "m long"))
    assert rows.count() == 6 and seen.get == {"n": 6, "completed": 5, "failed": 1}


def test_rows_tried_again_leave_as_one_batch(spark):
    """Not a batch for each row; long numbers, texts, times and lists beside nulls stay as the model gave them."""
    when = dt.datetime(2024, 5, 6, 7, 8, 9)

    def fn(rows):
        if (rows["n"] % 3 == 0).any():
            raise RuntimeError("bad row")
        n = rows["n"]
        return rows.assign(m=n + 2**60, s=[None if x == 4 else str(x) for x in n], t=pd.Timestamp(when), v=[[float(x)] for x in n], b=n > 1, f=n / 2)[["m", "s", "t", "v", "b", "f"]]

    df = spark.range(0, 30, 1, 1).selectExpr("id AS n")
    out = model_stage.model_stage(df, fn, "m long, s string, t timestamp_ntz, v array<double>, b boolean, f double")
    sizes = out.mapInPandas(lambda bs: (pd.DataFrame({"k": [len(b)]}) for b in bs), "k long").collect()
    assert [r["k"] for r in sizes] == [30]
    rows = {r["n"]: r for r in out.collect()}
    assert all(rows[n][1:] == (None,) * 6 + ("failed", "RuntimeError: bad row") for n in range(0, 30, 3))
    assert all(rows[n][1:] == (n + 2**60, None if n == 4 else str(n), when, [float(n)], n > 1, n / 2, "completed", None) for n in range(30) if n % 3)
    dropped = model_stage.model_stage(df, fn, "m long, s string, t timestamp_ntz, v array<double>, b boolean, f double", on_error="drop")
    assert sorted(r["n"] for r in dropped.collect()) == [n for n in range(30) if n % 3]
    assert model_stage.model_stage(df.where("n = 3"), fn, "m long, s string, t timestamp_ntz, v array<double>, b boolean, f double", on_error="drop").count() == 0
    assert model_stage.model_stage(df.where("n = 3"), fn, "m long, s string, t timestamp_ntz, v array<double>, b boolean, f double").first()["status"] == "failed"


def test_retrieval_metrics(spark):
    results = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1), ("q2", "d", 4)], "query_id string, id string, rank int")
    gold = spark.createDataFrame([("q1", "a"), ("q2", "d"), ("q3", "x")], "query_id string, id string")
    r = evaluate.retrieval_metrics(results, gold).first()
    assert (r["n_queries"], r["recall_at_1"], r["recall_at_5"]) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3)) and r["mrr"] == pytest.approx((1 + 0.25) / 3)


def test_evaluation_files(spark, tmp_path):
    path = tmp_path / "eval.json"
    memories = [{"id": "m1", "text": "the cat sat on a mat", "sector": "semantic"}, {"id": "m2", "text": "rent is due on friday", "sector": "episodic"}]
    path.write_text(json.dumps({"memories": memories, "queries": [{"id": "q", "text": "where is the cat", "sector": "semantic", "gold_ids": ["m1"]}]}))
    m, q = evaluate.read_eval(spark, str(path))
    report = evaluate.evaluate(m, q)
    assert report.first()["mrr"] == 1.0
    evaluate.write_eval(report, str(tmp_path / "out"))
    report = [r["value"] for r in spark.read.text(str(tmp_path / "out/report.md")).collect()]
    assert report[0].startswith("| n_queries |") and "| mrr |" in report[0] and set(report[1]) == {"|", "-"} and "| 1.0 |" in report[2]
    path.write_text(json.dumps({"memories": memories, "queries": [{"id": "q", "text": "x", "sector": "semantic", "gold_ids": ["lost"]}]}))
    with pytest.raises(ValueError):
        evaluate.read_eval(spark, str(path))


def test_labelled_files(spark, tmp_path):
    (tmp_path / "train.csv").write_text("text,primary\nhello,1\n")
    (tmp_path / "train.json").write_text('[{"text": "a", "primary": 1}, {"text": "b", "primary": 2}]')
    (tmp_path / "test.jsonl").write_text('{"text": "a"}\n{"text": "b"}\n')
    assert evaluate.read_labelled(spark, str(tmp_path / "train.csv"), "csv").first()["split"] == "train"
    assert evaluate.read_labelled(spark, str(tmp_path / "train.json"), "json").count() == 2
    assert evaluate.read_labelled(spark, str(tmp_path / "test.jsonl"), "jsonl").first()["split"] == "test"
    rows = pa.table({"text": ["a", "b"], "primary": [1, 2]})
    for name, new in (("dev", pa.ipc.new_file), ("stream", pa.ipc.new_stream)):
        with new(str(tmp_path / f"{name}.arrow"), rows.schema) as f:
            f.write_table(rows)
        got = evaluate.read_labelled(spark, str(tmp_path / f"{name}.arrow"), "arrow", "text string, primary long").collect()
        assert [tuple(r) for r in got] == [("a", 1, name), ("b", 2, name)]


def test_fingerprints_of_whole_texts(spark):
    def plain(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        x, out = h or 1, []
        for _ in range(32):
            x ^= x << 13 & 0xFFFFFFFF
            x ^= x >> 17
            x ^= x << 5 & 0xFFFFFFFF
            out.append(x / 0xFFFFFFFF * 2 - 1)
        return np.array(out) / np.linalg.norm(out)

    for text in ("a", "memory " * 30, "é漢字 mixed", "same beginning, other end 1", "same beginning, other end 2"):
        assert np.allclose(one(spark, V.fingerprint(F.lit(text))), plain(text))


def test_pairs_of_large_facts_are_dealt(spark):
    links = spark.createDataFrame([("f", f"e{i:03d}") for i in range(50)] + [("g", "a"), ("g", "b"), ("h", "x")], "fact_id string, canonical_id string")
    want = {("f", f"e{i:03d}", f"e{j:03d}") for j in range(50) for i in range(j)} | {("g", "a", "b")}
    for at_once in (3, 512):
        got = graph.entity_pairs(links, at_once=at_once).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert [tuple(r) for r in graph.entity_pairs(links, most=5).collect()] == [("g", "a", "b")]


def test_settings_out_of_bounds(spark):
    rel = spark.createDataFrame([("u", chr(97 + i), chr(98 + i), "SAME_AS", 1.0) for i in range(6)], "user_id string, source string, target string, edge_relation string, confidence double")
    seeds = spark.createDataFrame([("q", "u", "a")], "query_id string, user_id string, canonical_id string")
    assert {r["canonical_id"] for r in graph.walk(seeds, rel, hops=99).collect()} == {"b", "c", "d", "e"}
    assert graph.walk(seeds, rel, least_confidence=9.9).count() == 1 and graph.walk(seeds, rel, decay=-3.0, least_score=0.0).first()["score"] == pytest.approx(0.2)
    assert GraphConfig("custom", hops=99, decay=9.0, least_confidence=None).settings() == GraphConfig("custom", hops=4, decay=1.0, least_confidence=0.5)


def test_new_entities_are_grouped(spark):
    old = spark.createDataFrame([("c1", "u", "Paris", "LOCATION", [0.0, 1.0, 0.0])], "id string, user_id string, name string, entity_type string, v array<double>")
    new = spark.createDataFrame([("u", x, "LOCATION", v) for x, v in (("Oslo", [1.0, 0.0, 0.0]), ("Oslo city", [0.9, 0.0, 0.3]), ("city of Oslo", [0.75, 0.0, 0.62]), ("Bergen", [-1.0, 0.0, 0.1]), ("Lutetia", [1.0, -1.0, 0.0]), ("lutetia", [0.0, 1.0, 0.1]))], "user_id string, text string, entity_type string, v array<double>")
    got = {r["text"]: (r["canonical_id"], r["is_new"]) for r in graph.canonicalise(new, old).collect()}
    assert got["Oslo"] == got["Oslo city"] == got["city of Oslo"] != got["Bergen"]
    assert got["Lutetia"] == got["lutetia"] == ("c1", False)  # any mention of the key may be near


def test_repeats_in_a_batch(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    new = spark.createDataFrame([("a", "u", [1.0, 0.0]), ("b", "u", [1.0, 0.1]), ("c", "u", [1.0, 0.4]), ("d", "u", [0.0, 1.0]), ("e", "v", [1.0, 0.0])], "id string, user_id string, v array<double>").withColumn("created_at", at)
    got = {r["id"]: r["first_id"] for r in dynamics.repeats_within(new).collect()}
    assert got == {"b": "a", "c": "a"}  # c is near b alone, which repeats a


def test_sector_classifier(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(f"{words[i % 5]} {words[i % 5]} filler{i}", i % 5, [int(k == i % 5) for k in range(5)]) for i in range(150)]
    df = spark.createDataFrame(rows[:100], "text string, primary int, labels array<int>")
    unseen = spark.createDataFrame(rows[100:], df.schema)
    scored = evaluate.score_sectors(evaluate.fit_sectors(df, features=512, iterations=(1, 20)), unseen)
    assert evaluate.branch_metrics(scored).first()["accuracy"] > 0.95
    first = scored.first()
    assert len(first["probabilities"]) == len(SECTORS) and first["labels_pred"][first["primary_pred"]] == 1 and 0 < first["confidence"] <= 1


def test_weighted_loss(spark):
    df = spark.createDataFrame([(1.0, [0.2, 0.8], [1, 0], [0.9, 0.4]), (5.0, [0.5, 0.5], [0, 0], [0.1, 0.1])], "label double, shares array<double>, labels array<int>, probabilities array<double>")
    got = evaluate.weighted_loss(df).first()
    primary = -(math.log(0.8) + math.log(1e-12)) / 2
    label = -((math.log(0.9) + math.log(0.6)) / 2 + math.log(0.9)) / 2
    assert (got["primary_loss"], got["label_loss"], got["loss"]) == pytest.approx((primary, label, 0.7 * primary + 0.3 * label))


def test_hits_bring_back_short_vectors(spark):
    mem = spark.createDataFrame([("a", "u", "semantic", "short", "long text"), ("b", "u", "semantic", "", "text"), ("c", "u", "semantic", None, "text"), ("d", "u", "semantic", None, "text")], "id string, user_id string, primary_sector string, summary string, content string")
    vec = spark.createDataFrame([("a", "semantic", [0.1] * 64), ("a", "episodic", [0.1] * 64), ("b", "semantic", [0.1] * 65), ("c", "semantic", [0.1]), ("d", "semantic", [0.1])], "id string, sector string, v array<double>")
    hits = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "id string")
    got = {(r["id"], r["sector"]): r["v"] for r in dynamics.regenerated(hits, mem, vec).collect()}
    want = embedding.vectorise(spark.createDataFrame([("a", "u", "short", ["semantic"]), ("c", "u", "text", ["semantic"])], "id string, user_id string, content string, sectors array<string>"))
    assert got == {(r["id"], r["sector"]): r["v"] for r in want.collect()}


def test_ingest_of_texts(spark):
    at = F.lit("2024-01-02").cast("timestamp_ntz")
    old = spark.createDataFrame([("m1", "u", "semantic", 0.5, "the cat sat on the mat", ["semantic"])], "id string, user_id string, primary_sector string, salience double, content string, sectors array<string>").withColumns({"last_seen_at": at, "created_at": at})
    new = spark.createDataFrame([("n1", "u", "the cat sat on the mat", "semantic", ["semantic"]), ("n2", "u", "rates fell again", "episodic", ["emotional"]), ("n3", "u", "", "semantic", None)], "id string, user_id string, content string, primary_sector string, sectors array<string>").withColumn("created_at", at)
    inserts, boosts, waypoints, vectors = jobs.ingest_texts(new, old, embedding.vectorise(old))
    rows = {r["id"]: r for r in inserts.collect()}
    assert "n1" not in rows and rows["n2"]["salience"] == 0.5 and rows["n2"]["version"] == 1 and "v" not in inserts.columns
    assert [tuple(r) for r in boosts.collect()] == [("m1", 1)]
    assert {r["src_id"] for r in waypoints.collect()} == set(rows)
    assert {(r["id"], r["sector"]) for r in vectors.where("id = 'n2'").collect()} == {("n2", "episodic"), ("n2", "emotional")}


def test_graph_presets():
    assert GraphConfig("recall", hops=4).settings().hops == 2 and GraphConfig("precision", hops=4).settings().hops == 1
    assert GraphConfig("custom", hops=3).settings().hops == 3


def test_order_of_rows_does_not_matter(spark, sf):
    t = Tables(spark, sf)
    rows = [sorted(map(tuple, recall.vector_recall(t.probes.repartition(k), t.vectors.repartition(k + 1)).select("query_id", "id", "sector", "rank").collect())) for k in (1, 5)]
    assert rows[0] == rows[1]


def test_streams_like_batches(spark, sf, tmp_path):
    t = Tables(spark, sf)
    rows = t.hits.select(F.col("event_id").cast("string").alias("id"), "user_id", "memory_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "hits"))
    for name, make in (("sessions", lambda d: jobs.sessions(d.select("id", "user_id", "ts"))), ("hits", jobs.hit_counts)):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        batch = {str(r) for r in make(rows).collect()}
        streamed = {str(r) for r in spark.table(name).collect()}
        # What the watermark has not closed yet is not out; all that is out agrees.
        assert streamed and streamed <= batch


def test_stream_ingest_and_reinforce(spark, tmp_path):
    mem = spark.createDataFrame([("m1", "u", "semantic", 0.5)], "id string, user_id string, primary_sector string, salience double").withColumns({"last_seen_at": F.lit("2024-01-01").cast("timestamp_ntz"), "created_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    vec = spark.createDataFrame([("m1", "semantic", [1.0, 0.0])], "id string, sector string, v array<double>")
    new = spark.createDataFrame([("n1", "u", [1.0, 0.0]), ("n2", "u", [0.0, 1.0]), ("n2", "u", [0.0, 1.0])], "id string, user_id string, v array<double>").withColumn("created_at", F.lit("2024-01-02").cast("timestamp_ntz"))
    new.coalesce(1).write.parquet(str(tmp_path / "new"))
    seen = []

    def sink(number, inserts, boosts, waypoints):
        seen.append((sorted(r["id"] for r in inserts.collect()), [(r["id"], r["n"]) for r in boosts.collect()], [(r["src_id"], r["dst_id"]) for r in waypoints.collect()]))

    schema = new.schema
    source = spark.readStream.schema(schema)
    q = jobs.stream_ingest(source.parquet(str(tmp_path / "new")).withColumn("created_at", F.col("created_at").cast("timestamp")), lambda: (mem.withColumn("created_at", F.col("created_at").cast("timestamp")), vec), sink, str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert [x for x in seen if x[0] or x[1]] == [(["n2"], [("m1", 1)], [("n2", "n2")])]
