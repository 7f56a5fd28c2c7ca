"""Profiles merged by path, sealed profiles, and nearest vectors by random projections."""

from __future__ import annotations

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import sealing
from palimpsest.operators import neighbours, recall
from palimpsest.operators import sessions as ses


def merged(old, new, **kw):
    return ses.Profiles(**kw).merge(old, new)


def test_tags_go_by_name_alone():
    old, new = {"tags": [{"id": 1, "name": "tea", "weight": 0.6}]}, {"tags": [{"id": 2, "name": " TEA ", "weight": 0.9}, {"id": 1, "name": "run"}]}
    assert merged(old, new) == {"tags": [{"id": 2, "name": " TEA ", "weight": 0.9}, {"id": 1, "name": "run"}]}


@pytest.mark.parametrize("key", ["code", "type", "label", "id", "key", "name"])
def test_items_of_other_lists_go_by_the_default_keys(key):
    old, new = {"attributes": {"x": [{key: "A", "n": 1}]}}, {"attributes": {"x": [{key: "a", "n": 2}, {key: 7}, {key: 7, "m": 1}]}}
    assert merged(old, new) == {"attributes": {"x": [{key: "a", "n": 2}, {key: 7, "m": 1}]}}


def test_below_a_wildcard_neither_title_nor_type_names_an_item():
    pets = [{"type": "cat", "title": "x", "n": 1}, {"type": "cat", "title": "x", "n": 2}]
    assert merged({"demographic": {"extra": {"pets": pets}}}, {"demographic": {"extra": {"pets": [{"type": "cat", "code": "c1"}]}}}) == {"demographic": {"extra": {"pets": [*pets, {"type": "cat", "code": "c1"}]}}}
    assert merged({"demographic": {"extra": {"deep": {"pets": [{"code": "c1", "n": 1}]}}}}, {"demographic": {"extra": {"deep": {"pets": [{"code": "C1", "m": 2}]}}}}) == {"demographic": {"extra": {"deep": {"pets": [{"code": "C1", "n": 1, "m": 2}]}}}}
    assert merged({"other": {"pets": pets}}, {"other": {"pets": []}}) == {"other": {"pets": [pets[1]]}}


def test_paths_of_ones_own():
    table = {"a.b": ("x",), "a.*": ("y",), "a.c.*": ("z",)}
    p = ses.Profiles(table)
    assert [p.keys(x) for x in ("a.b", "a.d", "a.c.e", "q")] == [("x",), ("y",), ("z",), ses.IDENTITY]
    assert merged({"a": {"b": [{"x": 1, "y": 2}]}}, {"a": {"b": [{"x": 1, "y": 3}, {"y": 3}]}}, by_path=table) == {"a": {"b": [{"x": 1, "y": 3}, {"y": 3}]}}


def test_profiles_are_merged_and_made_compact_by_path(spark):
    old = {"demographic": {"extra": {"pets": [{"type": "cat", "name": "A"}, {"type": "cat", "name": "B"}]}}, "tags": [{"id": 1, "name": "t", "weight": 0.6}]}
    new = {"demographic": {"extra": {"pets": [{"type": "cat", "name": "b", "age": 3}]}}, "tags": [{"id": 2, "name": "T", "weight": 0.7}]}
    a, b = (spark.createDataFrame([("u", json.dumps(x)), (n, "broken {"), ("none", None)], "user_id string, profile string") for n, x in (("v", old), ("w", new)))
    got = {r["user_id"]: json.loads(r["profile"]) for r in ses.merge_profiles(a, b).collect()}
    assert got["u"] == {"demographic": {"extra": {"pets": [{"type": "cat", "name": "A"}, {"type": "cat", "name": "b", "age": 3}]}}, "preferences": {"habits": []}, "tags": [{"id": 2, "name": "T", "weight": 0.7}]}
    assert got["v"] == got["w"] == got["none"] == {"preferences": {"habits": []}, "tags": []}


KEY, OTHER = (base64.b64encode(bytes(range(i, i + 32))).decode() for i in (0, 1))
VALUE = {"a": "x", "b": {"c.d": ["y", "", 5, None, True, {"e": "日本\n\"q\""}]}, "f": [], "g": "json_enc::not sealed", "h": "x"}


def one_row(spark, value, key=KEY, **bound):
    names = F.create_map(*[F.lit(x) for p in (bound or {"id": "p1"}).items() for x in p])
    return spark.range(1).select(F.lit(value).alias("v"), F.lit(key).cast("string").alias("k"), names.alias("b"))


def sealed_and(spark, value, change=sealing.sealed_json, key=KEY, **bound):
    return one_row(spark, value, key, **bound).select(change(F.col("v"), F.col("k"), F.col("b")).alias("x")).first()["x"]


def test_profiles_are_sealed_text_by_text(spark):
    shut = sealed_and(spark, json.dumps(VALUE))
    s = json.loads(shut)
    texts = [s["a"], s["b"]["c.d"][0], s["b"]["c.d"][5]["e"], s["g"], s["h"]]
    assert all(t.startswith(sealing.SEALED) for t in texts) and len(set(texts)) == 5
    assert s["b"]["c.d"][1:5] == ["", 5, None, True] and s["f"] == []
    assert json.loads(sealed_and(spark, shut, sealing.opened_json)) == VALUE
    twice = json.loads(sealed_and(spark, shut))
    assert twice["a"] == s["a"] and json.loads(sealed_and(spark, json.dumps(twice), sealing.opened_json)) == VALUE


def test_sealed_texts_open_in_their_place_only(spark):
    shut = json.loads(sealed_and(spark, json.dumps({"a": "x", "b": ["y", "z"]})))
    swapped = {"a": shut["b"][0], "b": [shut["a"], shut["b"][1]]}
    got = json.loads(sealed_and(spark, json.dumps(swapped), sealing.opened_json))
    assert got == swapped | {"b": [swapped["b"][0], "z"]}
    for wrong in ({"key": OTHER}, {"id": "p2"}, {"id": "p1", "field": "tags"}):
        assert json.loads(sealed_and(spark, json.dumps(shut), sealing.opened_json, **wrong)) == shut


def test_what_cannot_be_sealed_stays(spark):
    for value in (None, "", "broken {", "5", "[]", "null", '"' + "a" * 3 + '"'):
        got = sealed_and(spark, value)
        assert got == value if value != '"aaa"' else json.loads(got).startswith(sealing.SEALED)
    assert sealed_and(spark, '{"a": "x"}', key=None) == '{"a": "x"}'


def test_bound_data_of_a_leaf(spark):
    got = one_row(spark, json.dumps(VALUE), id="p1", user_id="ü").select(sealing.leaves(F.col("v"), F.col("b")).alias("x")).first()["x"]
    assert [(r["path"], r["text"]) for r in got] == [("a", "x"), ("b.c.d[0]", "y"), ("b.c.d[1]", ""), ("b.c.d[5].e", '日本\n"q"'), ("g", "json_enc::not sealed"), ("h", "x")]
    assert bytes(got[1]["bound"]) == b'{"id":"p1","path":"b.c.d[0]","user_id":"\\u00fc"}'


def vectors_of(spark, v, **columns):
    rows = [(f"d{i}", *columns.values(), [float(y) for y in x]) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, ["id", *columns, "v"])


def found_by(df):
    return {(r["query_id"], r["sector"], r["id"], r["rank"], round(r["similarity"], 9)) for r in df.collect()}


def test_projections_find_all_of_a_small_user(spark):
    rand = np.random.default_rng(3)
    a = vectors_of(spark, rand.standard_normal((60, 16)), user_id="u", sector="s")
    b = vectors_of(spark, rand.standard_normal((30, 16)), user_id="w", sector="t")
    odd = spark.createDataFrame([("z", "u", "s", [0.0] * 16), ("n", "u", "s", None), ("short", "u", "s", [1.0, 2.0]), ("same", "u", "s", [1.0] * 16), ("same", "u", "r", [1.0] * 16)], "id string, user_id string, sector string, v array<double>")
    held = a.select("id", "user_id", "sector", "v").union(b.select("id", "user_id", "sector", "v")).union(odd)
    asked = [("q1", "u", 5, [1.0] * 16), ("q2", "u", 5, [0.0] * 16), ("q3", "w", 2, [float(x) for x in rand.standard_normal(16)]), ("q4", "nobody", 5, [1.0] * 16), ("q5", "u", 5, None), ("q6", "u", 1, [1.0, 0.0]), ("q7", "u", 25, [-1.0] * 16)]
    probes = spark.createDataFrame(asked, "query_id string, user_id string, top_k int, qv array<double>")
    want = found_by(recall.vector_recall(probes, held))
    assert found_by(neighbours.near_recall(probes, held)) == want and {r[0] for r in want} == {"q1", "q2", "q3", "q6", "q7"}
    index = neighbours.index(held, neighbours.Projections())
    assert found_by(neighbours.near_recall(probes, held, held=index)) == want
    assert neighbours.near_recall(probes, held.limit(0)).count() == 0


def test_projections_compare_few_and_find_most(spark):
    rand = np.random.default_rng(4)
    centres = rand.standard_normal((300, 32))
    v = np.repeat(centres, 20, axis=0) + 0.5 * rand.standard_normal((6000, 32))
    held = vectors_of(spark, v, user_id="u", sector="s")
    probes = held.where("CAST(substr(id, 2) AS INT) % 50 = 0").selectExpr("id AS query_id", "user_id", "5 AS top_k", "v AS qv")
    by = neighbours.Projections(tables=8, bits=10, enough=4)
    want, got = (found_by(x) for x in (recall.vector_recall(probes, held), neighbours.near_recall(probes, held, by)))
    compared = neighbours.candidates(probes, neighbours.index(held, by), by).count()
    assert len({r[:3] for r in got} & {r[:3] for r in want}) >= 0.95 * len(want)
    assert compared < 0.1 * 6000 * probes.count()


def test_measured_recall(spark, sf):
    from palimpsest.plans.all_queries import QUERIES

    rows = QUERIES["j9_measured_recall"](spark, sf).collect()
    assert len(rows) > 3 and sum(r["found"] for r in rows) >= 0.95 * sum(r["wanted"] for r in rows)


def walked(mentions, stored):
    """Mentions (id, user, key, v) in order, by plain Python; stored: (id, user, key, v)."""
    import hashlib

    def like(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    out, begun = {}, []
    for i, user, key, v in mentions:
        same = sorted(e for e, u, k, _ in stored if (u, k) == (user, key)) or [e for e, u, k, _ in begun if (u, k) == (user, key)]
        if same:
            out[i] = same[0]
            continue
        near = [(-like(v, w), 0, e) for e, u, _, w in stored if u == user and v is not None and w is not None]
        near += [(-like(v, w), 1 + n, e) for n, (e, u, _, w) in enumerate(begun) if u == user and v is not None and w is not None]
        best = min(near, default=(0, 0, None))
        if best[0] <= -0.85:
            out[i] = best[2]
        else:
            out[i] = "e" + hashlib.sha256(f"{user}|{key}".encode()).hexdigest()[:24]
            begun.append((out[i], user, key, v))
    return out


def test_entities_in_order_like_plain_python(spark):
    from palimpsest.operators import graph

    rand = np.random.default_rng(8)
    centres = rand.standard_normal((12, 6))
    rows = []
    for i in range(400):
        v = centres[rand.integers(12)] + 0.35 * rand.standard_normal(6)
        rows.append((i, f"u{rand.integers(3)}", f"N {rand.integers(150)}", "person", None if i % 41 == 0 else [float(x) for x in (v if i % 53 else v * 0)]))
    old = [(f"c{i}", f"u{i % 3}", f"n{i * 7}", "PERSON", None if i == 4 else [float(x) for x in centres[i % 5]]) for i in range(9)]
    mentions = spark.createDataFrame(rows, "id long, user_id string, text string, entity_type string, v array<double>").repartition(5)
    stored = spark.createDataFrame(old, "id string, user_id string, name string, entity_type string, v array<double>")
    got = graph.canonicalise_in_order(mentions, stored, ["id"]).collect()
    want = walked([(i, u, "PERSON|" + t.replace(" ", "").lower(), v) for i, u, t, _, v in rows], [(i, u, "PERSON|" + t, v) for i, u, t, _, v in old])
    assert {r["id"]: r["canonical_id"] for r in got} == want
    assert {r["is_new"] for r in got if r["canonical_id"].startswith("e")} == {True} and {r["is_new"] for r in got if r["canonical_id"].startswith("c")} == {False}
    assert graph.canonicalise_in_order(mentions, stored.limit(0), ["id"]).count() == 400 and graph.canonicalise_in_order(mentions.limit(0), stored, ["id"]).count() == 0


def test_relations_by_other_end_source_and_evidence(spark):
    from palimpsest.operators import graph

    rows = [("a", "b", "R", 1.0, "RULE", ["f1", "f2"]), ("c", "a", "R", 0.5, "FALLBACK", ["f2"]), ("b", "c", "S", 0.2, "RULE", None), ("a", "a", "S", None, None, ["f1"])]
    df = spark.createDataFrame(rows, "source string, target string, edge_relation string, confidence double, inference_source string, evidence array<string>")
    ends = lambda **kw: sorted((r["source"], r["target"]) for r in graph.relations_filter(df, **kw).collect())
    assert ends(entity="a", related="b") == [("a", "b")] and ends(related="c") == [("b", "c"), ("c", "a")]
    assert ends(sources=["RULE"]) == [("a", "b"), ("b", "c")] and ends(fact="f2") == [("a", "b"), ("c", "a")]
    assert ends(entity="a", fact="f2", sources=["FALLBACK", "RULE"], related="c") == [("c", "a")] and ends(fact="f1", low=0.1) == [("a", "b")]


@pytest.mark.parametrize(("by_sql", "plain"), [("i1_chunks_by_sql", "i1_chunks"), ("i2_sections_by_sql", "i2_sections")])
def test_table_functions_give_the_same_rows(spark, sf, by_sql, plain):
    from palimpsest.plans.all_queries import QUERIES

    a, b = QUERIES[by_sql](spark, sf), QUERIES[plain](spark, sf)
    assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_table_functions_in_sql(spark):
    from palimpsest.operators import table_functions

    table_functions.register(spark)
    got = spark.sql("SELECT id, section_index, section FROM VALUES (1, 'aa. bb.'), (2, NULL) AS t(id, x), LATERAL section_text(x, 4) ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, 0, "aa."), (1, 1, "bb."), (2, 0, "")]
    assert [tuple(r) for r in spark.sql("SELECT chunk, start, `end` FROM chunk_text('one two')").collect()] == [("one two", 0, 7)]


@pytest.mark.parametrize("hot", [1_000_000, 70, 7])
def test_segments_of_rows_of_one_time(spark, hot):
    """Very many rows of one hour, most of one time, and a few of others, are numbered alike however they are divided."""
    from palimpsest.operators import dynamics

    rand = np.random.default_rng(6)
    times = ["2024-01-01 10:00:00"] * 300 + ["2024-01-01 10:59:59"] * 60 + ["2023-12-31 23:00:00"] * 5 + [f"2024-01-0{d} 11:00:00" for d in range(1, 8)]
    rows = [(f"m{i:03d}", t) for i, t in enumerate(times)]
    df = spark.createDataFrame([rows[i] for i in rand.permutation(len(rows))], "id string, at string").selectExpr("id", "CAST(at AS TIMESTAMP_NTZ) AS created_at").repartition(6)
    got = dynamics.assign_segments(df, size=10, hot=hot)
    assert got.columns == ["id", "created_at", "segment"]
    want = {i: n // 10 for n, (_, i) in enumerate(sorted((t, i) for i, t in rows))}
    assert {r["id"]: r["segment"] for r in got.collect()} == want
