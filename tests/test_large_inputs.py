"""What keeps steps bounded on large tables, and that it changes no result."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_python_gets_batches_of_bounded_bytes(spark):
    """40 MB of texts in one partition come in batches of a few MB, whichever operator asks first."""
    from palimpsest.functions import sealing, text
    from palimpsest.operators import ingest, model_stage

    docs = spark.range(0, 400, 1, 1).select(F.concat(F.lit("d"), "id").alias("id"), F.repeat(F.lit("some words. "), 9000).alias("content"))
    makers = {
        "words": lambda: text.canonical_tokens(F.col("content")),
        "leaves": lambda: sealing.leaves(F.col("content"), F.create_map(F.lit("a"), F.lit("b"))),
        "sections": lambda: ingest.section_list(F.col("content")),
        "stage": lambda: model_stage.model_stage(docs, lambda b: b[["id"]].assign(n=len(b))[["n"]], "n long"),
    }
    for name, make in makers.items():
        spark.conf.unset(BOUND)
        made = make()
        assert spark.conf.get(BOUND) == "4194304b" or spark.conf.get(BOUND) == "4m", name
    assert made.agg(F.max("n")).first()[0] < 100


def test_a_root_knows_its_sections(spark):
    from palimpsest.operators import ingest

    docs = spark.createDataFrame([("a", "u", "text", "one two three. " * 100), ("b", "u", "text", "short"), ("c", "u", "text", "x. " * 300), ("m", "u", "text", ". " * 400)], "id string, user_id string, content_type string, content string")
    memories, links = ingest.ingest(docs)
    assert "Join" not in memories._jdf.queryExecution().optimizedPlan().toString()
    rows = memories.collect()
    roots = {r["id"]: r for r in rows if r["strategy"] == "root"}
    assert set(roots) == {"a", "c", "m"} and roots["m"]["total_sections"] == 0 and "across 0 sections" in roots["m"]["content"]
    for k, r in roots.items():
        assert r["total_sections"] == sum(x["root_id"] == k for x in rows) == links.where(F.col("src_id") == k).count()


def test_long_texts_are_hashed_at_once():
    """The hash of whole arrays of code points is that of one after the other."""
    from palimpsest.functions import vectors as V

    rand = np.random.default_rng(2)
    alphabets = ["ab \n", "".join(map(chr, range(32, 256))), "né漢字", "a😀b漢", "\0"]
    texts = ["", "x", "\0"] + ["".join(rand.choice(list(a), n)) for a in alphabets for n in (63, 64, 65, 3000, V.HASHED_AT_ONCE - 1, V.HASHED_AT_ONCE, V.HASHED_AT_ONCE + 1, 150_000)]
    for text in texts:
        h = 2166136261
        for c in text or "\0":
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        assert V.fnv1a(text) == h


def test_no_word_and_no_text_is_shuffled_to_decay(spark):
    from palimpsest.operators import dynamics

    texts = [("a", "u", "b a b a c"), ("b", "u", None), ("c", "u", "!"), ("d", "u", "one")]
    df = spark.createDataFrame(texts, "id string, user_id string, content string")
    words = dynamics.top_keywords(df, 2)
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["keywords"] for r in dynamics.top_keywords(spark.createDataFrame([("a", "bb aa bb aa cc"), ("b", None), ("c", "!"), ("d", "one")], "id string, content string"), 2).collect()} == {"a": "bb aa", "d": "one"}


@pytest.mark.parametrize("at_once", [7, 8192])
def test_blocks_of_vectors_like_plain_pairs(spark, at_once):
    """Copies, vectors without length, null ones and other lengths, in one block and in many."""
    from palimpsest.operators import pairs

    rand = np.random.default_rng(9)
    v = np.repeat(rand.standard_normal((12, 5)), 5, axis=0) + np.repeat(rand.integers(0, 2, 30), 2)[:, None] * 0.05
    rows = [(f"d{i}", "u" if i % 3 else "w", [float(x) for x in v[i]]) for i in range(60)] + [("z", "u", [0.0] * 5), ("n", "u", None), ("s", "u", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id string, user_id string, v array<double>")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return None
        dot = na = nb = 0.0
        for x, y in zip(a, b, strict=True):
            dot, na, nb = dot + x * y, na + x * x, nb + y * y
        return dot / (np.sqrt(na) * np.sqrt(nb)) if na * nb else 0.0

    like = {(a, b): s for a, u, x in rows for b, w, y in rows if u == w and a != b and (s := cosine(x, y)) is not None}
    got = {r["id"]: (r["to"], r["s"]) for r in pairs.nearest(df, df, ["user_id"], 0.9, at_once=at_once).collect()}
    best = {a: min((-s, b) for (x, b), s in like.items() if x == a) for a in {a for a, _ in like}}
    assert got == {a: (b, -s) for a, (s, b) in best.items() if -s >= 0.9}
    all_ = pairs.cosines(df, ["user_id"], at_once).collect()
    assert len(all_) == len(like) / 2 and {(r["a"], r["b"]): r["similarity"] for r in all_} == {k: s for k, s in like.items() if k[0] < k[1]}

    def groups(edges):
        root = {r[0]: r[0] for r in rows}
        for _ in rows:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    kept = [(r["a"], r["b"]) for r in pairs.links(df, ["user_id"], 0.97, at_once).collect()]
    assert groups(kept) == groups([k for k, s in like.items() if s >= 0.97]) and all(like[k] >= 0.97 for k in kept)


def test_the_index_is_completed(spark):
    """Vectors without near neighbours: what the projections miss comes from the pass with their bounds."""
    from palimpsest.operators import neighbours, recall

    v = np.random.default_rng(4).standard_normal((3000, 24))
    held = spark.createDataFrame([(f"d{i}", "u", "s", [float(x) for x in y]) for i, y in enumerate(v)], "id string, user_id string, sector string, v array<double>")
    probes = held.where("CAST(substr(id, 2) AS INT) % 100 = 0").selectExpr("id AS query_id", "user_id", "5 AS top_k", "v AS qv")
    by = neighbours.Projections(tables=2, bits=8, enough=1)
    found = [{(r["query_id"], r["id"], r["rank"]) for r in x.collect()} for x in (recall.vector_recall(probes, held), neighbours.near_recall(probes, held, by, exact=True), neighbours.near_recall(probes, held, by))]
    assert found[0] == found[1] != found[2]


def test_scores_by_words_are_whole_in_a_task(spark):
    """No row for a query, memory and term leaves a task; ties go by id."""
    from palimpsest.operators import recall

    memories = spark.createDataFrame([(f"m{i:02}", "u", "alpha beta" if i % 2 else "alpha") for i in range(30)] + [("x", "w", "alpha")], "id string, user_id string, content string")
    queries = spark.createDataFrame([("q", "u", "alpha beta gamma", 2), ("r", "w", "beta", 2)], "query_id string, user_id string, text string, top_k int")
    got = recall.bm25_recall(queries, memories)
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["query_id"], r["id"]) for r in got.orderBy("rank").collect()] == [("q", f"m{i:02}") for i in range(1, 12, 2)]


def test_texts_are_read_once_for_all_queries(spark):
    """Words are looked up before texts meet queries, with the results of text by text."""
    from palimpsest.functions import text as T
    from palimpsest.operators import recall

    texts = ["The meetings, abcdef x_y", "漢字漢 ABC abc", None, "", "sync night prefers", "a-b c3d4"]
    memories = spark.createDataFrame([(f"m{i}", "u" if i % 2 else "w", t) for i, t in enumerate(texts)], "id string, user_id string, content string")
    asked = spark.createDataFrame([("q1", "u", ["meeting", "bc", "漢字", "字漢"]), ("q2", "u", []), ("q3", "w", ["dark", "night", "x_y", "c3d", "cde", "prefer", "like"]), ("q4", "v", ["x"])], "query_id string, user_id string, tokens array<string>")
    held = recall.met_index(asked, memories)
    assert set(held.columns) == {"id", "user_id", "words", "inside"}
    q = F.col("tokens")
    got = held.join(asked, "user_id").select("query_id", "id", T.token_overlap(q, F.col("words")), T.keyword_overlap(q, None, F.col("inside")))
    want = asked.join(memories, "user_id").select("query_id", "id", T.token_overlap(q, T.token_set(F.col("content"))), T.keyword_overlap(q, F.col("content")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 9


def test_walks_sort_edges_of_entities_they_leave_from(spark):
    """The best edges of some entities are those that all entities have, and others are left out before they are ranked."""
    from palimpsest.operators import graph

    rows = [("u" if i % 2 else "w", f"a{i % 7}", f"a{i * 5 % 11}", "KNOWS", i % 10 / 10) for i in range(200)]
    rel = spark.createDataFrame(rows, "user_id string, source string, target string, edge_relation string, confidence double")
    only = spark.createDataFrame([("u", "a1"), ("w", "a2"), ("w", "none")], "user_id string, node string")
    some = graph.best_edges(graph.usable_edges(rel), 6, 2, only)
    want = {(r["user_id"], r["node"]): r["edges"] for r in graph.adjacency(rel, 6, 2).collect()}
    assert {(r["user_id"], r["node"]): r["edges"] for r in some.collect()} == {k: v for k, v in want.items() if k in (("u", "a1"), ("w", "a2"))}
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")  # below, so before


@pytest.mark.parametrize("at_once", [3, 512])
def test_pairs_of_repeated_links_come_once_with_columns_of_their_fact(spark, at_once):
    from palimpsest.operators import graph

    links = [("f", f"e{i:02}") for i in range(20)] * 2 + [("g", "b"), ("g", "a"), ("g", "b"), ("h", "x"), ("h", "x"), ("i", "a"), ("i", None), (None, "a"), (None, "b"), ("k", "a"), ("k", "b")]
    df = spark.createDataFrame(links, "fact_id string, canonical_id string")
    facts = spark.createDataFrame([("f", "u", 1.0), ("g", "w", None), ("h", "u", 2.0)], "fact_id string, user_id string, confidence double")
    pairs = [("f", f"e{i:02}", f"e{j:02}") for j in range(20) for i in range(j)] + [("g", "a", "b"), ("k", "a", "b")]
    assert sorted(map(tuple, graph.entity_pairs(df, at_once=at_once).collect())) == sorted(pairs)
    told = {"f": ("u", 1.0), "g": ("w", None)}
    got = graph.entity_pairs(df, at_once=at_once, facts=facts)
    assert got.columns == ["fact_id", "a", "b", "user_id", "confidence"]
    assert sorted(map(tuple, got.collect())) == sorted((*p, *told[p[0]]) for p in pairs if p[0] in told)
    for most, left in ((1, 2), (189, 2), (190, 192)):
        assert graph.entity_pairs(df, most=most, at_once=at_once).count() == left


def test_edges_are_merged_after_one_shuffle_and_one_sort(spark):
    """Lists of evidence are not begun before the shuffle; hot edges, repeats and missing values count as before."""
    from palimpsest.operators import graph

    rows = [("u", "a", "b", "R", f"f{i % 400:03}", "RULE" if i % 2 else None, i / 10, i % 500) for i in range(1000)] + [("u", "a", "b", "S", "f1", "X", None, None), ("u", "a", "b", "S", "f0", "Y", 2.0, None), (None, "a", "b", "R", None, "Z", 1.0, 3), (None, "a", "b", "R", "f9", "Z", 4.0, 1)]
    rows += [("w", f"a{i}", f"b{i}", "R", f"f{i}", "RULE", float(i), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id string, source string, target string, edge_relation string, fact_id string, inference_source string, confidence double, at int")
    merged = graph.merge_relations(df.repartition(5), "at")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_set" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = {}
    for *edge, fact, source, confidence, at in rows:
        facts, last = want.get(tuple(edge), (set(), None))
        order = (at is not None, at or 0, fact is not None, fact or "")
        if last is None or order > last[0]:
            last = (order, source, confidence)
        want[tuple(edge)] = (facts | ({fact} - {None}), last)
    got = {tuple(r)[:4]: (r["evidence"], r["confidence"], r["inference_source"]) for r in merged.collect()}
    ties = {("u", "a", "b", "R")}  # rows of one time and fact leave open which is last
    assert got.keys() == want.keys() and all(got[k][0] == sorted(want[k][0]) for k in want)
    assert all(got[k][1:] == (want[k][1][2], want[k][1][1]) for k in want.keys() - ties)


def test_facts_are_grouped_without_sorting(spark, tmp_path):
    """A fact is an event where O is the largest status of its lines."""
    import datetime

    from palimpsest.sources.views import Tables

    at = datetime.datetime(2024, 1, 1)
    status = [["O"], ["F", "O"], ["O", "P"], ["o"], [None], [None, "O"], ["", "O"], ["OO", "O"]]
    lines = [(k, 1, 5, 6, 0.1 * i, s, at) for k, all_ in enumerate(status) for i, s in enumerate(all_)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 20 + k) for k in range(len(status))], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    facts = Tables(spark, str(tmp_path)).facts
    assert "SortAggregate" not in facts._jdf.queryExecution().executedPlan().toString()
    want = {f"f{k}-1": "event" if max((s for s in all_ if s is not None), default=None) == "O" else "conversation" for k, all_ in enumerate(status)}
    assert {r["id"]: r["fact_kind"] for r in facts.collect()} == want


def _sessions(spark, rand):
    """Sessions of few vectors, two of them one way and as long, some without length, null or of another length."""
    kinds = [[1.0, 0.0, 2.0], [0.5, -1.0, 0.0], [0.5, -1.0, 0.0], [0.0] * 3, [1.0, 2.0], None, [3.0, 1.0, 1.0]]
    ids = [f"s{i}" for i in rand.permutation(400)]
    vectors = spark.createDataFrame([(f"v{k}", v) for k, v in enumerate(kinds)], "id string, v array<float>")
    rows = [(s, "u" if i % 4 else "w", [f"{s}-{j}" for j in range(i % 3)] if i % 5 else None, f"v{i % 9}") for i, s in enumerate(ids)]
    return vectors, spark.createDataFrame(rows, "id string, user_id string, dialogue_ids array<string>, vector_id string").repartition(3)


def test_sessions_of_one_vector_are_cut_before_they_meet_queries(spark):
    """The plan meets no more sessions of a vector than the largest k, with the rows of all pairs; v may be the session's own."""
    from palimpsest.functions.vectors import cosine
    from palimpsest.operators import recall

    vectors, sessions = _sessions(spark, np.random.default_rng(3))
    own = sessions.join(vectors.withColumnRenamed("id", "vector_id"), "vector_id").drop("vector_id")
    probes = spark.createDataFrame([(f"q{i}", u, v) for i, (u, v) in enumerate([("u", [1.0, 1.0, 1.0]), ("u", [-1.0, 2.0, 0.0]), ("w", [0.0, -1.0, 0.0]), ("w", [0.0] * 3), ("x", [1.0] * 3), ("u", None)])], "query_id string, user_id string, qv array<float>")
    ks = spark.createDataFrame([(f"q{i}", k) for i, k in enumerate([3, 90, 5, 4, 2, 2])], "query_id string, effective_k int")
    all_ = probes.join(ks, "query_id").join(own, "user_id").withColumn("similarity", cosine(F.col("v"), F.col("qv"))).where("similarity IS NOT NULL")
    want = recall.ranked(all_, ["query_id"], F.desc("similarity"), "id").where("rank <= effective_k").select("query_id", "id", "dialogue_ids", "similarity", "rank")
    for held in (sessions, own):
        got = recall.session_recall(probes, held, ks, vectors)
        assert sorted(map(str, map(tuple, got.select("query_id", "session_id", "dialogue_ids", "similarity", "rank").collect()))) == sorted(map(str, map(tuple, want.collect())))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan and "WindowGroupLimit" in plan


def test_vectors_that_are_no_numbers_come_first(spark):
    """As in an ORDER BY; one that lacks a number is left out."""
    from palimpsest.operators import recall

    sessions = spark.createDataFrame([("a", "u", [1.0, 0.0], ["m"]), ("b", "u", [float("nan"), 0.0], ["n"]), ("c", "u", [0.5, 0.5], ["o"]), ("d", "u", [1.0, None], ["p"])], "id string, user_id string, v array<double>, dialogue_ids array<string>")
    probes = spark.createDataFrame([("q", "u", [1.0, 0.0])], "query_id string, user_id string, qv array<double>")
    got = recall.session_recall(probes, sessions, spark.createDataFrame([("q", 2)], "query_id string, effective_k int"))
    assert [r["session_id"] for r in got.orderBy("rank").collect()] == ["b", "a"]


@pytest.mark.parametrize("name", ["r11_session_scores", "r11_attached_sessions", "r11_added_sessions"])
def test_orders_are_sorted_once_for_sessions(spark, sf, name):
    """What is found of sessions and memories is read from a checkpoint: no later step sorts the orders again."""
    from palimpsest.plans.all_queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan


def test_memories_keep_their_latest_topics_before_queries_meet_them(spark):
    """Also where a memory has very many topics: ties go by id, a topic that holds two of a query's memories or is told twice counts once."""
    import datetime

    from palimpsest.operators import graph
    from palimpsest.operators.recall import ranked

    rand = np.random.default_rng(5)
    days = [None, *(datetime.datetime(2024, 1, d) for d in (1, 2, 3))]
    rows = [(f"t{i}", "u" if i % 3 else "w", days[rand.integers(4)], None if i % 50 == 0 else [f"d{k}" for k in rand.integers(0, 5, 3)]) for i in range(600)]
    topics = spark.createDataFrame(rows + rows[:200], "id string, user_id string, updated_at timestamp_ntz, dialogue_ids array<string>").repartition(3)
    ids = spark.createDataFrame([("q", "u", "d1"), ("q", "u", "d2"), ("r", "w", "d4"), ("r", "w", "d4"), ("s", "u", "none")], "query_id string, user_id string, id string")
    want = ranked(graph.topics_of(topics, ids), ["query_id"], F.desc_nulls_last("updated_at"), "topic_id").where("rank <= 7")
    got = graph.latest_topics(topics, ids, 7)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 14
    assert "WindowGroupLimit [user_id" in got._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_left_out_before_they_are_shuffled(spark, sf, monkeypatch):
    """What can be wanted stays, whatever shares a bit with it; the edges around seeds read what was found of links and facts once."""
    from palimpsest.operators import recall
    from palimpsest.plans.all_queries import QUERIES

    rows = spark.createDataFrame([(f"a{i % 300}", f"b{i % 70}" if i % 9 else None, i) for i in range(3000)], "a string, b string, n int")
    wanted = spark.createDataFrame([("a7",), ("b3",), ("a7",), (None,), ("none",)], "key string")
    for bits, most in ((64, 3000), (1 << 26, 100)):
        monkeypatch.setattr(recall, "SIEVE_BITS", bits)
        got = recall.sieved(rows, wanted, "a", "b")
        assert got.columns == ["a", "b", "n"] and "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        kept = [r for r in got.collect() if r["a"] == "a7" or r["b"] == "b3"]
        assert sorted(kept) == sorted(rows.where("a = 'a7' OR b = 'b3'").collect()) and got.where("b IS NOT NULL").count() <= most
    plan = QUERIES["g11_edges"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "l_orderkey" not in plan


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_words_asked_for_go_to_tasks_once(spark, monkeypatch, most):
    """No text comes with the list of its user's words, and where these are too many all words stay, with the same scores."""
    from palimpsest.operators import recall

    monkeypatch.setattr(recall, "BROADCAST_BYTES", most)
    rows = [(f"m{i:02}", "u" if i % 3 else "w", None if i == 7 else "" if i == 8 else f"alpha beta{'s' * (i % 4)} x{i % 5} " * (i % 6 + 1)) for i in range(40)] + [("z", "v", "alpha"), ("n", None, "alpha")]
    memories = spark.createDataFrame(rows, "id string, user_id string, content string")
    queries = spark.createDataFrame([("q", "u", "alpha beta x3", 2), ("r", "w", "beta betass x1 x1", 2), ("s", "w", None, 2), ("t", "x", "alpha", 2)], "query_id string, user_id string, text string, top_k int")
    index = recall.term_index(queries, memories)
    python = [x for x in index._jdf.queryExecution().optimizedPlan().toString().split("\n") if "ArrowEvalPython" in x]
    assert len(python) == 1 and "wanted" not in python[0]
    found = {r["id"]: (r["length"], {t["term"]: t["tf"] for t in r["terms"]}) for r in index.collect()}
    assert set(found) == {r[0] for r in rows if r[1] in ("u", "w")} and found["m07"] == found["m08"] == (0, {})
    assert found["m13"][0] == 6 and {k: v for k, v in found["m13"][1].items() if k in ("alpha", "beta", "x3")} == {"alpha": 2, "beta": 2, "x3": 2}
    monkeypatch.undo()
    want = recall.bm25_recall(queries, memories).collect()
    assert sorted(map(tuple, recall.bm25_recall(queries, memories, docs=index).collect())) == sorted(map(tuple, want)) and len(want) == 12
