"""Keys with many rows, and entities with many relations."""

from __future__ import annotations

import random

from palimpsest.operators import graph
from palimpsest.operators import sessions as ses


def paired(turns):
    """Plain Python: an answer takes the latest open question."""
    want, open_ = {}, {}
    for t, user, role, _ in turns:
        stack = open_.setdefault(user, [])
        if role == "human":
            stack.append(t)
            want[t] = f"pair:{t}"
        else:
            want[t] = f"pair:{stack.pop() if stack else t}"
    return want


def check_pairs(spark, turns, hot):
    df = spark.createDataFrame(turns, "id string, user_id string, role string, n int").repartition(3)
    got = ses.pair_turns(df, ["n"], hot=hot)
    assert got.columns == [*df.columns, "pair_id"]
    rows = got.collect()
    assert len(rows) == len(turns) and {r["id"]: r["pair_id"] for r in rows} == paired(turns)


def test_pairs_of_divided_keys(spark):
    rng = random.Random(3)
    users = ["a", "a", "a", None, "b"]
    mixed = [(f"t{i}", rng.choice(users), rng.choice(["human", "assistant"]), i) for i in range(500)]
    check_pairs(spark, mixed, 40)
    deep = [(f"t{i}", "a", "human" if i < 60 else "assistant", i) for i in range(140)]
    check_pairs(spark, deep, 25)
    closed_first = [(f"t{i}", "a", "assistant" if i < 50 or i % 3 == 0 else "human", i) for i in range(150)]
    check_pairs(spark, closed_first, 20)
    check_pairs(spark, [], 20)


def test_divided_keys_are_in_several_tasks(spark):
    df = spark.range(1000).selectExpr("concat('t', id) AS id", "'u' AS user_id", "'human' AS role", "id AS n")
    few, many = ses.divided(df, ("user_id",), ["n"], 100)
    sizes = [r["count"] for r in many.groupBy("__part").count().collect()]
    assert few.count() == 0 and sum(sizes) == 1000 and len(sizes) >= 5 and max(sizes) < 500
    assert ses.divided(df, ("user_id",), ["n"], 1000)[1] is None


def test_sessions_of_divided_users(spark):
    rng = random.Random(4)
    rows, ts = [], {"a": 0, "b": 0, "c": 0}
    for i in range(400):
        user = rng.choice("aaab") if i % 40 else "c"
        ts[user] += rng.choice([5, 60, 600, 601, 4000])
        rows.append((f"t{i:03}", user, ts[user]))
    df = spark.createDataFrame(rows, "id string, user_id string, s long").selectExpr("id", "user_id", "timestamp_seconds(s) AS ts").repartition(3)
    want = {r["id"]: r["session_id"] for r in ses.gap_sessions(df, gap_minutes=10).collect()}
    numbers, last = {}, {}
    for i, user, s in rows:
        n = numbers.get(user, 0) + (0 if user in last and s - last[user] <= 600 else 1)
        numbers[user], last[user] = n, s
        assert want[i] == f"{user}:{n}"
    assert {r["id"]: r["session_id"] for r in ses.gap_sessions(df, gap_minutes=10, hot=30).collect()} == want


def test_walk_through_a_hub(spark):
    """A hub with many relations, parallel ones among them, against a walk over all of its edges."""
    rng = random.Random(5)
    relations = [("u", "hub", f"n{i % 700}", rng.choice(["KNOWS", "SAME_AS", "RELATED_TO"]), rng.choice([None, 0.5, 0.6, 0.7, 0.9])) for i in range(1500)]
    relations += [("u", f"n{rng.randrange(700)}", f"n{rng.randrange(700)}", "KNOWS", rng.random()) for _ in range(600)] + [("u", "s", "hub", "KNOWS", 1.0)] * 9
    rel = spark.createDataFrame(relations, "user_id string, source string, target string, edge_relation string, confidence double")
    seeds = spark.createDataFrame([("q", "u", "s"), ("p", "u", "hub"), ("r", "other", "hub")], "query_id string, user_id string, canonical_id string")
    near = graph.adjacency(rel, 30, 10)
    assert near.selectExpr("max(size(edges)) AS m").first()["m"] == 30
    weights = {r["edge_relation"]: r["w"] for r in rel.select("edge_relation", graph.S.edge_weight(graph.F.col("edge_relation")).alias("w")).distinct().collect()}
    edges = {}
    for _, a, b, kind, c in relations:
        if a != b and (c is None or c >= 0.5):
            gain = (c or 0.0) * weights[kind]
            edges.setdefault(a, []).append((b, gain))
            edges.setdefault(b, []).append((a, gain))
    for per_hop in (10, 40):
        want = {}
        for query, seed in (("q", "s"), ("p", "hub")):
            states = [(1.0, seed, (seed,))]
            for hop in (1, 2, 3):
                grown = [(s * 0.8 + g * 0.8**hop, to, (*path, to)) for s, node, path in states for to, g in edges.get(node, []) if to not in path]
                states = sorted((x for x in grown if x[0] >= 0.05), key=lambda x: (-x[0], x[1], x[2]))[:per_hop]
                for s, node, _ in states:
                    want[query, node] = max(want.get((query, node), 0.0), round(s, 9))
        got = {(r["query_id"], r["canonical_id"]): round(r["score"], 9) for r in graph.walk(seeds, rel, hops=3, per_hop=per_hop).collect()}
        assert got == want
