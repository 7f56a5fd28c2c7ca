"""Reinforcement by keyed state against the batch operator."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import dynamics
from palimpsest.sources.views import Tables
from palimpsest.streaming import reinforcement as R

SCHEMA = "memory_id string, event_id long, ts timestamp"
AS_OF = datetime(2024, 2, 1)
EPOCH = datetime(1970, 1, 1)


def run(spark, folder, memories, checkpoint, **kw):
    out = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = R.start(R.reinforced(stream, memories, **kw), lambda number, batch: out.extend(batch.collect()), checkpoint)
    assert q.awaitTermination(200)
    return out


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_like_the_batch(spark, sf, tmp_path):
    """Out-of-order, repeated and unknown hits in several micro-batches, with a restart in between."""
    t = Tables(spark, sf)
    ids = sorted(r["memory_id"] for r in t.hits.select("memory_id").distinct().collect())[:40]
    rand, begin = random.Random(2), datetime(2024, 1, 31)
    hits = [(rand.choice([*ids, "nobody", None]), i, begin + timedelta(seconds=20 * i)) for i in range(120)]
    parts = [hits[:40], hits[40:80], hits[80:]]
    for i in range(3):  # again, up to minutes late, in this batch and the next
        parts[i] = parts[i] + rand.sample(parts[i], 10) + (rand.sample(hits[40 * i - 20 : 40 * i], 8) if i else [])
        rand.shuffle(parts[i])
    folder, checkpoint = str(tmp_path / "hits"), str(tmp_path / "state")
    as_of = (AS_OF - EPOCH) // timedelta(microseconds=1)
    memories = t.memories.select("id", "primary_sector", "salience", "last_seen_at")
    got = []
    write(spark, parts[0], folder)
    write(spark, parts[1], folder)
    got += run(spark, folder, memories, checkpoint, as_of=as_of)
    write(spark, parts[2], folder)
    got += run(spark, folder, memories, checkpoint, as_of=as_of)  # goes on from the checkpoint
    last = {}
    for r in got:
        last[r["id"]] = max(last.get(r["id"], (0, 0.0)), (r["hits"], r["new_salience"]))
    each = spark.createDataFrame(hits, SCHEMA).where("memory_id IS NOT NULL").select(F.col("memory_id").alias("id"))
    want = {r["id"]: (r["hits"], r["new_salience"]) for r in dynamics.reinforce(each, t.memories, None, F.lit(AS_OF).cast("timestamp_ntz")).collect()}
    assert {k: n for k, (n, _) in last.items()} == {k: n for k, (n, _) in want.items()}
    assert {k: s for k, (_, s) in last.items()} == pytest.approx({k: s for k, (_, s) in want.items()})


def test_late_hits_are_dropped_and_events_forgotten(spark, tmp_path):
    memories = spark.createDataFrame([("m", "semantic", None, None), ("n", "odd", 0.5, datetime(2024, 1, 1))], "id string, primary_sector string, salience double, last_seen_at timestamp")
    folder, checkpoint = str(tmp_path / "hits"), str(tmp_path / "state")
    day = datetime(2024, 1, 2)
    for rows in ([("m", 1, day), ("n", 2, day)], [("m", 3, day + timedelta(days=1)), ("m", None, day)], [("m", 4, day), ("n", 5, day + timedelta(days=1, minutes=1))]):
        write(spark, rows, folder)
    got = run(spark, folder, memories, checkpoint)
    assert max(r["hits"] for r in got if r["id"] == "m") == 2 and max(r["hits"] for r in got if r["id"] == "n") == 2
    first = R.step("semantic", 0.0, 0.0)
    assert [r["new_salience"] for r in got if r["id"] == "m"] == pytest.approx([first, R.step("semantic", first, 1.0)])
    assert [r["last_seen_at"] for r in got if r["id"] == "n"][-1] == day + timedelta(days=1, minutes=1)
