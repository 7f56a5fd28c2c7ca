from __future__ import annotations

from collections import Counter

import corpus_pipeline
from palimpsest.llm import langid
from palimpsest.llm.common import table

from .test_operators import brute_components, brute_hits, brute_mix


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_run_like_brute_force(spark, sf):
    docs = [r for r in table(spark, sf, "documents").collect() if any(map(str.isalpha, r["text"] or ""))]
    groups = brute_components([(r["doc_id"], r["text"]) for r in docs])
    firsts = {c for _, _, c in groups}
    docs = [r for r in docs if r["doc_id"] in firsts]
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, sf, "benchmark").collect()]
    docs = [r for r in docs if not brute_hits(r["text"], items)[4]]
    times = Counter({d: taken // n for d, n, _, _, taken in brute_mix([(r["doc_id"], r["text"], r["source"]) for r in docs]) if taken})
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == times
    slots = Counter((r["shard"], r["slot"]) for r in got)
    assert max(slots.values()) == 1 and all((s, k) in slots for s in range(8) for k in range(sum(x == s for x, _ in slots)))


def test_stages_on_odd_rows(spark, clashing, none, sf):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (clashing, none):
            out = stage(spark, docs, sf)
            if name != "sharding":
                assert out.columns == docs.columns
            n = out.count()
            assert n <= 2 * docs.count()
            if name == "language" and docs is clashing:
                assert n == docs.count() - 4 and langid.UNKNOWN not in {r["lang"] for r in out.collect()}


def test_language_predicts_a_text_once(spark, sf):
    docs = corpus_pipeline.language(spark, table(spark, sf, "documents"), sf)
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_ngrams_counted_in_parts(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").limit(60)
    whole = langid.fit(docs, min_count=1)
    monkeypatch.setattr(langid, "CACHED_WORDS", 40)
    parts = langid.fit(docs, min_count=1)
    assert (parts.langs, parts.words, parts.grams) == (whole.langs, whole.words, whole.grams)
    assert (parts.gram_logs.value == whole.gram_logs.value).all() and len(whole.grams) > 400


def test_language_without_a_word(spark, sf):
    docs = spark.createDataFrame([(k, "123 !" if k % 2 else "the cat", "fr" if k % 2 else "en", "a", 1) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, sf).collect()} == set(range(0, 40, 2))
