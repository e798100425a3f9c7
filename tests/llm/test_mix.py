import os

import pytest

from worldloom.llm import mix

DOC = "doc_id bigint, source string, text string, copy int, n_tokens bigint"
COUNT = "doc_id bigint, source string, n_tokens bigint"
TARGET = "source string, target_share double, max_repeats int"


def test_capped_poisson_has_the_wanted_mean():
    for rate, cap in [(0.2, 1), (0.99, 1), (1.7, 2), (2.999, 3), (0.5, 4), (9.5, 10)]:
        assert sum(mix.capped_poisson(rate, cap)) == pytest.approx(rate, abs=1e-6)
    assert mix.capped_poisson(3, 3) == [1.0] * 3 and mix.capped_poisson(0, 2) == [0.0] * 2


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(6000)] + [(-1, None, 5), (-2, "other", 5)]
    return spark.createDataFrame(rows, COUNT)


def targets(spark, rows):
    return spark.createDataFrame(rows, TARGET)


def test_shares_and_caps(spark, counts):
    plan = mix.plan_mix(counts, targets(spark, [("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.2, 2)]))
    got = {r.source: r for r in mix.report(counts, plan).collect()}
    assert got["big"].actual_share == pytest.approx(0.5, abs=0.02) and got["small"].actual_share == pytest.approx(0.5, abs=0.02)
    assert got["big"].most_repeats == 1 and got["small"].most_repeats <= 3 and got["absent"].drawn == 0
    assert got["big"].rate == 1.0  # the largest mix that keeps every cap


def test_total_wanted(spark, counts):
    plan = mix.plan_mix(counts, targets(spark, [("big", 0.5, 1), ("small", 0.5, 3)]), total_tokens=20_000)
    assert sum(r.drawn_tokens for r in mix.report(counts, plan).collect()) == pytest.approx(20_000, rel=0.08)


def test_draws_are_repeatable_whole_and_shuffled(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", f"t{i}", 7, 1) for i in range(600)] + [(-1, None, None, 7, 1), (-2, "a", None, 7, 1), (-3, "a", "", 7, 1)], DOC)
    counts = docs.select("doc_id", "source", "n_tokens")
    plan = mix.plan_mix(counts, targets(spark, [("a", 0.5, 1), ("b", 0.5, 3)]))
    once, again = mix.draw(docs, plan, partitions=3).collect(), mix.draw(docs.repartition(7), plan, partitions=2).collect()
    key = lambda r: (r.doc_id, r.copy)
    assert sorted(map(key, once)) == sorted(map(key, again)) and len(set(map(key, once))) == len(once)
    assert all(r.text == f"t{r.doc_id}" for r in once if r.doc_id >= 0) and {r.source for r in once} == {"a", "b"}
    assert [r.doc_id for r in once] != sorted(r.doc_id for r in once)
    other = mix.draw(docs, plan, seed=2).collect()
    assert sorted(map(key, other)) != sorted(map(key, once))


def test_nothing_to_draw(spark, counts):
    none = mix.plan_mix(counts.limit(0), targets(spark, [("a", 1.0, 1)]))
    assert mix.report(counts.limit(0), none).collect()[0].actual_share == 0
    empty = mix.plan_mix(counts, targets(spark, []))
    assert mix.draw(spark.createDataFrame([(1, "big", "x", 1, 1)], DOC), empty).collect() == []


@pytest.mark.skipif(not os.path.exists(mix.TOKENIZER), reason="no tokenizer file")
def test_token_counts_round_trip(spark):
    texts = ["Hello world", "", None, "naïve — 木 \r\n\t<|endoftext|>", "a" * 50_000]
    docs = spark.createDataFrame([(i, "s", t, 1, 1) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.n_tokens for r in mix.token_counts(docs).collect()}
    enc = mix.encoder()
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
