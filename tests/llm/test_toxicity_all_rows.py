"""Toxicity learns from all labelled rows: counts, network and thresholds."""

import random

import numpy as np
from pyspark.sql import functions as F

from quizmill.llm import toxicity as t

WORDS = "red green blue bad worse worst fine calm word plain other thing".split()


def rows(spark, n, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(0, 9))) for _ in range(n)]
    docs = spark.createDataFrame([(i, x, "en" if i % 3 else None) for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, int("bad" in x)) for i, x in enumerate(texts)], "doc_id long, toxic int")


def test_no_labelled_row_is_left_out(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3_000 == 0, F.repeat(F.lit("word "), 6_000)).otherwise("few words").alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    got = t.labelled_texts(docs, labels)
    assert got["doc_id"].tolist() == [r[0] for r in docs.where(~t.held_out(F.col("doc_id"))).orderBy("doc_id").select("doc_id").collect()]
    assert got["text"].str.len().tolist() == [30_000 if i % 3_000 == 0 else 9 for i in got["doc_id"]]


def test_counts_over_shards(spark):
    texts = t.dealt(*rows(spark, 700))
    n, hits, count, bad = t.count_rows(texts)
    plain = texts.toPandas()
    want = t.row_counts(*t.word_rows(plain["text"]), plain["y"].to_numpy())
    assert (n == want[0]).all() and (hits == want[1]).all() and (count, bad) == (len(plain), plain["y"].sum())


def test_shards_train_one_network(spark, monkeypatch):
    """Several shards, in blocks: all steps are taken, the changes averaged over those that made them, however the rows lie."""
    monkeypatch.setattr(t, "SHARD_ROWS", 100)
    docs, labels = rows(spark, 900)
    texts = t.dealt(docs, labels).where("shard >= 0")
    assert texts.select("shard").distinct().count() == 8
    net = t.trained(texts, rounds=1, block_chars=1_000)
    again = t.trained(texts, rounds=0)
    same = t.trained(t.dealt(docs.repartition(7), labels.repartition(3)).where("shard >= 0").coalesce(1), rounds=1, block_chars=1_000)
    assert (net.table == same.table).all() and (net.out == same.out).all()
    start = t.Learner(again)
    own = []
    for shard in range(8):
        learner = t.Learner(again.__class__(again.table.copy(), [f.copy() for f in again.filters], [b.copy() for b in again.bias], again.out.copy(), again.out_bias))
        part = texts.where(f"shard = {shard}").toPandas().assign(shard=shard)
        rate = t.toxic_weight(texts.where("y = 1").count() / texts.count())
        for k, (_, block) in enumerate(t._blocks(iter([part]), 1_000)):
            rng = np.random.default_rng([5, 0, shard, 0, k])
            for _ in range(t.PASSES):
                learner.learn(*t.word_rows(block["text"]), block["y"].to_numpy().astype(np.float32), rng.permutation(len(block)), 32, 0.05, rate)
        own.append(learner)
    changed = np.sum([x.touched for x in own], axis=0)
    total = np.sum([x.net.table[:-1] - again.table[:-1] for x in own], axis=0)
    assert changed.max() == 8 and np.allclose(net.table[:-1], again.table[:-1] + total / np.maximum(changed, 1)[:, None], atol=1e-4)
    moved = t.Learner(again)
    moved.add_dense(np.mean([x.dense() for x in own], axis=0) - start.dense())
    assert np.allclose(net.out, moved.net.out, atol=1e-4) and np.allclose(net.out_bias, moved.net.out_bias, atol=1e-4) and all(np.allclose(a, b, atol=1e-4) for a, b in zip(net.filters, moved.net.filters, strict=True))


def test_cuts_over_all_rows(spark):
    rng = np.random.default_rng(7)
    y = (rng.random(900) < 0.3).astype(int)
    raw = np.round(rng.normal(size=900) + y, 1)
    langs = [("en", "de", None)[i] for i in rng.integers(0, 3, 900)]
    logits = spark.createDataFrame([(x, int(a), float(b)) for x, a, b in zip(langs, y, raw, strict=True)], "lang string, y int, raw double")
    found = {r["lang"]: r for r in t.best_cuts(logits, float(raw.min()), float(raw.max()))}
    assert set(found) == {None, "en", "de"}
    for lang, r in found.items():
        own = np.array([lang is None or x == lang for x in langs])
        best = max((2 * y[own & (raw >= c)].sum() / ((own & (raw >= c)).sum() + y[own].sum()), c) for c in set(raw[own]))
        lower = raw[own & (raw < best[1])]
        assert (r["at"], r["below"], r["texts"], r["toxic"]) == (best[1], lower.max() if len(lower) else None, own.sum(), y[own].sum())
