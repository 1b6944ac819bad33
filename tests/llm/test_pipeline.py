"""The pipeline's stages on planted rows, and on odd ones."""

import os
import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from quizmill.llm import common


def staged(spark, docs, sf, upto):
    for name, stage in P.STAGES[:upto]:
        docs = stage(spark, docs, sf)
        yield name, docs


def test_stages_take_effect(spark, sf, docs):
    rng = random.Random(9)
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    base = [r["text"] for r in docs.join(good, "doc_id").where("length(text) > 900 AND lang = 'en'").orderBy("doc_id").collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = " ".join(rng.sample(base[0].split() + base[1].split(), 120))
    rows = [
        (9001, clean, "en", "src1", len(clean)), (9002, clean.upper(), "en", "src2", len(clean)), (9003, clean + " extra", "en", "src3", len(clean) + 6),
        (9004, base[2] + " " + item + " " + base[3], "en", "src1", 0), (9005, " ".join(f"{w}$$$ ###" for w in base[4].split()), "en", "src1", 0),
    ]
    d = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    seen = {}
    for name, out in staged(spark, d, sf, 5):
        ids = {r[0] for r in out.select("doc_id").collect()}
        seen[name] = ids
        if name != "sharding":
            assert out.columns == docs.columns
    q, n, c = (seen[k] for k in ("quality classifier", "n-gram Jaccard join", "benchmark decontamination"))
    assert 9005 not in q and 9001 in q and 9003 in q
    assert 9003 not in n and 9001 in n and n <= q
    assert 9004 in n and 9004 not in c and 9001 in c
    assert len(c) >= 0.8 * len(n)


def test_run_returns_all_words_of_the_mix(spark, sf):
    """A run leaves its result; what others asked for meanwhile stays."""
    shared = common.shared_dir(spark).removeprefix("file://")
    other = common.stash(spark.range(3), "others")
    before = set(os.listdir(shared))
    with common.scratch_scope() as outer:
        out = P.run(spark, sf)
    left = [p for p in os.listdir(shared) if p not in before]
    assert len(left) == 1 and left[0].startswith("stage4-") and not outer and other.count() == 3
    assert {"shard", "slot", "grown_shard", "text"} <= set(out.columns)
    assert out.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).where("NOT ok").count() == 0


def test_stages_on_odd_rows(spark, sf, odd, none):
    words = lambda df: df.select(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    for name, stage in P.STAGES:
        out = stage(spark, odd, sf)
        assert stage(spark, none, sf).count() == 0
        if name.startswith("mixing"):  # a row for each document, epoch and output shard
            assert 0 < words(out) <= 2 * words(odd)
        else:
            assert out.count() <= odd.count()
        if "grown_shard" not in out.columns:
            assert out.columns == odd.columns
    stay = P.near_duplicates(spark, odd, sf)
    # the texts without words are one class, whose least id is 0; the row with words and no id is a class of its own
    assert stay.where("doc_id IS NULL").count() == 1 and stay.where("doc_id = 6").count() == 1 and stay.where("doc_id IN (0, 1, 2)").count() == 1
    assert stay.where("doc_id IN (7, 8)").count() == 1


def test_stages_decide_by_row(spark, sf, docs):
    """One id with two texts, several null ids, large ids: only the row that is a copy or holds an item goes."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    a, b, c, d, e = (r["text"] for r in docs.where("length(text) > 900 AND lang = 'en'").orderBy("doc_id").limit(5).collect())
    big = 2**53 + 1
    rows = [(big, a), (big, b), (big - 1, b + " more"), (None, c), (None, d), (None, f"{e} {item} {e}"), (None, c + " more"), (big + 1, f"{a} {item}")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    near = sorted(((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, df, sf).collect()), key=str)
    known = {r["doc_id"]: 0 for r in df.collect()}
    assert (big - 1, b + " more") in near and (big, b) not in near and (big, a) in near and (None, d) in near
    assert sum(t in (c, c + " more") for _, t in near) == 1 and {i for i, _ in near} <= set(known)
    clean = sorted(((r["doc_id"], r["text"]) for r in P.decontamination(spark, df, sf).collect()), key=str)
    assert clean == sorted(((i, t) for i, t in rows if item not in t), key=str)
    kept = P.quality(spark, df, sf).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} <= set(rows) and len(kept) >= 6
    for r in P.mixing(spark, df, sf).collect():
        assert any(i == r["doc_id"] and r["text"].strip() in t for i, t in rows)


def test_names_of_helper_columns(spark, sf, odd):
    """Columns that are named like the operators' own helpers stay as they are."""
    from quizmill.llm import line_dedup, mixing, sharding

    names = ["__row", "row_key", "__key", "__key2", "__size", "__parts", "__texts", "__bucket", "__one", "__inside", "__offset", "__g", "__b", "__sum", "__id", "__hash", "__keep", "kept0"]
    odd = odd.where("text IS NULL OR length(text) < 1000")
    df = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    held = lambda out: all(r[n] == f"{n}{'-' if r.doc_id is None else r.doc_id}" for r in out.collect() for n in names)
    for out in (sharding.shard_rows(df), line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)), mixing.mixed_texts(df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))):
        assert set(names) <= set(out.columns) and held(out)
    docs = df
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        assert set(names) <= set(docs.columns) and held(docs)
    assert line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).count() == plain.count()
