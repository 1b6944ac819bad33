"""Large ids and null ids in one batch come back as they are, from all ten operators."""

from pyspark.sql import functions as F

from quizmill.llm import decontaminate, importance, line_dedup, mixing, ngram_join, secret_scan, sharding, toxicity, warc
from quizmill.llm import edit_fingerprint as E

BIG = 2**53
IDS = [BIG - 1, BIG, BIG + 1, BIG + 2, None, None, -BIG - 1, 2**63 - 1, 7]


def test_ids_come_back(spark, labels):
    item = " ".join(f"item{chr(97 + k)}word" for k in range(20))
    text = lambda k: " ".join(f"{chr(97 + k)}{j}x" for j in range(30))
    rows = [(i, f"{text(k)} {item}", "en", "s") for k, i in enumerate(IDS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    bench = spark.createDataFrame([(BIG + 1, item), (None, text(3))], "item_id long, text string")
    marks = spark.createDataFrame([(BIG + 1, 1, 0), (BIG, 0, 1), (BIG + 2, 1, 1)], "doc_id long, quality int, toxic int")
    ids = lambda out, c="doc_id": sorted((r[c] for r in out.select(c).collect()), key=str)
    want = sorted(IDS, key=str)
    paths = df.withColumnRenamed("doc_id", "path")
    assert ids(secret_scan.findings_by_path(paths, secret_scan.scan_versions(paths)), "path") == want
    assert ids(importance.resample(df, marks)) == want
    assert ids(toxicity.toxicity(df, marks)) == want
    assert ids(line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df))) == want
    assert ids(warc.archive_round_trip(df.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.col("text").alias("html"))), "page_id") == want
    assert ids(E.with_classes(E.edit_fingerprints(df))) == want
    assert ids(sharding.shard_rows(df)) == want
    assert ids(mixing.taken_words(df)) == want
    found = decontaminate.contaminated(df, bench)
    assert ids(found.where(F.col("item_id") == BIG + 1)) == want and {r["doc_id"] for r in found.where("item_id IS NULL").collect()} == {IDS[3]}
    assert ids(ngram_join.near_classes(df)) == want


def test_a_repeated_label_id_is_made_one_before_it_is_collected(spark):
    docs = spark.createDataFrame([(1, "b", "en"), (1, "a", "de"), (1, None, "fr"), (3, "c", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.labelled_texts(docs, labels)
    assert rows["doc_id"].tolist() == [1, 3] and rows["text"].tolist() == ["", "c"] and rows["toxic"].tolist() == [1, 0]


def test_another_seed_draws_another_sample(spark):
    """The draw follows the weights: near the edge of the sample seeds differ, far from it they do not."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") / 400.0).alias("w"))
    draw = lambda seed: {r["doc_id"] for r in importance.top_k(df.withColumn("k", F.col("w") + importance.gumbel(F.col("doc_id"), seed)), "k", 2000).where("selected").collect()}
    a, b = draw(1), draw(2)
    assert len(a) == len(b) == 2000 and 100 < len(a - b) < 1000 and sum(x > 3600 for x in a) > 390 and a == draw(1)
