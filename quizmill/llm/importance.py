"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import Tokens, batches, mix, stash

BUCKETS = 1 << 14
#: At most so many labelled rows give the target text and the share of documents to draw.
LABELLED_ROWS = 20_000
SEED = 11
#: Histogram bins, and how few rows of a bin are sorted, in the search for the k-th key.
BINS, SORTED_ROWS = 4096, 10_000


def ngram_buckets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words, punctuation runs and their pairs in each text, and the text of each."""
    t = Tokens(list(texts), lower=False, punct=True)
    owners = t.owners
    pair = owners[1:] == owners[:-1] if len(owners) else np.zeros(0, bool)
    pairs = mix(t.hashes[:-1] * np.uint64(31) + t.hashes[1:])[pair] if len(owners) else t.hashes
    grams = np.concatenate([t.hashes, pairs]) >> np.uint64(64 - 14)
    return grams.astype(np.int64), np.concatenate([owners, owners[1:][pair]]) if len(owners) else owners


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for frame in frames:
        for part in batches(frame):
            grams, owners = ngram_buckets(part["text"])
            raw += np.bincount(grams, minlength=BUCKETS)
            wanted = part["quality"].to_numpy(dtype=float, na_value=np.nan)[owners] == 1
            target += np.bincount(grams[wanted], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": seen, "raw": raw[seen], "target": target[seen]})


def log_ratios(marked: DataFrame, smooth: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket. `marked` has text and quality (1: target). BUCKETS rows come to the driver, whatever the input's size."""
    counts = marked.select("text", "quality").mapInPandas(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, smooth), np.full(BUCKETS, smooth)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    if counts["target"].sum() == 0:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def labelled_sample(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """At most `rows` labelled ids with their quality, by hash order; an id with several labels has the lowest."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_weights(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_grams, log_weight (the log of the importance weight p_target / p_raw of the whole text), quality of sampled labelled rows, and the string columns `keep` of docs."""
    sample = stash(labelled_sample(labels), "labelled")
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep).join(F.broadcast(sample), "doc_id", "left")  # at most LABELLED_ROWS rows
    marked = marked.withColumn("doc_id", F.col("doc_id").cast("string"))
    ratios = log_ratios(marked)
    more = "".join(f", `{c}` string" for c in keep)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame):
                grams, owners = ngram_buckets(part["text"])
                n = np.bincount(owners, minlength=len(part))
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_grams": n, "log_weight": np.bincount(owners, ratios[grams], minlength=len(part)), "quality": part["quality"], **{c: part[c] for c in keep}})

    scored = marked.mapInPandas(score, f"doc_id string, n_grams long, log_weight double, quality int{more}")
    return stash(scored.withColumn("doc_id", F.col("doc_id").cast("long")), "log-weights")


def good_share(scored: DataFrame) -> float:
    """The share of the sampled labelled rows that are labelled good; 1 without labels."""
    share = scored.agg(F.avg(F.when(F.col("quality") == 1, 1.0).when(F.col("quality").isNotNull(), 0.0))).first()[0]
    return 1.0 if share is None else float(share)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise from the hash of doc_id: reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """`rows` with selected: whether the row is among the k largest keys; ties by doc_id, null first; rows equal in both are selected together.

    A histogram finds the bin of the k-th key, another one parts that bin, and so on until it holds few rows; only those are sorted. What comes to the driver does not grow with the input."""
    lo, hi, n = rows.agg(F.min(key), F.max(key), F.count(key)).collect()[0]
    if k >= n or k <= 0:
        return rows.withColumn("selected", F.lit(k > 0))
    room = k
    while n > SORTED_ROWS and lo < hi:
        place = F.least(F.floor((F.col(key) - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1))
        bins = rows.where(F.col(key).between(lo, hi)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for b in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if b["n"] >= room:
                lo, hi, n = b["lo"], b["hi"], b["n"]
                break
            room -= b["n"]
    edge = rows.where(F.col(key).between(lo, hi)).groupBy(key, "doc_id").count().orderBy(F.col(key).desc(), F.col("doc_id").asc_nulls_first()).limit(room).collect()
    for last in edge:
        room -= last["count"]
        if room <= 0:
            break
    tied = F.col("doc_id").isNull() if last["doc_id"] is None else F.col("doc_id").isNull() | (F.col("doc_id") <= last["doc_id"])
    return rows.withColumn("selected", (F.col(key) > last[key]) | ((F.col(key) == last[key]) & tied))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, selected (and the string columns `keep`) for every document.

    k = share of the documents, by default the share of good ones among the labelled rows. The k documents of the largest log_weight + Gumbel noise are a sample without replacement with chances in proportion to the weights; another seed draws another sample. Null and empty texts have weight 1 (log 0); rows with equal ids have equal noise; rows equal in key and id are drawn together."""
    scored = log_weights(docs, labels, keep)
    k = round((good_share(scored) if share is None else share) * scored.count())
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    return top_k(keyed, "gumbel_key", k).drop("quality")


def op2_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
