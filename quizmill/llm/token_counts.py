"""Token counts of whole texts, however long they are.

Huge documents are cut into chunks that overlap; each chunk is encoded with offsets on its own. Two neighbours are spliced at a boundary inside their overlap that is proven stable for the tokenizer (vocab.stable_boundary) and at which both encodings count alike; where an overlap has no such place, the document is cut anew with wider chunks and overlaps, in the end into one. Other documents are encoded whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm import vocab
from quizmill.llm.common import stash, text_of

#: Documents of more code points are huge; chunk and overlap are in code points too.
HUGE, CHUNK, OVERLAP, WIDER = 32_768, 16_384, 512, 8
#: What a Python worker keeps in memory: so many different words with their counts.
MEMO = 600_000
_KNOWN: dict[str, dict[str, int]] = {}


#: A word, cut between a letter or digit (that stays one when lower-cased) and the stops at its end: there a unit of the pattern ends.
_STOPPED = re.compile("(.*[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,]+)", re.DOTALL)


def whole_counts(name: str, texts: list[str]) -> list[int]:
    """Tokens of each text. Where the splitter drops white space, a text's count is the sum of its words' (all ends of words are stable), and a worker encodes a word once, without the stops behind it."""
    stable = vocab.stable_boundary(name).pattern
    if stable != vocab.AFTER_BLANK:
        return vocab.count_tokens(name, texts)
    parts = [re.findall(vocab.NO_BLANKS, t) for t in texts]
    known = _KNOWN.setdefault(name, {})
    if len(known) > MEMO:
        known.clear()
    new = set(chain.from_iterable(parts)).difference(known)
    cut = [(w, *m.groups()) for w in new if w[-1] in ".," and (m := _STOPPED.fullmatch(w))]
    bare = list(new.difference([c[0] for c in cut]).union([x for c in cut for x in c[1:]]).difference(known))
    known.update(zip(bare, vocab.count_tokens(name, bare), strict=True))
    known.update((w, known[stem] + known[stops]) for w, stem, stops in cut)
    return [sum(map(known.__getitem__, p)) for p in parts]


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts = pa.array(whole_counts(name, batch.column("__text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=[*batch.schema.names[:-1], "__tokens"])

    return run


def _cut(chunk: int, overlap: int):
    """Rows of (key, text) to rows of (key, part, at, last, text): part i begins at i * chunk and reaches `overlap` into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, rows = 0, []
                while True:
                    last = at + chunk + overlap >= len(text)
                    rows.append((key, at, last, text[at : at + chunk + overlap]))
                    at += chunk
                    if last or len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["key", "at", "last", "text"])
                        rows = []
                    if last:
                        break

    return run


def _encode(name: str, chunk: int, overlap: int):
    """Chunks to their token counts and, for both overlaps, the stable boundaries with the number of tokens before each."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stable = vocab.stable_boundary(name)
        for whole in batches:
            for row in range(0, whole.num_rows, 16):
                batch = whole.slice(row, 16)
                texts, places = batch.column("text").to_pylist(), batch.column("at").to_pylist()
                out = []
                for text, at, ends in zip(texts, places, vocab.token_ends(name, texts), strict=True):
                    ends = np.asarray(ends, np.int64)
                    zones = []
                    for begin, end in ((0, overlap), (chunk, chunk + overlap)):  # a boundary needs what it is told by inside the overlap
                        found = np.array([m.end() for m in stable.finditer(text, begin, min(end, len(text)))], np.int64)
                        zones += [found + at, np.searchsorted(ends, found, "right")]
                    out.append((len(ends), *zones))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[longs] * 4), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "at", "last")), *columns], names=_ENCODED)

    return run


_ENCODED = ["key", "at", "last", "n", "left_at", "left_n", "right_at", "right_n"]


def spliced(texts: DataFrame, name: str, chunk: int, overlap: int) -> DataFrame:
    """(key, text) -> (key, tokens): null where two neighbours have no common stable boundary or do not count alike at all of them. Rows with equal keys have equal texts."""
    parts = texts.mapInArrow(_cut(chunk, overlap), "key string, at long, last boolean, text string")
    parts = parts.groupBy("key", "at", "last").agg(F.first("text").alias("text"))  # copies meet; chunks are dealt out
    schema = "key string, at long, last boolean, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"
    found = stash(parts.mapInArrow(_encode(name, chunk, overlap), schema), "token-chunks")
    after = found.select("key", (F.col("at") - chunk).alias("at"), F.map_from_arrays("left_at", "left_n").alias("left"))
    before = found.where("NOT last").select("key", "at", "n", F.map_from_arrays("right_at", "right_n").alias("right"))
    both = before.join(after, ["key", "at"]).withColumn("common", F.array_intersect(F.map_keys("right"), F.map_keys("left")))
    shifts = F.array_distinct(F.transform("common", lambda p: F.element_at("right", p) - F.element_at("left", p)))
    # behind the boundary the left chunk's tokens go, before it the right one's
    surplus = F.when(F.size(shifts) == 1, F.col("n") - shifts[0])
    joints = both.groupBy("key").agg(F.sum(surplus).alias("surplus"), F.count(F.when(surplus.isNull(), 1)).alias("failed"))
    totals = found.groupBy("key").agg(F.sum("n").alias("n")).join(joints, "key", "left")
    return totals.select("key", F.when(F.coalesce("failed", F.lit(0)) == 0, F.col("n") - F.coalesce("surplus", F.lit(0))).alias("tokens"))


def huge_counts(texts: DataFrame, name: str, chunk: int = CHUNK, overlap: int = OVERLAP, wider: int = WIDER) -> tuple[DataFrame, int]:
    """(key, text) -> (key, tokens) and the number of rounds. In each round those that failed are cut anew, into chunks and overlaps `wider` times as long; a text that is one chunk cannot fail, so the rounds are few."""
    done, rounds = None, 0
    while True:
        result = stash(spliced(texts, name, chunk, overlap), "token-totals")
        rounds += 1
        good, failed = result.where("tokens IS NOT NULL"), result.where("tokens IS NULL").select("key")
        done = good if done is None else done.unionByName(good)
        if failed.isEmpty():
            return done, rounds
        texts = texts.join(failed.hint("merge"), "key", "left_semi")
        chunk, overlap = chunk * wider, overlap * wider


def token_counts(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), huge: int = HUGE, **cut: int) -> DataFrame:
    """The columns `keep` of all rows with n_bytes (UTF-8) and n_tokens of the whole text, without begin and end tokens; special strings inside texts as the library takes them. Null and empty texts: 0 and 0. Repeated rows stay; kept columns of these two names are replaced."""
    names = [c for c in keep if c not in ("n_bytes", "n_tokens")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)], text_of().alias("__text"))
    rows = rows.withColumn("__bytes", F.octet_length("__text").cast("long"))
    slim = [c for c in rows.columns if c != "__text"]
    of = lambda c: rows.schema[c].dataType.simpleString()
    small = rows.where(F.length("__text") <= huge).select(*slim, "__text").mapInArrow(_count(tokenizer), ", ".join(f"{c} {of(c)}" for c in slim) + ", __tokens long")
    long_ones = rows.where(F.length("__text") > huge).withColumn("__key", F.sha2("__text", 256))
    found, _ = huge_counts(long_ones.select(F.col("__key").alias("key"), F.col("__text").alias("text")), tokenizer, **cut)
    long_ones = long_ones.select(*slim, "__key").join(found.withColumnsRenamed({"key": "__key", "tokens": "__tokens"}).hint("merge"), "__key").drop("__key")
    return small.unionByName(long_ones).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)], F.col("__bytes").alias("n_bytes"), F.col("__tokens").alias("n_tokens"))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json")
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
