"""Alignment of two tokenizers' encodings of the same texts.

Interval coalescing: the tokens of both, lexsorted by start; where a start reaches the running maximum of the ends, a new group begins; inside a group all overlapping pairs are links. What is counted over the whole corpus (how many links hold an id pair) is joined back by chunks of texts: a chunk asks once for each of its different pairs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm import vocab
from quizmill.llm.common import stash, text_of

#: Characters of the texts that are encoded together, and of those that share a list of id pairs.
BATCH, CHUNK = 500_000, 8_000_000
#: Different words that a Python worker keeps encoded.
MEMO = 700_000


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class _Pool:
    """A growing array."""

    def __init__(self, kind: type):
        self.data, self.used = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.data[: self.used]


class _Side:
    """One tokenizer and the bytes of its tokens."""

    def __init__(self, name: str, end: str):
        self.name, self.model = name, vocab.load(name)
        vocab.stable_boundary(name)  # raises if words may not be encoded one by one
        self.bytes = vocab.token_bytes(name)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        written = np.array([str(i) for i in range(len(self.bytes))], object)
        #: As text, by whether the token is the last of its side in its group.
        self.written = np.stack([written + ",", written + end])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        if self.name.endswith(".json"):
            self.model.encode_special_tokens = True  # each time: the worker's object is shared with the token counts
            return [e.ids for e in self.model.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        if self.name.endswith(".tiktoken"):
            return [self.model.encode_ordinary(f" {t}") for t in texts]
        blank = [self.model.piece_to_id("▁")]  # sentencepiece puts the space before a text, but gives nothing for an empty one
        return [ids or blank for ids in self.model.encode(texts, num_threads=1)]

    def joined(self, words: list[str]) -> np.ndarray | None:
        """Ids of all words, encoded as one text with spaces between; None if its bytes are not given back."""
        ids = np.fromiter(chain.from_iterable(self.encode([" ".join(words[i : i + 256]) for i in range(0, len(words), 256)])), np.int32)
        return ids if b"".join(map(self.bytes.__getitem__, ids.tolist())) == "".join(f" {w}" for w in words).encode() else None

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a space and each word, one word after another; how many tokens each word has; whether they are the word's bytes. No word may be empty or end in white space."""
        sizes = np.array([len(w.encode()) + 1 for w in words], np.int64)
        ids = self.joined(words) if words else np.empty(0, np.int32)
        if ids is not None:
            return ids, np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), "right"), prepend=0), np.ones(len(words), bool)
        each = self.encode(words)
        good = [b"".join(map(self.bytes.__getitem__, x)) == b" " + w.encode() for x, w in zip(each, words, strict=True)]
        return np.fromiter(chain.from_iterable(each), np.int32), np.array([len(x) for x in each], np.int64), np.array(good, bool)


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of each range, one range after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group numbers of the A and the B tokens, and the links as indexes into both. The intervals of each side are in order and do not overlap each other."""
    starts, ends = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(starts)) >= len(a_start), starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.empty(len(starts), np.int64)
    group[order] = np.cumsum(np.concatenate([[False], starts[order][1:] >= reach[:-1]])) if len(starts) else 0
    first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    return group[: len(a_start)], group[len(a_start) :], np.repeat(np.arange(len(a_start)), last - first), _ranges(first, last - first)


class _Aligner:
    """Texts are cut before each space behind something else than white space. There both encodings have an end, so groups and links lie inside the words between: a worker encodes and coalesces a word once, and a text has its words' groups and links."""

    def __init__(self, a: str, b: str):
        self.a, self.b = _Side(a, "|"), _Side(b, ";")
        self.split = re.compile(f" (?<=[^{vocab.WHITE}] )").split
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # each word's groups as text
        self.good = _Pool(bool)
        self.numbers = [_Pool(np.int64) for _ in _NUMBERS]
        self.begins, self.links = _Pool(np.int64), _Pool(np.int32)  # where a word's links begin; the links' pairs by number
        self.pairs, self.places = np.empty(0, np.int64), np.empty(0, np.int32)  # pairs in order, and their numbers

    def pair_numbers(self, keys: np.ndarray) -> np.ndarray:
        """The worker's own numbers of id pairs; new pairs get the next ones."""
        different, inverse = np.unique(keys, return_inverse=True)
        new = np.setdiff1d(different, self.pairs, assume_unique=True)
        pairs = np.concatenate([self.pairs, new])
        places = np.concatenate([self.places, np.arange(len(self.pairs), len(pairs), dtype=np.int32)])
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.places = pairs[order], places[order]
        return self.places[np.searchsorted(self.pairs, different)][inverse]

    def learn(self, words: list[str]) -> None:
        n = len(words)
        sides, good = [], np.ones(n, bool)
        usual, odd = [], []  # odd ones are encoded one by one: behind white space the joined text has no sure boundary
        for w in words:
            (odd if not w or w[-1].isspace() or "▁" in w else usual).append(w)
        words[:] = usual + odd
        for side in (self.a, self.b):
            ids, sizes, fine = side.words(usual)
            each = side.encode(odd)
            fine = np.concatenate([fine, np.array([b"".join(map(side.bytes.__getitem__, x)) == b" " + w.encode() for x, w in zip(each, odd, strict=True)], bool)])
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(each), np.int32)])
            sides.append((ids, np.concatenate([sizes, np.array([len(x) for x in each], np.int64)])))
            good &= fine
        placed = []
        for side, (ids, sizes) in zip((self.a, self.b), sides, strict=True):
            owner = np.repeat(np.arange(n), sizes)
            ids, owner = ids[good[owner]], owner[good[owner]]
            ends = np.cumsum(side.lengths[ids])
            placed.append((ids, owner, ends - side.lengths[ids], ends))
        (a, a_word, a_start, a_end), (b, b_word, b_start, b_end) = placed
        a_group, b_group, a_link, b_link = coalesce(a_start, a_end, b_start, b_end)
        groups = int(a_group[-1]) + 1 if len(a_group) else 0
        a_sizes, b_sizes = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        # every group has tokens of both: A's of all groups so far come before B's of this one
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + (np.cumsum(b_sizes) - b_sizes)[a_group]] = self.a.written[np.diff(a_group, append=groups).astype(bool).astype(np.int8), a]
        out[np.arange(len(b)) + np.cumsum(a_sizes)[b_group]] = self.b.written[np.diff(b_group, append=groups).astype(bool).astype(np.int8), b]
        n_a, n_b = np.bincount(a_word, minlength=n), np.bincount(b_word, minlength=n)
        firsts = np.flatnonzero(np.diff(a_group, prepend=-1))
        n_links = np.bincount(a_word[a_link], minlength=n)
        for pool, values in zip(self.numbers, (n_a, n_b, np.bincount(a_word[firsts], minlength=n), n_links), strict=True):
            pool.add(values)
        at = 0
        for size in (n_a + n_b).tolist():
            self.groups.append("".join(out[at : at + size].tolist()))
            at += size
        self.begins.add(self.links.used + np.cumsum(n_links) - n_links)
        self.links.add(self.pair_numbers(a[a_link].astype(np.int64) << 32 | b[b_link]))
        self.good.add(good)
        self.known.update(zip(words, range(len(self.known), len(self.known) + n), strict=True))

    def align(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray]:
        """Per text n_a, n_b, n_groups, n_links and the hash of its groups; then the pair numbers of all links, text by text."""
        n = len(texts)
        parts = [self.split(t) if t else [] for t in texts]
        self.learn(list(set(chain.from_iterable(parts)).difference(self.known)))
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64)
        owner = np.repeat(np.arange(n), [len(p) for p in parts])
        bad = np.bincount(owner, ~self.good.all[words], n) > 0
        words, owner = words[~bad[owner]], owner[~bad[owner]]
        numbers = [np.bincount(owner, pool.all[words], n).astype(np.int64) for pool in self.numbers]
        hashes, at, listed = [], 0, words.tolist()
        for size in np.bincount(owner, minlength=n).tolist():
            hashes.append(hashlib.sha256("".join(map(self.groups.__getitem__, listed[at : at + size]))[:-1].encode()).hexdigest() if size else "")
            at += size
        return numbers, hashes, self.links.all[_ranges(self.begins.all[words], self.numbers[3].all[words])]


_ALIGNERS: dict[tuple[str, str], _Aligner] = {}


def _slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text."""
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1])
    at, total = 0, 0
    for i, size in enumerate(lengths.tolist()):
        if total and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(lengths):
        yield at, len(lengths)


def _encode(a: str, b: str, batch: int, chunk: int):
    """Rows of (kept columns, text) to (kept columns, chunk, counts, hash, links as numbers of the chunk's pairs; the chunk's first row has the pairs and how many links hold each)."""

    def close(aligner: _Aligner, name: str, parts: list, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The chunk's pairs get numbers of their own, in order of the pairs."""
        numbers = np.concatenate([p[3] for p in parts])
        counts = np.bincount(numbers, minlength=len(aligner.pairs))[aligner.places]
        held = np.flatnonzero(counts)
        pairs, counts = aligner.pairs[held], counts[held]
        renumbered = np.zeros(len(aligner.pairs), np.min_scalar_type(max(1, len(pairs))))
        renumbered[aligner.places[held]] = np.arange(len(pairs))
        places = renumbered[numbers]
        first, at = True, 0
        for kept, numbers, hashes, _ in parts:
            links = []
            for size in numbers[3].tolist():
                links.append(places[at : at + size].tobytes())
                at += size
            own = [[x.astype(np.int64).tobytes() if first and i == 0 else None for i in range(len(hashes))] for x in (pairs, counts)]
            first = False
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([name] * len(hashes)), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(hashes, pa.string()), pa.array(links, pa.binary()), *(pa.array(x, pa.binary()) for x in own)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a, b) not in _ALIGNERS:
            _ALIGNERS[a, b] = _Aligner(a, b)
        aligner = _ALIGNERS[a, b]
        parts, size, number = [], 0, 0
        if len(aligner.known) > MEMO:
            aligner.forget()
        for whole in batches:
            names = [*whole.schema.names[:-1], *_MADE]
            for begin, end in _slices(whole.column("__text"), batch):
                piece = whole.slice(begin, end - begin)
                texts = piece.column("__text").to_pylist()
                parts.append((piece.drop_columns(["__text"]), *aligner.align(texts)))
                size += sum(map(len, texts))
                if size >= chunk:
                    yield from close(aligner, f"{TaskContext.get().partitionId()}-{number}", parts, names)
                    parts, size, number = [], 0, number + 1
                    if len(aligner.known) > MEMO:
                        aligner.forget()
        if parts:
            yield from close(aligner, f"{TaskContext.get().partitionId()}-{number}", parts, names)

    return run


_MADE = ("__chunk", *_NUMBERS, "groups_sha256", "__links", "__pairs", "__counts")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, counts = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(pairs), np.int8))), pa.array(pairs), pa.array(counts)], names=["chunk", "pair", "n"])


def _resolve(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's texts with what the corpus says about its pairs."""
    order = np.argsort(answers.column("pair").to_numpy())
    count, best = (answers.column(c).to_numpy(zero_copy_only=False)[order] for c in ("count", "best"))
    kind = np.min_scalar_type(max(1, len(count)))
    sums, bests = [], []
    for links in texts.column("__links").to_pylist():
        found = np.frombuffer(links, kind)
        sums.append(int(count[found].sum()) if len(found) else 0)
        bests.append(int(best[found].sum()) if len(found) else 0)
    kept = texts.select([c for c in texts.column_names if c not in ("__chunk", "__links")])
    return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def pair_counts(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, pair, n) of each chunk, and over all of them pair (A's id * 2^32 + B's id), count (links that hold it) and best (whether no pair with this B id has a higher count)."""
    each = encoded.where("__pairs IS NOT NULL").select("__chunk", "__pairs", "__counts").mapInArrow(_pairs, "chunk string, pair long, n long")
    totals = stash(each.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts").withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    highest = totals.groupBy("b").agg(F.max("count").alias("highest"))
    return each, totals.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_tokens(docs: DataFrame, a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model", keep: tuple[str, ...] = ("doc_id",), batch: int = BATCH, chunk: int = CHUNK) -> DataFrame:
    """The columns `keep` of all rows with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of a space and the whole text in both encodings.

    Null and empty texts, and texts that an encoding does not give back byte by byte, have no tokens: zeros and ''. Repeated rows stay, and each counts; ties for the highest count are all best. Kept columns named like a result are replaced."""
    results = (*_NUMBERS, "n_best", "count_sum", "groups_sha256")
    names = [c for c in keep if c not in results]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)], text_of().alias("__text"))
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns[:-1])
    numbers = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    encoded = stash(rows.mapInArrow(_encode(a, b, batch, chunk), f"{kept}, __chunk string, {numbers}, __links binary, __pairs binary, __counts binary".lstrip(", ")), "aligned")
    each, totals = pair_counts(encoded)
    answers = each.select("chunk", "pair").join(totals.hint("merge"), "pair").select(F.col("chunk").alias("__chunk"), "pair", "count", "best")
    slim = encoded.drop("__pairs", "__counts")
    found = slim.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(_resolve, f"{kept}, {numbers}, n_best long, count_sum long".lstrip(", "))
    return found.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)], *results)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
