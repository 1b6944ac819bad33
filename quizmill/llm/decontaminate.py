"""Benchmark decontamination by latent semantic retrieval.

TF-IDF passages of the whole corpus go through one distributed pass of a randomised (Nystrom) SVD; windows of every document are compared with the benchmark's passages by cosine in the whitened latent space; candidates are settled by longest common subsequences and a check of the item's answer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import Tokens, batches, text_of

PASSAGE_WORDS = 32
RANK = 48
#: Least cosine of a candidate window, least share of an item's words in common order, and what suffices if the answer is there too.
COSINE, LCS, LCS_WITH_ANSWER, ANSWER = 0.5, 0.6, 0.5, 0.7
#: Items are compared in blocks of so many, which bounds what is broadcast.
ITEMS_PER_BLOCK = 5000
#: Tasks that sketch the corpus at most: each sends a row per vocabulary word that it met.
SKETCH_TASKS = 4096
#: Words in more than this share of the items are left out of the passages, but not where an item would keep fewer than LEAST_WORDS.
COMMON, LEAST_WORDS = 0.1, 8
_SLOTS = 20
#: Windows are compared in blocks: cells of (windows x passages) at a time, vocabulary words summed at a time, item words looked up at a time. They bound a task's memory, however long a text is and however many items there are.
CELLS, SPAN, LOOKUPS = 2_000_000, 65_536, 1_000_000


@dataclass
class Items:
    """A block of benchmark items: word hashes, answers, all their words (`known`, sorted hashes) and the vocabulary: those of them that tell items apart.

    numbers[k] is the vocabulary number of known word k, -1 for none (and at the end, for unknown words); flat[sizes' running sum] are the items' words as known words, one item after another. slots[p] is the number of known words whose first _SLOTS bits are below p; most is the largest number that share them."""

    ids: list[str | None]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    known: np.ndarray = field(default=None)
    vocabulary: np.ndarray = field(default=None)
    numbers: np.ndarray = field(default=None)
    flat: np.ndarray = field(default=None)
    sizes: np.ndarray = field(default=None)
    slots: np.ndarray = field(default=None)
    most: int = 0

    @classmethod
    def of(cls, rows: list[tuple[str | None, str]], common: np.ndarray = np.zeros(0, np.uint64)) -> "Items":
        """`common` are the words that are left out of the vocabulary, but not of items that would keep fewer than LEAST_WORDS."""
        t, last = Tokens([x for _, x in rows], words=True), Tokens([answer_of(x) for _, x in rows], words=True)
        cut = lambda k: [k.hashes[a:b] for a, b in zip(k.starts[:-1], k.starts[1:], strict=True)]
        out = cls([i for i, _ in rows], cut(t), cut(last))
        rare = ~np.isin(t.hashes, common)
        enough = np.bincount(t.owners, rare, minlength=len(rows)) >= LEAST_WORDS
        out.known, out.flat = np.unique(t.hashes, return_inverse=True)
        out.sizes = t.counts
        out.vocabulary = np.unique(t.hashes[rare | ~enough[t.owners]])
        out.numbers = np.full(len(out.known) + 1, -1, np.int32)
        out.numbers[np.searchsorted(out.known, out.vocabulary)] = np.arange(len(out.vocabulary))
        out.slots = np.concatenate([[0], np.cumsum(np.bincount((out.known >> np.uint64(64 - _SLOTS)).astype(np.int64), minlength=1 << _SLOTS))]).astype(np.int32)
        out.most = int(np.diff(out.slots).max(initial=0))
        return out

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 if it is not in the vocabulary."""
        return self.numbers[self.place(hashes)]

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the known ones, -1 for others."""
        out = np.full(len(hashes), -1, np.int32)
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        at = np.flatnonzero(self.slots[slot + 1] > self.slots[slot])
        lo, hi = self.slots[slot[at]], self.slots[slot[at] + 1]
        for step in range(self.most):
            here = lo + step < hi
            at, lo, hi = at[here], lo[here], hi[here]
            hit = self.known[lo + step] == hashes[at]
            out[at[hit]] = lo[hit] + step
        return out


def _item_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in batches(frame):
            t = Tokens(list(part["text"]), words=True)
            own = np.unique(np.stack([t.owners.astype(np.uint64), t.hashes]), axis=1)[1] if len(t.hashes) else t.hashes
            yield pd.DataFrame({"word": own.view(np.int64)})


def common_words(items: DataFrame) -> np.ndarray:
    """Hashes of the words in more than COMMON of all items (and in two at least): at most 1 / COMMON times the mean number of words of an item."""
    counted = items.select("text").mapInPandas(_item_words, "word long").groupBy("word").count()
    found = counted.where(F.col("count") > max(1.0, COMMON * items.count())).select("word").toPandas()
    return found["word"].to_numpy(np.int64).view(np.uint64)


def answer_of(text: str) -> str:
    """An item's answer: its last sentence or line that has words."""
    parts = [p for p in re.split(r"[.?!\n]+", text or "") if re.search(r"\w", p)]
    return parts[-1] if parts else ""


def _sketch(shipped):
    """Per task: for each vocabulary word the passages that hold it and its row of (C^T C) test, C being passages by words. `shipped` broadcasts the items and the test matrix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, test = shipped.value
        m = len(items.vocabulary)
        y, df, total = np.zeros((m, test.shape[1])), np.zeros(m, np.int64), 0
        for frame in frames:
            for part in batches(frame):
                t = Tokens(list(part["text"]), words=True)
                place = np.arange(len(t.hashes)) - np.repeat(t.starts[:-1], t.counts)
                firsts = np.concatenate([[0], np.cumsum(-(-t.counts // PASSAGE_WORDS))])
                total += int(firsts[-1])
                word = items.index(t.hashes)
                at = np.flatnonzero(word >= 0)
                passage = (firsts[:-1][t.owners[at]] + place[at] // PASSAGE_WORDS).astype(np.int64)
                pairs = np.unique(passage * m + word[at]) if len(at) else np.zeros(0, np.int64)
                if not len(pairs):
                    continue
                passage, w = pairs // m, pairs % m
                df += np.bincount(w, minlength=m)
                edges = np.flatnonzero(np.diff(passage, prepend=-1))
                rows = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(pairs))))
                sums = np.add.reduceat(test[w], edges, axis=0)
                by = np.argsort(w, kind="stable")
                starts = np.flatnonzero(np.diff(w[by], prepend=-1))
                y[w[by][starts]] += np.add.reduceat(sums[rows[by]], starts, axis=0)
        out = pd.DataFrame({"word": np.arange(m + 1), "df": np.append(df, total)})
        out["row"] = [*y.astype(np.float32).tolist(), [0.0] * test.shape[1]]
        yield out[out["df"] > 0]

    return run


def latent_basis(docs: DataFrame, items: Items, rank: int = RANK) -> np.ndarray:
    """A row for each vocabulary word: its idf times its place in the whitened latent space.

    Randomised SVD of the corpus's TF-IDF passages A = C D (D: idf) by the single-pass Nystrom method: with Y = A^T A T for a random T, A^T A is about Y (T^T Y)^-1 Y^T. The pass gathers C^T C T and the document frequencies, so T is D^-1 times the test matrix. vocabulary x rank numbers come to the driver."""
    m = len(items.vocabulary)
    if not m:
        return np.zeros((0, rank), np.float32)
    test = np.random.default_rng(17).normal(size=(m, rank)).astype(np.float32)
    shipped = docs.sparkSession.sparkContext.broadcast((items, test))  # bounded by ITEMS_PER_BLOCK
    parts = docs.select("text").coalesce(SKETCH_TASKS).mapInPandas(_sketch(shipped), "word long, df long, row array<float>")
    summed = parts.groupBy("word").agg(F.sum("df").alias("df"), *[F.sum(F.col("row")[i].cast("double")).alias(f"y{i}") for i in range(rank)]).toPandas().set_index("word")
    df, y = np.zeros(m + 1), np.zeros((m + 1, rank))
    df[summed.index] = summed["df"]
    y[summed.index] = summed[[f"y{i}" for i in range(rank)]]
    idf = np.log((1 + df[m]) / (1 + df[:m])) + 1
    y = y[:m] * idf[:, None]
    t = test.astype(float) / idf[:, None]
    shift = 1e-6 * max(np.linalg.norm(y), 1e-9)
    y += shift * t
    core = t.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, values.max(initial=0) * 1e-9 + 1e-12))
    u, s, _ = np.linalg.svd(y @ root, full_matrices=False)
    spread = np.sqrt(np.maximum(s**2 - shift, 0) + 1e-3 * s.max(initial=0) ** 2 + 1e-12)
    return (idf[:, None] * u / spread).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Pieces:
    """The items' passages of one width: latent vectors, item numbers, first words, how many vocabulary words a window must share, and the (passage, word) pairs, sorted.

    What must be shared follows from what is accepted in the end: where LCS_WITH_ANSWER of an item's words come in order, a passage has that share of its words in the text, and the nearest window, which is off by half a step, seven eighths of these; at worst all the passage's words outside the vocabulary are among them."""

    width: int
    vectors: np.ndarray
    item: np.ndarray
    first: np.ndarray
    least: np.ndarray
    pairs: np.ndarray


def pieces_of(items: Items, basis: np.ndarray) -> list[Pieces]:
    """Items of 32 words or more in passages of 32; of 16 or more in passages of 16; shorter ones in passages of 8 (or whole)."""
    out = []
    for width, lo, hi in ((32, 32, 1 << 30), (16, 16, 32), (8, 1, 16)):
        rows, own, first, least, pairs = [], [], [], [], []
        for i, words in enumerate(items.words):
            n = len(words)
            if not lo <= n < hi:
                continue
            w = items.index(words)
            starts = sorted({*range(0, max(1, n - width + 1), width), max(0, n - width)})
            for a in starts:
                inside = w[a : a + width]
                inside = inside[inside >= 0]
                pairs.append(np.unique(inside) + len(rows) * len(items.vocabulary))
                rows.append(basis[inside].sum(axis=0))
                own.append(i)
                first.append(a)
                wide = min(width, n)
                least.append(max(1, int(LCS_WITH_ANSWER * 7 / 8 * wide) - (wide - len(pairs[-1]))))
        if rows:
            out.append(Pieces(width, _unit(np.array(rows)), np.array(own), np.array(first), np.array(least), np.concatenate(pairs)))
    return out


def sharing(p: Pieces, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, piece: np.ndarray, vocabulary: int) -> np.ndarray:
    """Which of the candidates share enough words: window k holds the vocabulary words word[lo[k]:hi[k]] and is held against passage piece[k]."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    place = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(which))
    keys = piece[which] * np.int64(vocabulary) + word[place]
    hit = p.pairs[np.minimum(np.searchsorted(p.pairs, keys), len(p.pairs) - 1)] == keys
    return np.bincount(which[hit], minlength=len(lo)) >= p.least[piece]


def running_sums(basis: np.ndarray, word: np.ndarray, at: int) -> np.ndarray:
    """Row k: the sum of basis[word[at:at + k]], for windows that begin within SPAN words from `at` and have at most PASSAGE_WORDS."""
    part = word[at : at + SPAN + PASSAGE_WORDS]
    sums = np.zeros((len(part) + 1, basis.shape[1]), np.float32)
    np.cumsum(basis[part], axis=0, out=sums[1:])
    return sums


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, 64 cells and more at a time in the bits of an integer."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def windows(p: Pieces, t: Tokens, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a batch that hold enough vocabulary words for some passage of p, in order: text, first word, and the places of their first and next vocabulary words."""
    step = max(1, p.width // 4)
    per = np.maximum(1, -(-(t.counts - p.width) // step) + 1)
    doc = np.repeat(np.arange(len(per)), per)
    first = t.starts[:-1][doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
    last = np.minimum(first + p.width, t.starts[1:][doc])
    first = np.minimum(first, last)
    lo, hi = seen[first], seen[last]
    some = hi - lo >= p.least.min()
    return doc[some], first[some], lo[some], hi[some]


def holding(items: Items, places: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of the stretches lo:hi of `places`, sorted known words with their places (word x step + place), hold LCS_WITH_ANSWER of the item's words; no more words can come in order than come at all. lo, hi and step fit the keys in places[0] (step first)."""
    step, keys = places[0], np.append(places[1:], np.iinfo(np.int64).max)
    sizes, out = items.sizes[item], np.zeros(len(item), bool)
    begins, ends = np.concatenate([[0], np.cumsum(items.sizes)])[item], np.cumsum(sizes)
    at = 0
    while at < len(item):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + LOOKUPS, "right")))
        n = sizes[at:to]
        which = np.repeat(np.arange(to - at), n)
        word = items.flat[np.arange(len(which)) + np.repeat(begins[at:to] - (np.cumsum(n) - n), n)] * step
        hit = keys[np.searchsorted(keys, word + lo[at:to][which])] < word + hi[at:to][which]
        out[at:to] = np.bincount(which[hit], minlength=to - at) >= LCS_WITH_ANSWER * n
        at = to
    return out


def promising(items: Items, known: np.ndarray, t: Tokens, doc: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which candidates (text, item, first word) may be accepted: first the whole text, then the span that settle() reads must hold enough of the item's words. Starts within a quarter of the item's length are looked up together, for all their spans at once."""
    at = np.flatnonzero(known >= 0)
    step = np.int64(len(known) + 1)
    places = np.concatenate([[step], np.sort(known[at] * step + at)])
    pairs, pair = np.unique(doc * np.int64(len(items.ids)) + item, return_inverse=True)
    d, i = pairs // len(items.ids), pairs % len(items.ids)
    left = np.flatnonzero(holding(items, places, i, t.starts[d], t.starts[d + 1])[pair])
    n = items.sizes[item[left]]
    wide = np.maximum(1, n // 4)
    cells, cell = np.unique(np.stack([pair[left], start[left] // wide]), axis=1, return_inverse=True)
    d, i = d[cells[0]], i[cells[0]]
    n, wide = items.sizes[i], np.maximum(1, items.sizes[i] // 4)
    lo = t.starts[d] + np.maximum(0, cells[1] * wide - n // 4)
    hi = np.minimum(t.starts[d + 1], t.starts[d] + cells[1] * wide + wide + n + n // 4)
    out = np.zeros(len(doc), bool)
    out[left] = holding(items, places, i, lo, hi)[cell.ravel()]
    return out


def settle(item: list, answer: list, words: np.ndarray, start: int) -> tuple[float, float, int]:
    """Share of the item's words and of its answer's that come in order in the text about `start`, and where that span begins."""
    n = len(item)
    a = max(0, start - n // 4)
    span = words[a : max(a, start + n + n // 4 + 1)].tolist()
    held = set(span)
    if sum(x in held for x in item) < LCS_WITH_ANSWER * n:
        return 0.0, 0.0, a  # no more words can come in order than come at all
    share = lcs(item, span) / max(1, n)
    return share, lcs(answer, span) / max(1, len(answer)) if share >= LCS_WITH_ANSWER else 0.0, a


def _search(shipped, keep: tuple[str, ...] = ()):
    """`shipped` broadcasts the items and the basis."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, basis = shipped.value
        pieces = pieces_of(items, basis)
        long_words = [w.tolist() for w in items.words]
        answers = [w.tolist() for w in items.answers]
        for frame in frames:
            out = []
            for part in batches(frame, chars=500_000):
                t = Tokens(list(part["text"]), words=True)
                known = items.place(t.hashes)
                word = items.numbers[known]
                at = np.flatnonzero(word >= 0)
                if not len(at):
                    continue
                seen = np.concatenate([[0], np.cumsum(word >= 0)])
                inside = word[at].astype(np.int64)
                hits = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.float32),)]
                cut = [windows(p, t, seen) for p in pieces]
                for start in range(0, len(inside), SPAN):
                    sums = running_sums(basis, inside, start)
                    for p, (doc, first, lo_all, hi_all) in zip(pieces, cut, strict=True):
                        most = max(64, CELLS // len(p.vectors))
                        begin, end = np.searchsorted(lo_all, [start, start + SPAN])
                        for block in range(begin, end, most):
                            own = slice(block, min(end, block + most))
                            lo, hi = lo_all[own], hi_all[own]
                            near = _unit(sums[hi - start] - sums[lo - start]) @ p.vectors.T
                            r, c = np.divmod(np.flatnonzero(near >= COSINE), len(p.vectors))
                            if not len(r):
                                continue
                            enough = sharing(p, inside, lo[r], hi[r], c, len(items.vocabulary))
                            r, c = r[enough], c[enough]
                            hits.append((doc[own][r], p.item[c], first[own][r] - p.first[c] - t.starts[doc[own][r]], near[r, c]))
                found = [np.concatenate(x) for x in zip(*hits, strict=True)]
                good = promising(items, known, t, *found[:3]) if len(found[0]) else np.zeros(0, bool)
                candidates: dict[tuple[int, int], dict[int, float]] = {}
                for d, i, start, cosine in zip(*[x[good].tolist() for x in found], strict=True):
                    candidates.setdefault((d, i), {})[start] = cosine
                for (d, i), starts in candidates.items():
                    own, best, tried = t.hashes[t.starts[d] : t.starts[d + 1]], None, []
                    for start, cosine in sorted(starts.items(), key=lambda x: (-x[1], x[0])):
                        if any(abs(start - x) <= len(long_words[i]) // 8 for x in tried):
                            continue  # the span reaches a quarter of the item beyond either end: nearly the same span
                        tried.append(start)
                        share, found, a = settle(long_words[i], answers[i], own, start)
                        if (share >= LCS or (share >= LCS_WITH_ANSWER and found >= ANSWER)) and (best is None or share > best[0]):
                            best = (share, found, a, cosine)
                    if best:
                        out.append((part["doc_id"].iloc[d], items.ids[i], best[3], best[0], best[1], best[2], *(part[c].iloc[d] for c in keep)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "lcs", "answer", "near_word", *keep])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, near_word, and the string columns `keep` of docs): documents that hold a benchmark item, word for word or paraphrased; near_word is about where.

    Whole texts are searched; items are taken in blocks of ITEMS_PER_BLOCK, each with its own latent space and passes; which words are common is counted over all items. Null and empty texts hold nothing, items without words are held by none, items without id are searched like others, repeated rows are found as often as they come."""
    spark, found = docs.sparkSession, None
    items = benchmark.select("item_id", text_of().alias("text")).distinct()
    place = F.struct(F.col("item_id").isNotNull().alias("known"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text", place.alias("place"))
    common = common_words(items)
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    more = "".join(f", `{c}` string" for c in keep)
    after = None
    while True:
        rest = items if after is None else items.where(F.col("place") > F.struct(*[F.lit(v) for v in after]))
        block = rest.orderBy("place").limit(ITEMS_PER_BLOCK).collect()
        if block or found is None:
            own = Items.of([(r["item_id"], r["text"]) for r in block], common)
            shipped = spark.sparkContext.broadcast((own, latent_basis(texts, own)))  # bounded by ITEMS_PER_BLOCK
            rows = texts.mapInPandas(_search(shipped, keep), f"doc_id string, item_id string, cosine double, lcs double, answer double, near_word long{more}")
            found = rows if found is None else found.unionByName(rows)
        if len(block) < ITEMS_PER_BLOCK:
            return found.withColumns({"doc_id": F.col("doc_id").cast("long"), "item_id": F.col("item_id").cast("long")})
        after = tuple(block[-1]["place"])


def op9_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
