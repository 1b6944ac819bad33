"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling, trained in numpy.

Inputs of a score are the words of the whole text and nothing else. Labels and languages are used only to train and to set thresholds.

All labelled rows that may be learned from count, with their whole texts: three in four (by id) train the network, the rest set the thresholds. The rows that train lie in shards; in each round every shard trains the common network on its own rows, and the changes are averaged, for each parameter over the shards that changed it."""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import Tokens, batches, running_sum, scratch_path, stash

#: Rounds of averaging, and how often a shard's rows are passed over in each.
ROUNDS, PASSES = 4, 3
#: Rows of a shard: the first number until there are so many shards, then as many as the third says.
SHARD_ROWS, FEW_SHARDS, FULL_SHARD_ROWS = 4096, 8, 16384
#: Characters of the texts that a shard's task holds at a time; words of the texts that make one step.
BLOCK_CHARS, STEP_WORDS = 4_000_000, 500_000
#: Score at which a text counts as toxic.
CUT = 0.3
LEAST_OF_A_LANGUAGE = 10

_ROWS = 1 << 17  # of the embedding table
_DIMS = 12
_FILTERS = 16
_WIDTHS = (1, 2, 3)
_PAD = max(_WIDTHS)
_HEADS = (4, 6, 7, 8, 9)  # bytes of the word beginnings that are embedded beside the word


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def word_rows(texts) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (the word and its beginnings) with padding words (row -1) after each text's words, and where each text begins."""
    t = Tokens(list(texts), prefixes=_HEADS)
    n = len(t.starts) - 1
    begins = t.starts + _PAD * np.arange(n + 1)
    out = np.full((int(begins[-1]), 1 + len(_HEADS)), -1, np.int32)
    at = np.arange(len(t.hashes)) + _PAD * t.owners
    for k, h in enumerate([t.hashes, *(t.prefixes[p] for p in _HEADS)]):
        out[at, k] = (h >> np.uint64(64 - 17)).astype(np.int32)
    return out, begins


def row_counts(rows: np.ndarray, begins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component of a word (itself, its beginnings) and each embedding row: the texts, and the toxic texts, that hold it."""
    owner = np.repeat(np.arange(len(y)), np.diff(begins))
    n, hits = np.zeros((2, 1 + len(_HEADS), _ROWS), np.int64)
    for k in range(rows.shape[1]):
        real = rows[:, k] >= 0
        seen = np.sort(owner[real] * np.int64(_ROWS) + rows[real, k])
        seen = seen[np.flatnonzero(np.diff(seen, prepend=-1))]
        docs, row = seen // _ROWS, seen % _ROWS
        n[k] = np.bincount(row, minlength=_ROWS)
        hits[k] = np.bincount(row[y[docs] == 1], minlength=_ROWS)
    return n, hits


@dataclass
class TextCnn:
    """Parameters; the embedding table's last row is the padding word's and stays zero."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def start(cls, rows: np.ndarray, begins: np.ndarray, y: np.ndarray) -> "TextCnn":
        return cls.of_counts(*row_counts(rows, begins, y), len(y), float(y.sum()))

    @classmethod
    def of_counts(cls, n: np.ndarray, hits: np.ndarray, texts: int, toxic: float) -> "TextCnn":
        """Random, but for dimension 0: how much more often than by chance a row occurs in toxic training texts. n, hits: how many texts, and toxic ones, hold a row as word or as a beginning of some length."""
        rng = np.random.default_rng(3)
        table = rng.normal(0, 0.05, (_ROWS + 1, _DIMS)).astype(np.float32)
        table[:, 0] = 0
        rate = toxic / max(texts, 1)
        for seen, bad in zip(n, hits, strict=True):
            expect = seen * max(rate, 1e-6)
            excess = np.maximum(bad - expect - 1, 0) / np.sqrt(expect + 1)
            table[:_ROWS, 0] += np.where(seen > 0, np.log1p(excess), 0).astype(np.float32)
        table[_ROWS] = 0
        filters = [rng.normal(0, 1 / np.sqrt(w * _DIMS), (w * _DIMS, _FILTERS)).astype(np.float32) for w in _WIDTHS]
        for f in filters:
            f[0, : _FILTERS // 2] = np.abs(f[0, : _FILTERS // 2]) + 0.5
        out = rng.normal(0, 0.05, len(_WIDTHS) * _FILTERS).astype(np.float32)
        return cls(table, filters, [np.full(_FILTERS, -0.2, np.float32) for _ in _WIDTHS], out, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))

    def pooled(self, rows: np.ndarray, begins: np.ndarray, keep: bool = False):
        """Greatest filter response in each text (negative: 0); keep: also where it is."""
        x = self.table.take(rows[:, 0], axis=0, mode="wrap")  # faster than an index; row -1 is the last one here too
        for k in range(1, rows.shape[1]):
            x += self.table.take(rows[:, k], axis=0, mode="wrap")
        most, where = [], []
        for w, f, b in zip(_WIDTHS, self.filters, self.bias, strict=True):
            reply = x @ f[:_DIMS] + b
            for k in range(1, w):
                reply[:-k] += x[k:] @ f[k * _DIMS : (k + 1) * _DIMS]
            for back in range(1, _PAD):  # these would read the next text
                reply[begins[1:] - back] = -9
            if keep:
                own = [reply[a:e].argmax(axis=0) + a for a, e in zip(begins[:-1], begins[1:], strict=True)]
                where.append(np.array(own).reshape(-1, _FILTERS))
                most.append(np.take_along_axis(reply, where[-1], 0))
            else:
                most.append(np.maximum.reduceat(reply, begins[:-1], axis=0))
        z = np.maximum(np.concatenate(most, axis=1), 0)
        return (z, x, where) if keep else z

    def logits(self, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return self.pooled(rows, begins) @ self.out + self.out_bias

    def score(self, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
        if len(begins) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(rows, begins).astype(float) + self.shift, -30, 30)))


def toxic_weight(rate: float) -> float:
    """What a toxic text counts in the loss."""
    return min(4.0, max(1.0, (1 - rate) / max(rate, 1e-6) / 2))


@dataclass
class Learner:
    """A network with its Adagrad sums; the gradient of a max-pooled filter touches one place in each text."""

    net: TextCnn
    table: np.ndarray = field(default_factory=lambda: np.full((_ROWS + 1, _DIMS), 0.1, np.float32))
    filters: list[np.ndarray] = field(default_factory=lambda: [np.full((w * _DIMS, _FILTERS), 0.1) for w in _WIDTHS])
    bias: list[np.ndarray] = field(default_factory=lambda: [np.full(_FILTERS, 0.1) for _ in _WIDTHS])
    out: np.ndarray = field(default_factory=lambda: np.full(len(_WIDTHS) * _FILTERS, 0.1))
    out_bias: float = 0.1
    touched: np.ndarray = field(default_factory=lambda: np.zeros(_ROWS, bool))

    def learn(self, rows: np.ndarray, begins: np.ndarray, y: np.ndarray, order: np.ndarray, batch: int, rate: float, toxic: float) -> None:
        """One pass over the texts in the given order; a step takes `batch` of them, fewer where they are long."""
        sizes = np.diff(begins)
        at = 0
        while at < len(order):
            words = np.cumsum(sizes[order[at : at + batch]])
            part = order[at : at + max(1, int(np.searchsorted(words, STEP_WORDS, "right")))]
            self.step(np.concatenate([rows[begins[i] : begins[i + 1]] for i in part]), np.concatenate([[0], np.cumsum(sizes[part])]), y[part], rate, toxic)
            at += len(part)

    def step(self, own: np.ndarray, edges: np.ndarray, y: np.ndarray, rate: float, toxic: float) -> None:
        net = self.net
        z, x, where = net.pooled(own, edges, keep=True)
        p = 1 / (1 + np.exp(-np.clip(z @ net.out + net.out_bias, -30, 30)))
        g = ((p - y) * np.where(y == 1, toxic, 1.0) / len(y)).astype(np.float32)
        g_out = z.T @ g + 1e-4 * net.out
        g_z = (g[:, None] * net.out[None, :]) * (z > 0)
        touched, grads = [], []
        for k, w in enumerate(_WIDTHS):
            gz, place = g_z[:, k * _FILTERS : (k + 1) * _FILTERS], where[k]
            g_f = np.zeros_like(net.filters[k])
            live = gz != 0
            for step in range(w):
                at_x = np.minimum(place + step, len(x) - 1)
                f = net.filters[k][step * _DIMS : (step + 1) * _DIMS]
                g_f[step * _DIMS : (step + 1) * _DIMS] = np.einsum("nfd,nf->df", x[at_x], gz)
                touched.append(at_x[live])
                grads.append((gz[:, :, None] * f.T[None])[live])
            g_b = gz.sum(axis=0)
            self.filters[k] += g_f**2
            self.bias[k] += g_b**2
            net.filters[k] -= (rate * g_f / np.sqrt(self.filters[k])).astype(np.float32)
            net.bias[k] -= (rate * g_b / np.sqrt(self.bias[k])).astype(np.float32)
        words, grad = own[np.concatenate(touched)], np.concatenate(grads)
        flat = words.ravel()
        by_row = np.argsort(flat, kind="stable")
        by_row = by_row[np.searchsorted(flat[by_row], 0) :]  # padding words have row -1
        if len(by_row):
            first = np.flatnonzero(np.diff(flat[by_row], prepend=-1))
            into = flat[by_row[first]]
            g_e = np.add.reduceat(grad[by_row // words.shape[1]], first, axis=0)
            self.table[into] += g_e**2
            net.table[into] -= rate * g_e / np.sqrt(self.table[into])
            self.touched[into] = True
        self.out += g_out**2
        net.out -= (rate * g_out / np.sqrt(self.out)).astype(np.float32)
        self.out_bias += float(g.sum()) ** 2
        net.out_bias -= rate * float(g.sum()) / np.sqrt(self.out_bias)

    def dense(self) -> np.ndarray:
        """All that is not of the embedding table, in one row."""
        net = self.net
        parts = [*net.filters, *net.bias, net.out, net.out_bias, *self.filters, *self.bias, self.out, self.out_bias]
        return np.concatenate([np.ravel(p) for p in parts]).astype(float)

    def add_dense(self, change: np.ndarray) -> None:
        at = 0
        for of in (self.net, self):
            for a in (*of.filters, *of.bias, of.out):
                a += change[at : at + a.size].reshape(a.shape).astype(a.dtype)
                at += a.size
            of.out_bias += float(change[at])
            at += 1


def train(rows: np.ndarray, begins: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.05) -> TextCnn:
    """Adagrad on the logistic loss, over texts in memory."""
    learner, rng = Learner(TextCnn.start(rows, begins, y)), np.random.default_rng(5)
    for _ in range(epochs):
        learner.learn(rows, begins, y, rng.permutation(len(y)), batch, rate, toxic_weight(float(y.mean())))
    return learner.net


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, toxic, part of all labelled rows that may be learned from, with whole texts; part 3 calibrates. Of the rows that repeat an id the least text and language, and the greatest label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    own = texts.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("least"))
    return own.select("doc_id", "least.*", "toxic", part.alias("part"))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """labelled() of a small table, by id."""
    return labelled(docs, labels).toPandas().sort_values("doc_id")


def dealt(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, lang, y of labelled(), stored by shard, in a fixed order inside it. Shards from 0 on train, those below 0 calibrate."""
    rows = labelled(docs, labels).withColumn("y", (F.col("toxic") == 1).cast("int"))
    ids = labels.where("doc_id IS NOT NULL").count()
    shards = max(1, min(FEW_SHARDS, ids // SHARD_ROWS), ids // FULL_SHARD_ROWS)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    rows = rows.withColumn("shard", F.when(F.col("part") == 3, -1 - shard).otherwise(shard)).withColumn("place", F.xxhash64(F.lit(3), "doc_id"))
    slim = rows.repartition("shard").sortWithinPartitions("shard", "place", "doc_id").select("text", "lang", "y", "shard")
    path = scratch_path(docs.sparkSession, "toxicity-labelled")
    slim.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema("text string, lang string, y int, shard int").parquet(path)


def _blocks(frames: Iterator[pd.DataFrame], most: int = BLOCK_CHARS) -> Iterator[tuple[int, pd.DataFrame]]:
    """Consecutive rows of one shard, at most so many characters (or one row) at a time; which ones does not depend on the frames."""
    held, chars, last = [], 0, None
    for frame in frames:
        at = 0
        for i, (shard, size) in enumerate(zip(frame["shard"].tolist(), frame["text"].str.len().tolist(), strict=True)):
            if shard != last or chars + size > most:
                held += [frame.iloc[at:i]] * (i > at)
                if held:
                    yield last, pd.concat(held)
                held, chars, at, last = [], 0, i, shard
            chars += size
        held += [frame.iloc[at:]] * (len(frame) > at)
    if held:
        yield last, pd.concat(held)


def count_rows(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """row_counts() over all texts, their number and that of the toxic ones."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, hits = np.zeros((2, 1 + len(_HEADS), _ROWS), np.int64)
        texts = toxic = 0
        for _, block in _blocks(frames):
            y = block["y"].to_numpy()
            more = row_counts(*word_rows(block["text"]), y)
            n += more[0]
            hits += more[1]
            texts += len(y)
            toxic += int(y.sum())
        k, row = np.nonzero(n)
        yield pd.DataFrame({"k": k, "row": row, "n": n[k, row], "hits": hits[k, row]})
        yield pd.DataFrame({"k": [-1], "row": [0], "n": [texts], "hits": [toxic]})

    found = texts.mapInPandas(count, "k int, row int, n long, hits long").groupBy("k", "row").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow()
    k, row, seen, bad = (found[c].to_numpy() for c in ("k", "row", "n", "hits"))
    n, hits = np.zeros((2, 1 + len(_HEADS), _ROWS), np.int64)
    n[k[k >= 0], row[k >= 0]], hits[k[k >= 0], row[k >= 0]] = seen[k >= 0], bad[k >= 0]
    return n, hits, int(seen[k < 0].sum()), int(bad[k < 0].sum())


#: A change travels as a row number, its values and an Adagrad sum in units of 1 / _UNIT, whole numbers, so that sums do not depend on their order. Rows from _ROWS on hold what is not of the table.
_UNIT = 1 << 20
_CHANGE = [f"v{i}" for i in range(_DIMS + 1)]


def _changes(number: int, shipped, toxic: float, batch: int, rate: float, block_chars: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told() -> Iterator[pd.DataFrame]:
            row = np.flatnonzero(own.touched)
            table = np.concatenate([own.net.table[row] - before.net.table[row], (own.table[row] - before.table[row]).mean(axis=1, keepdims=True)], axis=1)
            dense = own.dense() - before.dense()
            dense = np.pad(dense, (0, -len(dense) % len(_CHANGE))).reshape(-1, len(_CHANGE))
            values = np.rint(np.concatenate([table, dense]) * _UNIT).astype(np.int64)
            yield pd.DataFrame({"row": np.concatenate([row, _ROWS + np.arange(len(dense))]).astype(np.int32), **dict(zip(_CHANGE, values.T, strict=True))})

        before, own, last, blocks = shipped.value, None, None, 0
        for shard, block in _blocks(frames, block_chars):
            if shard != last:
                if own is not None:
                    yield from told()
                own, last, blocks = deepcopy(before), shard, 0
            rows, begins = word_rows(block["text"])
            rng = np.random.default_rng([5, number, abs(shard), int(shard < 0), blocks])
            for _ in range(PASSES):
                own.learn(rows, begins, block["y"].to_numpy().astype(np.float32), rng.permutation(len(block)), batch, rate, toxic)
            blocks += 1
        if own is not None:
            yield from told()

    return run


def trained(texts: DataFrame, rounds: int = ROUNDS, batch: int = 32, rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> TextCnn:
    """The network after `rounds` rounds over all the texts (text, y, shard). What comes back from a round is one network, however many texts and shards there are."""
    n, hits, count, bad = count_rows(texts)
    learner = Learner(TextCnn.of_counts(n, hits, count, bad))
    context = texts.sparkSession.sparkContext
    for number in range(rounds):
        shipped = context.broadcast(learner)
        run = _changes(number, shipped, toxic_weight(bad / count), batch, rate, block_chars)
        changes = texts.mapInPandas(run, "row int, " + ", ".join(f"{c} long" for c in _CHANGE))
        mean = changes.groupBy("row").agg(*[(F.sum(c) / F.count(F.lit(1)) / _UNIT).cast("float").alias(c) for c in _CHANGE]).toArrow()
        row = mean["row"].to_numpy()
        values = np.stack([mean[c].to_numpy() for c in _CHANGE], axis=1)
        learner = deepcopy(learner)
        of_table = row < _ROWS
        learner.net.table[row[of_table]] += values[of_table, :_DIMS]
        learner.table[row[of_table]] += values[of_table, _DIMS:]
        dense = np.zeros((int((~of_table).sum()), len(_CHANGE)))
        dense[row[~of_table] - _ROWS] = values[~of_table]
        learner.add_dense(dense.ravel())
        shipped.destroy()
    return learner.net


def raw_logits(net: TextCnn, texts: DataFrame) -> DataFrame:
    """lang, y, raw (the logit before it is scaled) of all the texts."""
    shipped = texts.sparkSession.sparkContext.broadcast(net)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame, chars=400_000):
                yield pd.DataFrame({"lang": part["lang"], "y": part["y"], "raw": shipped.value.logits(*word_rows(part["text"])).astype(float)})

    return stash(texts.select("text", "lang", "y").mapInPandas(run, "lang string, y int, raw double"), "toxicity-logits")


def best_cuts(logits: DataFrame, low: float, high: float) -> list:
    """For all rows (lang null) and for each language: texts, toxic, and the two neighbouring logits `at` and `below` (null: none) between which the cut has the best F1. All rows count, by running sums over their logits."""
    each = logits.withColumn("lang", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), "lang"))))
    values = each.groupBy("lang", "raw").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    values = values.withColumn("bucket", F.floor((F.lit(high) - F.col("raw")) / max(high - low, 1e-9) * 1024)).withColumn("order", -F.col("raw"))
    for value in ("n", "hits"):
        values = running_sum(values, "lang", "bucket", ["order"], value, f"{value}_before")
    totals = each.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("texts"), F.sum("y").alias("toxic"))
    values = values.join(totals, F.col("lang").eqNullSafe(F.col("of")))
    f1 = 2 * (F.col("hits_before") + F.col("hits")) / (F.col("n_before") + F.col("n") + F.greatest(F.lit(1), "toxic"))
    values = stash(values.select("lang", "raw", "texts", "toxic", f1.alias("f1")), "toxicity-cuts")
    best = values.groupBy("lang").agg(F.max(F.struct("f1", "raw")).alias("best"), F.first("texts").alias("texts"), F.first("toxic").alias("toxic"))
    best = best.select(F.col("lang").alias("of"), F.col("best.raw").alias("at"), "texts", "toxic")
    found = values.join(best.select("of", "at"), F.col("lang").eqNullSafe(F.col("of"))).where("raw < at").groupBy(F.col("lang").alias("lower")).agg(F.max("raw").alias("below"))
    return best.join(found, F.col("of").eqNullSafe(F.col("lower")), "left").select(F.col("of").alias("lang"), "texts", "toxic", "at", "below").collect()


def fit(texts: DataFrame) -> tuple[TextCnn, dict[str, float]]:
    """The network, trained on all rows of dealt() whose shard is 0 or more, and, for each language with LEAST_OF_A_LANGUAGE toxic and as many other rows at least among those the network was not trained on, its own threshold on the score (others: CUT)."""
    learned, kept = texts.where("shard >= 0"), texts.where("shard < 0")
    if learned.isEmpty():
        learned, kept = texts, texts.limit(0)
    if learned.isEmpty():
        net = TextCnn.start(*word_rows([""]), np.zeros(1, np.float32))
        net.out[:] = 0
        return net, {}
    net = trained(learned)
    by_language = not kept.isEmpty()
    logits = raw_logits(net, kept if by_language else learned)
    low, high, spread = logits.agg(F.min("raw"), F.max("raw"), F.stddev_pop("raw")).first()
    cuts = {}
    found = {r["lang"]: r for r in best_cuts(logits, low, high)}
    edges = lambda r: (r["at"], r["at"] - 1 if r["below"] is None else r["below"])
    if 0 < found[None]["toxic"] < found[None]["texts"]:
        net.scale = 4.0 / max(float(spread), 1e-3)
        net.shift = float(np.log(CUT / (1 - CUT))) - net.scale * sum(edges(found[None])) / 2
    for lang, r in found.items():
        if lang is not None and by_language and LEAST_OF_A_LANGUAGE <= r["toxic"] <= r["texts"] - LEAST_OF_A_LANGUAGE:
            cut = float(np.mean([1 / (1 + np.exp(-np.clip(net.scale * x + net.shift, -30, 30))) for x in edges(r)]))
            cuts[lang] = min(max(cut, 0.01), 0.99)
    return net, cuts


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= CUT), lang_threshold, predicted_by_lang for every document.

    Null and empty texts are scored as a text without words; a null lang has the common threshold; repeated rows are scored alike; without labels all scores are equal. The trained table (under 10 MB, whatever the input) goes out with the scoring job."""
    net, cuts = fit(dealt(docs, labels))
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shipped.value
        for frame in frames:
            for part in batches(frame, chars=400_000):
                s = model.score(*word_rows(part["text"]))
                own = part["lang"].map(cuts).fillna(CUT).to_numpy(float)
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": s, "predicted": (s >= CUT).astype("int32"), "lang_threshold": own, "predicted_by_lang": (s >= own).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id")).alias("held_out"))
    scored = rows.mapInPandas(score, "doc_id string, held_out boolean, score double, predicted int, lang_threshold double, predicted_by_lang int")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_toxicity_cnn(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
