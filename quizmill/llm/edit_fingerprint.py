"""Randomised edit embedding: fingerprints whose Hamming likeness follows edit distance.

A shared random walk reads the characters of a text (ASCII as they are, others hashed to 128 symbols): at step j it emits the symbol it stands on and moves on if r_j(symbol) is 1. Texts that differ by few edits fall into step again after each one, so their step strings agree almost everywhere. Fingerprints sample bits of the step string at shared positions; bands of those bits find candidates, and the whole fingerprints verify them."""

from __future__ import annotations

import hashlib
import itertools
import math
import operator
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm import ngram_join
from quizmill.llm.common import packed, stash, text_of, unpacked

#: Steps after which the walk's random bits r_j repeat.
PERIOD = 1024
SAMPLES = 256
#: Likeness from which two fingerprints are linked, and the chance that the bands miss a pair at it.
THRESHOLD = 0.8
MISS = 0.02
_LEAST_LEVEL = 4
#: A fingerprint has bits of its own level and of four below, to be compared with shorter texts: all samples of the first two, then each second and each fourth.
STRIDES = (1, 1, 2, 4, 4)


class _Walk:
    """The walk as an automaton: states[j][byte] is the state (itself a list) in which the next byte is read; states[j][256] is j."""

    def __init__(self):
        rng = np.random.default_rng(7)
        bits = rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
        bits[0] = 1
        leave = np.zeros((PERIOD, 256), np.int64)  # the step at or after j at which the byte is left
        upcoming = np.full(256, PERIOD)
        for j in range(PERIOD - 1, -1, -1):
            upcoming = np.where(bits[j] == 1, j, upcoming)
            leave[j] = upcoming
        self.states: list[list] = [[] for _ in range(PERIOD)]
        for j in range(PERIOD):
            self.states[j] += [self.states[k] for k in ((leave[j] + 1) % PERIOD).tolist()] + [j]
        self.where = np.sort(rng.random(SAMPLES))
        self.bit = rng.integers(0, 2, (SAMPLES, 257), dtype=np.uint8)

    def run(self, data: bytes, state: int = 0) -> np.ndarray:
        """The state before each byte and after the last."""
        return np.fromiter(map(operator.itemgetter(256), accumulate(data, operator.getitem, initial=self.states[state])), np.int16, len(data) + 1)


_WALK: list[_Walk] = []


def _walk() -> _Walk:
    if not _WALK:
        _WALK.append(_Walk())
    return _WALK[0]


def fingerprint(data: bytes, states: np.ndarray) -> str:
    """steps:level:bits:... in hex: sampled bits of the first 2^level steps and, by STRIDES, of the first 2^(level-1), 2^(level-2), ...; level is the least with 2^level >= steps."""
    w = _walk()
    jumps = np.diff(states.astype(np.int32)) % PERIOD
    jumps[jumps == 0] = PERIOD
    ends = np.cumsum(jumps, dtype=np.int64)
    steps = int(ends[-1]) if len(ends) else 0
    level = max(_LEAST_LEVEL, (max(steps, 1) - 1).bit_length())
    read = np.frombuffer(data, np.uint8)
    out = [f"{steps:x}", f"{level:x}"]
    for below, stride in enumerate(STRIDES):
        at = (w.where[::stride] * (1 << (level - below))).astype(np.int64)
        symbol = np.full(len(at), 256)
        inside = at < steps
        symbol[inside] = read[np.searchsorted(ends, at[inside], side="right")]
        out.append(np.packbits(w.bit[np.arange(0, SAMPLES, stride), symbol]).tobytes().hex())
    return ":".join(out)


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of steps that agree, of those of the longer text. Bits agree by chance half the time, which is taken off. Both are compared on the shorter text's level, so the likeness of a text and a longer one that begins with it falls as the other grows; it is 0 where the longer one has more than 16 times the steps and so less than a sixteenth in common."""
    if a == b:
        return 1.0
    (sa, la, *ha), (sb, lb, *hb) = a.split(":"), b.split(":")
    sa, la, sb, lb = int(sa, 16), int(la, 16), int(sb, 16), int(lb, 16)
    level, apart = min(la, lb), abs(la - lb)
    if apart >= len(STRIDES) or not min(sa, sb):
        return 0.0
    stride = STRIDES[apart]
    at = (_walk().where[::stride] * (1 << level)).astype(np.int64)
    bits = [np.unpackbits(np.frombuffer(bytes.fromhex(h[lv - level]), np.uint8))[:: stride if lv == level else 1] for h, lv in ((ha, la), (hb, lb))]
    either, both = at < max(sa, sb), at < min(sa, sb)
    if not either.any():
        return 0.0
    same = int((bits[0][both] == bits[1][both]).sum())
    share = max(0.0, (2 * same - int(both.sum())) / int(either.sum()))
    return min(1.0, share * min(1 << level, max(sa, sb)) / max(sa, sb))


def symbols(text: str) -> bytes:
    """A byte for each character: ASCII as it is, others hashed to 128 .. 255."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, 128 + (points * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8).tobytes()


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


class _Doc:
    """A document with its walk, until the next document is known."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        data = symbols(text)
        self.states = _walk().run(data)
        self.print = fingerprint(data, self.states)

    def row(self, following: str, next_print: str) -> tuple:
        edited = edited_text(self.text, following)
        data, kept = symbols(edited), len(self.text) - len(self.text) // 3
        states = np.concatenate([self.states[:kept], _walk().run(data[kept:], int(self.states[kept]))])  # the walk of the kept part is the same
        print_ = fingerprint(data, states)
        return (self.doc_id, len(self.text), hashlib.sha256(edited.encode()).hexdigest(), self.print, print_, likeness(self.print, print_), likeness(self.print, next_print))


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order: each is finished when the next one comes. The first and the last of a partition go out with their texts and the partition's number, to meet their neighbours."""
    last, columns, part = None, [*_COLUMNS, "edge", "part", "packed"], TaskContext.get().partitionId()
    edge = lambda doc, which: (doc.doc_id, len(doc.text), None, doc.print, None, None, None, which, part, zlib.compress(doc.text.encode(), 1))
    frame_of = lambda rows: pd.DataFrame(rows, columns=columns).astype({"edge": "Int32", "part": "Int32"})
    rows = []
    for frame in frames:
        for doc_id, data in zip(frame["doc_id"], frame["packed"], strict=True):
            doc = _Doc(doc_id, unpacked(data))
            rows.append(edge(doc, 0) if last is None else (*last.row(doc.text, doc.print), None, None, None))
            last = doc
            if len(rows) == 1000:
                yield frame_of(rows)
                rows = []
    if last is not None:
        yield frame_of([*rows, edge(last, 1)])


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([_Doc(r.doc_id, unpacked(r.packed)).row(unpacked(r.next_packed), r.next_print) for r in frame.itertuples()], columns=_COLUMNS)


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited form, with their likeness and that of the next document in descending doc_id (after the last: the first).

    Texts are packed, range-partitioned by doc_id and tie once, so that rows without id fill many partitions, and streamed in order; the two edges of each partition (as many rows as partitions, not documents) are matched afterwards: partition numbers find the next partition that has rows, texts are joined by them. A null text is empty; null ids come last; rows with equal ids are ordered by a hash of the text; a lone document is its own next."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text_of()).alias("tie"), text_of().alias("text"))
    order = F.col("_id").desc_nulls_last()
    ranged = packed(rows).withColumn("_id", F.col("doc_id").cast("long")).repartitionByRange(order, "tie").sortWithinPartitions(order, "tie")
    done = stash(ranged.mapInPandas(_neighbours, f"{_SCHEMA}, edge int, part int, packed binary"), "edit-prints")
    # the partitions' order is the order of ids and ties; the list of partitions is all that this window sees
    parts = done.where("edge = 0").select("part")
    follow = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("_next"))
    firsts = done.where("edge = 0").select(F.col("part").alias("_next"), F.col("packed").alias("next_packed"), F.col("fingerprint").alias("next_print"))
    lasts = done.where("edge = 1").select("doc_id", "packed", "part").join(follow, "part").join(firsts.hint("merge"), "_next").select("doc_id", "packed", "next_packed", "next_print")
    every = done.where(F.col("edge").isNull()).select(*_COLUMNS).unionByName(lasts.mapInPandas(_finish, _SCHEMA))
    return every.withColumn("doc_id", F.col("doc_id").cast("long"))


def band_width(classes: int) -> tuple[int, int]:
    """Bits of a band and number of bands. Bits grow with the number of classes, so that unrelated texts seldom share a band; of two texts at the threshold, whose bits agree nine times in ten, no band is shared with a probability of at most MISS."""
    bits = max(16, (max(classes, 1) - 1).bit_length() + 2)
    return bits, math.ceil(math.log(MISS) / math.log(1 - ((1 + THRESHOLD) / 2) ** bits))


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        parts = [f.split(":") for f in frame["fingerprint"]]
        yield pd.DataFrame({"id": frame["id"], "steps": [int(p[0], 16) for p in parts], "level": [int(p[1], 16) for p in parts], "bits": [bytes.fromhex(p[2] + p[3]) for p in parts]})


def _packed(column: pd.Series) -> np.ndarray:
    """n x 2 x 32 bytes: the bits of the own level and of the one below."""
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 2, SAMPLES // 8)


def _band_rows(bits: int, count: int):
    rng = np.random.default_rng(11)
    at = np.stack([rng.choice(SAMPLES, bits, replace=False) for _ in range(count)])
    power = np.int64(1) << np.arange(bits, dtype=np.int64)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 1000):
                part = frame.iloc[k : k + 1000]
                both, level, steps = np.unpackbits(_packed(part["bits"]), axis=2), part["level"].to_numpy(np.int64), part["steps"].to_numpy()
                for low in (0, 1):
                    # a text of the level below has at most 2^(level-1) steps, so only texts near to that can be like it
                    some = np.flatnonzero((steps > 0) & ((low == 0) | (steps * THRESHOLD <= (np.int64(1) << (level - 1)))))
                    value = (both[some, low][:, at] * power).sum(axis=2)
                    key = ((level[some, None] - low) << 8 | np.arange(count)) << bits | value
                    yield pd.DataFrame({"band": key.ravel(), "id": np.repeat(part["id"].to_numpy()[some], count)})

    return rows


def _whole(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that hold whole runs of equal keys, from batches sorted by them, and where each run begins."""
    held = None
    for frame in itertools.chain(frames, [None]):
        if frame is not None:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if held is None or held.empty:
            continue
        values = [held[k].to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        if frame is None:
            yield held, np.concatenate([[0], edges])
        elif len(edges):
            yield held.iloc[: edges[-1]].reset_index(drop=True), np.concatenate([[0], edges[:-1]])
            held = held.iloc[edges[-1] :].reset_index(drop=True)


def _buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of each band with more than one, in blocks."""
    for frame, begins in _whole(frames, ["band"]):
        out, ids, bands = [], frame["id"].to_numpy(), frame["band"].to_numpy()
        ends = np.append(begins[1:], len(frame))
        some = np.flatnonzero(ends - begins > 1)
        for a, b in zip(begins[some].tolist(), ends[some].tolist(), strict=True):
            n = -(-(b - a) // ngram_join.BLOCK)
            out += [(bands[a], i, n, ids[a + i : b : n]) for i in range(n)]
        yield pd.DataFrame(out, columns=["band", "own", "n", "ids"])


def _near(steps: np.ndarray, level: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether likeness() of rows a and b, whose fingerprints differ, is at least THRESHOLD."""
    where = _walk().where
    held = np.zeros((len(steps), 2), np.int64)  # the sampled positions inside the steps; `where` ascends, so they come first
    for lv in np.unique(level):
        rows = level == lv
        for low in (0, 1):
            held[rows, low] = np.searchsorted((where * (1 << int(lv - low))).astype(np.int64), steps[rows])
    lv = np.minimum(level[a], level[b])
    la, lb = level[a] - lv, level[b] - lv
    ok = (la <= 1) & (lb <= 1) & (steps[a] > 0) & (steps[b] > 0)
    la, lb = np.minimum(la, 1), np.minimum(lb, 1)
    both, either = np.minimum(held[a, la], held[b, lb]), np.maximum(held[a, la], held[b, lb])
    longer = np.maximum(steps[a], steps[b])
    differ = np.bitwise_count((bits[a, la] ^ bits[b, lb]) & _FIRST[both]).sum(axis=1, dtype=np.int64)
    share = np.maximum(0.0, (both - 2 * differ) / np.maximum(either, 1))
    like = np.minimum(1.0, share * np.minimum(np.int64(1) << lv, longer) / np.maximum(longer, 1))
    return ok & (either > 0) & (like >= THRESHOLD)


#: Row n: the first n bits set.
_FIRST = np.packbits(np.arange(SAMPLES) < np.arange(SAMPLES + 1)[:, None], axis=1)
_PAIRS = 200_000


def like_pairs(frame: pd.DataFrame, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of rows of one run whose likeness is at least THRESHOLD."""
    steps, level, bits = frame["steps"].to_numpy(), frame["level"].to_numpy(np.int64), _packed(frame["bits"])
    ends = np.repeat(np.append(begins[1:], len(frame)), np.diff(np.append(begins, len(frame))))
    partners = ends - np.arange(len(frame)) - 1
    total, at = np.cumsum(partners), 0
    while at < len(frame):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
        n = partners[at:end]
        lo, hi = at, min(len(frame), int(ends[at:end].max()))
        a = np.repeat(np.arange(at, end), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = _near(steps[lo:hi], level[lo:hi], bits[lo:hi], a - lo, b - lo)
        yield a[near], b[near]
        at = end


def _linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning edges of the links inside each list."""
    for frame, begins in _whole(frames, ["list"]):
        ids = frame["id"].to_numpy()
        pairs = list(like_pairs(frame, begins))
        label = ngram_join.forest(len(ids), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        star = np.flatnonzero(label != np.arange(len(ids)))
        yield pd.DataFrame({"a": ids[label[star]], "b": ids[star]}).drop_duplicates()


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The number of links of each member inside a block of its component or across two."""
    for frame, begins in _whole(frames, ["component", "lo", "hi"]):
        own, links = frame["own"].to_numpy(), np.zeros(len(frame), np.int64)
        same = (frame["lo"] == frame["hi"]).to_numpy()
        for a, b in like_pairs(frame, begins):
            counts = same[a] | (own[a] != own[b])
            links += np.bincount(a[counts], minlength=len(frame)) + np.bincount(b[counts], minlength=len(frame))
        yield pd.DataFrame({"component": frame["component"].to_numpy(), "id": frame["id"].to_numpy(), "links": links})


def print_classes(prints: DataFrame) -> DataFrame:
    """fingerprint, leader, class_id, n_links: a row for each distinct fingerprint. leader is the least doc_id that has it, class_id the least of all that are linked to it, directly or through others; n_links counts the other fingerprints of likeness THRESHOLD or more. Ids are null where only rows without doc_id have it.

    Bands of sampled bits bring fingerprints together, and all members of a band are compared, in pairs of bounded blocks inside tasks; then all members of a component are, so its link counts are exact. A pair at the threshold that no other text connects is missed with probability MISS, one at 0.9 with less than 1e-7."""
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("leader"))
    classes = stash(distinct.withColumn("id", F.monotonically_increasing_id()), "print-classes")
    signed = stash(classes.select("id", "fingerprint").mapInPandas(_pack, "id long, steps long, level int, bits binary"), "print-bits")
    members = signed.mapInPandas(_band_rows(*band_width(signed.count())), "band long, id long").repartition("band").sortWithinPartitions("band", "id")
    buckets = stash(members.mapInPandas(_buckets, "band long, own int, n int, ids array<long>"), "print-buckets")
    paired = buckets.where("n > 1").select("band", "own", "ids", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_other"))
    paired = paired.groupBy("band", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi")).agg(F.array_sort(F.flatten(F.collect_set("ids"))).alias("ids"))
    lists = buckets.where("n = 1").select("ids").unionByName(paired.select("ids")).distinct()
    rows = lists.select(F.xxhash64("ids").alias("list"), F.explode("ids").alias("id")).join(signed.hint("merge"), "id")
    edges = stash(rows.repartition("list").sortWithinPartitions("list").mapInPandas(_linked, "a long, b long").distinct(), "print-edges")
    linked = stash(ngram_join.components(edges), "print-components")
    blocked = ngram_join._blocks(linked, "component").join(signed.hint("merge"), "id").repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    counts = blocked.mapInPandas(_counted, "component long, id long, links long").groupBy("component", "id").agg(F.sum("links").alias("n_links"))
    known = stash(classes.select("id", "leader").join(counts.hint("merge"), "id"), "print-links")
    least = known.groupBy("component").agg(F.min("leader").alias("class_id"))
    found = known.select("id", "component", "n_links").join(least.hint("merge"), "component").select("id", "class_id", "n_links")
    every = classes.join(found.hint("merge"), "id", "left")
    return every.select("fingerprint", "leader", F.coalesce("class_id", "leader").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def with_classes(prints: DataFrame) -> DataFrame:
    """`prints` with class_id and n_links of print_classes."""
    return prints.join(print_classes(prints).drop("leader").hint("merge"), "fingerprint").select(*prints.columns, "class_id", "n_links")


def near_links(prints: DataFrame) -> DataFrame:
    """(doc_id, leader, n_links): documents that are linked, directly or through others, to one of a lesser doc_id; leader is the least."""
    return with_classes(prints).where("doc_id <> class_id").select("doc_id", F.col("class_id").alias("leader"), "n_links")


def op6_edit_fingerprint(spark, sf_dir: str) -> DataFrame:
    return with_classes(edit_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
