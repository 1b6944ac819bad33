"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Copies (equal word sequences) are one class before anything is compared. MinHash bands bring candidates together; pairs are compared a few MinHash values at a time and dropped when the posterior probability that they reach the threshold is below a tolerance; the rest is verified exactly on the whole shingle sets.

No step writes all pairs of a group: candidate pairs live inside a task (blocks of a bounded number of documents and bytes), and what leaves it is a spanning forest and each document's number of links. A text moves once, to be written as its set's difference from one member of its group; only signatures and differences meet in pairs of blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import Tokens, batches, shingles, stash, text_of

WIDTH = 5
THRESHOLD = Fraction(4, 5)
#: 32 bands of 5 values: two sets of Jaccard 0.8 share no band with probability 3e-6.
BANDS, ROWS = 32, 5
_VALUES = BANDS * ROWS
#: A pair is dropped when its chance of reaching the threshold is below this.
TOLERANCE = 1e-4
_STEP = 32
#: Documents of one block, and bytes of set differences; a larger group is cut into blocks, and pairs of blocks are tasks' work.
BLOCK, BLOCK_BYTES = 512, 1 << 23

_RNG = np.random.default_rng(23)
_MULTIPLY = _RNG.integers(0, 1 << 31, _VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, _VALUES, dtype=np.uint32)


def minhashes(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """_VALUES MinHash values of each shingle set; all ones for an empty set."""
    n = len(begins) - 1
    out = np.full((n, _VALUES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(begins))
    if len(some):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(_VALUES):
            out[some, i] = np.minimum.reduceat(x * _MULTIPLY[i] + _ADD[i], begins[some])
    return out


def least_matches(threshold: float = float(THRESHOLD), tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values: the least number of equal ones with P(Jaccard >= threshold | equal) >= tolerance, under a uniform prior (a Beta posterior)."""

    def chance(m: int, n: int) -> float:
        # 1 - I_t(m + 1, n - m + 1), a binomial tail
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return {n: next(m for m in range(n + 1) if chance(m, n) >= tolerance) for n in range(_STEP, _VALUES + 1, _STEP)}


def _sign(keep: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame, chars=400_000):
                t = Tokens(list(part["text"]))
                values = minhashes(*shingles(t, WIDTH))
                keys = [np.frombuffer(hashlib.blake2b(t.hashes[a:b].tobytes(), digest_size=16).digest(), np.int64) for a, b in zip(t.starts[:-1], t.starts[1:], strict=True)]
                yield pd.DataFrame({"doc_id": part["doc_id"], "tie": part["tie"], "k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "words": t.counts, "signature": [v.tobytes() for v in values], **{c: part[c] for c in keep}})

    return run


def signatures(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, tie (hash of the text), k1, k2 (128 bits of the word sequence), words, signature, and the string columns `keep` of docs."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text_of()).alias("tie"), F.col("text").cast("string").alias("text"), *keep)
    more = "".join(f", `{c}` string" for c in keep)
    signed = rows.mapInPandas(_sign(list(keep)), f"doc_id string, tie long, k1 long, k2 long, words long, signature binary{more}")
    return stash(signed.withColumn("doc_id", F.col("doc_id").cast("long")), "signatures")


def word_classes(signed: DataFrame) -> DataFrame:
    """A row for each word sequence: k1, k2, copy_of (its least doc_id), n_copies, words, signature, holder (doc_id and tie of one of its rows) and a number of its own, id."""
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("holder")
    found = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), holder, F.max("words").alias("words"), F.max("signature").alias("signature"))
    return stash(found.withColumn("id", F.monotonically_increasing_id()), "word-classes")


def _band_keys() -> Column:
    return F.array(*[F.xxhash64(F.lit(b), F.substring("signature", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)])


def _blocks(members: DataFrame, group: str, most_bytes: int | None = None) -> DataFrame:
    """`members` (group, id, and bytes if most_bytes is given) with own, lo, hi: every two members of a group meet in one pair of blocks (or are in the same block). A group of at most BLOCK members (and most_bytes) is one block; its size is counted with a partial aggregation and written, so that both sides of the join are shuffles of their own and a hot group can be split."""
    n = F.ceil(F.count("*") / BLOCK)
    if most_bytes:
        n = F.greatest(n, F.ceil(F.sum("bytes") / most_bytes))
    sizes = stash(members.groupBy(group).agg(F.count("*").alias("_n"), n.cast("int").alias("_blocks")).where(F.col("_n") > 1), "sizes")
    counted = members.join(sizes.hint("merge"), group)
    own = F.pmod(F.xxhash64("id"), "_blocks").cast("int")
    paired = counted.select(group, "id", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return paired.select(group, "id", F.col("_own").alias("own"), F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"))


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if frame.empty:
            continue
        values = [frame[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        edges = [0, *change.tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield frame.iloc[a:b]
        held = frame.iloc[edges[-1] :]
    if held is not None and len(held):
        yield held


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def surviving_pairs(values: np.ndarray, own: np.ndarray, least: dict[int, int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of the one block, or across the two) that are left after the incremental comparison."""
    a, b = np.triu_indices(len(values), 1)
    if not same:
        across = own[a] != own[b]
        a, b = a[across], b[across]
    equal = np.zeros(len(a), np.int32)
    for n in range(_STEP, _VALUES + 1, _STEP):
        for at in range(0, len(a), 65536):
            s = slice(at, at + 65536)
            equal[s] += (values[a[s], n - _STEP : n] == values[b[s], n - _STEP : n]).sum(axis=1)
        stay = equal >= least[n]
        a, b, equal = a[stay], b[stay], equal[stay]
    return a, b


def _signature_rows(g: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(g["signature"]), np.uint32).reshape(len(g), _VALUES)


def _prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    least, out = least_matches(), []
    for g in _groups(frames, ["list"]):
        g = g.drop_duplicates("id")
        if len(g) < 2:
            continue
        ids, own = g["id"].to_numpy(), g["own"].to_numpy()
        a, b = surviving_pairs(_signature_rows(g), own, least, bool((own == own[0]).all()))
        if len(a):
            label = forest(len(ids), a, b)
            star = np.flatnonzero(label != np.arange(len(ids)))
            out.append(pd.DataFrame({"a": ids[label[star]], "b": ids[star]}))
        if len(out) >= 2000:
            yield pd.concat(out)
            out = []
    yield pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Spanning edges (a, b) of the pairs that the incremental comparison leaves.

    Bands with the same members (near copies share most bands) are compared once."""
    members = classes.where("words > 0").select("id", F.explode(_band_keys()).alias("band"))
    lists = _blocks(members, "band").groupBy("band", "lo", "hi").agg(F.sort_array(F.collect_set(F.struct("id", "own"))).alias("members")).select("members").distinct()
    rows = lists.select(F.xxhash64("members").alias("list"), F.explode("members").alias("m")).select("list", "m.id", "m.own")
    signed_rows = rows.join(classes.select("id", "signature").hint("merge"), "id")
    return stash(signed_rows.repartition("list").sortWithinPartitions("list").mapInPandas(_prune, "a long, b long").distinct(), "candidate-edges")


def components(edges: DataFrame) -> DataFrame:
    """(id, component: its least id) of the nodes of the edges (a, b), by alternating large and small stars, which shrink every component to a star in a few rounds."""
    current = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large, "large")
        down = stash(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        following = stash(small, "stars")
        check = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if check(following) == check(current):
            leaves = following.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return leaves.unionByName(following.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        current = following


def _shingle_sets(texts) -> list[np.ndarray]:
    h, begins = shingles(Tokens(list(texts)), WIDTH)
    return [np.unique(h[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def _differences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (component, part) with the part's copy of the pivot first: the members' sets as sorted differences from the pivot's. Only the pivot's set is held."""
    group, pivot = None, np.zeros(0, np.uint64)
    for frame in frames:
        for part in batches(frame, chars=400_000):
            out = []
            for component, place, head, member, i, own in zip(part["component"], part["part"], part["head"], part["member"], part["id"], _shingle_sets(part["text"]), strict=True):
                if head == 0:
                    group, pivot = (component, place), own
                elif group != (component, place):
                    raise ValueError(f"component {component} has no pivot in part {place}")
                if member:
                    out.append((component, i, len(own), len(pivot), np.setxor1d(own, pivot, assume_unique=True).tobytes()))
            yield pd.DataFrame(out, columns=["component", "id", "size", "pivot", "difference"])


def set_differences(docs: DataFrame, classes: DataFrame, candidates: DataFrame, repeats: bool = True) -> DataFrame:
    """component, id, size (of the shingle set), pivot (size of the pivot's) and difference (hashes that only one of the two has) of the candidates. The pivot of a component is its least id; its text goes to every part of the component, every other text to one. `repeats`: rows of docs may be equal in both doc_id and text; they are made one, with a partial aggregation."""
    sizes = stash(candidates.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "component-sizes")
    placed = candidates.join(sizes.hint("merge"), "component").withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    goes = F.when(F.col("id") == F.col("component"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    held = stash(placed.join(classes.select("id", "holder").hint("merge"), "id").select("component", "id", "own", goes.alias("goes"), F.col("holder.doc_id").alias("_doc"), F.col("holder.tie").alias("_tie")), "holders")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    joined = texts.join(held.hint("merge"), (F.xxhash64("text") == F.col("_tie")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    if repeats:
        joined = joined.groupBy("component", "id", "own").agg(F.max("text").alias("text"), F.max("goes").alias("goes"))
    rows = joined.select("component", "id", "own", "text", F.explode("goes").alias("part"))
    rows = rows.select("component", "part", F.when(F.col("id") == F.col("component"), 0).otherwise(1).alias("head"), (F.col("part") == F.col("own")).alias("member"), "id", "text")
    ordered = rows.repartition("component", "part").sortWithinPartitions("component", "part", "head")
    return stash(ordered.mapInPandas(_differences, "component long, id long, size long, pivot long, difference binary"), "differences")


def exact_links(g: pd.DataFrame, a: np.ndarray, b: np.ndarray, threshold: Fraction = THRESHOLD, most: int = 4_000_000) -> np.ndarray:
    """Which of the pairs (a, b) of rows of one component reach the threshold. Sets A, B that differ from the pivot P by D, E have |P| - |P \\ A| - |P \\ B| + |D and E| shingles in common, so only elements of differences that two rows at least share are looked up."""
    size, pivot = g["size"].to_numpy(np.int64), g["pivot"].to_numpy(np.int64)
    parts = [np.frombuffer(x, np.uint64) for x in g["difference"]]
    n = np.array([len(x) for x in parts], np.int64)
    gone = (pivot - size + n) // 2
    values, code, held = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = held[code] > 1
    owner = np.repeat(np.arange(len(parts)), n)[shared]
    code = code[shared].astype(np.int64)
    keys = owner * np.int64(len(values) + 1) + code  # ascending: rows in order, elements in order
    counts = np.bincount(owner, minlength=len(parts))
    starts = np.concatenate([[0], np.cumsum(counts)])
    few = np.where(counts[a] <= counts[b], a, b)
    other = a + b - few
    common, total, at = np.zeros(len(a), np.int64), np.cumsum(counts[few]), 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        m = counts[few[at:end]]
        which = np.repeat(np.arange(at, end), m)
        place = np.repeat(starts[few[at:end]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(len(which))
        wanted = other[which] * np.int64(len(values) + 1) + code[place]
        found = keys[np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))] == wanted if len(keys) else np.zeros(0, bool)
        common[at:end] = np.bincount(which[found] - at, minlength=end - at)
        at = end
    inter = pivot[a] - gone[a] - gone[b] + common
    return threshold.denominator * inter >= threshold.numerator * (size[a] + size[b] - inter)


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    least, out = least_matches(), []
    for g in _groups(frames, ["component", "lo", "hi"]):
        g = g.drop_duplicates("id").sort_values("id")
        if len(g) < 2:
            continue
        ids, own = g["id"].to_numpy(), g["own"].to_numpy()
        a, b = surviving_pairs(_signature_rows(g), own, least, bool(g["lo"].iloc[0] == g["hi"].iloc[0]))
        near = exact_links(g, a, b)
        a, b = a[near], b[near]
        if len(a):
            links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            some = np.flatnonzero(links)
            out.append(pd.DataFrame({"id": ids[some], "leader": ids[forest(len(ids), a, b)[some]], "links": links[some]}))
        if len(out) >= 500:
            yield pd.concat(out)
            out = []
    yield pd.concat(out) if out else pd.DataFrame({"id": np.zeros(0, np.int64), "leader": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})


def verified_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, repeats: bool = True) -> DataFrame:
    """(id, leader, links): per pair of blocks of a candidate component, a class's exact links in it and the least class it is connected to. Pairs that the incremental comparison drops are not verified."""
    sets = set_differences(docs, classes, candidates, repeats)
    blocked = _blocks(sets.select("component", "id", F.octet_length("difference").alias("bytes")), "component", BLOCK_BYTES)
    rows = blocked.join(stash(sets.drop("component").join(classes.select("id", "signature").hint("merge"), "id"), "verified-sets").hint("merge"), "id")
    ordered = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return stash(ordered.mapInPandas(_verify, "id long, leader long, links long"), "verified")


def near_classes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, class_id (the least doc_id it is linked to, directly or through others), copy_of (the least doc_id with the same words), n_copies (documents with the same words, itself included), n_links (other word sequences at Jaccard 0.8 or more), group (a number of the class that also classes without ids have), tie (hash of the text) and the string columns `keep` of docs.

    Words are runs of other than ASCII blanks, A-Z as a-z. A text of fewer than five words is one shingle; a text without words is linked to nothing but is a copy of its like. Rows that repeat a doc_id count as copies; a null doc_id is never the least, so class_id is null where no member has an id."""
    signed = signatures(docs, keep)
    classes = word_classes(signed)
    repeats = not signed.groupBy("doc_id", "tie").count().where("count > 1").isEmpty()
    links = verified_links(docs, classes, components(candidate_edges(classes)), repeats)
    joined = components(links.select(F.col("leader").alias("a"), F.col("id").alias("b")))
    counts = stash(links.groupBy("id").agg(F.sum("links").alias("n_links")).join(joined.hint("merge"), "id"), "link-counts")
    known = classes.select("k1", "k2", "copy_of", "n_copies", "id").join(counts.hint("merge"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    known = stash(known.select("k1", "k2", "copy_of", "n_copies", "group", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "known-classes")
    least = stash(known.groupBy("group").agg(F.min("copy_of").alias("class_id")), "least-ids")
    every = stash(known.join(least.hint("merge"), "group"), "near-classes")
    found = signed.select("doc_id", "tie", "k1", "k2", *keep).join(every.hint("merge"), ["k1", "k2"])
    return found.select("doc_id", "class_id", "copy_of", "n_copies", "n_links", "group", "tie", *keep)


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("group", "tie")
