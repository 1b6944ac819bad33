"""Line dedup, sharding and mixing against brute force, and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import duck_rows, spark_rows
from pyspark.sql import functions as F

from quizmill.llm import line_dedup, mixing, queries, sharding

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def run_lengths(gone):
    out, state = [0], False
    for g in gone:
        if g != state:
            out.append(0)
            state = g
        out[-1] += 1
    return ",".join(map(str, out if state else out[:-1]))


def brute_lines(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 20 and i is not None:
                held[key_of(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(held[key_of(x)]) >= 3 and max(held[key_of(x)]) != i for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), run_lengths(gone)))
    return sorted(map(str, out))


def dedup(docs):
    kept = line_dedup.apply_bitmaps(docs.select("doc_id", "text"), line_dedup.keep_bitmaps(docs, hot_rows=2))
    return sorted(str(tuple(r)) for r in kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256), "keep").collect())


def test_lines_equal_brute_force(spark, docs):
    assert dedup(docs) == brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_lines_case_blanks_and_hot_lines(spark):
    hot = "This line is held by every document"
    rows = [(i, f"own {i} line that nobody else has at all\n \t{hot.upper() if i % 2 else hot}\x0b\r\n{hot}\nÉTÉ ÉTÉ ÉTÉ ÉTÉ ÉTÉ{'é' if i % 2 else 'É'}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dedup(df) == brute_lines(rows)


def test_bitmap_runs(spark):
    df = spark.createDataFrame([([1, 2, 3, 7, 9, 10],), ([0],), ([],), (None,)], "d array<int>")
    assert [r[0] for r in df.select(line_dedup.bitmap(F.col("d"))).collect()] == ["1,3,3,1,1,2", "0,1", "", ""]


def test_line_query_equals_sql(spark, sf):
    q = queries.QUERIES["op4_line_dedup"](spark, sf)
    cols, expected = duck_rows(queries.ORACLE_SQL["op4_line_dedup"], sf)
    assert sorted(q.columns) == cols and spark_rows(q) == expected


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    hot = "a line that three documents hold"
    rows = [(1, f"{hot}\nprecious unrelated second line here"), (1, f"precious first line that nobody has\n{hot}"), (2, hot), (3, hot), (1, f"{hot}\nprecious unrelated second line here")]
    assert dedup(spark.createDataFrame(rows, "doc_id long, text string")) == brute_lines(rows)


def test_a_text_of_very_many_lines(spark):
    import time

    rows = [(i, "\n".join(f"line number {k} of the long document" + (" own" * i if k % 2 else "") for k in range(50_000))) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = dedup(df)
    assert time.time() - began < 60 and got == brute_lines(rows)


def test_lines_odd(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert dedup(odd) == brute_lines(rows)
    assert dedup(none) == []


def test_sharding_moves_only_into_the_new_shard(spark, sf, docs):
    rows = queries.QUERIES["op7_hash_tree_sharding"](spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    assert any(r["grown_shard"] == 16 for r in rows) and {r["shard"] for r in rows} <= set(range(16))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_equals_sql(spark, sf):
    cols, rows = duck_rows(queries.ORACLE_SQL["op7_hash_tree_sharding"], sf)
    assert spark_rows(queries.QUERIES["op7_hash_tree_sharding"](spark, sf)) == rows


def test_slots_of_a_hot_key(spark):
    """Rows of one key and of none get slots from several buckets, gapless together."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 5).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    rows = sharding.shard_rows(df, per_bucket=10).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 3000 and len(slots) <= 2
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_confine_movement(spark):
    root = sharding.tree(16)
    heavy = sharding.node("root", [sharding.node(r.name, [sharding.Node(k.name, k.weight, None, k.children) if (i, j) != (0, 0) else sharding.node(k.name, [sharding.Node(x.name, x.weight * (2 if x.shard == 0 else 1), x.shard) for x in k.children]) for j, k in enumerate(r.children)]) for i, r in enumerate(root.children)])
    df = spark.range(20_000).select(F.col("id").alias("k"))
    both = df.select(sharding.descend(F.col("k"), root).alias("a"), sharding.descend(F.col("k"), heavy).alias("b")).groupBy("a", "b").count().collect()
    counts = Counter()
    for r in both:
        counts[r["a"]] += r["count"]
        # a rack whose weight did not change keeps its rows unless they go to the region or rack that grew
        assert r["a"] == r["b"] or r["b"] in range(0, 8)
        assert not (r["a"] in range(8) and r["b"] in range(8, 16))
    assert all(abs(n - 1250) < 200 for n in counts.values())


def test_sharding_odd(spark, odd, none):
    out = sharding.shard_rows(odd)
    assert out.count() == odd.count()
    assert sharding.shard_rows(none).count() == 0
    rows = sharding.shard_rows(sharding.sizes(odd)).collect()
    assert len(rows) == odd.count() and min(r["size"] for r in rows) == 1


def test_mixing_equals_sql(spark, sf):
    q = queries.QUERIES["op8_source_mixing"](spark, sf)
    cols, expected = duck_rows(queries.ORACLE_SQL["op8_source_mixing"], sf)
    rows = spark_rows(q)
    assert sorted(q.columns) == cols and rows == expected
    assert spark_rows(queries.QUERIES["op8_source_mixing"](spark, sf)) == rows


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= more


def test_mixing_meets_targets(spark, odd, docs):
    for df in (odd, docs.withColumn("source", F.when(F.col("doc_id") < 150, "hot").otherwise(F.col("source")))):
        rows = mixing.taken_words(df, block=16).collect()
        sizes, taken, target = Counter(), Counter(), {}
        for r in rows:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        expected = brute_targets(sizes)
        assert all(abs(target[s] - expected[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1 for s in sizes)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 66, 90, 150, 1000])
def test_permutations(spark, n):
    df = spark.range(n).crossJoin(spark.range(3).withColumnRenamed("id", "e")).select("id", F.concat(F.lit("s:"), F.col("e").cast("string")).alias("seed"), "e").withColumn("keys", mixing.round_keys(F.col("seed")))
    to = df.withColumn("to", mixing.permuted(F.col("id"), F.lit(n), F.col("seed"), F.col("keys")))
    rows = to.withColumn("back", mixing.permuted(F.col("to"), F.lit(n), F.col("seed"), F.col("keys"), inverse=True)).collect()
    assert all(r["back"] == r["id"] for r in rows)
    orders = [[r["to"] for r in sorted(rows, key=lambda r: r["id"]) if r["e"] == e] for e in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    if n >= 50:  # neighbours part, and each epoch has an order of its own
        assert all(sum(abs(a - b) == 1 for a, b in zip(o, o[1:])) <= 8 for o in orders)
        assert sum(a == b for a, b in zip(orders[0], orders[1])) <= 8


def test_draws_are_multinomial(spark):
    plans = spark.createDataFrame([(0, "a", 200_000), (1, None, 64), (2, "c", 0)], "rank long, source string, slots long")
    rows = mixing.shard_counts(plans, 16).collect()
    n = Counter()
    for r in rows:
        n[r["rank"]] += r["n"]
    assert n == {0: 200_000, 1: 64}
    chi = sum((r["n"] - 12_500) ** 2 / 12_500 for r in rows if r["rank"] == 0)
    assert 3 < chi < 40
    assert all(r["begin"] == sum(x["n"] for x in rows if x["rank"] == r["rank"] and x["out_shard"] < r["out_shard"]) for r in rows)


def test_empty_rows_that_repeat_are_rows_of_their_own(spark):
    rows = [(1, "s", ""), (1, "s", ""), (1, "s", None), (None, None, "a b"), (None, None, "a b"), (None, None, "c d e")]
    got = mixing.taken_words(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=2).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 0, 2, 2, 3] and all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_mixed_texts_of_rows_without_ids(spark):
    rows = [(None, "s", "a1 a2 a3"), (None, "s", "b1 b2 b3 b4"), (7, "s", "c1"), (7, "s", "d1 d2"), (8, "t", " ".join(f"e{i}" for i in range(200)))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for block in (1, 2, 64):
        out = mixing.mixed_texts(df.withColumn("k", F.md5("text")), block, key="k").collect()
        for r in out:
            own = next(x[2].split() for x in rows if x[2].split()[0][0] == r["text"].strip()[0])
            assert r["text"].split() == sorted(r["text"].split(), key=own.index) and set(r["text"].split()) <= set(own)


def test_mixed_texts(spark, docs, none):
    out = mixing.mixed_texts(docs, block=64)
    assert out.columns == docs.columns
    words = lambda df: {r[0]: r[1] for r in df.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).collect()}
    target = {r["source"]: r["target"] for r in mixing.source_targets(mixing.token_counts(docs)).collect()}
    got = words(out)
    assert all(abs(got[s] - target[s]) <= 1 for s in target)
    by_shard = {r["out_shard"]: r["n"] for r in mixing.mix_blocks(mixing.token_counts(docs), mixing.source_targets(mixing.token_counts(docs)), 64).where("n > 0").groupBy("out_shard").agg(F.sum("n").alias("n")).collect()}
    listed = Counter()
    for r in mixing.taken_words(docs, block=64).collect():
        for part in filter(None, r["shards"].split(",")):
            listed[int(part.split(":")[0])] += int(part.split(":")[1])
    assert listed == by_shard and len(by_shard) > 32
    assert mixing.mixed_texts(none).count() == 0
    assert mixing.taken_words(none).count() == 0
