"""Importance resampling, toxicity, decontamination, n-gram join."""

import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quizmill.llm import common, decontaminate, importance, ngram_join, queries, toxicity


def test_tokens_equal_plain_ones():
    texts = ["One two,three  ++x", None, "", "É\tone\n\x0btwo", "a" * 1_200_000 + " b", " ".join(f"w{i}" for i in range(200_000))]
    for kw, split in ((dict(), lambda t: t.split()), (dict(lower=False), lambda t: t.split())):
        t = common.Tokens(texts, **kw)
        plain = [[w for w in split("".join(c.lower() if kw.get("lower", True) and "A" <= c <= "Z" else c for c in (x or "")))] for x in texts]
        assert t.counts.tolist() == [len(p) for p in plain]
        ids = {}
        flat = [w for p in plain for w in p]
        assert all(ids.setdefault(w, h) == h for w, h in zip(flat, t.hashes.tolist(), strict=True)) and len(set(ids.values())) == len(ids)
    assert common.Tokens(["a!!b  ?c"], punct=True).counts.tolist() == [5]
    assert common.Tokens(["a!!b  ?c"], words=True).counts.tolist() == [3]


def test_shingles_are_sets_of_runs():
    t = common.Tokens(["a b c d e f", "a b", "", "a b c d e"])
    h, begins = common.shingles(t, 5)
    assert np.diff(begins).tolist() == [2, 1, 0, 1] and h[0] == h[3] and h[0] != h[2]


def test_importance_against_labels(spark):
    """On the ten times larger table: the smallest has eleven rows labelled bad, of which one more or less would decide."""
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.QUERIES["op2_importance_resampling"](spark, sf).collect()}
    known = [(r["quality"], rows[r["doc_id"]]["selected"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good, bad = (float(np.mean([s for q, s in known if q == x])) for x in (1, 0))
    assert good > 0.97 and bad < 0.2


def test_importance_weights_equal_brute_force(spark, docs, labels):
    scored = {r["doc_id"]: r for r in importance.log_weights(docs, labels).collect()}
    quality = {r["doc_id"]: r["quality"] for r in importance.labelled_sample(labels).collect()}
    grams = {r["doc_id"]: Counter(importance.ngram_buckets([r["text"]])[0].tolist()) for r in docs.collect()}
    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for i, c in grams.items():
        for b, n in c.items():
            raw[b] += n
            target[b] += n * (quality.get(i) == 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, c in grams.items():
        assert abs(scored[i]["log_weight"] - sum(ratio[b] * n for b, n in c.items())) < 1e-6 and scored[i]["n_grams"] == sum(c.values())


def test_top_k(spark):
    rows = [(i, float(v)) for i, v in enumerate([5, 5, 5, 1, 9, -9e9, 9e9, 5.01])]
    df = spark.createDataFrame(rows, "doc_id long, k double")
    for k in range(len(rows) + 2):
        got = {r["doc_id"] for r in importance.top_k(df, "k", k).where("selected").collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_top_k_narrows_bins_and_breaks_ties(spark, monkeypatch):
    monkeypatch.setattr(importance, "SORTED_ROWS", 20)
    monkeypatch.setattr(importance, "BINS", 8)
    rng = random.Random(8)
    values = [rng.gauss(0, 1) for _ in range(500)] + [1e6, -1e6] + [0.25] * 40
    rows = [(i if i % 50 else None, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, k double")
    ordered = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
    for k in (1, 2, 77, 200, 220, 499, 541):
        last = ordered[k - 1]
        wanted = [r for r in ordered if r in ordered[:k] or r == last]
        got = [tuple(r) for r in importance.top_k(df, "k", k).where("selected").select("doc_id", "k").collect()]
        assert sorted(got, key=str) == sorted(wanted, key=str)


def test_gumbel_samples_by_weight(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, np.log(3.0)).otherwise(0.0).alias("w"))
    top = importance.top_k(df.withColumn("k", F.col("w") + importance.gumbel(F.col("doc_id"))), "k", 1000).where("selected")
    even = top.where("doc_id % 2 = 0").count()
    assert 690 < even < 800


def test_importance_odd(spark, odd, none, labels):
    assert importance.resample(odd, labels).count() == odd.count()
    assert importance.resample(none, labels).count() == 0
    assert importance.resample(odd, labels.limit(0)).where("selected").count() == odd.count()


def planted(spark, n=600):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    rows, marks = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        if bad:
            t.insert(rng.randrange(len(t)), rng.choice(["vilex", "nastyo"]))
        rows.append((i, " ".join(t), "en" if i % 3 else "de", "s"))
        marks.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = planted(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held])
    assert right > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    docs, labels = planted(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda lab: {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, lab).collect()}
    assert score(labels) == score(flipped)


def test_toxicity_odd(spark, odd, none, labels):
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).select("score").distinct().count() == 1


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(90))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_decontamination_finds_planted_items(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.orderBy("item_id").collect()][:20]
    clean = [r["text"] for r in docs.where("doc_id < 60").orderBy("doc_id").collect()]
    rng = random.Random(2)
    rows, truth = [], set()
    for k, (item, text) in enumerate(items):
        words = text.split()
        para = [w for w in words if rng.random() > 0.15]  # one word in seven left out
        host = clean[k].split()
        at = rng.randrange(len(host) + 1)
        rows.append((1000 + k, " ".join(host[:at] + (words if k % 2 else para) + host[at:])))
        truth.add((1000 + k, item))
    # items that the unchanged documents hold already
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect()}
    assert len(truth - found) <= 1
    norm = lambda t: " ".join(t.split())
    real = {(r["doc_id"], i) for r in docs.collect() for i, t in items if norm(t) in norm(r["text"])}
    assert real <= found
    assert len({d for d, _ in found if d < 1000}) <= 0.1 * docs.count()


def test_decontamination_odd(spark, sf, odd, none):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string")
    assert decontaminate.contaminated(odd, nothing).count() == 0


def brute_classes(rows):
    sets, rep = {}, {}
    for i, t in sorted(rows):
        w = tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split())
        sets[i] = (w, frozenset(w[k : k + 5] for k in range(max(1, len(w) - 4))) if w else frozenset())
        rep.setdefault(w, i)
    reps = sorted(rep.values())
    links, up = Counter(), {i: i for i in reps}

    def root(x):
        return x if up[x] == x else root(up[x])

    for n, a in enumerate(reps):
        for b in reps[:n]:
            x, y = sets[a][1], sets[b][1]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    copies = Counter(rep[sets[i][0]] for i, _ in rows)
    return sorted((i, root(rep[sets[i][0]]), rep[sets[i][0]], copies[rep[sets[i][0]]], links[rep[sets[i][0]]]) for i, _ in rows)


def near_rows(df):
    return sorted(tuple(r[c] for c in ("doc_id", "class_id", "copy_of", "n_copies", "n_links")) for r in ngram_join.near_classes(df).collect())


def test_near_classes_equal_brute_force(spark, docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 60").collect()]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(330):  # one large group of near copies, more than a block
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(120)] = rng.choice(words)
        rows.append((1000 + i, " ".join(t)))
    rows += [(5000 + i, "The SAME text\tagain and again and once more") for i in range(50)] + [(6000, "short"), (6001, "SHORT"), (6002, ""), (6003, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(df) == brute_classes(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 201), (7, 7)]
    got = {r["id"]: r["component"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 120)) and got[201] == 200
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_posterior_keeps_what_can_reach_the_threshold():
    least = ngram_join.least_matches()
    rng = np.random.default_rng(0)
    for n, m in least.items():
        assert (rng.binomial(n, 0.8, 20_000) < m).mean() < 2e-3 and m > 0.4 * n


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[1000:]
    v = ngram_join.minhashes(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    assert abs((v[0] == v[1]).mean() - 1 / 3) < 0.12


def test_near_classes_odd(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id IS NOT NULL").collect()]
    assert near_rows(odd.where("doc_id IS NOT NULL")) == brute_classes(rows)
    got = {(r["doc_id"], r["copy_of"], r["n_copies"]) for r in ngram_join.near_classes(odd).collect() if r["doc_id"] is None}
    assert got == {(None, None, 1), (None, 0, 4)}  # a text of its own; a null text is a copy of the texts without words
    assert near_rows(none) == []


def test_near_classes_of_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (4, c), (None, c + " more"), (None, c + " more"), (None, " ".join(f"d{i}" for i in range(9)))]
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 1), (None, 4, 1), (None, None, 0)}


def test_exact_links_equal_plain_sets():
    rng = np.random.default_rng(2)
    pivot = np.unique(rng.integers(0, 1 << 60, 60, dtype=np.uint64))
    sets = [pivot, *[np.unique(np.concatenate([rng.choice(pivot, rng.integers(30, len(pivot)), replace=False), rng.choice(pivot[:9] + np.uint64(1), rng.integers(0, 9))])) for _ in range(60)]]
    g = pd.DataFrame({"size": [len(x) for x in sets], "pivot": len(pivot), "difference": [np.setxor1d(x, pivot).tobytes() for x in sets]})
    a, b = np.triu_indices(len(sets), 1)
    plain = [5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    assert ngram_join.exact_links(g, a, b).tolist() == plain == ngram_join.exact_links(g, a, b, most=7).tolist() and 0 < sum(plain) < len(plain)


def test_groups_stay_together_across_batches():
    import pandas as pd

    frames = [pd.DataFrame({"k": k, "v": k}) for k in ([1, 1], [1, 2], [], [3], [3, 3, 4])]
    got = defaultdict(int)
    for g in ngram_join._groups(iter(frames), ["k"]):
        assert g["k"].nunique() == 1 and g["k"].iloc[0] not in got
        got[g["k"].iloc[0]] += len(g)
    assert dict(got) == {1: 3, 2: 1, 3: 3, 4: 1}


def test_search_does_not_depend_on_the_span(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(700)]
    items = [(str(k), " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((6, 12, 20, 31, 40, 90))]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, f"{filler(rng.randint(0, 900))} {x} {filler(rng.randint(0, 900))}") for k, x in items for _ in range(3)]
    own = decontaminate.Items.of(items)
    basis = np.random.default_rng(1).normal(size=(len(own.vocabulary), 8)).astype(np.float32)
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    run = lambda: pd.concat(decontaminate._search(SimpleNamespace(value=(own, basis)))(iter([frame]))).drop(columns="cosine").sort_values(["doc_id", "near_word"], ignore_index=True)
    expected = run()
    monkeypatch.setattr(decontaminate, "SPAN", 100)
    monkeypatch.setattr(decontaminate, "CELLS", 1)
    assert len(expected) and expected.equals(run())


def test_items_that_share_an_id_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", 2)
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i * 7919 + 100_003))
    texts = [" ".join(word(100 * k + j) for j in range(40)) for k in range(5)]
    bench = spark.createDataFrame([(1, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1), (1, 7), (2, 7), (3, 7), (4, 9)}


def test_vocabulary_lookup_is_exact(monkeypatch):
    monkeypatch.setattr(decontaminate, "_SLOTS", 6)  # many words in a slot
    rows = [(str(k), " ".join(f"word{k * 50 + j}" for j in range(50))) for k in range(60)]
    own = decontaminate.Items.of(rows)
    t = common.Tokens([x for _, x in rows] + ["none of these here"], words=True)
    at = own.index(t.hashes)
    assert len(own.vocabulary) == 3000 and (own.vocabulary[at[:3000]] == t.hashes[:3000]).all() and (at[3000:] == -1).all()


def test_common_words_are_counted_over_all_items(spark, monkeypatch):
    texts = [f"the common words of item {chr(97 + k % 26)}{k} " + " ".join(f"own{k}x{j}" for j in range(12)) for k in range(40)]
    bench = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(texts)], "doc_id long, text string")
    find = lambda: {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    whole = find()
    monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", 7)
    assert whole == find() == {(k, k if k else None) for k in range(40)}


def test_reworded_items_are_found(spark, sf, docs):
    """One word in five is another, and two neighbouring stretches change places."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rng = random.Random(12)
    clean = [r["text"].split() for r in docs.where("length(text) > 400").orderBy("doc_id").limit(40).collect()]
    pool = [w for t in clean for w in t]
    items = [(r["item_id"], r["text"].split()) for r in bench.orderBy("item_id").limit(40).collect()]
    rows = []
    for k, (_, words) in enumerate(items):
        new = [rng.choice(pool) if rng.random() < 0.2 else w for w in words]
        at = rng.randrange(max(1, len(new) - 6))
        new[at : at + 6] = new[at + 3 : at + 6] + new[at : at + 3]
        host = clean[k % len(clean)]
        rows.append((k, " ".join(host[:60] + new + host[60:])))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    hit = sum((k, i) in found for k, (i, _) in enumerate(items))
    print("reworded items found:", hit, "of", len(items))
    assert hit >= 0.9 * len(items)
