"""Secret scans, WARC archives, edit fingerprints."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import duck_rows, spark_rows
from pyspark.sql import functions as F

from quizmill.llm import edit_fingerprint as E
from quizmill.llm import queries, warc
from quizmill.llm import secret_scan as S


def brute_base(text):
    out = []
    for kind, pattern, group, least in S.BASE_RULES:
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                out.append((m.start(), kind, m.end()))
    order = [k for k, *_ in S.BASE_RULES]
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda x: (x[0], order.index(x[1]))))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="akie AKIA:=\"'_p0f9étokensrPw\n-.", max_size=120))
def test_spans_equal_the_plain_patterns(text):
    spans = sorted(((s["start"], s["kind"], s["end"]) for s in S.find_spans(text, S.BASE_RULES)), key=lambda x: (x[0], x[1]))
    plain = sorted(((m.start(), k, m.end()) for k, p, g, least in S.BASE_RULES for m in re.finditer(p, text, re.ASCII) if len(m.group(g)) >= least), key=lambda x: (x[0], x[1]))
    assert spans == plain


def test_secret_query(spark, sf, docs):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op1_secret_scan"](spark, sf).collect()}
    assert len(rows) == docs.count()
    for d in docs.collect():
        base = brute_base(d["text"] or "")
        r = rows[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(base.count(f"{k}:") for k in ("assign", "access", "hex"))


def test_ledger_scans_only_what_is_unseen(spark):
    v1 = spark.createDataFrame([("a", "token = abcdefgh"), ("b", "token = abcdefgh"), ("c", "none")], "path string, text string")
    first = S.scan_versions(v1, None, (1,))
    assert first.count() == 2
    ledger = first.cache()
    v2 = v1.union(spark.createDataFrame([("a", "-----BEGIN RSA PRIVATE KEY-----"), ("d", None)], "path string, text string"))
    more = S.scan_versions(v2, ledger, (1, 2))
    assert sorted((r["rule_version"]) for r in more.collect()) == [1, 1, 2, 2, 2, 2]
    found = S.findings_by_path(v2, ledger.union(more)).collect()
    kinds = defaultdict(list)
    for r in found:
        kinds[r["path"]] += [s["kind"] for s in r["spans"]]
    assert kinds["a"] == ["assign", "pem"] or kinds["a"] == ["pem", "assign"]
    assert kinds["b"] == ["assign"] and not kinds["c"] and not kinds["d"]
    assert S.scan_versions(v2, ledger.union(more)).count() == 0


def test_history_of_runs(spark, docs, monkeypatch):
    """The ledger of two runs holds each (blob, rule version) once, and finds what one run over all finds."""
    v = docs.where("doc_id < 80").select(F.col("doc_id").alias("path"), "text")
    v = v.unionByName(v.where("path < 20"))  # repeated rows
    both = S.scan_history([(v.where("path % 2 = 0"), (1,)), (v, (1, 2))])
    keys = [(r["blob"], r["rule_version"]) for r in both.collect()]
    assert len(keys) == len(set(keys)) == 2 * v.select("text").distinct().count()
    rows = lambda ledger: sorted(str(tuple(r)) for r in S.findings_by_path(v, ledger).collect())
    assert rows(both) == rows(S.scan_versions(v))


def test_secret_odd(spark, odd, none):
    v = odd.withColumnRenamed("doc_id", "path")
    assert S.findings_by_path(v, S.scan_versions(v)).count() == odd.count()
    assert S.scan_versions(none.withColumnRenamed("doc_id", "path")).count() == 0


def test_warc_equals_sql(spark, sf):
    q = queries.QUERIES["op5_warc_index"](spark, sf)
    cols, expected = duck_rows(queries.ORACLE_SQL["op5_warc_index"], sf)
    assert sorted(q.columns) == cols and spark_rows(q) == expected


def test_warc_copies_and_odd_payloads(spark):
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 9
    rows = [(3, "http://www.B.example/x#y", big), (1, "http://b.example/x", big), (2, None, big), (4, "http://a.example/", ""), (5, "u\nv", None), (6, "http://b.example:80/a", "small"), (7, "http://b.example/a", "small"), (None, "http://z", "some html without id"), (1, "http://b.example/x", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("clash"))
    out = warc.archive_round_trip(df).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    digest = hashlib.sha256(big.encode()).hexdigest()
    assert (by[1]["record_type"], by[2]["refers_to"], by[3]["refers_to"]) == ("response", 1, 1)
    assert all(by[i]["payload_bytes"] == len(big.encode()) and by[i]["payload_digest"] == digest for i in (1, 2, 3))
    assert by[6]["record_type"] == by[7]["record_type"] == "response" and by[5]["payload_bytes"] == 0
    order = [(r["url_key"], r["timestamp"]) for r in out]
    assert order == sorted(order)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_many_archives_and_ranges(spark, docs, tmp_path):
    pages = docs.where("doc_id < 120").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), F.col("doc_id") % 3, F.lit(".example/")).alias("url"), F.when(F.col("doc_id") % 4 == 0, F.lit("<p>one error page</p>" * 9)).otherwise(F.col("text")).alias("html"))
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path, archive_bytes=20_000)
    runs = warc.capture_runs(spark, path)
    assert runs.select("archive").distinct().count() > 3
    out = warc.merged_index(runs, merge_rows=10).collect()
    order = [(r["url_key"], r["timestamp"], r["page_id"]) for r in out]
    assert len(out) == pages.count() and order == sorted(order)
    assert {r["page_id"] for r in out if r["record_type"] == "revisit"} >= set(range(4, 120, 4)) & {r["page_id"] for r in out}


@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree([sorted(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_fingerprint_query(spark, sf, docs):
    rows = sorted(queries.QUERIES["op6_edit_fingerprint"](spark, sf).collect(), key=lambda r: -r["doc_id"])
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [r["doc_id"] for r in rows] == sorted(text, reverse=True)
    by_text = {}
    for r, nxt in zip(rows, [*rows[1:], rows[0]], strict=True):
        own, other = text[r["doc_id"]], text[nxt["doc_id"]]
        edited = E.edited_text(own, other)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(own)
        for t, f in ((own, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert f == E.fingerprint(E.symbols(t), E._walk().run(E.symbols(t)))
            assert by_text.setdefault(t, f) == f
        assert r["near_next"] == E.likeness(r["fingerprint"], nxt["fingerprint"])
    assert sum(r["near_edited"] for r in rows) / len(rows) > 0.6 > 0.2 > sum(r["near_next"] for r in rows) / len(rows)


def plain_walk(data):
    """The walk step by step: the byte at each step."""
    w = E._walk()
    import numpy as np

    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, (E.PERIOD, 256), dtype=np.uint8)
    bits[0] = 1
    out, i, j = [], 0, 0
    while i < len(data):
        out.append(data[i])
        i += int(bits[j % E.PERIOD, data[i]])
        j += 1
    return out, w


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=60))
def test_walk_equals_the_plain_one(text):
    data = E.symbols(text)
    assert len(data) == len(text)
    steps, w = plain_walk(data)
    level = max(4, (max(len(steps), 1) - 1).bit_length())
    parts = E.fingerprint(data, w.run(data)).split(":")
    assert (int(parts[0], 16), int(parts[1], 16)) == (len(steps), level)
    bits = [int(w.bit[k, steps[p] if p < len(steps) else 256]) for k, p in enumerate((w.where * (1 << level)).astype(int))]
    packed = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, E.SAMPLES, 8)).hex()
    assert parts[2] == packed


def test_fewer_edits_are_nearer():
    base = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood " * 20
    f = lambda t: E.fingerprint(t.encode(), E._walk().run(t.encode()))
    few, many = base.replace("fox", "cat", 2), base.replace("o", "0")
    assert E.likeness(f(base), f(base)) == 1 and E.likeness(f(base), f(few)) > 0.85 > 0.6 > E.likeness(f(base), f(many))


def test_near_links(spark):
    base = [" ".join(f"{chr(97 + (i * 7 + k * k) % 26)}{k * 31 % 17}w{i}" for k in range(150)) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t[:-5] + "q" * 5) for i, t in enumerate(base)] + [(20, base[0])]
    prints = E.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    links = {(r["doc_id"], r["leader"]) for r in E.near_links(prints).collect()}
    assert {(10 + i, i) for i in range(6)} | {(20, 0)} <= links and len(links) == 7


def test_near_links_against_brute_force(spark):
    """Most near texts are not the least of their bucket; sizes lie on both sides of a level's bound, and one family is larger than a block."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    texts = []
    for k in range(400):
        base = [word() for _ in range(rng.choice([6, 25, 60, 90, 120]))]
        texts.append(" ".join(base))
        for _ in range(300 if k == 7 else k % 4):
            texts.append(" ".join(word() if rng.random() < 0.04 else w for w in base))
    rows = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    prints = [(i, E.fingerprint(E.symbols(t), E._walk().run(E.symbols(t)))) for i, t in rows]
    got = {r["fingerprint"]: r for r in E.print_classes(spark.createDataFrame(prints, "doc_id long, fingerprint string")).collect()}
    known = sorted({f for _, f in prints})
    assert set(got) == set(known)
    pairs = [(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if E.likeness(a, b) >= E.THRESHOLD]
    links = Counter(x for p in pairs for x in p)
    together = sum(got[a]["class_id"] == got[b]["class_id"] for a, b in pairs)
    assert len(pairs) > 5000 and together >= 0.999 * len(pairs)
    assert sum(got[f]["n_links"] != links[f] for f in known) <= 0.002 * len(known)
    assert sum(r["n_links"] for r in got.values()) <= 2 * len(pairs)


def test_near_links_in_the_query(spark, docs):
    rows = docs.where("doc_id < 40").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a row without an id"), (900, "Some words " * 40), (901, "Some words " * 40)], "doc_id long, text string"))
    out = E.with_classes(E.edit_fingerprints(rows)).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == rows.count() and by_id[901]["class_id"] == 900 and by_id[None]["class_id"] is None


def test_fingerprint_odd(spark, odd, none):
    out = E.edit_fingerprints(odd).collect()
    assert len(out) == odd.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert E.edit_fingerprints(none).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    r = E.edit_fingerprints(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0


@pytest.mark.parametrize("n", [1, 2, 7])
def test_fingerprint_partitions_do_not_matter(spark, docs, n):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = spark_rows(E.edit_fingerprints(docs.where("doc_id < 40")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 40 and got == test_fingerprint_partitions_do_not_matter.__dict__.setdefault("rows", got)


def test_likeness_falls_without_jumps():
    """A text and longer ones that begin with it: likeness falls with the length, near to the share of the longer text, whatever powers of two lie between."""
    rng = random.Random(21)
    for words in (15, 40, 80, 110, 300):
        base = " ".join("".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randrange(2, 9))) for _ in range(words))
        tail = " ".join("".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randrange(2, 9))) for _ in range(9 * words))
        whole = lambda t: E.fingerprint(E.symbols(t), E._walk().run(E.symbols(t)))
        of, last = whole(base), None
        for part in range(24, 161):
            factor = part / 20
            found = E.likeness(of, whole(f"{base} {tail}"[: int(len(base) * factor)]))
            assert abs(found - (found if last is None else last)) <= 0.1 and abs(found - 1 / factor) <= 0.13, (words, factor, found, last)
            last = found


def test_rows_without_id_fill_many_partitions(spark):
    """Nine rows in ten have no id: they are dealt by the tie too, and the order over partitions holds."""
    rng = random.Random(22)
    rows = [(i if i % 10 == 0 else None, " ".join(rng.choices("red green blue black white".split(), k=30))) for i in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.col("doc_id"), "tie": F.xxhash64("text")})
    order = F.col("_id").desc_nulls_last()
    dealt = df.repartitionByRange(8, order, "tie").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 700
    got = E.edit_fingerprints(df.select("doc_id", "text")).collect()
    placed = [r.text for r in df.orderBy(order, "tie").collect()]
    following = dict(zip(placed, placed[1:] + placed[:1], strict=True))
    prints = {t: E.fingerprint(E.symbols(t), E._walk().run(E.symbols(t))) for t in placed}
    expected = sorted((prints[t], hashlib.sha256(E.edited_text(t, n).encode()).hexdigest()) for t, n in following.items())
    assert sorted((r.fingerprint, r.edited_sha256) for r in got) == expected
