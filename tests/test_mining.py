"""Laws, duties and questions on a small book; the invariants of questions."""

import random

import duckdb
import pytest
from oracle import norm, spark_rows
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.operators import mining, passages, questions
from quizmill.plans import queries as Q

TEXTS = [
    ("paragraph", "The Fair Credit Reporting Act (FCRA) requires lenders to give a notice before they share reports. It is old.", ["One"]),
    ("paragraph", "The FCRA also limits who may see a credit report at all. Under the Health Records Act, clinics must keep every file for six years.", ["One"]),
    ("paragraph", "The Children Privacy Rule protects young users of web sites from hidden tracking. The Mail Order Rule applies to sellers that ship goods late.", ["Two"]),
    ("paragraph", "The Federal Trade Commission enforces rules on unfair conduct in most markets. The Student Records Act was enacted in 1974 to protect the files of pupils.", ["Two"]),
    ("paragraph", "The Mail Order Rule was adopted in 1975. The Health Records Act requires the Health Records Act to be read by every single clinic.", ["Two"]),
    ("heading", "The Void Act requires nothing from anyone at all.", ["Three"]),
]


def sentences(spark):
    rows = [("b", i, k, t, p) for i, (k, t, p) in enumerate(TEXTS)]
    blocks = spark.createDataFrame(rows, "book_id string, idx int, kind string, text string, path array<string>")
    return mining.sentences(passages.study_passages(blocks))


def test_entities(spark):
    found = {r["name"]: (r["kind"], r["acronym"]) for r in mining.find_entities(sentences(spark)).collect()}
    assert found["Fair Credit Reporting Act"] == ("law", "FCRA")
    assert found["Federal Trade Commission"] == ("agency", None)
    assert "Void Act" not in found
    assert len(found) == 6


def test_duties(spark):
    s = sentences(spark)
    e = mining.find_entities(s)
    d = {(r["idx"], r["pos"]): (r["key"], r["predicate"], r["under"]) for r in mining.find_duties(s, e).collect()}
    assert d[0, 0] == ("fair credit reporting act", "requires lenders to give a notice before they share reports", False)
    assert d[1, 0][:2] == ("fair credit reporting act", "limits who may see a credit report at all")
    assert d[1, 1] == ("health records act", "clinics must keep every file for six years", True)
    assert d[3, 1][1] == "was enacted to protect the files of pupils"
    assert (4, 0) not in d and (4, 1) not in d
    first = {r["key"]: r["idx"] for r in mining.first_duty(mining.find_duties(s, e)).collect()}
    assert first["fair credit reporting act"] == 0 and first["health records act"] == 1


def test_law_questions(spark):
    s = sentences(spark)
    e = mining.find_entities(s)
    d = mining.find_duties(s, e)
    rows = questions.law_questions(d, e, mining.first_duty(d)).collect()
    assert rows
    for r in rows:
        assert len(set(r["options"])) == 4 and r["answer"] == 0 and len(r["explanations"]) == 4
        assert r["options"][0].lower() not in r["stem"].lower()
        assert any(r["quote"] in t for _, t, _ in TEXTS)
    assert questions.law_questions(d, e, mining.first_duty(d), per_answer=1).groupBy(F.get("options", 0)).count().where("count > 1").count() == 0


def test_glossary_pairs(spark):
    rows = [("b", 0, "paragraph", "Data broker", ["Glossary"]), ("b", 1, "paragraph", "A firm that sells facts about people it never met.", ["Glossary"]), ("b", 2, "paragraph", "Nudge. A design that steers people to one choice.", ["Glossary"]), ("b", 4, "paragraph", "Lonely term", ["Glossary"])]
    blocks = spark.createDataFrame(rows, "book_id string, idx int, kind string, text string, path array<string>")
    found = {r["key"]: (r["idx"], r["definition"]) for r in mining.book_definitions(blocks).collect()}
    assert found["data broker"] == (1, "A firm that sells facts about people it never met")
    assert found["nudge"] == (2, "A design that steers people to one choice")
    assert len(found) == 2


def test_one_book_alone_equals_that_book_in_a_corpus(spark):
    rows = [(b, i, k, t, p) for b in ("x", "y") for i, (k, t, p) in enumerate(TEXTS)]
    blocks = spark.createDataFrame(rows, "book_id string, idx int, kind string, text string, path array<string>")
    both = mining.find_entities(mining.sentences(passages.study_passages(blocks)))
    one = mining.find_entities(mining.sentences(passages.study_passages(blocks.where("book_id = 'x'"))))
    assert sorted(map(tuple, both.where("book_id = 'x'").collect())) == sorted(map(tuple, one.collect()))


def test_loading_blocks(spark):
    blocks = spark.createDataFrame([(b, i) for b in ("x", "y") for i in range(5)], "book_id string, idx long")
    assert [tuple(r) for r in passages.load_blocks(blocks, "x", 1, 3).collect()] == [("x", 1), ("x", 2)]
    assert [r["idx"] for r in passages.load_all_blocks(blocks, "y").collect()] == [0, 1, 2, 3, 4]
    asked = spark.createDataFrame([("x", 3, 9), ("y", 0, 1), ("y", 0, 2), ("z", 0, 9)], "book_id string, start long, end long")
    assert sorted(tuple(r) for r in passages.load_ranges(blocks, asked).collect()) == [("x", 3), ("x", 4), ("y", 0), ("y", 0), ("y", 1)]
    assert passages.load_books(blocks, asked).count() == 10


def test_term_counts_in_pieces(spark, monkeypatch):
    """Keys inside keys, keys that overlap themselves, books cut into pieces: against plain counts."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("aab .É") for _ in range(n))
    rows = [(f"b{i % 3}", i, rng.choice(["paragraph", "list-item", "heading"]), text(rng.choice([0, 5, 400]))) for i in range(60)]
    keys = [(f"b{b}", k) for b in range(3) for k in ("aa", "a", "aba", "b.", "é", "zz", "aabaab")] + [("b9", "a")]
    blocks, terms = spark.createDataFrame(rows, "book_id string, idx int, kind string, text string"), spark.createDataFrame(keys, "book_id string, key string")
    plain = {(b, k): sum(t.lower().count(k) for book, _, kind, t in rows if book == b and kind != "heading") for b, k in keys}
    monkeypatch.setattr(mining, "PIECE", 7)
    assert {(r.book_id, r.key): r.n for r in mining.term_counts(terms, blocks).collect()} == plain
    assert {(r.book_id, r.key): r.n for r in mining.term_counts(terms, blocks, most=2).collect()} == {k: min(n, 2) for k, n in plain.items()}


def test_nearest_definitions(spark):
    """Against all pairs: small chapters, runs of one length, related and repeated definitions."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        term = rng.choice(["net", "network", "law", "data", "seed"]) + rng.choice(["", " a", " b", f" {i}", f" {i}"])
        rows.append((f"b{i % 2}", f"{term}{rng.choice(['', i])}", f"c{int(rng.random() ** 3 * 12)}", i, 0, rng.choice(["x" * rng.randrange(5, 60), f"about {rng.choice(['law', 'data'])} {i}", "the same text"])))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "book_id string, key string, chapter string, idx int, pos int, definition string")
    related = lambda a, b: a in b or b in a
    expected = {}
    for book, key, chapter, _, _, text in rows:
        others = [o for o in rows if o[0] == book and not related(key, o[1]) and key not in o[5].lower() and o[5] != text]
        others.sort(key=lambda o: (o[2] != chapter, abs(len(o[5]) - len(text)), o[3], o[4], o[1]))
        expected[book, key] = [o[1] for o in others[:6]]
    for side in (1, 4, 16):
        got = {}
        for r in questions.nearest_definitions(df, side=side).orderBy("rank").collect():
            got.setdefault((r.book_id, r.key), []).append(r.o_key)
        assert got == {k: v for k, v in expected.items() if v}


def test_entity_patterns_without_recursion(spark):
    """The loops that do not call themselves find what the patterns say, in random rows of the words that matter; and they keep up with any number of words."""
    rng = random.Random(5)
    words = "Act Rule Board Office Bureau Department of of of the the and & in The Of Abc Ab9 Ab_x U.S. Tr.ab9 Ab.c X- Y' O’b é9 Éa x (AB) , . 9".split()
    rows = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "  ", ""]) for _ in range(rng.randrange(2, 30))) for _ in range(20_000)]
    rows += [" ".join(["Department", "of", "the"][: rng.randrange(2, 4)] + [rng.choice(words) for _ in range(rng.randrange(1, 9))]) + rng.choice(["", ".", "9", " (XY)"]) for _ in range(20_000)]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    as_said = [F.regexp_extract_all("t", F.lit(f"({T.ascii_bounds(T.js_blanks(p))})"), F.lit(1)).alias(f"a{i}") for i, (_, p) in enumerate(mining.ENTITY_PATTERNS)]
    flat = [F.regexp_extract_all("t", F.lit(f"({T.ascii_bounds(T.js_blanks(mining._flat(p)))})"), F.lit(1)).alias(f"b{i}") for i, (_, p) in enumerate(mining.ENTITY_PATTERNS)]
    found = [0, 0, 0]
    for r in df.select("t", *as_said, *flat).collect():
        for i in range(3):
            assert r[f"a{i}"] == r[f"b{i}"], r["t"]
            found[i] += len(r[f"a{i}"])
    assert min(found) > 1_000
    long = "The " + "the of " * 20_000
    sents = spark.createDataFrame([("b", 0, 0, f"{long}Data Act passed."), ("b", 1, 0, f"Department of {'The ' * 20_000}Sea acts.")], "book_id string, idx int, pos int, sentence string")
    got = {r["name"] for r in mining.find_entities(sents).collect()}
    assert got == {"Data Act", f"Department of {'The ' * 20_000}Sea"}


def test_duty_of_a_long_name(spark):
    """A sentence is cut where names of its book can end, not behind each of its words: that took the square of a long name's length."""
    name = f"Department of {'The ' * 100_000}Sea"
    said = [f"The {name} requires all firms to keep every file.", "Department of Sea requires all firms to keep no file.", "Department of The Sea"]
    sents = spark.createDataFrame([("b", i, 0, s, "c") for i, s in enumerate(said)], "book_id string, idx int, pos int, sentence string, chapter string")
    got = mining.find_duties(sents, mining.find_entities(sents)).orderBy("idx").collect()
    assert [(r["idx"], r["name"], r["predicate"]) for r in got] == [(0, name, "requires all firms to keep every file"), (1, "Department of Sea", "requires all firms to keep no file")]


@pytest.mark.parametrize("name", ["min8_first_duty", "qst3_law_distractors", "qst4_law_questions", "qst5_generate_concepts"])
def test_law_queries_on_long_runs_of_words(spark, sf, tmp_path, name):
    """Documents that begin with thousands of connecting words, as some of the given ones with hundreds do."""
    run = F.concat(F.repeat(F.lit("The "), F.lit(2_000)), F.repeat(F.lit("to the of "), F.lit(2_000)))
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    d = d.withColumn("text", F.when(F.col("doc_id") % 10 == 2, F.concat(run, "text")).when(F.col("doc_id") % 10 == 5, F.concat(F.lit("Department of "), run, "text")).otherwise(F.col("text")))
    d.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(Q.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    expected = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert expected and spark_rows(Q.QUERIES[name](spark, str(tmp_path))) == expected
