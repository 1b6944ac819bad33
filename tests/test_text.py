"""Text functions on cases that the given prose does not hold."""

import duckdb
import pytest
from oracle import norm, spark_rows
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.plans import queries as Q


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ",".join(f"v{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"v{i}") for i in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("One ends here. Two starts! Three?", ["One ends here.", "Two starts!", "Three?"]),
        ("The U.S. Congress met in Dec. Then it rested. See 15 U.S.C. Sec. 45 for more.", ["The U.S. Congress met in Dec. Then it rested.", "See 15 U.S.C. Sec. 45 for more."]),
        ("J. Smith said “yes.” Nobody else did.", ["J. Smith said “yes.”", "Nobody else did."]),
        ("no capital. follows here", ["no capital. follows here"]),
        ("", []),
        ("He left.”))))))))))) Then she did. ......Inc. The end", ["He left.”)))))))))))", "Then she did. ......Inc. The end"]),
        ("etc.. Next one", ["etc..", "Next one"]),
        ("One ends.\u00a0Two\u3000starts", ["One ends.", "Two\u3000starts"]),
    ],
)
def test_split_sentences(spark, text, expected):
    assert one(spark, T.split_sentences, text) == expected


def test_normalize(spark):
    assert one(spark, T.normalize_text, " a­b \t\n c d ") == "ab c d"


@pytest.mark.parametrize(
    ("base", "href", "expected"),
    [("OPS/text/a.html", "b.html#x", "OPS/text/b.html"), ("OPS/text/a.html", "../img/c%20d.png", "OPS/img/c d.png"), ("OPS/a.html", "/x/./y.html", "x/y.html"), ("OPS/a.html", "#top", "OPS/a.html"), ("a.html", "bad%zz.html", "bad%zz.html"), ("a.html", "a+b.html", "a+b.html")],
)
def test_resolve_path(spark, base, href, expected):
    assert one(spark, T.resolve_path, base, href) == expected


def test_fragment(spark):
    assert one(spark, T.fragment_of, "a#b%20c") == "b c"
    assert one(spark, T.fragment_of, "a") is None
    assert one(spark, T.fragment_of, "a#") is None


@pytest.mark.parametrize(
    ("sentence", "term"),
    [
        ("Data minimization is the practice of collecting only what a task needs.", "Data minimization"),
        ("The term “pseudonymization” refers to replacing direct identifiers with codes.", "pseudonymization"),
        ("Cookies are small text files that a site stores on a device.", "Cookies"),
        ("A controller means the body that decides why data are processed.", "controller"),
        ("Consent (CNS) is defined as a freely given agreement to some processing.", "Consent"),
        ("It is the practice of collecting only what one needs for it.", None),
        ("Privacy is a difficult concept to pin down in one sentence.", None),
        ("Encryption is often used with other controls in modern systems.", None),
        ("Security means that nothing is ever lost by anyone at all.", None),
        ("Is privacy a right that everyone holds in every place?", None),
        ("Profiling is done by many firms in many lands today.", None),
    ],
)
def test_definition(spark, sentence, term):
    found = one(spark, T.definition_in_sentence, sentence)
    assert (found["term"] if found else None) == term


def test_definition_is_cleaned(spark):
    found = one(spark, T.definition_in_sentence, "Consent is defined as a freely given agreement to some processing.")
    assert found["definition"] == "A freely given agreement to some processing"


@pytest.mark.parametrize(
    ("text", "term", "definition"),
    [
        ("Adequacy. A finding that a country protects data well enough.", "Adequacy", "A finding that a country protects data well enough"),
        ("Opt-in (OI): See also Consent. An active choice made by a person. More text.", "Opt-in", "An active choice made by a person"),
        ("Notice — A statement made to a person about data use", "Notice", "A statement made to a person about data use"),
        ("too short. No.", None, None),
    ],
)
def test_glossary_entry(spark, text, term, definition):
    found = one(spark, T.glossary_entry, text)
    assert (found["term"], found["definition"]) == (term, definition) if found else term is None


def test_clean_definition_drops_open_aside(spark):
    assert one(spark, T.clean_definition, "known as a ring of trusted firms (Books") == "A ring of trusted firms"


def test_first_letter_has_one_capital(spark):
    """As SQL's upper: ß has ẞ, ŉ and ﬁ have none; whole mappings (SS, ʼN, FI) would lengthen the text."""
    for c in "aßŉǰﬁᾀᾈῳǆéñœıд1 ":
        text = f"{c}chzu beschie"
        assert one(spark, T.capitalised, text) == duckdb.execute("SELECT upper($1[1]) || $1[2:]", [text]).fetchone()[0]
    assert one(spark, T.clean_definition, "known as ßachzu beschie.") == "ẞachzu beschie"
    assert one(spark, T.glossary_entry, "Notice — ßheit a person about data use")["definition"] == "ẞheit a person about data use"


def test_glossary_entries_of_small_letters(spark, tmp_path):
    lines = [f"Notice{sign} {first}heit einer Person über ihre Daten" for sign in (".", ":", " —") for first in ("ß", "ü", "ŉ", "ñ", "S", "ﬁ")]
    spark.createDataFrame([(i, "\n".join(["Title", *lines]), "de", "s", 9) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(Q.ORACLE_SQL["txt10_glossary_entry"])
    cols = [c[0] for c in cur.description]
    expected = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert any("ẞ" in x for r in expected for x in r)
    assert spark_rows(Q.QUERIES["txt10_glossary_entry"](spark, str(tmp_path))) == expected


def test_blanks_beyond_ascii(spark):
    assert one(spark, T.key_of, "\u00a0Data\u2003 Fiduciary’s\u3000") == "data fiduciary's"
    assert one(spark, T.strip_leading, "Under\u00a0the Data Act") == "Data Act"
    assert one(spark, T.definition_in_sentence, "A covenant\u00a0is a promise that\u2003binds two firms.")["term"] == "covenant"


def test_any_number_of_leading_words(spark):
    long = " ".join(["The the of And to in"] * 10_000)
    assert one(spark, T.strip_leading, f"{long} Data Act of the Land") == "Data Act of the Land"
    assert one(spark, T.strip_leading, long) == "in"


def test_fnv_and_ids(spark):
    def fnv(t):
        h = 0x811C9DC5
        units = t.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2])) * 0x01000193) % 2**32
        return h

    for t in ("", "a", "book|define|data minimization", "é|x", "a\U0001f600b\ufeff"):
        assert one(spark, T.fnv1a32, t) == fnv(t)
    n, out = fnv("b|define|k"), ""
    while n:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    assert one(spark, T.question_id, "b|define|k") == f"concept-{out}"


def test_snippet_and_highlight(spark):
    s = one(spark, lambda t: T.snippet(t, F.lit("NEEDLE"), 4), "hay hay needle hay hay")
    assert (s["before"], s["match"], s["after"]) == ("…hay ", "needle", " hay…")
    s = one(spark, lambda t: T.snippet(t, F.lit("zzz"), 2), "abcdef")
    assert (s["before"], s["match"], s["after"]) == ("abcd", "", "…")
    h = one(spark, T.highlight, "one two three", "two")
    assert (h["before"], h["match"], h["after"]) == ("one ", "two", " three")
    assert one(spark, T.highlight, "one", "x")["before"] == "one"


def test_person_is_a_word_as_written(spark):
    """Only the words of the list in their own case speak of a person: "i.e." and "We" do not."""
    cases = [("small files, i.e. a token, that a browser keeps", True), ("a plan for We Co customers and others", True), ("small files that you keep on a disk", False), ("a thing that I keep on my disk", False), ("a rule for Our Lady of the lakes", True)]
    df = spark.createDataFrame(cases, "d string, ok boolean")
    assert all(r["got"] == r["ok"] for r in df.withColumn("got", T.plausible_definition(F.col("d"))).collect())
