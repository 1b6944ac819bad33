"""Token counts against the libraries on whole texts."""

import pytest
from pyspark.sql import functions as F

from quizmill.llm import token_counts as tc
from quizmill.llm import vocab

FILES = ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json")
HARD = [
    "x" * 30_000, "x" * 500 + " " + "y" * 9_000 + " " + "z" * 700, None, "", " ", "\n", "a b " * 900, "\n \n  a" * 1_000, "1 2<|endoftext|> 3" * 500, "É é ́a" * 400, "日本 語" * 800,
    "it's  we'll   x  y z \x1c!\x1d w" * 90, "▁a ▁" * 300, "tab\tand\r\nline " * 200,
    "Stop. stop., STOP,. 1. 2,, é. É, ǆ. ı. ß. İ. ×. ÷. x̣. 's. n't, !., .,. ., .a a.b. <|endoftext|>. it's, ½. Ⅻ, 한. 日, ½.",
]


def expected(rows, name):
    return sorted(((i if i is not None else -1), n) for (i, _), n in zip(rows, vocab.count_tokens(name, [t or "" for _, t in rows]), strict=True))


@pytest.mark.parametrize("name", FILES)
def test_spliced_counts(spark, docs, name):
    """Small chunks, so that all kinds of text are cut, spliced and cut anew; repeated rows and rows without id."""
    rows = [*enumerate(HARD), (0, HARD[0]), (None, HARD[6]), (None, HARD[6]), *[(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(60).collect()]]
    got = tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), name, huge=200, chunk=128, overlap=32, wider=4).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == expected(rows, name)


def test_rounds(spark):
    """A text with blanks is done in one round; one without is widened until it is one chunk."""
    of = lambda text: spark.createDataFrame([("k", text)], "key string, text string")
    assert tc.huge_counts(of("some words " * 900), FILES[0], 128, 32, 4)[1] == 1
    found, rounds = tc.huge_counts(of("x" * 9_000), FILES[0], 128, 32, 4)
    assert rounds == 4 and found.collect()[0].tokens == vocab.count_tokens(FILES[0], ["x" * 9_000])[0]


def test_disagreeing_neighbours_are_not_spliced(spark, monkeypatch):
    """If a boundary called stable were not, its neighbours would count differently, and the text would be cut anew."""
    monkeypatch.setattr(vocab, "stable_boundary", lambda name: __import__("re").compile("."))
    text = "incomprehensibilities" * 40
    encode = tc._encode(FILES[0], 64, 16)
    import pyarrow as pa

    cut = pa.Table.from_batches(list(tc._cut(64, 16)(iter([pa.RecordBatch.from_pydict({"key": ["k"], "text": [text]})]))))
    rows = pa.Table.from_batches(list(encode(iter(cut.to_batches())))).to_pylist()
    shifts = [{a - b for p, a in zip(x["right_at"], x["right_n"], strict=True) for q, b in zip(y["left_at"], y["left_n"], strict=True) if p == q} for x, y in zip(rows, rows[1:], strict=False)]
    assert any(len(s) > 1 for s in shifts)


def test_a_tokenizer_is_read_once_for_its_boundary(monkeypatch):
    """Batches after the first do not take the whole vocabulary apart again."""
    tc.whole_counts(FILES[0], ["a b"])
    monkeypatch.setattr(vocab.json, "loads", lambda *a: pytest.fail("read again"))
    assert tc.whole_counts(FILES[0], ["a b", "c"]) == [2, 1]


def test_counts_and_alignment_in_one_worker():
    """The alignment takes special strings as plain text, the counts as the library does by default, in any order in one process."""
    from quizmill.llm import alignment

    name, text = "byte_bpe_50k.json", "1 2<|endoftext|> 3"
    counts, ends = vocab.count_tokens(name, [text]), vocab.token_ends(name, [text])
    side = alignment._Side(name, ";")
    plain = side.encode([text])
    assert len(plain[0]) > counts[0]
    assert (vocab.count_tokens(name, [text]), vocab.token_ends(name, [text]), side.encode([text])) == (counts, ends, plain)


def test_whole_table(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = tc.op13_token_counts(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == expected(rows, FILES[0])
    assert {r.doc_id: (r.n_bytes, r.over_limit) for r in got} == {i: (len((t or "").encode()), n > 2048) for (i, t), (_, n) in zip(sorted(rows), expected(rows, FILES[0]), strict=True)}


def test_odd_tables(odd, none):
    got = tc.token_counts(odd.withColumn("n_tokens", F.lit("clash")).withColumn("__0", F.lit(1)), FILES[0], keep=("doc_id", "size", "n_tokens", "__0"))
    assert got.count() == odd.count() and set(got.columns) == {"doc_id", "size", "__0", "n_bytes", "n_tokens"}
    assert {(r.n_bytes, r.n_tokens) for r in got.where("doc_id IN (0, 1)").collect()} == {(0, 0)}
    assert tc.token_counts(none, FILES[0]).count() == 0
