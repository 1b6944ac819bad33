"""Alignment against plain loops over the libraries' encodings of whole texts."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quizmill.llm import alignment as al
from quizmill.llm import vocab

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
HARD = [
    None, "", " ", "  ", "a", "  two  spaces   inside ", "ends in a space ", "\nline\n line \n\n  line", "a\xa0 b \xa0c  d", "▁ a▁b", "nul\x00 byte", "É é ́a ǆ", "日本 語 🎉🎉 👩‍👩‍👧", "<|endoftext|> <s> </s> <unk> <0x0A>", "x" * 3000, "tab\t\tand\r\n crlf",
    "it's we'll 12345 67 !!?? ... a,b;c|d", "one two one two", "\x1c \x1d! \x1e",
]


def brute(rows):
    """Token by token, link by link."""
    model, pieces = vocab.load(A), vocab.load(B)
    model.encode_special_tokens = True
    a_bytes, b_bytes = vocab.token_bytes(A), vocab.token_bytes(B)
    texts, corpus = [], Counter()
    for _, text in rows:
        whole = f" {text}"
        a = model.encode(whole, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if b"".join(a_bytes[i] for i in a) != whole.encode() or b"".join(b_bytes[i] for i in b) != whole.encode():
            a = b = []
        spans = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if at <= s and e <= cut) for side in spans))
            at = cut
        links, low = [], 0
        for s, e, i in spans[0]:
            while low < len(spans[1]) and spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        corpus.update(links)
        texts.append((len(a), len(b), groups, links))
    highest = Counter()
    for (_, b), n in corpus.items():
        highest[b] = max(highest[b], n)
    return sorted(
        (-1 if i is None else i, a, b, len(g), len(k), sum(corpus[p] == highest[p[1]] for p in k), sum(corpus[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for (i, _), (a, b, g, k) in zip(rows, texts, strict=True)
    )


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("chunk", [50, 5_000, 8_000_000])
def test_against_brute_force(spark, docs, chunk):
    rows = [*enumerate(HARD), (3, "one two one two"), (3, "one two one two"), (None, "no id"), (None, None), *[(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(80).collect()]]
    assert found(al.align_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batch=chunk // 2, chunk=chunk)) == brute(rows)


def test_whole_table(spark, sf, docs):
    assert found(al.op11_token_alignment(spark, sf)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_the_two_files_of_the_vocabulary_agree(docs):
    texts = [t for t in HARD if t] + [r.text or "" for r in docs.limit(60).collect()]
    model = vocab.load(A)
    model.encode_special_tokens = True
    assert [e.ids for e in model.encode_batch(texts, add_special_tokens=False)] == [vocab.load("byte_bpe_50k.tiktoken").encode_ordinary(t) for t in texts]
    assert vocab.token_bytes(A)[:50_256] == vocab.token_bytes("byte_bpe_50k.tiktoken")[:50_256]


def test_forgetting_words_changes_nothing(spark, docs, monkeypatch):
    rows = docs.limit(50)
    expected = found(al.align_tokens(rows))
    monkeypatch.setattr(al, "MEMO", -1)
    aligner = al._Aligner("byte_bpe_50k.tiktoken", B)
    texts = [r.text or "" for r in rows.collect()]
    numbers, hashes, links = aligner.align(texts)
    again = aligner.align(texts)
    assert [x.tolist() for x in numbers] == [x.tolist() for x in again[0]] and hashes == again[1] and links.tolist() == again[2].tolist()
    aligner.forget()
    assert aligner.align(texts)[1] == hashes and sorted(hashes) == sorted(x[-1] for x in expected)


def test_odd_tables(odd, none):
    got = al.align_tokens(odd.withColumn("n_a", F.lit("clash")).withColumn("__chunk", F.lit(1)), keep=("doc_id", "size", "n_a", "__chunk"))
    assert got.count() == odd.count() and {"doc_id", "size", "__chunk", "n_a"} < set(got.columns)
    assert {(r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in got.where("doc_id IN (0, 1)").collect()} == {(0, 0, 0, "")}
    assert al.align_tokens(none).count() == 0
