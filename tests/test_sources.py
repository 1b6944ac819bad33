"""HTML walks, bundles that are refused, merges that change nothing the second time."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quizmill.operators import merge, passages, slices, structure
from quizmill.plans import adapters as A
from quizmill.sources import bundle, epub
from quizmill.streaming import streams


def test_tokenize():
    html = """<html><head><title>no</title></head><body><h1 id="c1">Chapter <b>1</b></h1><section><h2>Part</h2><p>One&nbsp;<br/>two</p>
    <div class="note"><h3>Note</h3><p>Inside <span role="doc-pagebreak" aria-label="12"></span> text</p></div></section>
    <ul><li>Item</li></ul>loose text<table><caption>Cap</caption><tr><th>a</th><td>b</td></tr><tr><td></td></tr></table><script>no()</script></body></html>"""
    t = epub.tokenize(html)
    assert [(x["kind"], x["text"]) for x in t] == [("heading", "Chapter 1"), ("heading", "Part"), ("paragraph", "One two"), ("heading", "Note"), ("paragraph", "Inside text"), ("list-item", "Item"), ("paragraph", "loose text"), ("paragraph", "Cap"), ("table", "a | b")]
    assert [x["rank"] for x in t][:4] == [1, 12, None, 13]
    assert t[0]["anchors"] == ["c1"] and t[8]["rows"] == [["a", "b"]]
    assert t[4]["page_after"] == "12" and t[4]["page_before"] is None
    assert (t[3]["box_start"], t[3]["box_end"]) == (3, 4)


def test_nav_document_first_and_ncx_for_what_it_lacks(spark):
    opf = '<package><manifest><item id="n" href="nav.xhtml" properties="scripted nav"/><item id="x" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="x"/></package>'
    nav = '<html xmlns:epub="http://www.idpf.org/2007/ops"><nav epub:type="landmarks"><ol><li><a href="z">Z</a></li></ol></nav><nav epub:type="toc"><ol><li><a href="t/a.xhtml#s">A&nbsp;1</a><ol><li><a href="t/b.xhtml">B</a></li></ol></li><li><span>Part</span><ol><li><a href="t/c.xhtml">C</a></li></ol></li></ol></nav></html>'
    ncx = '<ncx><navMap><navPoint><navLabel><text>N</text></navLabel><content src="n.xhtml"/><navPoint><navLabel><text>M</text></navLabel><content src="n.xhtml#m"/></navPoint></navPoint></navMap><pageList><pageTarget><navLabel><text>7</text></navLabel><content src="t/a.xhtml#p7"/></pageTarget></pageList></ncx>'
    files = {"META-INF/container.xml": '<rootfile full-path="OPS/book.opf"/>', "OPS/book.opf": opf, "OPS/toc.ncx": ncx}
    rows = [("a", p, t) for p, t in {**files, "OPS/nav.xhtml": nav}.items()] + [("b", p, t) for p, t in files.items()]
    got = epub.nav_links(spark.createDataFrame(rows, "book_id string, path string, text string")).orderBy("book_id", "kind", "pos").collect()
    page = ("pages", 0, "7", "OPS/t/a.xhtml", "p7")
    assert [(r["kind"], r["depth"], r["title"], r["path"], r["fragment"]) for r in got if r["book_id"] == "a"] == [page, ("toc", 0, "A 1", "OPS/t/a.xhtml", "s"), ("toc", 1, "B", "OPS/t/b.xhtml", None), ("toc", 0, "C", "OPS/t/c.xhtml", None)]
    assert [(r["kind"], r["depth"], r["title"], r["path"], r["fragment"]) for r in got if r["book_id"] == "b"] == [page, ("toc", 0, "N", "OPS/n.xhtml", None), ("toc", 1, "M", "OPS/n.xhtml", "m")]


def test_book_without_text_is_refused(spark):
    blocks = spark.createDataFrame([("a", 0, "heading", None), ("b", 0, "heading", None), ("b", 1, "paragraph", "1")], "book_id string, idx int, kind string, page string")
    meta = spark.createDataFrame([("a", "A"), ("b", "B")], "book_id string, title string")
    books, left = epub.import_books(meta, blocks)
    assert [r["title"] for r in books.collect()] == ["B"] and left.count() == 2


@pytest.mark.parametrize(
    ("header", "change", "verdict"),
    [
        ({"app": "quizmill", "format": 1}, None, "ok"), ({"app": "other", "format": 1}, None, "not_ours"), ({"app": "quizmill", "format": "1"}, None, "not_ours"),
        ({"app": "quizmill", "format": 2}, None, "too_new"), ({"app": "quizmill", "format": 1}, "books", "damaged"), ({"app": "quizmill", "format": 1}, "missing", "damaged"), ("{", None, "not_ours"),
    ],
)
def test_check_bundle(spark, header, change, verdict):
    rows = {"books": [{"id": "b", "title": "T", "block_count": 1}], "blocks": [{"book_id": "b", "idx": 0, "kind": "paragraph", "text": "x", "path": []}], "questions": [], "attempts": []}
    if change == "books":
        rows["books"].append({"id": 7, "title": "T", "block_count": 1})
    lines = lambda xs: spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in xs], "value string")
    raw = {t: lines(r) for t, r in rows.items() if not (change == "missing" and t == "blocks")}
    assert bundle.check_bundle(lines([header]), raw).first()["verdict"] == verdict


def test_merging_twice_adds_nothing(spark, sf):
    here, there = A.sides(spark, sf)
    known = there.select("book_id").distinct()
    cols = here.columns
    once = merge.merge_questions(here, there, known)
    twice = merge.question_actions(once, there, known)
    assert twice.where("action = 'add' OR action = 'remove' OR action = 'update'").count() == 0
    assert sorted(once.columns) == sorted(cols)


def test_slices_part_the_passages(spark, sf):
    b = A.blocks(spark, sf)
    s = slices.slice_book(b, 600, 150)
    inside = slices.slice_blocks(s, b)
    assert inside.groupBy("book_id", "idx").count().where("count > 1").count() == 0
    assert s.where(F.col("chars") > 780).join(inside.groupBy("book_id", "slice_key").count(), ["book_id", "slice_key"]).where("count > 1").count() == 0


def test_bad_drafts(spark):
    good = {"stem": "Q", "options": ["A) a", "b", "c", "d"], "correctIndex": 0, "explanations": ["1", "2", "3", "4"], "sourcePassages": ["P3", 3]}
    bad = [{"stem": " "}, {"options": ["a", "b", "c"]}, {"options": ["a", "A", "c", "d"]}, {"options": ["a", "b", "c", "All of the above"]}, {"correctIndex": 4}, {"sourcePassages": ["P99"]}, {"correctIndex": 1.5}]
    text = "Sure:\n```json\n" + json.dumps({"questions": [good, *[{**good, **b} for b in bad], {**good, "explanations": ["1"]}]}) + "\n```"
    r = spark.createDataFrame([("b", "1-5", text)], "book_id string, slice_key string, text string")
    p = spark.createDataFrame([("b", "1-5", i, "t") for i in range(1, 6)], "book_id string, slice_key string, idx int, text string")
    rows = sorted(slices.validate_drafts(r, p).collect(), key=lambda x: x["pos"])
    assert [x["pos"] for x in rows] == [0, 8]
    assert rows[0]["options"] == ["a", "b", "c", "d"] and rows[0]["sources"] == [3] and rows[1]["explanations"] is None


def test_chapter_needs_an_entry_placed_while_reading(spark):
    blocks = spark.createDataFrame([("b", i) for i in range(5)], "book_id string, idx int")
    toc = spark.createDataFrame([("b", "One", 0, 1, "anchor"), ("b", "Two", 0, 3, "fallback"), ("b", "Sub", 1, 2, "anchor")], "book_id string, title string, depth int, block_index int, via string")
    assert [r["chapter"] for r in structure.assign_chapter(blocks, toc).orderBy("idx").collect()] == [None, "One", "One", "One", "One"]


def test_watermarked_attempts(spark, sf, tmp_path):
    events = A.read(spark, sf, "events")
    s = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    s = s.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    out = str(tmp_path / "out")
    q = streams.attempts_stream(s.unionByName(s), "400 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == events.count()


def test_listed_pages():
    """Places of the page list: their label wins, short text that repeats it goes, text around goes on; a mark around blocks turns the page before them."""
    html = '<body><p>A<a id="p1"></a> one</p><p id="p2">Long text of its own</p><p>x <span id="p3">p. 3</span>y</p><section id="p4"><h1>H</h1><p>z <span role="doc-pagebreak" id="p5" title="no">5</span></p></section><hr id="p1"/><table id="p2"><tr><td>t<a id="t1"></a></td></tr></table><p id="last"></p></body>'
    t = epub.tokenize(html, {"p1": "1", "p2": "2", "p3": "3", "p4": "4", "p5": "five"})
    assert [(x["text"], x["page_before"], x["page_after"]) for x in t] == [("A one", None, "1"), ("Long text of its own", "2", "2"), ("x y", None, "3"), ("", "4", "4"), ("H", None, None), ("z", None, "five"), ("t", None, None), ("", None, None)]
    assert t[-2]["anchors"] == ["p2", "t1"] and t[-1]["anchors"] == ["last"]


def test_contents_of_an_import(spark):
    """Entries by anchor, by file, by a file without text and by an anchor that never came; a chapter inside a box keeps its headings open; the file after it goes on."""
    opf = '<package><metadata><title>T</title></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{}</manifest><spine>{}</spine></package>'
    files = {
        "a.xhtml": '<body><p>before</p><section><p>s</p><h1 id="one">Head</h1><p>in</p></section><p>after</p></body>', "b.xhtml": '<body><img src="x"/><span id="lost"/></body>',
        "c.xhtml": "<body><p>carried</p><div><h2>Box</h2><p>boxed</p></div><p>free</p></body>",
    }
    links = [("One", "a.xhtml#one"), ("Empty", "b.xhtml"), ("Void", "b.xhtml#never"), ("Late", "c.xhtml#never"), ("Gone", "z.xhtml")]
    nav = "".join(f'<li><a href="{h}">{t}</a></li>' for t, h in links)
    members = {
        "META-INF/container.xml": '<rootfile full-path="book.opf"/>', "nav.xhtml": f'<html xmlns:epub="http://www.idpf.org/2007/ops"><nav epub:type="toc"><ol>{nav}</ol></nav></html>', **files,
        "book.opf": opf.format("".join(f'<item id="{f[0]}" href="{f}" media-type="application/xhtml+xml"/>' for f in files), "".join(f'<itemref idref="{f[0]}"/>' for f in files)),
    }
    parts = spark.createDataFrame([("k", p, t, None) for p, t in members.items()], "book_id string, path string, text string, error string")
    books, blocks, contents = epub.import_archives(parts)
    got = {r.title: (r.block_index, r.via) for r in contents.collect()}
    assert got == {"One": (2, "anchor"), "Empty": (5, "anchor"), "Void": (5, "anchor"), "Late": (5, "fallback")}
    rows = [(r.text, r.path) for r in blocks.orderBy("idx").collect()]
    assert rows == [
        ("before", []), ("s", []), ("Head", ["One", "Head"]), ("in", ["One", "Head"]), ("after", ["One", "Head"]), ("carried", ["Void"]), ("Box", ["Void", "Box"]), ("boxed", ["Void", "Box"]), ("free", ["Void"]),
    ]
    assert [x.title for x in books.first().toc] == ["One", "Empty", "Void", "Late"]


def test_texts_of_an_import_move_few_times(spark, tmp_path):
    """What an import shuffles is a small multiple of its texts, however many joins its structure takes; a name that an archive holds twice gives its blocks once."""
    rng = random.Random(3)
    opf = '<package><metadata><title>T</title></metadata><manifest><item id="d" href="D.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="d"/></spine></package>'
    nav = '<html xmlns:epub="http://www.idpf.org/2007/ops"><nav epub:type="toc"><ol><li><a href="d.xhtml">D</a></li></ol></nav></html>'
    text = lambda: f"<body><h1>H</h1>{''.join(f'<p>{rng.randbytes(1000).hex()}</p>' for _ in range(20))}</body>"
    rows = [(f"k{i}", p, t, None) for i in range(60) for p, t in (("META-INF/container.xml", '<rootfile full-path="book.opf"/>'), ("book.opf", opf), ("nav.xhtml", nav), ("d.xhtml", text()))]
    rows.append(rows[3])
    spark.createDataFrame(rows, "book_id string, path string, text string, error string").write.parquet(str(tmp_path / "parts"))
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        epub.import_archives(spark.read.parquet(str(tmp_path / "parts")))[1].write.parquet(str(tmp_path / "blocks"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = shuffled() - before
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    assert blocks.count() == 60 * 21 and blocks.agg(F.sum(F.length("text"))).first()[0] == 60 * (20 * 2000 + 1)
    assert moved < 6 * 60 * 20 * 2000


def test_one_bucket_is_read(spark, tmp_path):
    """A book and ranges of it are read from its own directory: all others hold junk."""
    blocks = spark.createDataFrame([(f"b{i % 40}", i // 40, "paragraph", f"t{i}") for i in range(400)], "book_id string, idx int, kind string, text string")
    books = blocks.select(F.col("book_id").alias("id")).distinct()
    path = str(tmp_path / "stored")
    epub.write_books(books, blocks, path, buckets=64)
    own = spark.range(1).select(passages.bucket_of(F.lit("b7"))).first()[0]
    book, ranges = passages.stored_book(spark, path, "b7"), passages.stored_ranges(spark, path, spark.createDataFrame([("b7", 2, 5)], "book_id string, start int, end int"))
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(rf"PartitionFilters: .*\(bucket#\d+ = {own}\)", plan(book))
    assert re.search(rf"PartitionFilters: .*bucket#\d+ = {own}\)", plan(ranges))
    for f in (tmp_path / "stored" / "blocks").glob("bucket=*/*.parquet"):
        if f.parent.name != f"bucket={own}":
            f.write_bytes(b"junk")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    spark.catalog.refreshByPath(path)
    assert [r.text for r in book.orderBy("idx").collect()] == [f"t{7 + 40 * k}" for k in range(10)]
    assert [r.idx for r in ranges.orderBy("idx").collect()] == [2, 3, 4]


def test_attempt_ledger_is_replayed(spark, tmp_path):
    """A batch that is played again, after it wrote and after it failed half-way, adds nothing; another run adds only what is new."""
    path = str(tmp_path / "ledger")
    batch = lambda *ids: spark.createDataFrame([(i, f"u{i}") for i in ids], "id long, user string")
    rows = lambda: sorted((r.id, r.user) for r in spark.read.parquet(path).collect())
    one = streams.append_new(path, "one", buckets=4)
    one(batch(1, 2, 2, 3), 0)
    one(batch(3, 4, 5), 1)
    one(batch(3, 4, 5), 1)
    assert rows() == [(i, f"u{i}") for i in range(1, 6)]
    lost = next((tmp_path / "ledger" / "run=one" / "batch=1").iterdir())
    for f in lost.iterdir():
        f.unlink()
    one(batch(3, 4, 5), 1)
    one(batch(1), 2)
    streams.append_new(path, "two", buckets=4)(batch(5, 6, 1), 0)
    assert rows() == [(i, f"u{i}") for i in range(1, 7)]


def test_keyed_state_writes_what_changed(spark, tmp_path):
    """Two runs over arriving files: the second writes only the keys that changed, late rows lose, repeats change nothing; the table equals the batch."""
    schema = "user_id long, question_id string, at long, id long, chosen int"
    first = [(1, "q1", 10, 1, 0), (1, "q1", 10, 2, 1), (1, "q2", 5, 3, 2), (2, "q1", 7, 4, 3)]
    second = [(1, "q1", 9, 5, 3), (1, "q1", 10, 1, 0), (1, "q2", 6, 6, 1), (3, "q9", 1, 7, 0), (2, "q1", 7, 9, 1)]
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streams.run_upserts(streams.newest_by_key(stream, ["user_id", "question_id"], ["at", "id", "chosen"], less_is_better=True), out, check)
    versions = {v: sorted((r.user_id, r.question_id) for r in rows) for v in (0, 1) if (rows := spark.read.parquet(out).where(F.col("version") == v).collect())}
    assert versions == {0: [(1, "q1"), (1, "q2"), (2, "q1")], 1: [(1, "q2"), (3, "q9")]}
    best = {}
    for u, q, at, i, c in first + second:
        best[u, q] = max(best.get((u, q), (at, -i, c)), (at, -i, c), key=lambda x: x[:2])
    assert {(r.user_id, r.question_id): (r.at, -r.id, r.chosen) for r in streams.current(spark, out, ["user_id", "question_id"]).collect()} == best


def test_keyed_state_runs_natively(spark, tmp_path):
    """No Python call for each key, which took a thousand times a row's share of the batch; rows without a time lose to those with one, as in SQL."""
    schema = "user_id long, question_id string, at long, id long, chosen int"
    rows = [(1, "q1", None, 1, 0), (1, "q1", 4, 2, 1), (2, "q1", 9, 4, 3), (2, "q1", None, 3, 2), (3, "q1", None, 6, 0), (3, "q1", None, 5, 1)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).write.parquet(source)
    newest = streams.newest_by_key(spark.readStream.schema(schema).parquet(source), ["user_id", "question_id"], ["at", "id", "chosen"], less_is_better=True)
    assert not re.search("Python|Pandas|UDF", newest._jdf.queryExecution().analyzed().toString())
    streams.run_upserts(newest, out, str(tmp_path / "check"))
    got = streams.current(spark, out, ["user_id", "question_id"]).collect()
    assert {r.user_id: (r.at, r.id, r.chosen) for r in got} == {1: (4, 2, 1), 2: (9, 4, 3), 3: (None, 5, 1)}


def test_lines_of_files(spark):
    import gzip

    data = {"a.gz": gzip.compress(b"one\r\ntwo\n") + gzip.compress(b"three"), "b.gz": b"plain\nlast", "c": gzip.compress(b"x" * 3_000_000 + b"\nend"), "d": gzip.compress(b"cut off\n" * 999)[:-9], "e": b"\xff\xfe\n", "f": b""}
    got = bundle.decoded_lines(spark.createDataFrame(list(data.items()), "path string, content binary")).collect()
    of = lambda f: [r.value for r in got if r.file == f and r.error is None]
    assert of("a.gz") == ["one", "two", "three"] and of("b.gz") == ["plain", "last"] and [len(x) for x in of("c")] == [3_000_000, 3] and of("f") == []
    assert {r.file: r.error for r in got if r.error} == {"d": "damaged", "e": "undecodable"}


def test_slices_are_saved_once(spark):
    made = "id string, book_id string, chunk string, created_at long, model string"
    rows = spark.createDataFrame([("a", "b", "1-2", 5, "m"), ("a", "b", "1-2", 5, "m"), ("c", "b", "1-2", 5, "m"), ("d", "b", "1-2", 9, "n"), ("e", "b", "3-4", 9, "n")], made)
    bank = rows.limit(0)
    saved = slices.save_questions(bank, rows)
    assert sorted(r.id for r in saved.collect()) == ["a", "c", "e"]
    assert slices.save_questions(saved, rows).count() == 0


def test_headings_by_a_stack(spark):
    """Against the rule itself: a heading covers a block up to its scope's end unless a later one of its rank or lower covers it too."""
    rng = random.Random(8)
    headings, blocks = [], []
    for book in range(6):
        for seq in range(120):
            chapter = rng.choice([None, 3]) if book == 5 else None if seq < 20 else seq // 50
            blocks.append((f"b{book}", chapter, seq))
            if rng.random() < (0.1 if book < 2 else 0.5):
                headings.append((f"b{book}", chapter, seq, rng.randrange(1, 5), f"h{seq}", rng.choice([None, seq, seq + rng.randrange(30), seq + 3])))
    expected = {}
    for book, chapter, seq in blocks:
        covers = [h for h in headings if h[:2] == (book, chapter) and h[2] <= seq and (h[5] is None or seq <= h[5])]
        expected[book, seq] = [h[4] for h in covers if not any(x[2] > h[2] and x[3] <= h[3] for x in covers)]
    got = structure.heading_path(spark.createDataFrame(blocks, "book_id string, chapter_start int, seq int"), spark.createDataFrame(headings, "book_id string, chapter_start int, seq int, rank int, text string, scope_end int"))
    assert {(r.book_id, r.seq): list(r.headings) for r in got.collect()} == expected
