"""Registered queries of the sources and streams, over the given pages, documents and events."""

from __future__ import annotations

import functools
import html
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quizmill.functions.scratch import scratch, written
from quizmill.operators import bank, passages, structure
from quizmill.plans import adapters as A
from quizmill.plans.queries import query
from quizmill.sources import bundle, epub
from quizmill.streaming import streams


def pages_as_documents(spark, sf_dir: str) -> DataFrame:
    """Each page is a one-file book."""
    return A.read(spark, sf_dir, "pages").where("page_id IS NOT NULL").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc"), "html")


def _zip_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for n, html in zip(frame["page_id"], frame["html"], strict=True):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
                z.writestr("OPS/Book.opf" if n % 5 == 0 else "OPS/book.opf", f'<package><metadata><title>{"" if n % 7 == 0 else f"Page {n}"}</title><creator>A{n % 3}</creator></metadata><manifest><item id="a" href="text/p%20{n}.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="n"/><itemref idref="a"/></spine></package>')
                z.writestr(f"OPS/text/p {n}.xhtml", html or "")
                if n % 4 < 2:
                    z.writestr("META-INF/encryption.xml", f'<encryption><EncryptedData><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/><CipherData><CipherReference URI="{"OPS/f.otf" if n % 4 else "OPS/text/p.xhtml"}"/></CipherData></EncryptedData></encryption>')
            out.append((f"file:/books/p{n}.epub", b"no archive" if n % 11 == 0 else data.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


def archives(spark, sf_dir: str) -> DataFrame:
    """(path, content): each page as an EPUB; some are no archives, some are protected, some name their package file in other case."""
    pages = A.read(spark, sf_dir, "pages").where("page_id IS NOT NULL").select("page_id", "html")
    return pages.mapInPandas(_zip_pages, "path string, content binary")


@query("""SELECT 'p' || page_id || '.epub' AS book_id, CASE WHEN page_id % 11 = 0 THEN 1 WHEN page_id % 4 < 2 THEN 4 ELSE 3 END AS members, (page_id % 11 = 0)::INT AS errors FROM pages WHERE page_id IS NOT NULL""")
def src1_read_epubs(spark, sf_dir: str) -> DataFrame:
    return epub.epub_members(archives(spark, sf_dir)).groupBy("book_id").agg(F.count("*").alias("members"), F.count_if(F.col("error").isNotNull()).cast("int").alias("errors"))


@query("""SELECT 'p' || page_id || '.epub' AS book_id, CASE WHEN page_id % 7 = 0 THEN 'Untitled book' ELSE 'Page ' || page_id END AS title, 'A' || (page_id % 3) AS author, 'OPS/text/p ' || page_id || '.xhtml' AS path FROM pages WHERE page_id IS NOT NULL AND page_id % 11 <> 0""")
def src2_epub_package(spark, sf_dir: str) -> DataFrame:
    meta, manifest, spine = epub.epub_package(epub.epub_members(archives(spark, sf_dir)))
    return structure.spine_documents(manifest, spine).join(meta, "book_id").select("book_id", "title", "author", "path")


def _zip_linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for n, url in zip(frame["page_id"], frame["url"], strict=True):
            title, data = html.escape(url or "untitled"), io.BytesIO()
            parts = "".join(f'<li><a href="text/p.xhtml#s{k}">Part {k}</a></li>' for k in range(1, n % 3 + 1))
            pages = "".join(f'<li><a href="text/p.xhtml#p{k}">{k}</a></li>' for k in range(1, n % 5 + 1))
            nav = f'<nav epub:type="toc"><ol><li><a href="text/p.xhtml">Nav {title}</a>{f"<ol>{parts}</ol>" if parts else ""}</li></ol></nav>' + (f'<nav epub:type="page-list"><ol>{pages}</ol></nav>' if n % 4 == 2 else "")
            point = lambda label, src, inner="": f'<navPoint><navLabel><text>{label}</text></navLabel><content src="../text/{src}"/>{inner}</navPoint>'
            targets = "".join(f'<pageTarget><navLabel><text>n{k}</text></navLabel><content src="../text/p.xhtml#n{k}"/></pageTarget>' for k in range(1, n % 5 + 1))
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
                item = '<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if n % 4 else ""
                z.writestr("OPS/book.opf", f'<package><manifest>{item}<item id="x" href="ncx/toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="x"/></package>')
                if n % 4:
                    z.writestr("OPS/nav.xhtml", f'<html xmlns:epub="http://www.idpf.org/2007/ops"><body>{nav}{"<p>" if n % 4 == 3 else ""}</body></html>')
                z.writestr("OPS/ncx/toc.ncx", f"<ncx><navMap>{point(f'Ncx {title}', 'p.xhtml', ''.join(point(f'Point {k}', f'p.xhtml#s{k}') for k in range(1, n % 3 + 1)))}</navMap><pageList>{targets}</pageList></ncx>")
            out.append((f"file:/books/p{n}.epub", data.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


@query("""WITH p AS (SELECT 'p' || page_id || '.epub' AS book_id, page_id AS n, page_id % 4 IN (1, 2) AS nav, coalesce(nullif(url, ''), 'untitled') AS title FROM pages WHERE page_id IS NOT NULL),
parts AS (SELECT *, unnest(range(1, n % 3 + 1)) AS k FROM p), leaves AS (SELECT *, unnest(range(1, n % 5 + 1)) AS k FROM p)
SELECT book_id, 'toc' AS kind, 0 AS pos, 0 AS depth, CASE WHEN nav THEN 'Nav ' ELSE 'Ncx ' END || title AS title, 'OPS/text/p.xhtml' AS path, NULL AS fragment FROM p
UNION ALL SELECT book_id, 'toc', k::INT, 1, CASE WHEN nav THEN 'Part ' ELSE 'Point ' END || k, 'OPS/text/p.xhtml', 's' || k FROM parts
UNION ALL SELECT book_id, 'pages', k::INT - 1, 0, CASE WHEN n % 4 = 2 THEN '' ELSE 'n' END || k, 'OPS/text/p.xhtml', CASE WHEN n % 4 = 2 THEN 'p' ELSE 'n' END || k FROM leaves""")
def src2_nav_links(spark, sf_dir: str) -> DataFrame:
    """Each page as an EPUB with an NCX and, but for a quarter, a nav document: without page list, with one, or not well-formed."""
    pages = A.read(spark, sf_dir, "pages").where("page_id IS NOT NULL").select("page_id", "url")
    return epub.nav_links(epub.epub_members(pages.mapInPandas(_zip_linked, "path string, content binary")))


@query("""SELECT 'p' || page_id || '.epub' AS book_id FROM pages WHERE page_id IS NOT NULL AND (page_id % 11 = 0 OR page_id % 4 <> 0)""")
def src3_reject_protected(spark, sf_dir: str) -> DataFrame:
    return epub.reject_protected(epub.epub_members(archives(spark, sf_dir))).select("book_id").distinct()


@query(None)
def src4_html_to_tokens(spark, sf_dir: str) -> DataFrame:
    return epub.html_to_tokens(pages_as_documents(spark, sf_dir)).select("doc", "seq", "kind", "text", "rank", "box_start", "box_end", "anchors")


def _page_blocks(spark, sf_dir: str) -> DataFrame:
    t = epub.html_to_tokens(pages_as_documents(spark, sf_dir)).withColumns({"book_id": F.col("doc"), "spine_pos": F.lit(0)})
    return structure.number_blocks(structure.fill_pages(t))


#: Four documents are an archive, a document one of its files.
ARCHIVE_DOCS = 4


def _archive_file(doc: int, lines: list[str]) -> str:
    """A document as XHTML: most have a heading; every seventh line is boxed with a heading of its own; page numbers are marks in the text, or only listed: places before a line, around it, or inside it."""
    out = [f"<h1>Document {doc}</h1>"] if doc % 3 != 2 else []
    for i, line in enumerate(lines):
        clean = " ".join(line.split())
        body, shut = html.escape(clean), f'<p id="l{i}">' + "{}</p>"
        if i % 10 == 3:
            body = f'<span role="doc-pagebreak" aria-label="i{doc}.{i}">x</span>{body}'
        elif i % 20 == 8:  # a listed place whose text is the label
            body = f'{html.escape(clean[:1])}<span id="p{i}">l{doc}.{i}</span>{html.escape(clean[1:])}'
        elif i % 20 == 18:
            shut = f'<div id="p{i}">{shut}</div>'
        if i % 7 == 6 and clean:
            shut = f'<div class="note"><h2>Note {i}</h2>{shut}</div>'
        out.append(shut.format(body))
    return f"<html><head><title>no text</title></head><body>{''.join(out)}</body></html>"


def _zip_archives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for book, docs, texts in zip(frame["book"], frame["docs"], frame["texts"], strict=True):
            files = [(int(d), t.split("\n")) for d, t in zip(docs, texts, strict=True)]
            href = "f{0}.xhtml".format
            entry = lambda title, link, inner="": f'<li><a href="{link}">{title}</a>{inner}</li>'
            parts = [entry(f"Document {d}" if d % 5 != 4 else f"Extra {d}", href(d) + ("" if d % 5 != 4 else "#none"), f"<ol>{entry(f'Line 5 of {d}', href(d) + '#l5')}</ol>") for d, _ in files]
            pages = [entry(f"l{d}.{i}", f"{href(d)}#p{i}") for d, lines in files for i in range(8, len(lines), 10)]
            nav = f'<nav epub:type="toc"><ol>{"".join(parts)}</ol></nav><nav epub:type="page-list"><ol>{"".join(pages)}</ol></nav>'
            items = "".join(f'<item id="d{d}" href="{href(d)}" media-type="application/xhtml+xml"/>' for d, _ in files)
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
                z.writestr("OPS/book.opf", f'<package><metadata><title>Archive {book}</title></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine><itemref idref="n"/>{"".join(f"""<itemref idref="d{d}"/>""" for d, _ in files)}</spine></package>')
                z.writestr("OPS/nav.xhtml", f'<html xmlns:epub="http://www.idpf.org/2007/ops"><body>{nav}</body></html>')
                for d, lines in files:
                    z.writestr(f"OPS/{href(d)}", _archive_file(d, lines))
            out.append((f"file:/books/{book}", data.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


def document_archives(spark, sf_dir: str) -> DataFrame:
    """(path, content): EPUBs with contents and page list, made of the documents."""
    d = A.documents(spark, sf_dir).select(F.concat(F.lit("k"), F.floor(F.col("doc_id") / ARCHIVE_DOCS).cast("string")).alias("book"), "doc_id", "text")
    each = d.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("d")).select("book", F.col("d.doc_id").alias("docs"), F.col("d.text").alias("texts"))
    return each.mapInPandas(_zip_archives, "path string, content binary")


def _imported(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return epub.import_archives(written(epub.epub_members(document_archives(spark, sf_dir)), "members"))


#: What the archives hold, from the way they are made: p is a place in the reading order, 10 million a document and 10 a line.
ARCHIVES = f"""
a_docs AS (SELECT 'k' || (doc_id // {ARCHIVE_DOCS}) AS book_id, doc_id AS doc, coalesce(text, '') AS body FROM documents WHERE doc_id IS NOT NULL),
a_lines AS (SELECT book_id, doc, unnest(range(len(string_split(body, chr(10))))) AS i, trim(regexp_replace(unnest(string_split(body, chr(10))), '\\s+', ' ', 'g')) AS line FROM a_docs),
a_rows AS (SELECT book_id, doc, doc * 10000000 AS p, 'heading' AS kind, 'Document ' || doc AS text, 1 AS own FROM a_docs WHERE doc % 3 <> 2
  UNION ALL SELECT book_id, doc, doc * 10000000 + (i + 1) * 10, 'heading', 'Note ' || i, 2 FROM a_lines WHERE i % 7 = 6 AND line <> ''
  UNION ALL SELECT book_id, doc, doc * 10000000 + (i + 1) * 10 + 1, 'paragraph', line, CASE WHEN i % 7 = 6 THEN 3 ELSE 0 END FROM a_lines WHERE line <> ''),
a_blocks AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY p) - 1 AS idx FROM a_rows),
a_marks AS (SELECT book_id, doc * 10000000 + (i + 1) * 10 + CASE WHEN i % 20 = 8 THEN 2 ELSE 1 END AS p, CASE WHEN i % 10 = 3 THEN 'i' ELSE 'l' END || doc || '.' || i AS label FROM a_lines WHERE i % 10 = 3 OR i % 10 = 8),
a_links AS (SELECT book_id, doc, (doc % {ARCHIVE_DOCS}) * 2 AS pos, CASE WHEN doc % 5 <> 4 THEN 'Document ' ELSE 'Extra ' END || doc AS title, 0 AS depth, doc % 5 = 4 AS unseen, doc * 10000000 AS p FROM a_docs
  UNION ALL SELECT d.book_id, d.doc, (d.doc % {ARCHIVE_DOCS}) * 2 + 1, 'Line 5 of ' || d.doc, 1, l.i IS NULL, d.doc * 10000000 + CASE WHEN l.i IS NULL THEN 0 ELSE 61 END FROM a_docs d LEFT JOIN a_lines l ON d.doc = l.doc AND l.i = 5),
a_filled AS (SELECT DISTINCT doc FROM a_rows),
a_toc AS (SELECT l.book_id, row_number() OVER (PARTITION BY l.book_id ORDER BY l.doc, l.pos) - 1 AS pos, l.title, l.depth, b.idx AS block_index, CASE WHEN l.unseen AND f.doc IS NOT NULL THEN 'fallback' ELSE 'anchor' END AS via
  FROM a_links l LEFT JOIN a_filled f ON l.doc = f.doc ASOF LEFT JOIN a_blocks b ON l.book_id = b.book_id AND b.p >= l.p),
a_starts AS (SELECT book_id, block_index AS idx, arg_max(title, pos) AS title FROM a_toc WHERE depth = 0 AND via = 'anchor' AND block_index IS NOT NULL GROUP BY ALL),
a_placed AS (SELECT b.*, s.title AS chapter, s.idx AS began, m.label AS page FROM a_blocks b ASOF LEFT JOIN a_starts s ON b.book_id = s.book_id AND b.idx >= s.idx ASOF LEFT JOIN a_marks m ON b.book_id = m.book_id AND b.p >= m.p),
a_heads AS (SELECT book_id, idx, text FROM a_placed WHERE own = 1),
a_headed AS (SELECT b.*, CASE WHEN h.idx >= coalesce(b.began, -1) THEN h.text END AS head FROM a_placed b ASOF LEFT JOIN a_heads h ON b.book_id = h.book_id AND b.idx >= h.idx),
a_out AS (SELECT book_id, idx, kind, text, page, CASE own WHEN 1 THEN 1 WHEN 2 THEN 1 + (head IS NOT NULL)::INT END AS level,
  array_to_string(list_filter([chapter, CASE WHEN chapter IS NULL OR NOT (contains(lower(chapter), lower(head)) OR contains(lower(head), lower(chapter))) THEN head END, CASE WHEN own > 1 THEN 'Note ' || ((p // 10) % 1000000 - 1) END], lambda x: x IS NOT NULL), ' > ') AS path FROM a_headed)"""


@query(f"WITH {ARCHIVES} SELECT * FROM a_out")
def src5_imported_blocks(spark, sf_dir: str) -> DataFrame:
    """From archives to blocks with chapter, headings in force and page; half of the page labels stand in the page list only."""
    blocks = _imported(spark, sf_dir)[1]
    return blocks.select("book_id", "idx", "kind", "text", "page", "level", F.array_join("path", " > ").alias("path"))


@query(f"""WITH {ARCHIVES}, stats AS (SELECT book_id, count(*) AS block_count, count(*) FILTER (kind <> 'heading') AS passage_count, bool_or(page IS NOT NULL) AS has_page_numbers FROM a_out GROUP BY book_id)
SELECT s.*, 'Archive ' || s.book_id AS title, string_agg(t.title || '@' || t.block_index || '/' || t.depth || '/' || t.via, '; ' ORDER BY t.pos) AS contents FROM stats s JOIN a_toc t ON s.book_id = t.book_id AND t.block_index IS NOT NULL WHERE passage_count > 0 GROUP BY ALL""")
def src5_imported_books(spark, sf_dir: str) -> DataFrame:
    """The same import's books with their contents: title, block, depth and how the block was found."""
    entry = lambda t: F.concat(t["title"], F.lit("@"), t["block_index"].cast("string"), F.lit("/"), t["depth"].cast("string"), F.lit("/"), t["via"])
    return _imported(spark, sf_dir)[0].select("book_id", "block_count", "passage_count", "has_page_numbers", "title", F.array_join(F.transform("toc", entry), "; ").alias("contents"))


@query(f"""WITH {ARCHIVES}, marked AS (SELECT l.*, m.label, m.p % 10 AS inside FROM a_lines l LEFT JOIN a_marks m ON l.book_id = m.book_id AND m.p // 10 = (l.doc * 10000000 + (l.i + 1) * 10) // 10),
every AS (SELECT book_id, doc, p, kind, text, CASE own WHEN 1 THEN 1 WHEN 2 THEN 2 END AS rank, NULL AS page_before, NULL AS page_after FROM a_rows WHERE kind = 'heading'
  UNION ALL SELECT book_id, doc, doc * 10000000 + (i + 1) * 10 + 1, 'paragraph', line, NULL, CASE WHEN i % 20 <> 18 AND (inside = 1 OR line = '') THEN label END, CASE WHEN i % 20 <> 18 THEN label END FROM marked WHERE line <> '' OR (label IS NOT NULL AND i % 20 <> 18)
  UNION ALL SELECT book_id, doc, doc * 10000000 + (i + 1) * 10 + 0.5, 'paragraph', '', NULL, label, label FROM marked WHERE i % 20 = 18
  UNION ALL SELECT book_id, doc, doc * 10000000 + 9999990, 'paragraph', '', NULL, NULL, NULL FROM (SELECT book_id, doc, arg_max(line, i) AS line, arg_max(label, i) AS label, arg_max(coalesce(label, ''), i) AS l FROM marked GROUP BY ALL) WHERE line = '' AND l = '')
SELECT book_id, 'OPS/f' || doc || '.xhtml' AS path, row_number() OVER (PARTITION BY doc ORDER BY p) - 1 AS seq, kind, text, rank, page_before, page_after FROM every""")
def src4_archive_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of the archives' files, page marks and listed places with them."""
    parts = written(epub.epub_members(document_archives(spark, sf_dir)), "members")
    rows = epub.package_rows(parts)
    tokens = epub.book_tokens(epub.book_files(parts, rows, epub.nav_links(parts, rows)))
    return tokens.select("book_id", "path", "seq", "kind", "text", "rank", "page_before", "page_after")


@query(None)
def src5_import_books(spark, sf_dir: str) -> DataFrame:
    blocks = _page_blocks(spark, sf_dir)
    meta = A.read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("book_id"), F.col("url").alias("title"))
    return epub.import_books(meta, blocks)[0]


@query("SELECT 'p' || page_id AS book_id, page_id % 7 AS pos, url AS path FROM pages WHERE page_id IS NOT NULL AND page_id % 3 <> 0")
def str1_spine_documents(spark, sf_dir: str) -> DataFrame:
    p = A.read(spark, sf_dir, "pages").where("page_id IS NOT NULL")
    book, item = F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("book_id"), F.concat(F.lit("i"), F.col("page_id").cast("string")).alias("item")
    manifest = p.select(book, item, F.col("url").alias("path"), F.when(F.col("page_id") % 6 == 0, "image/png").otherwise("application/xhtml+xml").alias("media_type"), F.when(F.col("page_id") % 6 == 3, "scripted nav").alias("properties"))
    return structure.spine_documents(manifest, p.select(book, (F.col("page_id") % 7).alias("pos"), item))


@query("""WITH d AS (SELECT 'b' || (doc_id // 100) AS book_id, doc_id, doc_id % 100 AS k FROM documents WHERE doc_id IS NOT NULL),
blocks AS (SELECT book_id, doc_id * 10 + 2 AS g, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) - 1 AS idx FROM d WHERE doc_id % 4 <> 1),
goals AS (SELECT book_id, k AS pos, CASE k % 3 WHEN 0 THEN doc_id * 10 WHEN 1 THEN doc_id * 10 + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END ELSE doc_id * 10 END AS g, CASE WHEN k % 3 = 2 AND doc_id % 4 <> 1 THEN 'fallback' ELSE 'anchor' END AS via FROM d)
SELECT t.book_id, t.pos, t.via, b.idx AS block_index FROM goals t ASOF JOIN blocks b ON t.book_id = b.book_id AND b.g >= t.g""")
def str3_resolve_toc(spark, sf_dir: str) -> DataFrame:
    """Each document is a file with an anchor before or after its only block; a quarter of the files have no block."""
    d = A.documents(spark, sf_dir).select("book_id", "doc_id", (F.col("doc_id") % 100).cast("int").alias("k"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") * 10).alias("g0"))
    anchor = F.when(F.col("doc_id") % 2 == 0, F.col("g0") + 3).otherwise(F.col("g0") + 1)
    anchors = d.select("book_id", "path", F.lit(None).cast("string").alias("fragment"), F.col("g0").alias("g")).unionByName(d.select("book_id", "path", F.lit("a").alias("fragment"), anchor.alias("g")))
    idx = F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id")) - 1
    blocks = d.where("doc_id % 4 <> 1").select("book_id", "path", (F.col("g0") + 2).alias("g"), idx.alias("idx"))
    links = d.select("book_id", F.col("k").alias("pos"), F.lit("t").alias("title"), F.lit(0).alias("depth"), "path", F.when(F.col("k") % 3 == 1, "a").when(F.col("k") % 3 == 2, "none").alias("fragment"))
    return structure.resolve_toc(links, anchors, blocks).select("book_id", "pos", "via", "block_index")


def _headed(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = A.blocks(spark, sf_dir).select("book_id", F.col("doc_id").alias("chapter_start"), F.col("idx").alias("seq"), "text")
    b = b.withColumn("kind", F.when(F.col("seq") % 4 == 0, "heading").otherwise("paragraph"))
    h = b.where("kind = 'heading'").select("book_id", "chapter_start", "seq", (F.col("seq") % 12 / 4 + 1).cast("int").alias("rank"), F.concat(F.lit("H"), F.col("seq").cast("string")).alias("text"), F.when(F.col("seq") % 20 == 8, F.col("seq") + 6).alias("scope_end"))
    return b, h


_HEADED = A.BLOCKS + """,
b AS (SELECT book_id, doc_id AS c, idx AS seq, CASE WHEN idx % 4 = 0 THEN 'heading' ELSE 'paragraph' END AS kind FROM blocks),
h AS (SELECT book_id, c, seq AS hs, (seq % 12 // 4 + 1)::INT AS rank, 'H' || seq AS t, CASE WHEN seq % 20 = 8 THEN seq + 6 END AS stop FROM b WHERE kind = 'heading'),
cov AS (SELECT b.*, hs, rank, t FROM b JOIN h ON b.book_id = h.book_id AND b.c = h.c AND hs <= seq AND (stop IS NULL OR seq <= stop)),
live AS (SELECT * FROM cov x WHERE NOT EXISTS (SELECT 1 FROM cov y WHERE y.book_id = x.book_id AND y.c = x.c AND y.seq = x.seq AND y.hs > x.hs AND y.rank <= x.rank)),
lists AS (SELECT b.book_id, b.seq, b.kind, b.c, coalesce(string_agg(t, '>' ORDER BY hs), '') AS headings, count(t) AS n FROM b LEFT JOIN live l ON b.book_id = l.book_id AND b.c = l.c AND b.seq = l.seq GROUP BY ALL)"""


@query(f"WITH {_HEADED} SELECT book_id, seq, headings FROM lists")
def str5_heading_path(spark, sf_dir: str) -> DataFrame:
    return structure.heading_path(*_headed(spark, sf_dir)).select("book_id", "seq", F.array_join("headings", ">").alias("headings"))


@query(f"WITH {_HEADED} SELECT book_id, seq, CASE WHEN kind = 'heading' THEN n::INT END AS level FROM lists")
def str6_heading_level(spark, sf_dir: str) -> DataFrame:
    return structure.heading_path(*_headed(spark, sf_dir)).select("book_id", "seq", structure.heading_level(F.col("kind"), F.col("headings")).alias("level"))


@query(f"""WITH {_HEADED}, rest AS (SELECT book_id, seq, CASE WHEN starts_with(headings, 'H') THEN CASE WHEN contains(headings, '>') THEN substring(headings, instr(headings, '>') + 1) ELSE '' END ELSE headings END AS r FROM lists)
SELECT book_id, seq, CASE WHEN r = '' THEN 'h' ELSE 'h>' || r END AS path FROM rest""")
def str7_build_path(spark, sf_dir: str) -> DataFrame:
    """Chapter "h": the first heading, which contains it, is skipped."""
    p = structure.build_path(F.lit("h"), F.col("headings"))
    return structure.heading_path(*_headed(spark, sf_dir)).select("book_id", "seq", F.array_join(p, ">").alias("path"))


_BUNDLE = {
    "books": "id string, title string, block_count bigint",
    "blocks": "book_id string, idx bigint, kind string, text string, path array<string>",
    "questions": "id string, book_id string, source string, stem string, options array<string>, answer int, block_indexes array<bigint>, chapter string, created_at bigint, flagged boolean, flagged_at bigint",
    "attempts": "id bigint, user_id bigint, question_id string, book_id string, chosen int, at bigint",
}


def bundle_tables(spark, sf_dir: str) -> dict[str, DataFrame]:
    q = A.questions(spark, sf_dir)
    attempts = bank.record_attempts(A.attempts(spark, sf_dir), q)
    full = {"books": A.books(spark, sf_dir), "blocks": A.blocks(spark, sf_dir), "questions": q, "attempts": attempts}
    return {name: full[name].select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema)]) for name, schema in _BUNDLE.items()}


def _exported(spark, sf_dir: str) -> str:
    path = scratch(spark, "bundle")
    bundle.export_bundle(bundle_tables(spark, sf_dir), path, 1704067200000)
    return path


@query(f"WITH {A.QUESTIONS} SELECT id, book_id, source, stem, array_to_string(options, ',') AS options, answer, created_at, flagged, flagged_at FROM questions")
def src9_src10_bundle_round_trip(spark, sf_dir: str) -> DataFrame:
    back = bundle.read_bundle(spark, _exported(spark, sf_dir), {k: StructType.fromDDL(v) for k, v in _BUNDLE.items()})
    return back["questions"].select("id", "book_id", "source", "stem", F.array_join("options", ",").alias("options"), "answer", "created_at", "flagged", "flagged_at")


@query(f"""WITH {A.QUESTIONS}, {A.BOOKS.strip()}, {A.BLOCKS.strip()}, {A.ATTEMPTS.strip()}
SELECT 'books' AS name, id AS key, title || '|' || block_count AS held FROM books UNION ALL SELECT 'blocks', book_id || ':' || idx, kind || '|' || path[1] || '|' || text FROM blocks
UNION ALL SELECT 'questions', id, chapter || '|' || array_to_string(block_indexes, ',') FROM questions UNION ALL SELECT 'attempts', a.id::VARCHAR, a.question_id || '|' || q.book_id || '|' || a.chosen || '|' || a."at" FROM attempts a JOIN questions q ON a.question_id = q.id""")
def src9_src10_all_tables(spark, sf_dir: str) -> DataFrame:
    """All four tables of a bundle, written and read back."""
    back = bundle.read_bundle(spark, _exported(spark, sf_dir), {k: StructType.fromDDL(v) for k, v in _BUNDLE.items()})
    said = lambda *c: F.concat_ws("|", *[x if not isinstance(x, str) else F.col(x).cast("string") for x in c]).alias("held")
    key = F.col("id").cast("string").alias("key")
    rows = {
        "books": back["books"].select(key, said("title", "block_count")), "blocks": back["blocks"].select(F.concat_ws(":", "book_id", F.col("idx").cast("string")).alias("key"), said("kind", F.get("path", 0), "text")),
        "questions": back["questions"].select(key, said("chapter", F.array_join("block_indexes", ","))), "attempts": back["attempts"].select(key, said("question_id", "book_id", "chosen", "at")),
    }
    return functools.reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name"), "key", "held") for name, df in rows.items()])


@query(f"SELECT event_id AS id, '{bundle.APP}-' || strftime(ts, '%Y-%m-%d-%H%M') AS name FROM events")
def src9_bundle_names(spark, sf_dir: str) -> DataFrame:
    """The file name of a bundle that is saved at each event's time."""
    return A.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), bundle.bundle_name(F.col("ts")).alias("name"))


@query("SELECT 'ok' AS verdict, 0::BIGINT AS bad_books, 0::BIGINT AS bad_blocks, 0::BIGINT AS bad_questions, 0::BIGINT AS bad_attempts")
def src11_check_bundle(spark, sf_dir: str) -> DataFrame:
    path = _exported(spark, sf_dir)
    raw = {t: bundle.read_raw(spark, path, t) for t in bundle.TABLES}
    return bundle.check_bundle(bundle.read_raw(spark, path, "header"), raw)


@query("""WITH n AS (SELECT count(*) AS questions, count(*) FILTER (doc_id % 10 = 0) AS bad FROM documents WHERE doc_id IS NOT NULL)
SELECT 'newer format' AS given, 'too_new' AS verdict, 0::BIGINT AS bad_questions, 0::BIGINT AS bad_blocks FROM n UNION ALL SELECT 'other app', 'not_ours', 0, 0 FROM n UNION ALL SELECT 'other app, newer', 'not_ours', 0, 0 FROM n
UNION ALL SELECT 'no header', 'not_ours', 0, 0 FROM n UNION ALL SELECT 'wrong field', CASE WHEN bad > 0 THEN 'damaged' ELSE 'ok' END, bad, 0 FROM n UNION ALL SELECT 'broken line', CASE WHEN bad > 0 THEN 'damaged' ELSE 'ok' END, bad, 0 FROM n UNION ALL SELECT 'no blocks', 'damaged', 0, NULL FROM n""")
def src11_refused_bundles(spark, sf_dir: str) -> DataFrame:
    """The exported bundle of the given tables, changed in the ways that are refused."""
    path = _exported(spark, sf_dir)
    raw, header = {t: bundle.read_raw(spark, path, t) for t in bundle.TABLES}, bundle.read_raw(spark, path, "header")
    tenth = F.get_json_object("value", "$.id").rlike("^q[0-9]*0$")
    spoilt = lambda value: {**raw, "questions": raw["questions"].select(F.when(tenth, value).otherwise(F.col("value")).alias("value"))}
    other = header.select(F.replace("value", F.lit(f'"{bundle.APP}"'), F.lit('"other"')).alias("value"))
    newer = lambda head: head.select(F.replace("value", F.lit(f'"format":{bundle.FORMAT}'), F.lit(f'"format":{bundle.FORMAT + 1}')).alias("value"))
    cases = {
        "newer format": (newer(header), raw), "other app": (other, raw), "other app, newer": (newer(other), raw), "no header": (header.limit(0), raw),
        "wrong field": (header, spoilt(F.regexp_replace("value", '"answer":[0-9]+', '"answer":"x"'))), "broken line": (header, spoilt(F.substring("value", 1, 9))), "no blocks": (header, {**raw, "blocks": None}),
    }
    rows = [bundle.check_bundle(*given).select(F.lit(name).alias("given"), "verdict", "bad_questions", "bad_blocks") for name, given in cases.items()]
    return functools.reduce(DataFrame.unionByName, rows)


def exported_files(spark, path: str, table: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{table}").select("path", "content")


@query("""WITH n AS (SELECT count(*) AS n FROM documents WHERE doc_id IS NOT NULL)
SELECT 'whole' AS given, 'ok' AS verdict, n AS questions FROM n UNION ALL SELECT 'plain text named gz', 'ok', n FROM n UNION ALL SELECT 'cut off gzip', 'damaged', NULL FROM n UNION ALL SELECT 'broken gzip', 'damaged', NULL FROM n
UNION ALL SELECT 'binary junk', 'damaged', 0 FROM n UNION ALL SELECT 'junk as header', 'not_ours', n FROM n UNION ALL SELECT 'broken header', 'damaged', n FROM n""")
def src10_unreadable_bundles(spark, sf_dir: str) -> DataFrame:
    """The exported bundle, with files that a reader by file name would fail on."""
    path = _exported(spark, sf_dir)
    files = {t: exported_files(spark, path, t) for t in ("header", *bundle.TABLES)}
    q, content = files["questions"], F.col("content")
    plain = bundle.decoded_lines(q).groupBy("file").agg(F.array_join(F.collect_list("value"), "\n").alias("t")).select(F.col("file").alias("path"), F.encode("t", "UTF-8").alias("content"))
    half = F.substring(content, F.lit(1), F.length(content) - 20)
    spoilt = F.concat(F.substring(content, F.lit(1), F.lit(12)), F.unhex(F.lit("ffffffffffff")), F.substring(content, F.lit(30), F.length(content)))
    with_ = lambda df, c: df.select("path", c.alias("content"))
    junk = F.unhex(F.lit("fffe00ff0a80"))
    cases = {
        "whole": {}, "plain text named gz": {"questions": plain}, "cut off gzip": {"questions": with_(q, half)}, "broken gzip": {"questions": with_(q, spoilt)},
        "binary junk": {"questions": with_(q, junk)}, "junk as header": {"header": with_(files["header"], junk)}, "broken header": {"header": with_(files["header"], half)},
    }
    rows = []
    for name, changed in cases.items():
        raw = {t: bundle.decoded_lines(f) for t, f in {**files, **changed}.items()}
        n = raw["questions"].agg(F.count("value").alias("questions"))
        n = n.withColumn("questions", F.lit(None).cast("long")) if name in ("cut off gzip", "broken gzip") else n
        rows.append(bundle.check_bundle(raw["header"], raw).select(F.lit(name).alias("given"), "verdict").join(n, F.lit(True)))
    return functools.reduce(DataFrame.unionByName, rows)


@query(f"WITH {A.BLOCKS}, n AS (SELECT book_id, count(*) AS c FROM blocks GROUP BY book_id) SELECT book_id, idx, text FROM blocks JOIN n USING (book_id) WHERE idx >= c // 4 AND idx < c * 3 // 4")
def src6_stored_ranges(spark, sf_dir: str) -> DataFrame:
    """The middle half of every book, from books that were written and are read by bucket."""
    path = scratch(spark, "books")
    epub.write_books(A.books(spark, sf_dir), A.blocks(spark, sf_dir), path)
    c = F.count("*")
    asked = spark.read.parquet(f"{path}/blocks").groupBy("book_id").agg(F.floor(c / 4).alias("start"), F.floor(c * 3 / 4).alias("end"))
    return passages.stored_ranges(spark, path, asked).select("book_id", "idx", "text")


# ---------------------------------------------------------------- streams


def _event_stream(spark, sf_dir: str) -> DataFrame:
    """The events table as a stream of one file; a plain file is given to the stream by its folder and name."""
    schema = A.read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id AS id, user_id FROM events")
def stm1_attempts_stream(spark, sf_dir: str) -> DataFrame:
    e = _event_stream(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", "ts")
    twice = e.unionByName(e)
    out = scratch(spark, "attempts")
    streams.run_into(twice, streams.append_new(out, "one"), scratch(spark, "stream"))
    streams.run_into(e, streams.append_new(out, "two"), scratch(spark, "stream"))  # another stream brings them again
    return spark.read.parquet(out).select("id", "user_id")


@query("SELECT event_id AS id, user_id FROM events")
def stm1_bounded_attempts(spark, sf_dir: str) -> DataFrame:
    """The form with bounded state: repeats within the watermark's delay are dropped, state older than it is let go."""
    e = _event_stream(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", "ts")
    out = scratch(spark, "bounded")
    once = streams.attempts_stream(e.unionByName(e), "400 days").select("id", "user_id")
    once.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH {A.ATTEMPTS.replace(A.DOCUMENT_COUNT, '1000')} SELECT user_id, question_id, id, chosen, \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY \"at\" DESC, id) AS n FROM attempts) WHERE n = 1")
def stm2_last_attempt_stream(spark, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    e = _event_stream(spark, sf_dir).select(n.alias("id"), "user_id", F.concat(F.lit("q"), (n * 7 % 1000).cast("string")).alias("question_id"), (F.floor(n / 3) % 4).cast("int").alias("chosen"), F.floor(F.unix_micros("ts") / 3600000000).alias("at"))
    return streams.run_available(streams.last_attempt_stream(e), scratch(spark, "last"), scratch(spark, "stream"))


@query(f"WITH {A.ATTEMPTS} SELECT user_id, question_id, \"at\", id, chosen FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY \"at\" DESC, id) AS n FROM attempts) WHERE n = 1")
def stm2_last_attempt_state(spark, sf_dir: str) -> DataFrame:
    """The running last attempt from keyed state: only changed keys leave a batch, into a versioned table. Questions are as many as the documents."""
    n, count = F.col("event_id"), A.read(spark, sf_dir, "documents").agg(F.max("doc_id") + 1).first()[0] or 1
    e = _event_stream(spark, sf_dir).select(n.alias("id"), "user_id", F.concat(F.lit("q"), (n * 7 % count).cast("string")).alias("question_id"), (F.floor(n / 3) % 4).cast("int").alias("chosen"), F.floor(F.unix_micros("ts") / 3600000000).cast("long").alias("at"))
    path = scratch(spark, "last")
    streams.run_upserts(streams.newest_by_key(e, ["user_id", "question_id"], ["at", "id", "chosen"], less_is_better=True), path, scratch(spark, "stream"))
    return streams.current(spark, path, ["user_id", "question_id"])


@query("""WITH c AS (SELECT 'q' || (event_id * 7 % 1000) AS id, event_id % 3 = 0 AS flagged, floor(epoch_us(ts) / 3600000000)::BIGINT AS "at" FROM events)
SELECT id, flagged, "at" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "at" DESC, flagged DESC) AS n FROM c) WHERE n = 1""")
def stm2_flag_stream(spark, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    e = _event_stream(spark, sf_dir).select(F.concat(F.lit("q"), (n * 7 % 1000).cast("string")).alias("id"), (n % 3 == 0).alias("flagged"), F.floor(F.unix_micros("ts") / 3600000000).alias("at"))
    return streams.run_available(streams.flag_stream(e), scratch(spark, "flags"), scratch(spark, "stream"))


@query(f"WITH {A.CALLS}, d AS (SELECT *, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::DATE AS day FROM calls) SELECT day, model, count(*) AS requests, bool_or(used_up) AS used_up FROM d GROUP BY day, model")
def stm3_daily_usage_stream(spark, sf_dir: str) -> DataFrame:
    e = _event_stream(spark, sf_dir).select(F.col("event_type").alias("model"), "ts", (F.col("event_id") % 97 == 0).alias("used_up"))
    return streams.run_available(streams.daily_usage_stream(e), scratch(spark, "usage"), scratch(spark, "stream"))

