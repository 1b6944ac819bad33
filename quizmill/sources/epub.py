"""EPUB corpora: archives to members, package data and block tokens. Archives are read by Spark's binaryFile source; helpers only turn one member into flat rows, everything else is joins and windows."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.functions.scratch import written
from quizmill.functions.text import fragment_of, resolve_path
from quizmill.operators import passages, structure

# Elements that hold blocks, and elements whose content is not book text.
_BLOCK = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table ul".split())
_SKIP = set("script style nav head template noscript rt rp audio video object embed iframe canvas svg".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_FONT = re.compile(r"\.(otf|ttf|woff2?)$", re.IGNORECASE)
_OBFUSCATION = {"http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC"}
_WS = re.compile(r"\s+")

_TOKENS = "doc string, seq int, kind string, text string, rank int, box_start int, box_end int, page_before string, page_after string, anchors array<string>, rows array<array<string>>"


def _wanted(name: str) -> bool:
    return name.lower().endswith((".xml", ".opf", ".ncx", ".xhtml", ".html", ".htm"))


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            book, rows = path.rsplit("/", 1)[-1], []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if _wanted(info.filename) and not info.is_dir():
                            rows.append((book, info.filename, z.read(info).decode("utf-8-sig", "replace"), None))
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                rows = [(book, None, None, "not a valid EPUB: it cannot be opened")]
            if not any((p or "").lower() == "meta-inf/container.xml" for _, p, _, _ in rows) and not rows[:1] == [(book, None, None, "not a valid EPUB: it cannot be opened")]:
                rows = [(book, None, None, "not a valid EPUB: container.xml is missing")]
            yield pd.DataFrame(rows, columns=["book_id", "path", "text", "error"])


def epub_members(files: DataFrame) -> DataFrame:
    """(book_id, path, text, error) of archives (path, content): a row for each XML or HTML member; an archive that cannot be read is one row with an error."""
    return files.select("path", "content").mapInPandas(_members, "book_id string, path string, text string, error string")


def read_epubs(spark, path: str) -> DataFrame:
    """The members of all EPUB files under a path."""
    return epub_members(spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path))


def _suffix(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def member(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (book_id, want; other columns stay) with the member's path and text: the exact name, else the same name in other case. Names meet first; then a text moves once, and only if its name ends like one that is wanted (the few endings of epub_members come to the driver)."""
    named = parts.where(F.col("path").isNotNull()).select("book_id", "path", F.lower("path").alias("_low"))
    joined = wanted.select("book_id", "want", F.lower("want").alias("_low")).join(named, ["book_id", "_low"])
    best = joined.groupBy("book_id", "want").agg(F.min_by("path", F.struct((F.col("path") != F.col("want")).cast("int"), "path")).alias("path"))
    endings = [r[0] for r in best.select(_suffix(F.col("path"))).distinct().collect()]
    texts = parts.where(_suffix(F.col("path")).isin(endings)).select("book_id", "path", "text")
    found = wanted.join(best, ["book_id", "want"]).join(texts, ["book_id", "path"]).dropDuplicates(["book_id", "path", "want"])  # an archive may hold a name twice
    return found.select(*wanted.columns, "path", "text")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(el, name: str) -> str:
    return next((v for k, v in el.attrib.items() if _local(k) == name), "")


def _xml(text: str):
    try:
        return ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text))
    except ElementTree.ParseError:
        return None


def _clean(text: str) -> str:
    return _WS.sub(" ", text.replace("\u00ad", "")).strip()


def _package(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for book, path, text in zip(frame["book_id"], frame["path"], frame["text"], strict=True):
            root = _xml(text)
            if root is None:
                continue
            for el in root.iter():
                name, own = _local(el.tag), _clean("".join(el.itertext()))
                if name in ("title", "creator", "language"):
                    out.append((book, name, path, len(out), own, None, None, None))
                elif name == "item":
                    out.append((book, "item", path, len(out), _attr(el, "id"), _attr(el, "href"), _attr(el, "media-type"), _attr(el, "properties")))
                elif name == "itemref":
                    out.append((book, "itemref", path, len(out), _attr(el, "idref"), None, None, None))
                elif name == "spine":
                    out.append((book, "spine", path, len(out), _attr(el, "toc"), None, None, None))
        yield pd.DataFrame(out, columns=["book_id", "kind", "opf", "pos", "value", "href", "media_type", "properties"])


def package_rows(parts: DataFrame) -> DataFrame:
    """The elements of each book's package file, in order."""
    container = member(parts, parts.select("book_id").distinct().withColumn("want", F.lit("META-INF/container.xml")))
    opf = container.select("book_id", F.regexp_extract("text", "full-path\\s*=\\s*[\"']([^\"']+)", 1).alias("want"))
    return member(parts, opf).select("book_id", "path", "text").mapInPandas(_package, "book_id string, kind string, opf string, pos int, value string, href string, media_type string, properties string")


def epub_package(parts: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """meta (book_id, title, author, language), manifest (book_id, item, path, media_type, properties), spine (book_id, pos, item). rows: package_rows, if the caller has them."""
    rows = package_rows(parts) if rows is None else rows
    first = lambda kind: F.min_by(F.when((F.col("kind") == kind) & (F.col("value") != ""), F.col("value")), F.when((F.col("kind") == kind) & (F.col("value") != ""), F.col("pos")))
    meta = rows.groupBy("book_id").agg(F.coalesce(first("title"), F.lit("Untitled book")).alias("title"), first("creator").alias("author"), first("language").alias("language"))
    manifest = rows.where((F.col("kind") == "item") & (F.col("value") != "") & (F.col("href") != "")).select("book_id", F.col("value").alias("item"), resolve_path(F.col("opf"), F.col("href")).alias("path"), "media_type", "properties")
    return meta, manifest, rows.where("kind = 'itemref'").select("book_id", "pos", F.col("value").alias("item"))


_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);)\w+;")


def _list_links(ol, depth: int) -> Iterator[tuple]:
    """(depth, title, href) of a nested list; an entry without a link does not deepen what it holds."""
    for li in (e for e in ol if _local(e.tag) == "li"):
        label = next((e for name in ("a", "span") for e in li if _local(e.tag) == name), None)
        title, href = ("", "") if label is None else (_clean("".join(label.itertext())), _attr(label, "href"))
        if title and href:
            yield depth, title, href
        nested = next((e for e in li if _local(e.tag) == "ol"), None)
        if nested is not None:
            yield from _list_links(nested, depth + 1 if title and href else depth)


def _named(el, name: str):
    return (e for e in el.iter() if e is not el and _local(e.tag) == name)


def _ncx_link(el, depth: int, content) -> Iterator[tuple]:
    title, src = _clean("".join(t for e in [next(_named(el, "text"), None)] if e is not None for t in e.itertext())), "" if content is None else _attr(content, "src")
    if title and src:
        yield depth, title, src


def _points(el, depth: int) -> Iterator[tuple]:
    for point in (e for e in el if _local(e.tag) == "navPoint"):
        yield from _ncx_link(point, depth, next((e for e in point if _local(e.tag) == "content"), None))
        yield from _points(point, depth + 1)


def member_links(text: str, ncx: bool) -> dict[str, list[tuple]]:
    """Contents ("toc") and page list ("pages") of a nav document or an NCX as (depth, title, href); empty if it is not well-formed."""
    root = _xml(_ENTITY.sub(lambda m: unescape(m.group(0)), text))
    if root is None:
        return {}
    if ncx:
        nav_map = next(_named(root, "navMap"), None)
        pages = [x for target in _named(root, "pageTarget") for x in _ncx_link(target, 0, next(_named(target, "content"), None))]
        return {"toc": [] if nav_map is None else list(_points(nav_map, 0)), "pages": pages}
    navs = list(_named(root, "nav"))
    typed = lambda name: next((n for n in navs if name in _attr(n, "type").split()), None)
    toc = typed("toc")
    lists = {"toc": toc if toc is not None else next(iter(navs), None), "pages": typed("page-list")}
    return {kind: list(_list_links(ol, 0)) for kind, nav in lists.items() if nav is not None and (ol := next(_named(nav, "ol"), None)) is not None}


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = frame[["book_id", "path", "text", "ncx"]].itertuples(index=False)
        out = [(book, path, int(ncx), kind, pos, *link) for book, path, text, ncx in rows for kind, links in member_links(text, ncx).items() for pos, link in enumerate(links)]
        yield pd.DataFrame(out, columns=["book_id", "source", "ncx", "kind", "pos", "depth", "title", "href"])


def nav_links(parts: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(book_id, kind, pos, depth, title, path, fragment): contents ("toc") and page list ("pages") of each book. The nav document comes first; the NCX (the one the spine names, else the first by media type) fills each kind that the nav document lacks. rows: package_rows, if the caller has them."""
    rows = package_rows(parts) if rows is None else rows
    item = rows.where((F.col("kind") == "item") & (F.col("value") != "") & (F.col("href") != ""))
    item = item.select("book_id", "pos", "value", resolve_path(F.col("opf"), F.col("href")).alias("want"), "media_type", F.array_contains(F.split("properties", "\\s+"), "nav").alias("nav"))
    named = rows.where("kind = 'spine'").groupBy("book_id").agg(F.min_by("value", "pos").alias("toc"))
    first = lambda df, order: df.groupBy("book_id").agg(F.min_by("want", order).alias("want"))
    nav = first(item.where("nav"), F.col("pos")).withColumn("ncx", F.lit(False))
    by_name = F.col("value").eqNullSafe(F.col("toc"))
    ncx = item.join(named, "book_id", "left").where(by_name | (F.col("media_type") == "application/x-dtbncx+xml"))
    ncx = first(ncx, F.struct((~by_name).cast("int"), "pos")).withColumn("ncx", F.lit(True))
    wanted = nav.unionByName(ncx)
    found = member(parts, wanted.select("book_id", "want").distinct()).join(wanted, ["book_id", "want"])
    links = found.select("book_id", F.col("want").alias("path"), "text", "ncx").mapInPandas(_links, "book_id string, source string, ncx int, kind string, pos int, depth int, title string, href string")
    chosen = links.groupBy("book_id", "kind").agg(F.min("ncx").alias("ncx"))
    links = links.join(chosen, ["book_id", "kind", "ncx"])
    return links.select("book_id", "kind", "pos", "depth", "title", resolve_path(F.col("source"), F.col("href")).alias("path"), fragment_of(F.col("href")).alias("fragment"))


def protected(parts: DataFrame) -> DataFrame:
    """(book_id): copy-protected books. Only fonts may be encrypted, by the two obfuscations."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bad = []
            for book, text in zip(frame["book_id"], frame["text"], strict=True):
                root = _xml(text)
                data = [] if root is None else [e for e in root.iter() if _local(e.tag) == "EncryptedData"]
                for d in data:
                    algorithm = next((_attr(e, "Algorithm") for e in d.iter() if _local(e.tag) == "EncryptionMethod"), "")
                    uri = next((_attr(e, "URI") for e in d.iter() if _local(e.tag) == "CipherReference"), "")
                    if not (_FONT.search(uri) and algorithm in _OBFUSCATION):
                        bad.append(book)
            yield pd.DataFrame({"book_id": bad}, dtype="object")

    return parts.where(F.lower("path") == "meta-inf/encryption.xml").select("book_id", "text").mapInPandas(found, "book_id string").distinct()


def reject_protected(parts: DataFrame) -> DataFrame:
    """Members of books that are not copy-protected."""
    return parts.join(protected(parts), "book_id", "left_anti")


class _Walker(HTMLParser):
    """Block tokens of one document: (kind, text, rank, box_start, box_end, page_before, page_after, anchors, rows)."""

    def __init__(self, listed: dict[str, str] | None = None):
        super().__init__(convert_charrefs=True)
        self.listed = listed or {}
        self.tokens: list[dict] = []
        self.stack: list[dict] = []
        self.skip = 0
        self.text: list[str] = []
        self.anchors: list[str] = []
        self.page_before = self.page_after = None
        self.marks: list[dict] = []
        self.emitted = 0
        self.table: dict | None = None
        self.in_body = False

    def _flush(self) -> None:
        text = _clean("".join(self.text))
        if text or self.page_before or self.page_after:
            top = next((x for x in reversed(self.stack) if x["tag"] in _BLOCK), {"tag": "body"})
            heading = re.fullmatch(r"h[1-6]", top["tag"])
            sections = sum(x["tag"] in ("section", "article") for x in self.stack)
            item = any(x["tag"] == "li" for x in self.stack)
            self.tokens.append({"kind": "heading" if heading else "list-item" if item else "paragraph", "text": text, "rank": 10 * sections + int(top["tag"][1]) if heading else None, "page_before": self.page_before, "page_after": self.page_after, "anchors": self.anchors, "rows": None, "boxes": [x["box"] for x in self.stack if x["tag"] in _BLOCK and not re.fullmatch(r"h[1-6]|body|p", x["tag"])]})
            self.anchors, self.page_before, self.page_after = [], None, None
        self.text = []
        self.emitted += 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "body":
            self.in_body = True
        if self.skip or tag in _SKIP:
            self.skip += tag not in _VOID
            return
        if self.table is None and tag in _BLOCK:
            self._flush()
        if tag == "hr":
            return
        if a.get("id"):
            self.anchors.append(a["id"])
        listed = self.listed.get(a.get("id") or "")
        broken = "pagebreak" in (a.get("epub:type") or "").split() or a.get("role") == "doc-pagebreak"
        if (listed or broken) and tag != "table":
            label = listed or _clean(a.get("aria-label") or a.get("title") or "")
            mark = {"depth": len(self.stack), "listed": listed, "broken": broken, "at": len(self.text), "emitted": self.emitted, "before": not _clean("".join(self.text)), "told": bool(label)}
            self._turn(label, mark["before"])
            if tag not in _VOID:
                self.marks.append(mark)
        if tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            return
        self.stack.append({"tag": tag, "box": len(self.tokens)})
        if tag == "table" and self.table is None:
            self.table = {"rows": [], "caption": None, "depth": len(self.stack)}
        elif self.table is not None and tag == "tr":
            self.table["rows"].append([])
        elif self.table is not None and tag in ("td", "th", "caption"):
            self.text = []

    def _turn(self, label: str, before: bool) -> None:
        """A page begins here: before the text of the block, or inside it. Marks in tables are not read."""
        if label and self.table is None:
            if before:
                self.page_before = label
            self.page_after = label

    def _end_mark(self) -> None:
        """What a mark holds is the page number and no text of the book: always for a page break, for a listed place if it is hardly more than the label. A mark around blocks only turns the page."""
        mark = self.marks.pop()
        if self.emitted != mark["emitted"]:
            return
        own = _clean("".join(self.text[mark["at"] :]))
        if not mark["told"]:
            self._turn(own, mark["before"])
        if mark["broken"] or (len(own) <= len(mark["listed"]) + 4 and mark["listed"] in own):
            del self.text[mark["at"] :]

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.skip -= tag not in _VOID
            return
        if not any(x["tag"] == tag for x in self.stack):
            return
        while self.marks and len(self.stack) - next(i for i, x in enumerate(reversed(self.stack), 1) if x["tag"] == tag) <= self.marks[-1]["depth"]:
            self._end_mark()
        if self.table is not None and tag in ("td", "th"):
            if self.table["rows"]:
                self.table["rows"][-1].append(_clean("".join(self.text)))
            self.text = []
        elif self.table is not None and tag == "caption":
            self.table["caption"], self.text = _clean("".join(self.text)), []
        elif self.table is not None and tag == "table" and len(self.stack) <= self.table["depth"]:
            self._end_table()
        elif self.table is None and tag in _BLOCK:
            self._flush()
        elif tag in _BLOCK:
            self.text.append(" ")
        while self.stack.pop()["tag"] != tag:
            pass

    def _end_table(self) -> None:
        t, self.table, self.text = self.table, None, []
        rows = [r for r in t["rows"] if any(r)]
        boxes = [x["box"] for x in self.stack if x["tag"] in _BLOCK and x["tag"] not in ("body", "table")]
        if rows:
            base = {"rank": None, "page_before": None, "page_after": None, "anchors": self.anchors, "boxes": boxes}
            if t["caption"]:
                self.tokens.append({"kind": "paragraph", "text": t["caption"], "rows": None, **base})
                base["anchors"] = []
            self.tokens.append({"kind": "table", "text": "\n".join(" | ".join(r) for r in rows), "rows": rows, **base})
            self.anchors = []

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        self.text.append(data)


def tokenize(html: str, listed: dict[str, str] | None = None) -> list[dict]:
    """Tokens in order. `listed`: page labels by id, from the book's page list; they go before marks in the text. box_start and box_end are those of the innermost box of a heading that has other content too (null: open to the end)."""
    w = _Walker(listed)
    body = re.search(r"<body[^>]*>(.*?)(?:</body\s*>|\Z)", html, re.DOTALL | re.IGNORECASE)
    w.feed(body.group(1) if body else html)
    w.close()
    w._flush()
    tokens = w.tokens
    if w.anchors:  # places behind the last text: what follows is in another file
        tokens.append({"kind": "paragraph", "text": "", "rank": None, "page_before": None, "page_after": None, "anchors": w.anchors, "rows": None, "boxes": []})
    for i, t in enumerate(tokens):
        t["box_start"] = t["box_end"] = None
        if t["kind"] != "heading":
            continue
        for start in reversed(t["boxes"]):
            end = i
            while end + 1 < len(tokens) and start in tokens[end + 1]["boxes"]:
                end += 1
            if any(x["kind"] != "heading" and x["text"] for x in tokens[start : end + 1]):
                t["box_start"], t["box_end"] = start, end
                break
    return tokens


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for doc, html, listed in zip(frame["doc"], frame["html"], frame["listed"], strict=True):
            out += [(doc, i, t["kind"], t["text"], t["rank"], t["box_start"], t["box_end"], t["page_before"], t["page_after"], t["anchors"], t["rows"]) for i, t in enumerate(tokenize(html or "", json.loads(listed) if listed else None))]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _TOKENS.split(", ")]).astype({"rank": "Int32", "box_start": "Int32", "box_end": "Int32"})


def html_to_tokens(pages: DataFrame) -> DataFrame:
    """Block tokens of `pages` (doc, html, and listed if the book has a page list: label by id): headings, paragraphs, list items and tables in reading order; a token without text only carries a page label or anchors."""
    listed = F.to_json("listed") if "listed" in pages.columns else F.lit(None).cast("string")
    return pages.select(F.col("doc").cast("string").alias("doc"), F.col("html").cast("string").alias("html"), listed.alias("listed")).mapInPandas(_tokens, _TOKENS)


def book_files(parts: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
    """(book_id, spine_pos, path, html, listed): the books' documents in reading order, each with the labels that the page list has for places in it; of several for one place the last holds."""
    _, manifest, spine = epub_package(parts, rows)
    docs = structure.spine_documents(manifest, spine).groupBy("book_id", "path").agg(F.min("pos").alias("spine_pos"))
    labels = links.where("kind = 'pages' AND fragment IS NOT NULL").groupBy("book_id", "path", "fragment").agg(F.max_by("title", "pos").alias("label"))
    listed = labels.groupBy("book_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("fragment", "label"))).alias("listed"))
    wanted = docs.join(listed, ["book_id", "path"], "left").withColumnRenamed("path", "want")
    return member(parts, wanted).select("book_id", F.col("want").alias("path"), "spine_pos", F.col("text").alias("html"), "listed")


def book_tokens(files: DataFrame) -> DataFrame:
    """The files' tokens with book_id, path, spine_pos and place: one key for the reading order over file and token."""
    doc = F.to_json(F.struct("book_id", "path", F.col("spine_pos").cast("string").alias("spine_pos")))
    named = F.from_json("doc", "book_id string, path string, spine_pos string")
    tokens = html_to_tokens(files.select(doc.alias("doc"), "html", "listed")).withColumn("_n", named)
    tokens = tokens.select("_n.book_id", "_n.path", F.col("_n.spine_pos").cast("int").alias("spine_pos"), *[c for c in tokens.columns if c not in ("doc", "_n")])
    return tokens.withColumn("place", structure.place(F.col("spine_pos"), F.col("seq")))


def build_books(meta: DataFrame, files: DataFrame, tokens: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """books (with toc), blocks (book_id, idx, kind, text, path, page, level, rows) and contents (book_id, pos, title, depth, block_index, via) from a book's files, tokens (written: they are read several times) and links. Texts other than headings wait until all else is known: they meet their blocks in one join."""
    begun = F.when(F.col("kind") == "heading", F.col("text")).otherwise(F.substring("text", 1, 1))
    read = structure.number_blocks(structure.fill_pages(tokens.drop("anchors", "rows").withColumn("text", begun)))
    seen = tokens.select("book_id", "path", "place", F.posexplode("anchors").alias("n", "fragment"))
    whole = files.select("book_id", "path", structure.place(F.col("spine_pos"), F.lit(0)).alias("place"), F.lit(-1).alias("n"), F.lit(None).cast("string").alias("fragment"))
    anchors = whole.unionByName(seen).withColumnRenamed("place", "g")
    contents = structure.resolve_toc(links.where("kind = 'toc'"), anchors, read.select("book_id", "path", F.col("place").alias("g"), "idx"))
    placed = structure.assign_chapter(read, contents)
    blocks = structure.block_paths(placed).select("book_id", "place", "idx", "kind", "path", "page", "level")
    books, kept = import_books(meta, blocks, contents)
    whole = kept.join(tokens.select("book_id", "place", "text", "rows"), ["book_id", "place"])
    return books, whole.select("book_id", "idx", "kind", "text", "path", "page", "level", "rows"), contents.join(books.select("book_id"), "book_id", "left_semi")


def import_archives(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """books, blocks and contents of archives (the rows of epub_members; write them first, they are read several times). Protected books and books without text are left out; nulls in package files and links that lead nowhere are skipped."""
    rows = written(package_rows(parts).join(protected(parts), "book_id", "left_anti"), "packages")  # all else follows from these
    links = written(nav_links(parts, rows), "links")
    files = book_files(parts, rows, links)
    tokens = written(book_tokens(files), "tokens")
    return build_books(epub_package(parts, rows)[0], written(files.select("book_id", "path", "spine_pos"), "files"), tokens, links)


def import_books(meta: DataFrame, blocks: DataFrame, toc: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(books, blocks) of the books that have a block other than headings."""
    stats = blocks.groupBy("book_id").agg(F.count("*").alias("block_count"), F.count_if(F.col("kind") != "heading").alias("passage_count"), F.bool_or(F.col("page").isNotNull()).alias("has_page_numbers")).where("passage_count > 0")
    books = meta.join(stats, "book_id")
    if toc is not None:
        order = ["pos"] if "pos" in toc.columns else []
        entries = toc.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(*order, "block_index", "title", "depth", "via"))).alias("toc"))
        books = books.join(entries, "book_id", "left")
    return books, blocks.join(stats.select("book_id"), "book_id", "left_semi")


def write_books(books: DataFrame, blocks: DataFrame, path: str, buckets: int = passages.BUCKETS) -> None:
    """Both tables as Parquet; blocks in `buckets` directories by the hash of the book, in reading order, so that a book is found without a directory of its own (passages.stored_book, stored_ranges). Large buckets are written by several tasks."""
    books.write.mode("overwrite").parquet(f"{path}/books")
    dealt = blocks.withColumn("bucket", passages.bucket_of(F.col("book_id"), buckets)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "book_id", "idx").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
