"""Book structure: numbering, contents entries, chapters, headings, pages, reading segments. Windows run inside a book; joins are on the book."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine_documents(manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """Reading order: manifest (book_id, item, path, media_type, properties) by spine (book_id, pos, item); (x)html only, without the navigation document."""
    docs = spine.join(manifest, ["book_id", "item"])
    nav = F.array_contains(F.split(F.coalesce("properties", F.lit("")), "\\s+"), "nav")
    return docs.where(F.col("media_type").rlike("x?html") & ~nav).select("book_id", "pos", "path")


def number_blocks(tokens: DataFrame) -> DataFrame:
    """idx: dense, from 0, in reading order (spine_pos, seq) within the book."""
    return tokens.withColumn("idx", F.row_number().over(Window.partitionBy("book_id").orderBy("spine_pos", "seq")) - 1)


def place(spine_pos: Column, seq: Column) -> Column:
    """One key for the reading order over the files of a book and the tokens of a file."""
    return F.shiftleft(spine_pos.cast("long"), 32) + seq


def resolve_toc(links: DataFrame, anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Contents links (book_id, pos, title, depth, path, fragment) with block_index and via.

    anchors (book_id, path, fragment, g): g is the place in reading order of an anchor; blocks (book_id, path, g, idx). A link goes to the first block at or after its anchor; without a fragment or with an unseen one to the first block of its file, else to the next block emitted. Links of files that are not read, or after the last block, are dropped. anchors may have n, the order of anchors at one place. read: the order in which entries were met."""
    order = F.col("n") if "n" in anchors.columns else F.lit(0)
    anchors = anchors.select("book_id", "path", "fragment", F.struct("g", order.alias("n")).alias("_at"))
    first_anchor = anchors.where(F.col("fragment").isNotNull()).groupBy("book_id", "path", "fragment").agg(F.min("_at").alias("_anchor"))
    files = anchors.where(F.col("fragment").isNull()).groupBy("book_id", "path").agg(F.min("_at").alias("_file"))
    filled = blocks.select("book_id", "path").distinct().withColumn("_filled", F.lit(True))
    placed = links.join(first_anchor, ["book_id", "path", "fragment"], "left").join(files, ["book_id", "path"], "left").join(filled, ["book_id", "path"], "left")
    goal = placed.withColumn("_at", F.coalesce("_anchor", "_file")).where(F.col("_at").isNotNull()).withColumn("g", F.col("_at.g"))
    # an unseen anchor is given up at the end of its file; if that has no block, the entry waits for the next one like any other
    unseen = F.col("fragment").isNotNull() & F.col("_anchor").isNull()
    via = F.when(unseen & F.col("_filled").isNotNull(), "fallback").otherwise("anchor")
    # as-of forward: union both and look at the next block in order
    left = goal.select("book_id", "g", F.lit(0).alias("_block"), "pos", "title", "depth", via.alias("via"), F.struct(F.col("_file.g").alias("file"), unseen.alias("late"), F.col("_at.g").alias("at"), F.col("_at.n").alias("n")).alias("_order"), F.lit(None).cast("int").alias("idx"))
    right = blocks.select("book_id", "g", F.lit(1).alias("_block"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(None).cast(left.schema["_order"].dataType).alias("_order"), "idx")
    ahead = Window.partitionBy("book_id").orderBy("g", "_block").rowsBetween(0, Window.unboundedFollowing)
    both = left.unionByName(right).withColumn("block_index", F.first("idx", ignorenulls=True).over(ahead))
    found = both.where((F.col("_block") == 0) & F.col("block_index").isNotNull())
    read = F.row_number().over(Window.partitionBy("book_id").orderBy("_order", "pos"))
    return found.select("book_id", "pos", "title", "depth", "block_index", "via", read.alias("read"))


def assign_chapter(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """chapter and chapter_start of each block: the latest top entry at or before it that was placed while reading; of several at one block the one read last (toc has no `read`: the greatest title)."""
    last = F.max_by("title", "read") if "read" in toc.columns else F.max("title")
    starts = toc.where((F.col("depth") == 0) & (F.col("via") != "fallback")).groupBy("book_id", F.col("block_index").alias("idx")).agg(last.alias("_title"))
    running = Window.partitionBy("book_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.join(starts, ["book_id", "idx"], "left")
    at = F.when(F.col("_title").isNotNull(), F.col("idx"))
    return marked.withColumns({"chapter": F.last("_title", ignorenulls=True).over(running), "chapter_start": F.last(at, ignorenulls=True).over(running)}).drop("_title")


def _in_force(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headings in order (book_id, chapter, seq, rank, text, scope_end) to the places where what is in force changes (book_id, chapter, at, headings).

    A stack of the headings that may still come into force: a new one takes away those of its rank or higher that end no later than it does; those that outlive it come back when it ends. Memory: one stack."""
    group, stack, ends, out = None, [], [], []

    def now(at: int) -> None:
        low, names = None, []
        for _, rank, text in reversed(stack):
            if low is None or rank < low:
                low = rank
                names.append(text)
        if out and out[-1][:3] == (*group, at):
            out.pop()
        out.append((*group, at, names[::-1]))

    def end_before(seq: float) -> None:
        while ends and ends[0] < seq:
            last = heapq.heappop(ends)
            kept = [h for h in stack if h[0] > last]
            if len(kept) < len(stack):
                stack[:] = kept
                now(last + 1)

    def pack() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["book_id", "_c", "_s", "_headings"])

    for batch in batches:
        for book, chapter, seq, rank, text, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (book, chapter) != group:
                if group:
                    end_before(math.inf)
                group, stack, ends = (book, chapter), [], []
            end_before(seq)
            stop = math.inf if stop is None else stop
            stack[:] = [h for h in stack if h[1] < rank or h[0] > stop]
            if stop >= seq:
                stack.append((stop, rank, text))
                if stop < math.inf:
                    heapq.heappush(ends, stop)
            now(seq)
            if len(out) > 4_000:
                kept, out = out[-1], out[:-1]  # the last one may be replaced
                yield pack()
                out = [kept]
    if group:
        end_before(math.inf)
    if out:
        yield pack()


def heading_path(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """headings in force (array, outermost first) for each block of a chapter instance.

    blocks and headings: book_id, chapter_start, seq; headings also rank, text, scope_end (null: open). A heading covers what follows up to its scope's end unless a later heading of its rank or lower, that covers the same block, replaces it. The headings of a chapter pass through a stack once; blocks take the latest state before them, so no block meets a heading by a join."""
    chapter = F.coalesce("chapter_start", F.lit(-1)).cast("long")
    h = headings.select("book_id", chapter.alias("_c"), F.col("seq").cast("long").alias("_s"), F.col("rank").cast("int").alias("rank"), "text", F.col("scope_end").cast("long").alias("scope_end"))
    states = h.repartition("book_id", "_c").sortWithinPartitions("book_id", "_c", "_s").mapInArrow(_in_force, "book_id string, _c long, _s long, _headings array<string>")
    rows = blocks.withColumns({"_c": chapter, "_s": F.col("seq").cast("long"), "_block": F.lit(True)}).unionByName(states, allowMissingColumns=True)
    latest = Window.partitionBy("book_id", "_c").orderBy("_s", F.col("_block").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("headings", F.coalesce(F.last("_headings", ignorenulls=True).over(latest), F.array().cast("array<string>")))
    return placed.where("_block").drop("_c", "_s", "_block", "_headings")


def heading_level(kind: Column, headings: Column) -> Column:
    """1 for a top heading, null for other blocks."""
    return F.when(kind == "heading", F.size(headings))


def build_path(chapter: Column, headings: Column) -> Column:
    """Chapter, then headings; the first heading is skipped if it repeats the chapter title or part of it, any other if it equals the one before it (ignoring case)."""
    first = F.when(chapter.isNotNull() & (chapter != ""), F.array(chapter)).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(headings, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def step(acc, x):
        low, prev = F.lower(x["h"]), F.lower(F.element_at(acc, -1))
        repeats = F.when((x["i"] == 0) & (F.size(first) > 0), F.contains(prev, low) | F.contains(low, prev)).otherwise(prev == low)
        return F.when((F.size(acc) > 0) & repeats, acc).otherwise(F.concat(acc, F.array(x["h"])))

    return F.aggregate(numbered, first, lambda acc, x: F.when(F.size(acc) == 0, F.array(x["h"])).otherwise(step(F.when(F.size(acc) == 0, F.array(F.lit(""))).otherwise(acc), x)))


def block_paths(blocks: DataFrame) -> DataFrame:
    """path and level of blocks (book_id, place, seq, idx, kind, text, rank, box_start, box_end, spine_pos, chapter, chapter_start).

    A heading in a box ends with the box, unless a chapter began inside the box before it; other headings stay open, also into the next file."""
    running = Window.partitionBy("book_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    began = F.last(F.when(F.col("idx") == F.col("chapter_start"), F.col("place")), ignorenulls=True).over(running)
    rows = blocks.withColumns({"_began": began, "_seq": F.col("seq"), "seq": F.col("place")})
    boxed = F.col("box_end").isNotNull() & ~F.coalesce(F.col("_began") >= place(F.col("spine_pos"), F.col("box_start")), F.lit(False))
    headings = rows.where("kind = 'heading'").select("book_id", "chapter_start", "seq", "rank", "text", F.when(boxed, place(F.col("spine_pos"), F.col("box_end"))).alias("scope_end"))
    found = heading_path(rows, headings).withColumn("seq", F.col("_seq"))
    return found.withColumns({"level": heading_level(F.col("kind"), F.col("headings")), "path": build_path(F.col("chapter"), F.col("headings"))}).drop("_began", "_seq")


def fill_pages(tokens: DataFrame) -> DataFrame:
    """page in force for each token that has text: a mark before the text counts for the block itself, one inside from the next block on."""
    before = Window.partitionBy("book_id").orderBy("spine_pos", "seq").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.coalesce("page_after", "page_before"), ignorenulls=True).over(before)
    return tokens.withColumn("page", F.coalesce("page_before", carried)).where(F.coalesce("text", F.lit("")) != "")


def page_starts(blocks: DataFrame) -> DataFrame:
    """starts_page: a page label that differs from the one in force before the block."""
    before = F.last("page", ignorenulls=True).over(Window.partitionBy("book_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("starts_page", F.col("page").isNotNull() & ~F.col("page").eqNullSafe(before))


def book_stats(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    b = blocks.groupBy("book_id").agg(F.count("*").alias("block_count"), F.count_if(F.col("kind") != "heading").alias("passage_count"), F.bool_or(F.col("page").isNotNull()).alias("has_page_numbers"))
    t = toc.groupBy("book_id").agg(F.count_if(F.col("depth") == 0).alias("chapters"), F.bool_or(F.col("depth") > 1).alias("deep"))
    return b.join(t, "book_id", "left").withColumns({"chapters": F.coalesce("chapters", F.lit(0)), "deep": F.coalesce("deep", F.lit(False))})


def segment_starts(books: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, start): 0 and every contents entry, once each; an entry without a place counts as 0."""
    return books.select("book_id", F.lit(0).alias("start")).unionByName(toc.select("book_id", F.coalesce("block_index", F.lit(0)).cast("int").alias("start"))).distinct()


def sections(starts: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, start, stop): the stretches between starts, stop exclusive and at most block_count."""
    ahead = F.lead("start").over(Window.partitionBy("book_id").orderBy("start"))
    return starts.withColumn("_next", ahead).join(books.select("book_id", "block_count"), "book_id").select("book_id", "start", F.least(F.coalesce("_next", F.col("block_count")), F.col("block_count")).alias("stop"), "block_count")


def segment_for(positions: DataFrame, starts: DataFrame, books: DataFrame, most: int = 150) -> DataFrame:
    """positions (book_id, position) with their segment [start, end): chunks of `most` blocks counted from the section's start."""
    inside = positions.join(books.select("book_id", "block_count"), "book_id").withColumn("at", F.least(F.greatest("position", F.lit(0)), F.greatest(F.col("block_count") - 1, F.lit(0))))
    # as-of backward: the section starts among the positions of the book, in order
    marks = sections(starts, books).select("book_id", F.col("start").alias("at"), F.lit(0).alias("_kind"), F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.lit(None).cast("int").alias("position"))
    asked = inside.select("book_id", "at", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_start"), F.lit(None).cast("int").alias("_stop"), F.col("position").cast("int").alias("position"))
    running = Window.partitionBy("book_id").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked).withColumns({"_s": F.last("_start", ignorenulls=True).over(running), "_e": F.last("_stop", ignorenulls=True).over(running)}).where("_kind = 1")
    start = (F.col("_s") + F.floor((F.col("at") - F.col("_s")) / most) * most).cast("int")
    return both.select("book_id", "position", start.alias("start"), F.least(start + most, F.col("_e")).alias("end"))


def segments(starts: DataFrame, books: DataFrame, most: int = 150) -> DataFrame:
    """All segments of each book with the previous and next start and the percentage read at their end."""
    cut = sections(starts, books).where("start < stop")
    rows = cut.select("book_id", "block_count", "stop", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(most))).alias("start"))
    rows = rows.withColumn("end", F.least(F.col("start") + most, F.col("stop")))
    w = Window.partitionBy("book_id").orderBy("start")
    return rows.select("book_id", "start", "end", F.lag("start").over(w).alias("previous"), F.lead("start").over(w).alias("next"), F.floor(100 * F.col("end") / F.col("block_count") + 0.5).cast("int").alias("percent"))
