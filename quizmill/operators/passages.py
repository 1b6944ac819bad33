"""Passage selection and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.functions.text import CITATION, NOTE_LIKE, NUMBERED, ascii_bounds, is_study_passage, js_blanks


def load_blocks(blocks: DataFrame, book_id: str, start: int, end: int) -> DataFrame:
    """start <= idx < end of a book, in reading order."""
    return blocks.where((F.col("book_id") == book_id) & (F.col("idx") >= start) & (F.col("idx") < end)).orderBy("idx")


def load_ranges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """load_blocks for a table of requests (book_id, start, end): each block once for every request that holds it."""
    held = blocks.join(ranges.select("book_id", "start", "end"), "book_id").where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end")))
    return held.select(*blocks.columns)


def load_all_blocks(blocks: DataFrame, book_id: str) -> DataFrame:
    return blocks.where(F.col("book_id") == book_id).orderBy("idx")


def load_books(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """load_all_blocks for the books in `ids` (book_id)."""
    return blocks.join(ids.select("book_id"), "book_id", "left_semi")


#: Directories that stored blocks are dealt to, by book.
BUCKETS = 64


def bucket_of(book_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(book_id), F.lit(buckets)).cast("int")


def stored_book(spark, path: str, book_id: str, buckets: int = BUCKETS) -> DataFrame:
    """load_all_blocks from stored books: the bucket is a constant, so one directory is read."""
    return load_all_blocks(spark.read.parquet(f"{path}/blocks").where(F.col("bucket") == bucket_of(F.lit(book_id), buckets)), book_id).drop("bucket")


def stored_ranges(spark, path: str, ranges: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """load_ranges from stored books. The buckets that are asked for (at most `buckets` numbers come to the driver) are a constant of the read, so no others are opened."""
    asked = ranges.select(bucket_of(F.col("book_id"), buckets).alias("bucket"), "book_id", "start", "end")
    held_in = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("bucket").isin(held_in))
    held = blocks.join(asked, ["bucket", "book_id"]).where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end")))
    return held.select(*[c for c in blocks.columns if c != "bucket"])


def list_books(books: DataFrame) -> DataFrame:
    return books.orderBy("imported_at", "id")


def note_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with is_note: numbered lines with a citation, or next to a numbered line (by index) and like a note themselves."""
    w = Window.partitionBy("book_id").orderBy("idx")
    rows = blocks.withColumn("_numbered", (F.col("kind") != "heading") & F.col("text").rlike(js_blanks(NUMBERED)))
    near = lambda f, step: F.coalesce((f("idx").over(w) == F.col("idx") + step) & f("_numbered").over(w), F.lit(False))
    in_run = near(F.lag, -1) | near(F.lead, 1)
    note = F.col("_numbered") & (F.col("text").rlike(ascii_bounds(js_blanks(CITATION))) | (in_run & F.col("text").rlike(ascii_bounds(js_blanks(NOTE_LIKE)))))
    return rows.withColumn("is_note", note).drop("_numbered")


def study_passages(blocks: DataFrame) -> DataFrame:
    """Passages worth asking about: no headings, front or back matter, notes."""
    return note_blocks(blocks).where(is_study_passage(F.col("kind"), F.col("path")) & ~F.col("is_note")).drop("is_note")


def search_passages(blocks: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The first `limit` blocks in (book, idx) order that contain the query, ignoring case, and whether there are more. The top-n keeps limit + 1 rows of each task."""
    needle = query.strip().lower()
    hits = blocks.where(F.contains(F.lower("text"), F.lit(needle)) if len(needle) >= 2 else F.lit(False))
    some = hits.orderBy("book_id", "idx").limit(limit + 1)
    ranked = some.withColumns({"_n": F.row_number().over(Window.orderBy("book_id", "idx")), "_all": F.count("*").over(Window.partitionBy())})
    return ranked.where(F.col("_n") <= limit).withColumn("more", F.col("_all") > limit).drop("_n", "_all")


def load_passages(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each question's passages, in the order of its block indexes; missing ones are left out."""
    cited = questions.select("id", "book_id", F.posexplode("block_indexes").alias("pos", "idx"))
    return cited.join(blocks.select("book_id", "idx", "text"), ["book_id", "idx"]).select("id", "pos", "book_id", "idx", "text")
