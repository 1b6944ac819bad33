"""Line deduplication [native]: range-partitioned line hashes with a secondary sort, keep bitmaps out.

DataFrame functions only. Text stays where it is until the end: what moves is (hash, row, position). A row is known by its doc_id and the hash of its text, so rows that share a doc_id do not cut each other's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import BLANKS, hidden, shown, stash, text_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """ASCII blanks stripped at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of the lines whose key has min_chars code points at least; h1, h2 are 128 bits. Written once: texts are split here and at the end, nowhere between."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    lines = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return stash(keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")), "line-hashes")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, hot_rows: int = 1000) -> DataFrame:
    """(doc_id, text_hash, dropped: sorted positions) of the lines that repeat in min_docs documents and are not in the largest doc_id that holds them.

    1. Pre-aggregation by hash, combined on the map side: only hashes on min_docs lines of two documents go on.
    2. Their lines are range-partitioned by hash and sorted by document and position; a hash on more than hot_rows lines gets a salt from its documents, so that a line held by a third of all rows fills many partitions.
    3. One pass in that order marks the first line of each document under a hash; the marks are the exact count of distinct documents."""
    lines = line_hashes(docs, min_chars)
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where((F.col("n") >= min_docs) & (F.col("lo") < F.col("hi")))
    salts = F.ceil(F.col("n") / hot_rows)
    # written, so that both sides of the join are shuffles of their own and a hot hash can be split
    repeated = stash(repeated.select("h1", "h2", "n"), "repeated")
    hits = lines.join(repeated.hint("merge"), ["h1", "h2"]).select("h1", "h2", F.pmod(F.xxhash64("doc_id"), salts).alias("salt"), "doc_id", "text_hash", "pos")
    ranged = hits.repartitionByRange("h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "text_hash", "pos")
    marked = stash(ranged.withColumn("first", ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(order))), "lines")
    keepers = marked.where("first").groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    lost = marked.join(stash(keepers.select("h1", "h2", "keeper"), "keepers").hint("merge"), ["h1", "h2"]).where(F.col("doc_id") < F.col("keeper"))
    return lost.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def bitmap(dropped: Column) -> Column:
    """Run-length form of a keep bitmap: lengths of the runs kept, dropped, kept, dropped and so on, comma-joined; the last run of kept lines is left out, so the form is empty when all lines stay."""
    first = F.array_except(dropped, F.transform(dropped, lambda p: p + 1))
    last = F.array_except(dropped, F.transform(dropped, lambda p: p - 1))
    kept = F.zip_with(first, F.concat(F.array(F.lit(-1)), last), lambda a, b: a - b - 1)
    lost = F.zip_with(first, last, lambda a, b: b - a + 1)
    return F.coalesce(F.array_join(F.flatten(F.zip_with(kept, lost, lambda a, b: F.array(a.cast("string"), b.cast("string")))), ","), F.lit(""))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, hot_rows: int = 1000) -> DataFrame:
    """The operator: (doc_id, text_hash, keep) of the rows that lose lines, `keep` as bitmap() writes it. Rows that are not listed keep every line.

    Null or empty texts are one empty line; rows without doc_id are left alone; rows that repeat a doc_id count as one document, but each has its own bitmap; other columns are ignored."""
    return dropped_lines(docs, min_chars, min_docs, hot_rows).select("doc_id", "text_hash", bitmap(F.col("dropped")).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that the bitmap keeps, joined; linear in the lines: the runs become a flag for each line, and the last run's flags are null."""
    flags = F.flatten(F.transform(F.split(keep, ","), lambda n, i: F.array_repeat(i % 2 == 0, n.cast("int"))))
    return F.array_join(F.zip_with(lines, flags, lambda line, stays: F.when(F.coalesce(stays, F.lit(True)), line)), "\n")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with keep (empty: all lines stay), n_lines, n_dropped and the kept text in `kept`. Columns of these names are replaced, all others stay."""
    docs, names = hidden(docs)
    marks = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("keep").alias("__keep"))
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64(text_of()) == F.col("__hash"))
    marked = docs.drop("keep", "n_lines", "n_dropped", "kept").join(marks.hint("merge"), same, "left")  # grows with the documents: never broadcast
    lines = F.split(text_of(), "\n")
    lost = F.filter(F.split("__keep", ","), lambda n, i: i % 2 == 1)
    counted = marked.withColumns({
        "keep": F.coalesce("__keep", F.lit("")),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.aggregate(lost, F.lit(0).cast("long"), lambda a, n: a + n.cast("long")), F.lit(0)).cast("long"),
        "kept": F.when(F.col("__keep").isNull(), text_of()).otherwise(kept_lines(lines, F.col("__keep"))),
    })
    return shown(counted.drop("__id", "__hash", "__keep"), names)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = apply_bitmaps(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), "keep")


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
), keepers AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, k.keeper IS NOT NULL AND l.doc_id < k.keeper AS gone FROM lines l LEFT JOIN keepers k ON l.key = k.key
), runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) AS b FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked WHERE gone) GROUP BY doc_id, run
), maps AS (
  SELECT doc_id, string_agg((a - before - 1) || ',' || (b - a + 1), ',' ORDER BY a) AS keep
  FROM (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), -1) AS before FROM runs) GROUP BY doc_id
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
)
SELECT kept.*, coalesce(maps.keep, '') AS keep FROM kept LEFT JOIN maps ON kept.doc_id = maps.doc_id
"""
