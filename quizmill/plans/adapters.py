"""The given tables as books, blocks, questions, attempts, ...; each derivation as a DataFrame and as DuckDB SQL (a WITH item).

A book is a hundred consecutive documents, a chapter one document, a block one line: books stay bounded however large the corpus or a source is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOK_DOCS = 100


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return d.withColumns({"book_id": F.concat(F.lit("b"), F.floor(F.col("doc_id") / BOOK_DOCS).cast("string")), "text": F.coalesce("text", F.lit(""))})


def blocks(spark, sf_dir: str) -> DataFrame:
    """book_id, idx, kind, text, path, page, level, doc_id."""
    lines = documents(spark, sf_dir).select("book_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    idx = F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id", "line")) - 1
    rows = lines.withColumn("idx", idx)
    tail = F.col("doc_id") % 10
    title = F.when(tail == 3, "Notes").when(tail == 7, "Glossary of terms").when(tail == 9, "Preface").otherwise(F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    kind = F.when((F.col("line") == 0) & (F.length("text") < 40), "heading").when(F.col("idx") % 6 == 5, "list-item").otherwise("paragraph")
    return rows.select("book_id", "idx", kind.alias("kind"), "text", F.array(title).alias("path"), F.when(F.col("idx") >= 7, (F.floor((F.col("idx") - 7) / 50) + 1).cast("string")).alias("page"), F.when(kind == "heading", 1).alias("level"), "doc_id")


BLOCKS = """
docs AS (SELECT *, 'b' || (doc_id // 100)::VARCHAR AS book_id, coalesce(text, '') AS body FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT book_id, doc_id, unnest(string_split(body, chr(10))) AS text, unnest(range(len(string_split(body, chr(10))))) AS line FROM docs),
numbered AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id, line) - 1 AS idx FROM lines),
blocks AS (SELECT book_id, idx, CASE WHEN line = 0 AND length(text) < 40 THEN 'heading' WHEN idx % 6 = 5 THEN 'list-item' ELSE 'paragraph' END AS kind, text,
  [CASE doc_id % 10 WHEN 3 THEN 'Notes' WHEN 7 THEN 'Glossary of terms' WHEN 9 THEN 'Preface' ELSE 'Document ' || doc_id END] AS path,
  CASE WHEN idx >= 7 THEN ((idx - 7) // 50 + 1)::VARCHAR END AS page, doc_id FROM numbered)"""


def toc(spark, sf_dir: str) -> DataFrame:
    """book_id, title, depth, block_index, via: a top entry at each document's first block; every fifth is found by fallback only."""
    first = blocks(spark, sf_dir).groupBy("book_id", "doc_id").agg(F.min("idx").alias("block_index"))
    return first.select("book_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), (F.col("doc_id") % 3 == 2).cast("int").alias("depth"), "block_index", F.when(F.col("doc_id") % 5 == 4, "fallback").otherwise("anchor").alias("via"))


TOC = BLOCKS + """,
toc AS (SELECT book_id, 'Document ' || doc_id AS title, CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END AS depth, min(idx) AS block_index, CASE WHEN doc_id % 5 = 4 THEN 'fallback' ELSE 'anchor' END AS via FROM blocks GROUP BY book_id, doc_id)"""


def books(spark, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).groupBy("book_id").agg(F.min("doc_id").alias("lo"), F.count("*").alias("n"))
    return d.select(F.col("book_id").alias("id"), F.concat(F.lit("Title "), (F.col("lo") % 700).cast("string")).alias("title"), F.timestamp_seconds(F.lit(1700000000) - F.col("lo") * 60).alias("imported_at"), F.col("n").cast("int").alias("block_count"))


BOOKS = """
books AS (SELECT 'b' || (doc_id // 100)::VARCHAR AS id, 'Title ' || (min(doc_id) % 700) AS title, 1700000000 - min(doc_id) * 60 AS imported_s, count(*)::INT AS block_count FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL)"""


def questions(spark, sf_dir: str) -> DataFrame:
    """One question for each document; created_at and flagged_at are epoch seconds."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = documents(spark, sf_dir).join(labels, "doc_id", "left")
    n, k = F.col("doc_id"), F.col("doc_id") % BOOK_DOCS
    s = lambda c: c.cast("string")
    flagged = F.when(F.col("toxic") == 1, True).when(F.col("toxic") == 0, False)
    created = F.lit(1704067200) + n * 60
    source = F.when(n % 4 == 0, "ai").otherwise("cloze")
    return d.select(
        F.concat(F.lit("q"), s(n)).alias("id"), "book_id", source.alias("source"), F.when(n % 4 == 1, "define").when(n % 4 == 2, "term").alias("style"),
        F.substring("text", 1, 40).alias("stem"), F.array(*[F.concat(F.lit(x), s(n)) for x in "ABCD"]).alias("options"), (n % 4).cast("int").alias("answer"),
        F.array(*[F.concat(F.lit(f"why {x}"), s(n)) for x in "ABCD"]).alias("explanations"), F.array(k, k + 2).alias("block_indexes"),
        F.substring("text", 5, 12).alias("quote"), F.concat(F.lit("Chapter "), s(F.floor(k / 7))).alias("chapter"),
        F.when(n % 4 == 0, F.concat(s(k - k % 10), F.lit("-"), s(k - k % 10 + 9))).alias("chunk"), F.when(n % 4 == 0, "m1").alias("model"),
        created.alias("created_at"), flagged.alias("flagged"), F.when(flagged.isNotNull() & (n % 3 != 0), created + 3600).alias("flagged_at"), n.alias("doc_id"),
    )


QUESTIONS = """
marks AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
questions AS (SELECT 'q' || d.doc_id AS id, 'b' || (d.doc_id // 100) AS book_id, CASE WHEN d.doc_id % 4 = 0 THEN 'ai' ELSE 'cloze' END AS source,
  CASE d.doc_id % 4 WHEN 1 THEN 'define' WHEN 2 THEN 'term' END AS style, substring(coalesce(text, ''), 1, 40) AS stem,
  ['A' || d.doc_id, 'B' || d.doc_id, 'C' || d.doc_id, 'D' || d.doc_id] AS options, (d.doc_id % 4)::INT AS answer,
  ['why A' || d.doc_id, 'why B' || d.doc_id, 'why C' || d.doc_id, 'why D' || d.doc_id] AS explanations, [d.doc_id % 100, d.doc_id % 100 + 2] AS block_indexes,
  substring(coalesce(text, ''), 5, 12) AS quote, 'Chapter ' || (d.doc_id % 100 // 7) AS chapter,
  CASE WHEN d.doc_id % 4 = 0 THEN (d.doc_id % 100 - d.doc_id % 10) || '-' || (d.doc_id % 100 - d.doc_id % 10 + 9) END AS chunk, CASE WHEN d.doc_id % 4 = 0 THEN 'm1' END AS model,
  1704067200 + d.doc_id * 60 AS created_at, CASE m.toxic WHEN 1 THEN true WHEN 0 THEN false END AS flagged,
  CASE WHEN m.toxic IN (0, 1) AND d.doc_id % 3 <> 0 THEN 1704067200 + d.doc_id * 60 + 3600 END AS flagged_at, d.doc_id
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id WHERE d.doc_id IS NOT NULL)"""


def document_count(spark, sf_dir: str) -> Column:
    """One more than the largest doc_id, as a scalar subquery."""
    return read(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n")).scalar()


def book_number(n: Column, count: Column) -> Column:
    """One of the books, by a number."""
    return F.concat(F.lit("b"), (n % F.greatest(F.floor(count / BOOK_DOCS), F.lit(1))).cast("string"))


#: The same in SQL.
DOCUMENT_COUNT = "(SELECT max(doc_id) + 1 FROM documents)"
BOOK_COUNT = "(SELECT greatest((max(doc_id) + 1) // 100, 1) FROM documents)"


def attempts(spark, sf_dir: str) -> DataFrame:
    """id, user_id, question_id, chosen, at (epoch hours, so that times tie)."""
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(n.alias("id"), "user_id", F.concat(F.lit("q"), (n * 7 % document_count(spark, sf_dir)).cast("string")).alias("question_id"), (F.floor(n / 3) % 4).cast("int").alias("chosen"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("at"))


ATTEMPTS = f"""
attempts AS (SELECT event_id AS id, user_id, 'q' || (event_id * 7 % {DOCUMENT_COUNT}) AS question_id, (event_id // 3 % 4)::INT AS chosen, floor(epoch_us(ts) / 3600000000)::BIGINT AS "at" FROM events)"""


def llm_calls(spark, sf_dir: str) -> DataFrame:
    """book_id, model, ts (UTC timestamp), used_up, ms, part, step."""
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(n.alias("id"), F.concat(F.lit("b"), (F.col("user_id") % 10).cast("string")).alias("book_id"), F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"), (n % 97 == 0).alias("used_up"), F.floor(F.coalesce("value", F.lit(0.0)) * 10).alias("ms"), F.floor(n / 2).alias("part"), F.when(n % 2 == 0, "write").otherwise("check").alias("step"))


CALLS = """
calls AS (SELECT event_id AS id, 'b' || (user_id % 10) AS book_id, event_type AS model, ts, event_id % 97 = 0 AS used_up, floor(coalesce(value, 0) * 10)::BIGINT AS ms, event_id // 2 AS part, CASE WHEN event_id % 2 = 0 THEN 'write' ELSE 'check' END AS step FROM events)"""


def sides(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions here and there: documents not on the other side by doc_id % 3, the rest on both with other stamps."""
    q = questions(spark, sf_dir)
    n = F.col("doc_id")
    here = q.where(n % 3 != 2)
    moved = F.col("created_at") + (n % 5 - 2) * 100
    there = q.where(n % 3 != 0).withColumns({"created_at": moved, "flagged": F.when(n % 7 == 1, True).otherwise(F.col("flagged")), "flagged_at": F.when(n % 7 == 1, moved + 9000).otherwise(F.col("flagged_at")), "stem": F.concat(F.lit("T"), F.col("stem"))})
    return here, there


SIDES = QUESTIONS + """,
here AS (SELECT * FROM questions WHERE doc_id % 3 <> 2),
there AS (SELECT * REPLACE (created_at + (doc_id % 5 - 2) * 100 AS created_at, CASE WHEN doc_id % 7 = 1 THEN true ELSE flagged END AS flagged,
  CASE WHEN doc_id % 7 = 1 THEN created_at + (doc_id % 5 - 2) * 100 + 9000 ELSE flagged_at END AS flagged_at, 'T' || stem AS stem) FROM questions WHERE doc_id % 3 <> 0)"""
