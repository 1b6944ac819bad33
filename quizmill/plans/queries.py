"""The registered queries of the library: each operator over the given tables, with the same result in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.functions.scratch import written
from quizmill.operators import bank, merge, mining, passages, questions, slices, structure
from quizmill.plans import adapters as A

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _re(pattern: str) -> str:
    """A pattern as DuckDB's engine reads it, inside quotes."""
    return pattern.replace("\\z", "$").replace("'", "''")


_ABBR = "|".join(a.replace(".", "\\.") for a in T.ABBREVIATIONS)
NOTED = A.BLOCKS + f""",
flagged AS (SELECT *, kind <> 'heading' AND regexp_matches(text, '{_re(T.NUMBERED)}') AS numbered FROM blocks),
noted AS (SELECT *, numbered AND (regexp_matches(text, '{_re(T.CITATION)}') OR ((coalesce(lag(idx) OVER w = idx - 1 AND lag(numbered) OVER w, false) OR coalesce(lead(idx) OVER w = idx + 1 AND lead(numbered) OVER w, false))
  AND regexp_matches(text, '{_re(T.NOTE_LIKE)}'))) AS is_note FROM flagged WINDOW w AS (PARTITION BY book_id ORDER BY idx)),
study AS (SELECT * FROM noted WHERE kind <> 'heading' AND NOT is_note AND NOT regexp_matches(trim(path[1]), '{_re(T.SKIPPED_SECTION)}'))"""
_SPLIT = r"""regexp_replace({0}, '([.!?]["”’)\]]*)\s+(["“(]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g')"""
SENTENCES = NOTED + """,
pieces AS (SELECT book_id, idx, path, unnest(string_split(marked, chr(1))) AS piece, unnest(range(len(string_split(marked, chr(1))))) AS n FROM (SELECT *, """ + _SPLIT.format("text") + """ AS marked FROM study WHERE kind IN ('paragraph', 'list-item'))),
joined AS (SELECT *, sum(CASE WHEN coalesce(regexp_matches(before, '(^|[^A-Za-z.])\\.*(?:""" + _ABBR + """|[A-Z])\\.["”’)\\]]*$'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, idx ORDER BY n) AS g
  FROM (SELECT *, lag(piece) OVER (PARTITION BY book_id, idx ORDER BY n) AS before FROM pieces)),
glued AS (SELECT book_id, idx, any_value(path) AS path, g, regexp_replace(string_agg(piece, ' ' ORDER BY n), '^\\s+|\\s+$', '', 'g') AS sentence FROM joined GROUP BY book_id, idx, g),
sents AS (SELECT book_id, idx, path, path[1] AS chapter, row_number() OVER (PARTITION BY book_id, idx ORDER BY g) - 1 AS pos, sentence FROM glued WHERE sentence <> '')"""


# ---------------------------------------------------------------- sources and structure


@query(f"WITH {A.BLOCKS}, n AS (SELECT book_id, count(*) AS c FROM blocks GROUP BY book_id) SELECT book_id, idx, text FROM blocks JOIN n USING (book_id) WHERE idx >= c // 4 AND idx < c * 3 // 4")
def src6_load_blocks(spark, sf_dir: str) -> DataFrame:
    """The middle half of every book."""
    c = F.col("block_count")
    asked = _counts(spark, sf_dir).select("book_id", F.floor(c / 4).alias("start"), F.floor(c * 3 / 4).alias("end"))
    return passages.load_ranges(A.blocks(spark, sf_dir), asked).select("book_id", "idx", "text")


@query(f"WITH {A.BLOCKS} SELECT book_id, idx, kind, page FROM blocks")
def src6_load_all_blocks(spark, sf_dir: str) -> DataFrame:
    return passages.load_books(A.blocks(spark, sf_dir), A.books(spark, sf_dir).select(F.col("id").alias("book_id"))).select("book_id", "idx", "kind", "page")


@query(f"WITH {A.BOOKS} SELECT id, title, imported_s FROM books")
def src7_list_books(spark, sf_dir: str) -> DataFrame:
    return passages.list_books(A.books(spark, sf_dir)).select("id", "title", F.unix_seconds("imported_at").alias("imported_s"))


@query(f"WITH {A.SIDES} SELECT id, stem, created_at FROM there UNION ALL SELECT id, stem, created_at FROM here WHERE id NOT IN (SELECT id FROM there)")
def src8_save_questions(spark, sf_dir: str) -> DataFrame:
    return merge.save_questions(*A.sides(spark, sf_dir)).select("id", "stem", "created_at")


@query(f"WITH {A.QUESTIONS}, {A.BOOKS.strip()} SELECT 'question' AS kind, id FROM questions WHERE book_id NOT IN ('b0', 'b3') UNION ALL SELECT 'book', id FROM books WHERE id NOT IN ('b0', 'b3')")
def src12_delete_books(spark, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([("b0",), ("b3",)], "book_id string")
    books, left = merge.delete_books(ids, A.books(spark, sf_dir), A.questions(spark, sf_dir))
    return left.select(F.lit("question").alias("kind"), "id").unionByName(books.select(F.lit("book").alias("kind"), "id"))


@query(f"WITH {A.BLOCKS} SELECT book_id, doc_id, text, idx FROM blocks")
def str2_number_blocks(spark, sf_dir: str) -> DataFrame:
    lines = A.documents(spark, sf_dir).select("book_id", F.col("doc_id").alias("spine_pos"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return structure.number_blocks(lines).select("book_id", F.col("spine_pos").alias("doc_id"), "text", "idx")


@query(f"""WITH {A.TOC}, starts AS (SELECT book_id, block_index AS idx, max(title) AS title FROM toc WHERE depth = 0 AND via <> 'fallback' GROUP BY ALL)
SELECT b.book_id, b.idx, s.title AS chapter, s.idx AS chapter_start FROM blocks b ASOF LEFT JOIN starts s ON b.book_id = s.book_id AND b.idx >= s.idx""")
def str4_assign_chapter(spark, sf_dir: str) -> DataFrame:
    return structure.assign_chapter(A.blocks(spark, sf_dir), A.toc(spark, sf_dir)).select("book_id", "idx", "chapter", "chapter_start")


@query(f"""WITH {A.BLOCKS}, marks AS (SELECT *, CASE WHEN idx % 50 = 7 AND idx % 100 <> 57 THEN idx // 50 + 1 END AS pb, CASE WHEN idx % 100 = 57 THEN idx // 50 + 1 END AS pa FROM blocks)
SELECT book_id, idx, coalesce(pb, last_value(coalesce(pa, pb) IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::VARCHAR AS page FROM marks WHERE text <> ''""")
def str8_fill_pages(spark, sf_dir: str) -> DataFrame:
    b = A.blocks(spark, sf_dir)
    label = (F.floor(F.col("idx") / 50) + 1).cast("string")
    tokens = b.drop("page").withColumns({"spine_pos": F.col("doc_id"), "seq": F.col("idx"), "page_before": F.when((F.col("idx") % 50 == 7) & (F.col("idx") % 100 != 57), label), "page_after": F.when(F.col("idx") % 100 == 57, label)})
    return structure.fill_pages(tokens).select("book_id", "idx", "page")


@query(f"""WITH {A.BLOCKS} SELECT book_id, idx, page FROM (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM blocks)
WHERE page IS NOT NULL AND page IS DISTINCT FROM before""")
def str9_page_starts(spark, sf_dir: str) -> DataFrame:
    return structure.page_starts(A.blocks(spark, sf_dir)).where("starts_page").select("book_id", "idx", "page")


@query(f"""WITH {A.TOC} SELECT b.*, t.chapters, t.deep FROM (SELECT book_id, count(*) AS block_count, count(*) FILTER (kind <> 'heading') AS passage_count, bool_or(page IS NOT NULL) AS has_page_numbers FROM blocks GROUP BY book_id) b
JOIN (SELECT book_id, count(*) FILTER (depth = 0) AS chapters, bool_or(depth > 1) AS deep FROM toc GROUP BY book_id) t ON b.book_id = t.book_id""")
def str10_book_stats(spark, sf_dir: str) -> DataFrame:
    return structure.book_stats(A.blocks(spark, sf_dir), A.toc(spark, sf_dir))


def _counts(spark, sf_dir: str) -> DataFrame:
    return A.blocks(spark, sf_dir).groupBy("book_id").agg(F.count("*").cast("int").alias("block_count"))


def _starts(spark, sf_dir: str) -> DataFrame:
    return structure.segment_starts(_counts(spark, sf_dir), A.toc(spark, sf_dir))


_STARTS = A.TOC + """,
counts AS (SELECT book_id, count(*) AS block_count FROM blocks GROUP BY book_id),
starts AS (SELECT book_id, 0 AS start FROM counts UNION SELECT book_id, block_index FROM toc),
sections AS (SELECT s.book_id, start, least(coalesce(lead(start) OVER (PARTITION BY s.book_id ORDER BY start), block_count), block_count) AS stop, block_count FROM starts s JOIN counts c ON s.book_id = c.book_id)"""


@query(f"WITH {_STARTS} SELECT * FROM starts")
def str11_segment_starts(spark, sf_dir: str) -> DataFrame:
    return _starts(spark, sf_dir)


@query(f"""WITH {_STARTS}, q AS (SELECT book_id, block_count, unnest(range(-20, block_count + 21, 13)) AS position FROM counts), p AS (SELECT book_id, position, least(greatest(position, 0), block_count - 1) AS "at" FROM q)
SELECT p.book_id, position, start + ("at" - start) // 5 * 5 AS start, least(start + ("at" - start) // 5 * 5 + 5, stop) AS "end" FROM p ASOF JOIN sections s ON p.book_id = s.book_id AND p."at" >= s.start""")
def str12_segment_for(spark, sf_dir: str) -> DataFrame:
    """Every thirteenth position of every book, from before its start to beyond its end."""
    counts = _counts(spark, sf_dir)
    asked = counts.select("book_id", F.explode(F.sequence(F.lit(-20).cast("long"), F.col("block_count") + 20, F.lit(13).cast("long"))).alias("position"))
    return structure.segment_for(asked, _starts(spark, sf_dir), counts, 5)


@query(f"""WITH {_STARTS}, cut AS (SELECT book_id, block_count, unnest(range(start, stop, 5)) AS start, stop FROM sections WHERE start < stop), e AS (SELECT *, least(start + 5, stop) AS "end" FROM cut)
SELECT book_id, start, "end", lag(start) OVER w AS previous, lead(start) OVER w AS next, floor(100 * "end" / block_count + 0.5)::INT AS percent FROM e WINDOW w AS (PARTITION BY book_id ORDER BY start)""")
def str13_segments(spark, sf_dir: str) -> DataFrame:
    return structure.segments(_starts(spark, sf_dir), _counts(spark, sf_dir), 5)


# ---------------------------------------------------------------- passages


@query(f"WITH {NOTED} SELECT book_id, idx, kind <> 'heading' AND NOT regexp_matches(trim(path[1]), '{_re(T.SKIPPED_SECTION)}') AS study, path[1] AS chapter FROM blocks")
def pas1_study_and_chapter(spark, sf_dir: str) -> DataFrame:
    return A.blocks(spark, sf_dir).select("book_id", "idx", T.is_study_passage(F.col("kind"), F.col("path")).alias("study"), T.chapter_of(F.col("path")).alias("chapter"))


@query(f"WITH {A.BLOCKS} SELECT book_id, idx, coalesce(path[2], 'Start of book') AS chapter FROM blocks")
def pas2_chapter_of(spark, sf_dir: str) -> DataFrame:
    return A.blocks(spark, sf_dir).select("book_id", "idx", T.chapter_of(F.slice("path", 2, 1)).alias("chapter"))


def _numbered(b: DataFrame) -> DataFrame:
    """Lines as notes: some blocks get a number, a year or a link."""
    n = (F.col("idx") % 90 + 1).cast("string")
    text = F.when(F.col("idx") % 10 < 3, F.concat(n, F.lit(". “"), F.col("text"))).when(F.col("idx") % 10 == 5, F.concat(n, F.lit(" see https://example.org "), F.col("text"))).when(F.col("idx") % 10 == 7, F.concat(n, F.lit(" plain "), F.col("text"))).otherwise(F.col("text"))
    return b.withColumn("text", text)


_NUMBERED = NOTED.replace("flagged AS (SELECT *, kind", """blocks2 AS (SELECT * REPLACE (CASE WHEN idx % 10 < 3 THEN (idx % 90 + 1) || '. “' || text WHEN idx % 10 = 5 THEN (idx % 90 + 1) || ' see https://example.org ' || text WHEN idx % 10 = 7 THEN (idx % 90 + 1) || ' plain ' || text ELSE text END AS text) FROM blocks),
flagged AS (SELECT *, kind""").replace("AS numbered FROM blocks)", "AS numbered FROM blocks2)")


@query(f"WITH {_NUMBERED} SELECT book_id, idx, is_note FROM noted")
def pas3_note_blocks(spark, sf_dir: str) -> DataFrame:
    return passages.note_blocks(_numbered(A.blocks(spark, sf_dir))).select("book_id", "idx", "is_note")


@query(f"WITH {_NUMBERED} SELECT book_id, idx, text FROM study")
def pas4_study_passages(spark, sf_dir: str) -> DataFrame:
    return passages.study_passages(_numbered(A.blocks(spark, sf_dir))).select("book_id", "idx", "text")


@query(f"WITH {A.BLOCKS}, hits AS (SELECT book_id, idx, row_number() OVER (ORDER BY book_id, idx) AS n, count(*) OVER () AS total FROM blocks WHERE contains(lower(text), 'license')) SELECT book_id, idx, total > 50 AS more FROM hits WHERE n <= 50")
def pas5_search_passages(spark, sf_dir: str) -> DataFrame:
    return passages.search_passages(A.blocks(spark, sf_dir), " LICENSE ").select("book_id", "idx", "more")


@query(f"""WITH {A.BLOCKS}, f AS (SELECT *, instr(lower(text), 'and') - 1 AS "at", length(text) AS n FROM blocks)
SELECT book_id, idx, CASE WHEN "at" < 0 THEN substring(text, 1, 40) ELSE CASE WHEN "at" > 20 THEN '…' ELSE '' END || substring(text, greatest("at" - 20, 0) + 1, "at" - greatest("at" - 20, 0)) END AS before,
  CASE WHEN "at" < 0 THEN '' ELSE substring(text, "at" + 1, 3) END AS match,
  CASE WHEN "at" < 0 THEN CASE WHEN n > 40 THEN '…' ELSE '' END ELSE substring(text, "at" + 4, least(n, "at" + 23) - "at" - 3) || CASE WHEN "at" + 23 < n THEN '…' ELSE '' END END AS after FROM f""")
def pas6_snippet(spark, sf_dir: str) -> DataFrame:
    return A.blocks(spark, sf_dir).select("book_id", "idx", T.snippet(F.col("text"), F.lit(" AND "), 20).alias("s")).select("book_id", "idx", "s.*")


@query(f"""WITH {A.QUESTIONS}, f AS (SELECT id, coalesce(text, '') AS text, quote, CASE WHEN length(quote) > 0 THEN instr(coalesce(text, ''), quote) ELSE 0 END AS "at" FROM questions q JOIN documents d ON q.doc_id = d.doc_id)
SELECT id, CASE WHEN "at" > 0 THEN substring(text, 1, "at" - 1) ELSE text END AS before, CASE WHEN "at" > 0 THEN quote ELSE '' END AS match, CASE WHEN "at" > 0 THEN substring(text, "at" + length(quote)) ELSE '' END AS after FROM f""")
def pas7_highlight(spark, sf_dir: str) -> DataFrame:
    q = A.questions(spark, sf_dir).select("id", "doc_id", "quote").join(A.documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return q.select("id", T.highlight(F.col("text"), F.col("quote")).alias("h")).select("id", "h.*")


@query(f"""WITH {A.QUESTIONS}, {A.BLOCKS.strip()}, cited AS (SELECT id, book_id, unnest(block_indexes) AS idx, unnest(range(len(block_indexes))) AS pos FROM questions)
SELECT c.id, c.pos, c.book_id, c.idx, b.text FROM cited c JOIN blocks b ON c.book_id = b.book_id AND c.idx = b.idx""")
def pas8_load_passages(spark, sf_dir: str) -> DataFrame:
    return passages.load_passages(A.questions(spark, sf_dir), A.blocks(spark, sf_dir))


# ---------------------------------------------------------------- text functions


@query(r"SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), chr(173), ''), '[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS text FROM documents WHERE doc_id IS NOT NULL")
def txt1_normalize_text(spark, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query(r"""WITH u AS (SELECT page_id, url, rtrim(regexp_replace(regexp_replace(string_split(url, '#')[1], '^[a-z]+://[^/]*', ''), '/+', '/', 'g'), '/') AS p FROM pages)
SELECT page_id, CASE WHEN p = '' THEN 'a/b.html' WHEN p LIKE '/%' THEN substring(p, 2) ELSE 'a/' || p END AS path, CASE WHEN contains(url, '#') AND string_split(url, '#')[2] <> '' THEN string_split(url, '#')[2] END AS fragment FROM u""")
def txt2_resolve_path(spark, sf_dir: str) -> DataFrame:
    local = F.regexp_replace("url", "^[a-z]+://[^/#]*", "")
    return A.read(spark, sf_dir, "pages").select("page_id", T.resolve_path(F.lit("a/b.html"), local).alias("path"), T.fragment_of(F.col("url")).alias("fragment"))


@query(f"WITH {SENTENCES} SELECT book_id, idx, pos, sentence FROM sents")
def txt3_min1_sentences(spark, sf_dir: str) -> DataFrame:
    return mining.sentences(passages.study_passages(A.blocks(spark, sf_dir))).select("book_id", "idx", "pos", "sentence")


@query(r"SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), '’', ''''), '\s+', ' ', 'g')) AS key FROM documents WHERE doc_id IS NOT NULL")
def txt4_key_of(spark, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", T.key_of(F.col("text")).alias("key"))


@query(f"SELECT doc_id, regexp_replace(trim(coalesce(text, '')), '^(?:(?:{T.LEADING})\\s+)+', '') AS name FROM documents WHERE doc_id IS NOT NULL")
def txt5_strip_leading(spark, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", T.strip_leading(F.col("text")).alias("name"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[A-Z][a-z]') THEN lower(text[1]) || text[2:] ELSE text END AS low, CASE WHEN lang = 'en' THEN source || ' (EN)' ELSE source END AS shown FROM (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents WHERE doc_id IS NOT NULL)")
def txt11_lower_first(spark, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", T.lower_first(F.col("text")).alias("low"), T.display_name(F.col("source"), F.when(F.col("lang") == "en", "EN")).alias("shown"))


@query("SELECT doc_id, source = lang OR contains(source, 'src1') OR contains('src1', source) AS related FROM documents WHERE doc_id IS NOT NULL")
def txt12_related(spark, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", T.related(F.col("source"), F.lit("src1")).alias("related"))


@query("""WITH RECURSIVE h AS (SELECT doc_id, source || '|' || doc_id AS s, 0 AS i, 2166136261::BIGINT AS v FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, i + 1, (xor(v, ascii(s[i + 1])::BIGINT) * 16777619) % 4294967296 FROM h WHERE i < length(s))
SELECT doc_id, v AS hash FROM h WHERE i = length(s)""")
def txt13_fnv1a32(spark, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", T.fnv1a32(F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("hash"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY md5('7|' || doc_id)) AS place FROM documents WHERE doc_id IS NOT NULL")
def txt14_seeded_order(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = A.documents(spark, sf_dir)
    return d.select("doc_id", F.row_number().over(Window.partitionBy("book_id").orderBy(T.seeded(F.lit(7), F.col("doc_id")))).alias("place"))


# ---------------------------------------------------------------- mining and questions

_WORDS = lambda items: ", ".join(f"'{w}'" for w in items)
_PLAUSIBLE_TERM = f"""len(regexp_split_to_array(term, '\\s+')) BETWEEN 1 AND 6 AND length(term) >= 3 AND lower(regexp_split_to_array(term, '\\s+')[1]) NOT IN ({_WORDS(T.NOT_TERMS)})
  AND NOT regexp_matches(term, '[,;:?!<>=“”"]|\\d|percent') AND NOT regexp_matches(regexp_split_to_array(term, '\\s+')[-1], '(?i)^(?:a|an|the|of|to|and|or|is|are)$')
  AND NOT regexp_matches(term, '\\b(?:whether|that|which|who|if|when|you|your|we|our|I)\\b')
  AND NOT (regexp_matches(regexp_split_to_array(term, '\\s+')[1], '(?i)ing$') AND coalesce(regexp_matches(regexp_split_to_array(term, '\\s+')[2], '(?i)^(?:a|an|the|every|each|your|our)$'), false))"""
_PLAUSIBLE_DEFINITION = """len(regexp_split_to_array({0}, '\\s+')) BETWEEN 5 AND 45 AND NOT regexp_matches({0}, '[!?]|[,.]["”’](?:\\s|$)|["”’][,.]?\\s+(?:said|cried|interrupted|asked|replied)|[<>{{}}=]')
  AND NOT regexp_matches({0}, '(?i)^(?:the following|this (?:specification|section|chapter|book|guide|document)|for example|see\\b)') AND NOT regexp_matches({0}, '""" + _re(T.PERSON) + """')"""
_CLEAN = """regexp_replace(trim(regexp_replace(regexp_replace(trim(regexp_replace({0}, '\\bSee also [^.]+\\.\\s*', '', 'g')), '(?i)^(?:defined as|known as)\\s+', ''), '[.;:]+$', '')), '^(.+?)[\\s,;:]*\\([^()]*$', '\\1')"""
FOUND = SENTENCES + f""",
parts AS (SELECT *, regexp_extract(sentence, '{_re(T.DEFINITION)}', ['a', 'b', 'c']) AS m FROM sents WHERE NOT regexp_matches(sentence, '^["“‘'']|[!?]')),
told AS (SELECT book_id, idx, pos, sentence, chapter, trim(m.a) AS term, m.b AS verb, regexp_matches(m.c, '^defined as\\s+') AS explicit, trim(regexp_replace(m.c, '^defined as\\s+', '')) AS body FROM parts WHERE m.b <> ''),
judged AS (SELECT *, lower(regexp_replace(regexp_extract(body, '^(?:a|an|the|any|one of the|one of)\\s+(\\S+)', 1), '\\W', '', 'g')) AS article,
  regexp_extract(body, '^(?:a|an|the|any|one of the|one of)\\s+(\\S+)', 1) <> '' AS has_article FROM told),
found AS (SELECT book_id, idx, pos, sentence, chapter, term, upper({_CLEAN.format('body')}[1]) || {_CLEAN.format('body')}[2:] AS definition FROM judged
  WHERE CASE WHEN verb IN ('is', 'are') AND NOT explicit THEN NOT regexp_matches(body, '^(?:{T.NOT_DEFINING})\\b') AND CASE WHEN has_article THEN article NOT IN ({_WORDS(T.EVALUATIVE)}) ELSE regexp_matches(body, '^\\S+(?:\\s+\\S+){{0,8}}?\\s+(?:that|which|who|whose|where)\\b') END
    ELSE NOT regexp_matches(body, '(?i)^that\\b') END AND {_PLAUSIBLE_TERM} AND {_PLAUSIBLE_DEFINITION.format('body')})"""


@query(f"WITH {FOUND} SELECT book_id, idx, pos, term, definition FROM found")
def txt9_definition_in_sentence(spark, sf_dir: str) -> DataFrame:
    s = mining.sentences(passages.study_passages(A.blocks(spark, sf_dir))).where(F.col("sentence").rlike("\\s(?:is|are|refers to|means|denotes)\\s"))
    return s.withColumn("d", T.definition_in_sentence(F.col("sentence"))).where("d IS NOT NULL").select("book_id", "idx", "pos", "d.*")


@query(f"WITH {SENTENCES} SELECT book_id, idx, pos, upper({_CLEAN.format('sentence')}[1]) || {_CLEAN.format('sentence')}[2:] AS clean FROM sents")
def txt6_clean_definition(spark, sf_dir: str) -> DataFrame:
    s = mining.sentences(passages.study_passages(A.blocks(spark, sf_dir)))
    return s.select("book_id", "idx", "pos", T.clean_definition(F.col("sentence")).alias("clean"))


@query(f"WITH {SENTENCES}, terms AS (SELECT book_id, idx, pos, array_to_string(string_split(sentence, ' ')[1:3], ' ') AS term FROM sents) SELECT book_id, idx, pos, term, {_PLAUSIBLE_TERM} AS plausible FROM terms")
def txt7_plausible_term(spark, sf_dir: str) -> DataFrame:
    s = mining.sentences(passages.study_passages(A.blocks(spark, sf_dir))).withColumn("term", F.substring_index("sentence", " ", 3))
    return s.select("book_id", "idx", "pos", "term", T.plausible_term(F.col("term")).alias("plausible"))


@query(f"WITH {SENTENCES} SELECT book_id, idx, pos, {_PLAUSIBLE_DEFINITION.format('sentence')} AS plausible FROM sents")
def txt8_plausible_definition(spark, sf_dir: str) -> DataFrame:
    s = mining.sentences(passages.study_passages(A.blocks(spark, sf_dir)))
    return s.select("book_id", "idx", "pos", T.plausible_definition(F.col("sentence")).alias("plausible"))


CANDIDATES = FOUND + """,
candidates AS (SELECT *, trim(regexp_replace(replace(lower(term), '’', ''''), '\\s+', ' ', 'g')) AS key FROM found WHERE chapter NOT IN ('Preface', 'Glossary of terms'))"""


@query(f"WITH {CANDIDATES} SELECT book_id, idx, pos, term, definition, chapter FROM candidates")
def min5_sentence_candidates(spark, sf_dir: str) -> DataFrame:
    return mining.sentence_candidates(mining.sentences(passages.study_passages(A.blocks(spark, sf_dir)))).select("book_id", "idx", "pos", "term", "definition", "chapter")


COUNTS = CANDIDATES + """,
keys AS (SELECT DISTINCT book_id, key FROM candidates),
counts AS (SELECT k.book_id, k.key, sum((length(lower(s.text)) - length(replace(lower(s.text), k.key, ''))) // length(k.key))::BIGINT AS n FROM keys k JOIN study s ON k.book_id = s.book_id AND s.kind IN ('paragraph', 'list-item') GROUP BY ALL)"""


@query(f"WITH {COUNTS} SELECT book_id, key, n FROM counts")
def min6_term_counts(spark, sf_dir: str) -> DataFrame:
    study = written(passages.study_passages(A.blocks(spark, sf_dir)), "study")
    c = written(mining.sentence_candidates(mining.sentences(study)), "candidates")
    return mining.term_counts(c.select("book_id", T.key_of(F.col("term")).alias("key")), study)


_ENDS_SHORT = f"(^|[^A-Za-z.])\\.*(?:{_ABBR}|[A-Z])\\.[\"”’)\\]]*$"


def _first_sentence(x: str) -> str:
    """SQL: the pieces of a text up to the first one that does not end in an abbreviation."""
    pieces = f"string_split({_SPLIT.format(x)}, chr(1))"
    return f"trim(array_to_string(({pieces})[1:coalesce(nullif(list_position(list_transform({pieces}, lambda p: NOT regexp_matches(p, '{_ENDS_SHORT}')), true), 0), len({pieces}))], ' '))"


_ENTRY = f"""SELECT book_id, idx, text, path, nxt, at_, regexp_matches(trim(text), '{_re(T.GLOSSARY)}') AS framed, trim(regexp_replace(regexp_extract(trim(text), '{_re(T.GLOSSARY)}', 1), '\\s*\\([^)]*\\)$', '')) AS term,
  trim(regexp_replace(regexp_extract(trim(text), '{_re(T.GLOSSARY)}', 2), '\\bSee also [^.]+\\.\\s*', '', 'g')) AS told"""
_CAPITAL = "upper({0}[1]) || {0}[2:]"
_DEFINED_BY = _CLEAN.format(_first_sentence("told"))
GLOSSED = SENTENCES + f""",
blocks_on AS (SELECT *, lead(text) OVER w AS nxt, lead(idx) OVER w AS at_ FROM study WHERE kind IN ('paragraph', 'list-item') WINDOW w AS (PARTITION BY book_id ORDER BY idx)),
split_up AS ({_ENTRY} FROM blocks_on),
cleaned AS (SELECT *, {_CAPITAL.format('(' + _DEFINED_BY + ')')} AS definition FROM split_up),
entries AS (SELECT *, framed AND {_PLAUSIBLE_TERM} AND {_PLAUSIBLE_DEFINITION.format('definition')} AS whole FROM cleaned)"""
GLOSSARY = GLOSSED + f""",
inside AS (SELECT * FROM entries WHERE len(list_filter(path, lambda p: regexp_matches(p, '{_re(T.GLOSSARY_SECTION)}'))) > 0),
short AS (SELECT book_id, at_ AS idx, text AS term, nxt AS sentence, path, trim(regexp_replace(nxt, '\\bSee also [^.]+\\.\\s*', '', 'g')) AS told FROM inside
  WHERE NOT whole AND at_ = idx + 1 AND NOT regexp_matches(text, '[.!?]$') AND len(regexp_split_to_array(text, '\\s+')) <= 6),
short_cleaned AS (SELECT *, {_CAPITAL.format('(' + _DEFINED_BY + ')')} AS definition FROM short),
glossary AS (SELECT book_id, idx, 0 AS pos, term, definition, text AS sentence, path[1] AS chapter FROM inside WHERE whole
  UNION ALL SELECT book_id, idx, -1, term, definition, sentence, path[1] FROM short_cleaned WHERE {_PLAUSIBLE_TERM} AND {_PLAUSIBLE_DEFINITION.format('definition')})"""


@query(f"WITH {GLOSSED} SELECT book_id, idx, CASE WHEN whole THEN term END AS term, CASE WHEN whole THEN definition END AS definition FROM entries")
def txt10_glossary_entry(spark, sf_dir: str) -> DataFrame:
    study = passages.study_passages(A.blocks(spark, sf_dir)).where(F.col("kind").isin("paragraph", "list-item"))
    return study.select("book_id", "idx", T.glossary_entry(F.col("text")).alias("e")).select("book_id", "idx", "e.*")


@query(f"WITH {GLOSSARY} SELECT * FROM glossary")
def min4_glossary_candidates(spark, sf_dir: str) -> DataFrame:
    return mining.glossary_candidates(passages.study_passages(A.blocks(spark, sf_dir)))


DEFINED = COUNTS + GLOSSARY.removeprefix(SENTENCES) + """,
every AS (SELECT book_id, key, term, definition, idx, pos, sentence, chapter, false AS glossed FROM candidates
  UNION ALL SELECT book_id, trim(regexp_replace(replace(lower(term), '’', ''''), '\\s+', ' ', 'g')), term, definition, idx, pos, sentence, chapter, true FROM glossary),
defined AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.book_id, c.key ORDER BY c.idx, c.pos) AS n_ FROM every c LEFT JOIN counts k ON c.book_id = k.book_id AND c.key = k.key
  WHERE NOT contains(lower(definition), c.key) AND (glossed OR coalesce(k.n, 0) >= 2)) WHERE n_ = 1)"""
_DEFINED_ROWS = "SELECT book_id, key, term, definition, idx, pos, sentence, chapter FROM defined"


@query(f"WITH {DEFINED} {_DEFINED_ROWS}")
def min7_definitions(spark, sf_dir: str) -> DataFrame:
    return mining.book_definitions(written(passages.study_passages(A.blocks(spark, sf_dir)), "study"))


def concept_blocks(spark, sf_dir: str) -> DataFrame:
    """Blocks of which every third begins with a definition and a second mention of its term, both made of the block's own words: the given prose hardly defines anything twice."""
    words = F.split(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ")
    term, body = F.array_join(F.slice(words, 1, 2), " "), F.lower(F.array_join(F.slice(words, 3, 8), " "))
    told = F.concat(F.upper(F.substring(term, 1, 1)), F.substring(term, F.lit(2), F.length(term)), F.lit(" is a kind of "), body, F.lit(". More on "), F.lower(term), F.lit(" follows. "), F.col("text"))
    return A.blocks(spark, sf_dir).withColumn("text", F.when((F.col("idx") % 3 == 0) & (F.col("kind") != "heading"), told).otherwise(F.col("text")))


def _on_concepts(sql: str) -> str:
    words = "string_split(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')"
    term, body = f"array_to_string(({words})[1:2], ' ')", f"lower(array_to_string(({words})[3:10], ' '))"
    told = f"upper(({term})[1]) || ({term})[2:] || ' is a kind of ' || {body} || '. More on ' || lower({term}) || ' follows. ' || text"
    concept = f"concept AS (SELECT * REPLACE (CASE WHEN idx % 3 = 0 AND kind <> 'heading' THEN {told} ELSE text END AS text) FROM blocks),\nflagged AS (SELECT *, kind"
    return sql.replace("flagged AS (SELECT *, kind", concept).replace("AS numbered FROM blocks)", "AS numbered FROM concept)")


CONCEPTS = _on_concepts(DEFINED)


def _all_definitions(spark, sf_dir: str) -> DataFrame:
    """Passages are written, as an import would have stored them; so are the definitions, which questions read many times."""
    study = written(passages.study_passages(concept_blocks(spark, sf_dir)), "study")
    return written(mining.book_definitions(study), "definitions")


@query(f"WITH {CONCEPTS} SELECT book_id, key, term, definition, idx, pos, chapter FROM defined")
def min7_sentence_definitions(spark, sf_dir: str) -> DataFrame:
    return _all_definitions(spark, sf_dir).select("book_id", "key", "term", "definition", "idx", "pos", "chapter")


DISTRACTED = CONCEPTS + """,
pairs AS (SELECT d.book_id, d.key, o.key AS o_key, row_number() OVER (PARTITION BY d.book_id, d.key ORDER BY (o.chapter <> d.chapter)::INT, abs(length(o.definition) - length(d.definition)), o.idx, o.pos, o.key) AS r
  FROM defined d JOIN defined o ON d.book_id = o.book_id AND NOT (d.key = o.key OR contains(d.key, o.key) OR contains(o.key, d.key)) AND NOT contains(lower(o.definition), d.key) AND o.definition <> d.definition),
near AS (SELECT *, row_number() OVER (PARTITION BY book_id, key ORDER BY md5(key || '|' || o_key)) AS n, count(*) OVER (PARTITION BY book_id, key) AS c FROM pairs WHERE r <= 6),
wrong AS (SELECT book_id, key, n, o_key AS other FROM near WHERE n <= 3 AND c >= 3)"""


@query(f"WITH {DISTRACTED} SELECT * FROM wrong")
def qst1_definition_distractors(spark, sf_dir: str) -> DataFrame:
    return questions.definition_distractors(_all_definitions(spark, sf_dir))


_ASKED = DISTRACTED + """, w AS (SELECT x.book_id, x.key, list(o.term ORDER BY n) AS terms, list(o.definition ORDER BY n) AS defs FROM wrong x JOIN defined o ON x.book_id = o.book_id AND x.other = o.key GROUP BY ALL),
q AS (SELECT d.*, terms, defs, substring(md5('coin|' || d.key), 1, 1) < '8' AS ask, CASE WHEN regexp_matches(definition, '^[A-Z][a-z]') THEN lower(definition[1]) || definition[2:] ELSE definition END AS low FROM defined d JOIN w ON d.book_id = w.book_id AND d.key = w.key)
SELECT book_id, CASE WHEN ask THEN 'term' ELSE 'define' END AS style, CASE WHEN ask THEN 'Which term does the book describe as “' || low || '”?' ELSE 'Which of the following best describes “' || term || '”?' END AS stem,
  array_to_string(CASE WHEN ask THEN [term] || terms ELSE [definition] || defs END, ' / ') AS options, idx, sentence AS quote, chapter FROM q"""


@query(f"WITH {_ASKED}")
def qst2_definition_questions(spark, sf_dir: str) -> DataFrame:
    q = questions.definition_questions(_all_definitions(spark, sf_dir))
    return q.select("book_id", "style", "stem", F.array_join("options", " / ").alias("options"), F.get("block_indexes", 0).alias("idx"), "quote", "chapter")


#: Law names for the given prose, which has none: a fixed list, dealt to sentences by position.
_LAWS = ("Fair Credit Act", "Open Data Rule", "Clean Harbor Regulation", "Public Records Act", "Rural Broadband Act", "Safe Toys Directive", "Digital Markets Act", "Student Privacy Act", "Federal Water Commission", "National Seed Board")


def law_blocks(spark, sf_dir: str) -> DataFrame:
    """Blocks of which every third begins with what a law or agency requires; the rest of the line is the given text."""
    n = (F.col("idx") % len(_LAWS) + 1).cast("int")
    name = F.element_at(F.array(*[F.lit(x) for x in _LAWS]), n)
    acronym = F.when(F.col("idx") % 4 == 1, F.concat(F.lit(" (L"), n.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    words = F.array_join(F.slice(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]+", " "), " +"), 1, 9), " ")
    told = F.concat(F.when(F.col("idx") % 2 == 0, "Under the ").otherwise("The "), name, acronym, F.when(F.col("idx") % 2 == 0, ", firms must ").otherwise(" requires firms to "), words, F.lit(". "), F.col("text"))
    return A.blocks(spark, sf_dir).withColumn("text", F.when((F.col("idx") % 3 == 0) & (F.col("kind") != "heading"), told).otherwise(F.col("text")))


_LAW_SENTENCES = SENTENCES.replace("flagged AS (SELECT *, kind", f"""lawful AS (SELECT * REPLACE (CASE WHEN idx % 3 = 0 AND kind <> 'heading' THEN
  CASE WHEN idx % 2 = 0 THEN 'Under the ' ELSE 'The ' END || [{', '.join(f"'{x}'" for x in _LAWS)}][idx % 10 + 1] || CASE WHEN idx % 4 = 1 THEN ' (L' || (idx % 10 + 1) || ')' ELSE '' END
  || CASE WHEN idx % 2 = 0 THEN ', firms must ' ELSE ' requires firms to ' END || array_to_string(regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g'), ' +')[1:9], ' ') || '. ' || text ELSE text END AS text) FROM blocks),
flagged AS (SELECT *, kind""").replace("AS numbered FROM blocks)", "AS numbered FROM lawful)")
_ACRONYM = r"\s*\(([A-Z][A-Z0-9&]{1,7})\)"
_HITS = "\nUNION ALL ".join(
    f"SELECT book_id, idx, pos, {p} AS p, '{kind}' AS kind, unnest(regexp_extract_all(sentence, '{_re(pattern)}')) AS raw, unnest(regexp_extract_all(sentence, '(?:{_re(pattern)})(?:{_ACRONYM})?', 1)) AS acronym, unnest(range(len(regexp_extract_all(sentence, '{_re(pattern)}')))) AS n FROM sents"
    for p, (kind, pattern) in enumerate(mining.ENTITY_PATTERNS)
)
_ENTITIES = _LAW_SENTENCES + f""",
hits AS ({_HITS}),
named AS (SELECT *, regexp_replace(trim(raw), '^(?:(?:{T.LEADING})\\s+)+', '') AS name FROM hits),
entities AS (SELECT book_id, trim(regexp_replace(replace(lower(name), '’', ''''), '\\s+', ' ', 'g')) AS key, first(name ORDER BY idx, pos, p, n) AS name, first(kind ORDER BY idx, pos, p, n) AS kind,
  first(acronym ORDER BY idx, pos, p, n) FILTER (coalesce(acronym, '') <> '') AS acronym FROM named WHERE len(regexp_split_to_array(name, '\\s+')) >= 2 GROUP BY book_id, key)"""
_AFTER = r"(?:\s*\([A-Z][A-Z0-9&]{1,7}\))?"
_WAS = _re(mining._ENACTED)
_SPACED = "' ' || regexp_replace(lower(predicate), '[^a-z0-9_]+', ' ', 'g') || ' '"
_DUTIES = _ENTITIES + f""",
bodies AS (SELECT *, regexp_replace(sentence, '\\.$', '') AS body, regexp_extract(regexp_replace(sentence, '\\.$', ''), '^(Under (?:the )?|The\\s+)?', 1) AS lead FROM sents WHERE regexp_matches(sentence, '^[A-Z]')),
forms AS (SELECT *, substring(body, length(lead) + 1) AS rest FROM bodies UNION ALL SELECT * REPLACE ('' AS lead), body AS rest FROM bodies WHERE starts_with(lead, 'The')),
starts AS (SELECT *, unnest([name, acronym]) AS start FROM entities),
begun AS (SELECT f.*, x.key, x.name, x.kind, x.acronym, substring(f.rest, length(x.start) + 1) AS after FROM forms f JOIN starts x ON x.book_id = f.book_id AND x.start IS NOT NULL AND starts_with(f.rest, x.start)
  AND (length(f.rest) = length(x.start) OR regexp_matches(f.rest[length(x.start) + 1], '[\\s,(]'))),
told AS (SELECT *, starts_with(lead, 'Under') AS under, CASE WHEN starts_with(lead, 'Under') THEN regexp_extract(after, '^{_AFTER},\\s+(.+)$', 1) ELSE regexp_extract(after, '^{_AFTER}(?:,\\s+[^,]{{3,90}},)?\\s+(.+)$', 1) END AS said FROM begun),
best AS (SELECT *, row_number() OVER (PARTITION BY book_id, idx, pos ORDER BY length(name) DESC, key) AS r FROM told WHERE said <> ''),
plain AS (SELECT *, regexp_extract(said, '{_WAS}', 1) AS how, regexp_replace(CASE WHEN regexp_extract(said, '{_WAS}', 1) = 'and' THEN regexp_extract(said, '{_WAS}', 2) ELSE said END, '{_re(mining._ADVERB)}', '') AS p FROM best WHERE r = 1),
predicates AS (SELECT *, CASE WHEN under THEN said WHEN how = 'to' THEN 'was enacted to ' || regexp_extract(said, '{_WAS}', 2) WHEN (NOT regexp_matches(said, '{_WAS}') OR how = 'and') AND regexp_matches(p, '^(?:{mining.DUTY_VERBS})\\b') THEN p END AS predicate FROM plain),
duties AS (SELECT book_id, idx, pos, key, name, kind, acronym, regexp_replace(predicate, '[.;:,]+$', '') AS predicate, under, sentence, chapter FROM predicates WHERE len(regexp_split_to_array(predicate, '\\s+')) BETWEEN 4 AND 40
  AND NOT contains({_SPACED}, ' ' || lower(name) || ' ') AND NOT coalesce(contains({_SPACED}, ' ' || lower(acronym) || ' '), false))"""


@query(f"WITH {_ENTITIES} SELECT book_id, key, name, kind, acronym FROM entities")
def min2_find_entities(spark, sf_dir: str) -> DataFrame:
    return mining.find_entities(mining.sentences(passages.study_passages(law_blocks(spark, sf_dir))))


def _laws(spark, sf_dir: str):
    """Sentences, entities and duties are written: each is read by what follows."""
    s = written(mining.sentences(passages.study_passages(law_blocks(spark, sf_dir))), "sentences")
    e = written(mining.find_entities(s), "entities")
    d = written(mining.find_duties(s, e), "duties")
    return e, d, mining.first_duty(d)


@query(f"WITH {_DUTIES} SELECT * FROM duties")
def min3_find_duties(spark, sf_dir: str) -> DataFrame:
    return _laws(spark, sf_dir)[1]


@query(f"WITH {_DUTIES} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY book_id, key ORDER BY idx, pos) AS r FROM duties) WHERE r = 1")
def min8_first_duty(spark, sf_dir: str) -> DataFrame:
    return _laws(spark, sf_dir)[2]


@query(f"""WITH {_DUTIES}, fd AS (SELECT book_id, key, chapter FROM (SELECT *, row_number() OVER (PARTITION BY book_id, key ORDER BY idx, pos) AS r FROM duties) WHERE r = 1),
e AS (SELECT e.book_id, e.kind, e.key, fd.chapter FROM entities e LEFT JOIN fd ON e.book_id = fd.book_id AND e.key = fd.key),
pairs AS (SELECT d.book_id, d.idx, d.pos, e.key, row_number() OVER (PARTITION BY d.book_id, d.idx, d.pos ORDER BY (e.chapter IS DISTINCT FROM d.chapter)::INT, md5(md5(d.sentence) || '|' || e.key)) AS r
  FROM duties d JOIN e ON d.book_id = e.book_id AND d.kind = e.kind AND NOT contains(d.key, e.key) AND NOT contains(e.key, d.key) AND NOT contains(lower(d.sentence), e.key))
SELECT book_id, idx, pos, list(key ORDER BY r) AS wrong FROM pairs WHERE r <= 3 GROUP BY ALL HAVING count(*) = 3""")
def qst3_law_distractors(spark, sf_dir: str) -> DataFrame:
    e, d, f = _laws(spark, sf_dir)
    return questions.law_distractors(d, e, f)


_LAW_ASKED = _DUTIES + """, fd AS (SELECT book_id, key, chapter FROM (SELECT *, row_number() OVER (PARTITION BY book_id, key ORDER BY idx, pos) AS r FROM duties) WHERE r = 1),
e AS (SELECT e.book_id, e.kind, e.key, e.name || CASE WHEN e.acronym IS NULL THEN '' ELSE ' (' || e.acronym || ')' END AS shown, fd.chapter FROM entities e LEFT JOIN fd ON e.book_id = fd.book_id AND e.key = fd.key),
pairs AS (SELECT d.book_id, d.idx, d.pos, e.shown, row_number() OVER (PARTITION BY d.book_id, d.idx, d.pos ORDER BY (e.chapter IS DISTINCT FROM d.chapter)::INT, md5(md5(d.sentence) || '|' || e.key)) AS r
  FROM duties d JOIN e ON d.book_id = e.book_id AND d.kind = e.kind AND NOT contains(d.key, e.key) AND NOT contains(e.key, d.key) AND NOT contains(lower(d.sentence), e.key)),
wrong AS (SELECT book_id, idx, pos, list(shown ORDER BY r) AS others FROM pairs WHERE r <= 3 GROUP BY ALL HAVING count(*) = 3),
asked AS (SELECT d.*, others, row_number() OVER (PARTITION BY d.book_id, d.key ORDER BY d.idx, d.pos) AS n FROM duties d JOIN wrong w ON d.book_id = w.book_id AND d.idx = w.idx AND d.pos = w.pos)
SELECT book_id, idx, CASE WHEN under THEN 'Which ' || kind || ' is this? “Under this ' || kind || ', ' || CASE WHEN regexp_matches(predicate, '^[A-Z][a-z]') THEN lower(predicate[1]) || predicate[2:] ELSE predicate END || '.”' ELSE 'Which ' || kind || ' ' || predicate || '?' END AS stem,
  array_to_string([name || CASE WHEN acronym IS NULL THEN '' ELSE ' (' || acronym || ')' END] || others, ' / ') AS options, sentence AS quote, chapter FROM asked WHERE n <= 4"""


@query(f"WITH {_LAW_ASKED}")
def qst4_law_questions(spark, sf_dir: str) -> DataFrame:
    e, d, f = _laws(spark, sf_dir)
    q = questions.law_questions(d, e, f)
    return q.select("book_id", F.get("block_indexes", 0).alias("idx"), "stem", F.array_join("options", " / ").alias("options"), "quote", "chapter")


@query(f"""SELECT coalesce(a.book_id, b.book_id) AS book_id, coalesce("define", 0) AS "define", coalesce(term, 0) AS term, coalesce(law, 0) AS law
FROM (SELECT book_id, count(*) FILTER (style = 'define') AS "define", count(*) FILTER (style = 'term') AS term FROM (WITH {_ASKED}) GROUP BY book_id) a
FULL JOIN (SELECT book_id, count(*) AS law FROM (WITH {_LAW_ASKED}) GROUP BY book_id) b ON a.book_id = b.book_id""")
def qst5_generate_concepts(spark, sf_dir: str) -> DataFrame:
    e, d, f = _laws(spark, sf_dir)
    both = questions.generate_concepts(questions.definition_questions(_all_definitions(spark, sf_dir)), questions.law_questions(d, e, f))
    return questions.style_counts(both)


@query(f"""WITH {A.SIDES}, fresh AS (SELECT * FROM there WHERE source = 'cloze'), mine AS (SELECT DISTINCT book_id FROM fresh)
SELECT h.id, h.stem, h.flagged, h.flagged_at FROM here h WHERE NOT (source = 'cloze' AND book_id IN (SELECT book_id FROM mine)) AND id NOT IN (SELECT id FROM fresh)
UNION ALL SELECT f.id, f.stem, coalesce(h.flagged, f.flagged), coalesce(h.flagged_at, f.flagged_at) FROM fresh f LEFT JOIN here h ON f.id = h.id""")
def qst6_replace_concepts(spark, sf_dir: str) -> DataFrame:
    here, there = A.sides(spark, sf_dir)
    return merge.replace_concepts(here, there.where("source = 'cloze'")).select("id", "stem", "flagged", "flagged_at")


# ---------------------------------------------------------------- slices

_RUNS = NOTED + """,
passages AS (SELECT book_id, idx, path[1] AS chapter, length(text) AS chars FROM study WHERE length(text) >= 20),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY book_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN chapter IS DISTINCT FROM lag(chapter) OVER (PARTITION BY book_id ORDER BY idx) THEN 1 ELSE 0 END AS fresh FROM passages)),
placed AS (SELECT *, row_number() OVER (PARTITION BY book_id, run ORDER BY idx) AS n FROM runs),
walk AS (
  SELECT book_id, run, n, idx, chars AS total, 1 AS raw FROM placed WHERE n = 1
  UNION ALL SELECT p.book_id, p.run, p.n, p.idx, CASE WHEN w.total + p.chars > 600 THEN p.chars ELSE w.total + p.chars END, CASE WHEN w.total + p.chars > 600 THEN w.raw + 1 ELSE w.raw END
  FROM walk w JOIN placed p ON p.book_id = w.book_id AND p.run = w.run AND p.n = w.n + 1),
raw AS (SELECT w.book_id, w.run, w.raw, p.chapter, min(w.idx) AS a, max(w.idx) AS z, sum(p.chars) AS chars FROM walk w JOIN placed p ON p.book_id = w.book_id AND p.run = w.run AND p.n = w.n GROUP BY ALL),
fold AS (
  SELECT book_id, run, raw, chapter, a, z, chars, 1 AS slice FROM raw WHERE raw = 1
  UNION ALL SELECT r.book_id, r.run, r.raw, r.chapter, CASE WHEN r.chars < 150 AND f.chars + r.chars <= 780.0 THEN f.a ELSE r.a END, r.z,
    CASE WHEN r.chars < 150 AND f.chars + r.chars <= 780.0 THEN f.chars + r.chars ELSE r.chars END, CASE WHEN r.chars < 150 AND f.chars + r.chars <= 780.0 THEN f.slice ELSE f.slice + 1 END
  FROM fold f JOIN raw r ON r.book_id = f.book_id AND r.run = f.run AND r.raw = f.raw + 1),
slices AS (SELECT book_id, run, chapter, slice, min(a) AS a, max(z) AS z, max(chars) AS chars FROM fold GROUP BY ALL)"""
SLICES = "RECURSIVE " + _RUNS


@query(f"WITH {SLICES} SELECT book_id, run, chapter, a || '-' || z AS slice_key, a AS start, z AS stop, chars::BIGINT AS chars FROM slices")
def llm1_slice_book(spark, sf_dir: str) -> DataFrame:
    return slices.slice_book(A.blocks(spark, sf_dir), 600, 150)


@query(f"WITH {SLICES.replace('> 600 THEN', '> 36000 THEN').replace('< 150 AND', '< 4000 AND').replace('<= 780.0', '<= 46800.0')} SELECT book_id, run, chapter, a || '-' || z AS slice_key, a AS start, z AS stop, chars::BIGINT AS chars FROM slices")
def llm1_full_size_slices(spark, sf_dir: str) -> DataFrame:
    """Slices at the sizes that are meant for use."""
    return slices.slice_book(A.blocks(spark, sf_dir))


@query("SELECT doc_id, least(12, greatest(2, floor(n_chars / 3000 + 0.5)))::INT AS wanted FROM documents WHERE doc_id IS NOT NULL")
def llm2_questions_wanted(spark, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", slices.questions_wanted(F.col("n_chars")).alias("wanted"))


@query(f"WITH {A.QUESTIONS} SELECT id, string_split(chunk, '-')[1]::INT AS first, string_split(chunk, '-')[2]::INT AS last FROM questions")
def llm3_parse_range(spark, sf_dir: str) -> DataFrame:
    return A.questions(spark, sf_dir).select("id", slices.parse_range(F.col("chunk")).alias("r")).select("id", "r.*")


_DONE = "done AS (SELECT DISTINCT book_id, string_split(chunk, '-')[1]::INT AS a, string_split(chunk, '-')[2]::INT AS z FROM questions WHERE chunk IS NOT NULL)"


def _done(spark, sf_dir: str) -> DataFrame:
    return bank.done_slices(A.questions(spark, sf_dir))


# the note test sees only what is left: the ranges go before it
PENDING = "RECURSIVE " + A.QUESTIONS + ", " + _DONE + ", " + _RUNS.strip().replace("flagged AS (SELECT *, kind", "left_ AS (SELECT b.* FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.book_id = b.book_id AND b.idx BETWEEN d.a AND d.z)),\nflagged AS (SELECT *, kind").replace("AS numbered FROM blocks)", "AS numbered FROM left_)")


@query(f"WITH {PENDING} SELECT book_id, chapter, a || '-' || z AS slice_key, chars::BIGINT AS chars FROM slices")
def llm4_pending_slices(spark, sf_dir: str) -> DataFrame:
    return slices.pending_slices(A.blocks(spark, sf_dir), _done(spark, sf_dir), 600, 150).select("book_id", "chapter", "slice_key", "chars")


@query(f"""WITH {PENDING}, allnoted AS (SELECT * FROM blocks WHERE kind <> 'heading' AND path[1] <> 'Notes'),
c AS (SELECT book_id, path[1] AS chapter, min(idx) AS first_idx FROM allnoted GROUP BY ALL), t AS (SELECT book_id, chapter, count(*) AS n, sum(least(12, greatest(2, floor(chars / 3000 + 0.5))))::BIGINT AS q FROM slices GROUP BY ALL)
SELECT c.book_id, c.chapter, first_idx, coalesce(n, 0) AS slices, coalesce(q, 0) AS questions, 2 * coalesce(n, 0) AS requests, coalesce(n, 0) = 0 AS done FROM c LEFT JOIN t ON c.book_id = t.book_id AND c.chapter = t.chapter""")
def llm5_slice_plan(spark, sf_dir: str) -> DataFrame:
    return slices.slice_plan(A.blocks(spark, sf_dir), _done(spark, sf_dir), 600, 150)


@query(f"""WITH {SLICES}, {A.BOOKS.strip()}, l AS (SELECT s.book_id, s.a, s.z, s.chapter, s.chars, string_agg('[P' || p.idx || '] ' || p.text, chr(10) ORDER BY p.idx) AS lines FROM slices s JOIN study p ON p.book_id = s.book_id AND p.idx BETWEEN s.a AND s.z AND length(p.text) >= 20 GROUP BY ALL)
SELECT l.book_id, a || '-' || z AS slice_key, concat_ws(chr(10), 'Book: ' || title, 'Section: ' || chapter, {', '.join("'" + r.replace("'", "''") + "'" for r in slices.WRITE_RULES)},
  'Write ' || least(12, greatest(2, floor(chars / 3000 + 0.5)))::INT || ' questions.', '', lines) AS prompt FROM l JOIN books b ON l.book_id = b.id""")
def llm6_write_requests(spark, sf_dir: str) -> DataFrame:
    b = A.blocks(spark, sf_dir)
    s = slices.slice_book(b, 600, 150)
    return slices.write_requests(s, slices.slice_blocks(s, b), A.books(spark, sf_dir)).drop("response_schema")


def responses(spark, sf_dir: str) -> DataFrame:
    """Model answers made from the slices: good, fenced and bad ones by slice."""
    s = slices.slice_book(A.blocks(spark, sf_dir), 600, 150)
    n = F.pmod(F.col("start"), F.lit(6))
    q = lambda stem, options, index, source: F.concat(F.lit('{"stem":"'), stem, F.lit('","options":['), options, F.lit('],"correctIndex":'), index, F.lit(',"explanations":["a","b","c","d"],"sourcePassages":['), source, F.lit("]}"))
    good, bad = F.lit('"A) one","two","three","four"'), F.lit('"one","ONE","three","all of the above"')
    own, other = F.concat(F.lit('"P'), F.col("start").cast("string"), F.lit('"')), F.lit("999999")
    first = q(F.concat(F.lit("Q"), F.col("slice_key")), F.when(n == 1, bad).otherwise(good), F.when(n == 2, "7").otherwise("1"), F.when(n == 3, other).otherwise(own))
    second = q(F.lit("Second"), good, F.lit('"2"'), F.col("stop").cast("string"))
    body = F.concat(F.lit('{"questions":['), first, F.lit(","), second, F.lit("]}"))
    return s.withColumn("text", F.when(n == 4, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(n == 5, F.lit("sorry")).otherwise(body))


@query(f"WITH {SLICES} SELECT book_id, a || '-' || z AS slice_key, a % 6 <> 5 AS parsed, CASE WHEN a % 6 <> 5 THEN 'Second' END AS second FROM slices")
def llm7_parse_json_text(spark, sf_dir: str) -> DataFrame:
    v = slices.parse_json_text(F.col("text"))
    return responses(spark, sf_dir).select("book_id", "slice_key", v.isNotNull().alias("parsed"), F.try_variant_get(v, "$.questions[1].stem", "string").alias("second"))


#: What responses() makes, in SQL.
_RESPONSES = SLICES + """,
written AS (SELECT *, a || '-' || z AS slice_key, '{"questions":[{"stem":"Q' || a || '-' || z || '","options":[' || CASE WHEN a % 6 = 1 THEN '"one","ONE","three","all of the above"' ELSE '"A) one","two","three","four"' END || '],"correctIndex":' || CASE WHEN a % 6 = 2 THEN '7' ELSE '1' END
  || ',"explanations":["a","b","c","d"],"sourcePassages":[' || CASE WHEN a % 6 = 3 THEN '999999' ELSE '"P' || a || '"' END || ']},{"stem":"Second","options":["A) one","two","three","four"],"correctIndex":"2","explanations":["a","b","c","d"],"sourcePassages":[' || z || ']}]}' AS body FROM slices),
responses AS (SELECT *, CASE a % 6 WHEN 4 THEN 'Here:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' WHEN 5 THEN 'sorry' ELSE body END AS text FROM written)"""


@query(f"""WITH {_RESPONSES}
SELECT book_id, slice_key, CASE WHEN a % 4 < 2 THEN '' ELSE text END AS text, CASE WHEN a % 4 = 0 OR a % 8 = 1 THEN 'blocked' WHEN a % 4 = 1 THEN 'bad-output' ELSE 'ok' END AS status,
  CASE WHEN a % 4 <> 0 THEN chars::INT END AS prompt_tokens, NULL::INT AS output_tokens, NULL::INT AS thinking_tokens FROM responses""")
def llm8_response_text(spark, sf_dir: str) -> DataFrame:
    """Answers of which a quarter is refused with the prompt, an eighth declined, an eighth empty."""
    n = F.pmod(F.col("start"), F.lit(4))
    shape = lambda text, finish: F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit("hm").alias("text"), F.lit(True).alias("thought")), F.struct(text.alias("text"), F.lit(None).cast("boolean").alias("thought"))).alias("parts")).alias("content"), finish.alias("finishReason"))).alias("candidates"), F.struct(F.col("chars").alias("promptTokenCount")).alias("usageMetadata"))
    body = F.when(n == 0, F.lit('{"promptFeedback":{"blockReason":"SAFETY"}}')).otherwise(F.to_json(shape(F.when(n == 1, F.lit("")).otherwise(F.col("text")), F.when(F.col("start") % 8 == 1, F.lit("RECITATION")).otherwise(F.lit("STOP")))))
    return responses(spark, sf_dir).select("book_id", "slice_key", slices.response_text(body).alias("r")).select("book_id", "slice_key", "r.*")


def _drafts(spark, sf_dir: str):
    b, r = A.blocks(spark, sf_dir), responses(spark, sf_dir)
    p = slices.slice_blocks(r, b)
    return r, p, slices.validate_drafts(r, p)


@query(f"""WITH {SLICES}, d AS (SELECT book_id, a || '-' || z AS slice_key, 0 AS pos, 'Q' || a || '-' || z AS stem, 1 AS answer, [a] AS sources FROM slices WHERE a % 6 IN (0, 4) UNION ALL SELECT book_id, a || '-' || z, 1, 'Second', 2, [z] FROM slices WHERE a % 6 <> 5)
SELECT book_id, slice_key, pos, stem, 'one,two,three,four' AS options, answer, array_to_string(sources, ',') AS sources FROM d""")
def llm9_validate_drafts(spark, sf_dir: str) -> DataFrame:
    d = _drafts(spark, sf_dir)[2]
    return d.select("book_id", "slice_key", "pos", "stem", F.array_join("options", ",").alias("options"), "answer", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {SLICES}, d AS (SELECT book_id, a || '-' || z AS slice_key, 0 AS pos, 'Q' || a || '-' || z AS stem FROM slices WHERE a % 6 IN (0, 4) UNION ALL SELECT book_id, a || '-' || z, 1, 'Second' FROM slices WHERE a % 6 <> 5),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, slice_key ORDER BY pos) AS q FROM d),
asked AS (SELECT book_id, slice_key, string_agg(concat_ws(chr(10), 'Question ' || q || ': ' || stem, '0) one', '1) two', '2) three', '3) four'), chr(10) || chr(10) ORDER BY q) AS asked FROM n GROUP BY ALL),
l AS (SELECT s.book_id, s.a || '-' || s.z AS slice_key, string_agg('[P' || p.idx || '] ' || p.text, chr(10) ORDER BY p.idx) AS lines FROM slices s JOIN study p ON p.book_id = s.book_id AND p.idx BETWEEN s.a AND s.z AND length(p.text) >= 20 GROUP BY ALL)
SELECT asked.book_id, asked.slice_key, concat_ws(chr(10), {', '.join("'" + r.replace("'", "''") + "'" for r in slices.CHECK_RULES)}, '', lines, '', asked) AS prompt, '{slices.CHECK_SCHEMA}' AS response_schema, 0.0::DOUBLE AS temperature
FROM asked JOIN l ON asked.book_id = l.book_id AND asked.slice_key = l.slice_key""")
def llm10_check_requests(spark, sf_dir: str) -> DataFrame:
    _, p, d = _drafts(spark, sf_dir)
    return slices.check_requests(d, p)


def checks(r: DataFrame) -> DataFrame:
    """Answers of the checking call: the first question agrees when the slice starts at an even block, the second is ambiguous for a third of them."""
    first = F.when(F.col("start") % 2 == 0, "1").otherwise("3")
    body = F.concat(F.lit('{"checks":[{"question":1,"answer":'), first, F.lit(',"ambiguous":false},{"question":1,"answer":1,"ambiguous":false},{"question":"2","answer":"2","ambiguous":'), (F.col("start") % 3 == 0).cast("string"), F.lit("}]}"))
    return r.select("book_id", "slice_key", body.alias("text"))


@query(f"""WITH {SLICES}, d AS (SELECT book_id, a, a || '-' || z AS slice_key, 0 AS pos, 1 AS answer FROM slices WHERE a % 6 IN (0, 4) UNION ALL SELECT book_id, a, a || '-' || z, 1, 2 FROM slices WHERE a % 6 <> 5),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, slice_key ORDER BY pos) AS q FROM d)
SELECT book_id, slice_key, pos, answer FROM n WHERE (q = 1 AND answer = CASE WHEN a % 2 = 0 THEN 1 ELSE 3 END) OR (q = 2 AND answer = 2 AND a % 3 <> 0)""")
def llm11_apply_check(spark, sf_dir: str) -> DataFrame:
    r, _, d = _drafts(spark, sf_dir)
    return slices.apply_check(d, checks(r)).select("book_id", "slice_key", "pos", "answer")


@query(f"""WITH {SLICES}, n AS (SELECT *, least(12, greatest(2, floor(chars / 3000 + 0.5)))::INT AS wanted, (a % 6 IN (0, 4))::INT AS one, (a % 6 <> 5)::INT AS two FROM slices),
k AS (SELECT *, one + two AS valid, CASE WHEN one = 1 THEN (a % 2 = 0)::INT + (a % 3 <> 0)::INT ELSE 0 END AS kept FROM n)
SELECT book_id, a || '-' || z AS slice_key, wanted, valid, kept, greatest(0, wanted - valid) + valid - kept AS dropped FROM k""")
def llm12_slice_results(spark, sf_dir: str) -> DataFrame:
    r, _, d = _drafts(spark, sf_dir)
    return slices.slice_results(r, d, slices.apply_check(d, checks(r)))


def _answered(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions from all slices' checked drafts, and those that are saved when two models have answered every even slice, the second one later, and all is saved twice."""
    r, _, d = _drafts(spark, sf_dir)
    kept = written(slices.apply_check(d, checks(r)), "kept")
    at = F.lit(1704067200) + F.length("slice_key")
    one = slices.question_rows(kept, r, F.lit("m1"), at)
    two = slices.question_rows(kept.where(F.substring_index("slice_key", "-", 1).cast("int") % 2 == 0), r, F.lit("m2"), at + 60)
    both = one.unionByName(two)
    saved = written(slices.save_questions(one.limit(0), both), "saved")
    return one, saved.unionByName(slices.save_questions(saved, both))


_KEPT = SLICES + """, d AS (SELECT book_id, chapter, a, z, a || '-' || z AS slice_key, 0 AS pos, 'Q' || a || '-' || z AS stem, 1 AS answer, a AS cited FROM slices WHERE a % 6 IN (0, 4) UNION ALL SELECT book_id, chapter, a, z, a || '-' || z, 1, 'Second', 2, z FROM slices WHERE a % 6 <> 5),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, slice_key ORDER BY pos) AS q FROM d),
kept AS (SELECT * FROM n WHERE (q = 1 AND answer = CASE WHEN a % 2 = 0 THEN 1 ELSE 3 END) OR (q = 2 AND answer = 2 AND a % 3 <> 0))"""


@query(f"""WITH {_KEPT} SELECT 'ai-' || md5(book_id || '|' || slice_key || '|' || stem || '|one|two|three|four') AS id, book_id, 'ai' AS source, stem, 'one|two|three|four' AS options, answer, cited AS block, chapter, slice_key AS chunk, 'm1' AS model, 1704067200 + length(slice_key) AS created_at FROM kept""")
def llm12_question_rows(spark, sf_dir: str) -> DataFrame:
    """Kept drafts become questions once, though many slices are answered twice and everything is saved twice."""
    q = _answered(spark, sf_dir)[1]
    return q.select("id", "book_id", "source", "stem", F.array_join("options", "|").alias("options"), "answer", F.get("block_indexes", 0).alias("block"), "chapter", "chunk", "model", "created_at")


def _again(sql: str) -> str:
    """The steps from blocks to slices a second time, over what the done ranges leave: all names get a 2."""
    steps = sql.removeprefix(A.BLOCKS).replace("AS numbered FROM blocks)", "AS numbered FROM left_)")
    for name in sorted(set(re.findall(r"^(\w+)(?:\([^)]*\))? AS \(", steps, re.MULTILINE)), key=len, reverse=True):
        steps = re.sub(rf"\b{name}\b(?! AS (?:BIGINT|INT))", f"{name}2", steps)
    return steps


@query(f"""WITH {_KEPT}, done AS (SELECT DISTINCT book_id, a, z FROM kept), left_ AS (SELECT b.* FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.book_id = b.book_id AND b.idx BETWEEN d.a AND d.z)){_again(_RUNS)}
SELECT book_id, chapter, a || '-' || z AS slice_key, chars::BIGINT AS chars FROM slices2""")
def llm12_saved_slices_are_done(spark, sf_dir: str) -> DataFrame:
    """What is still to be asked when the questions are saved: done slices (BNK4) of the bank go into the pending ones (LLM4)."""
    done = bank.done_slices(_answered(spark, sf_dir)[1])
    return slices.pending_slices(A.blocks(spark, sf_dir), done, 600, 150).select("book_id", "chapter", "slice_key", "chars")


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'invalid-key' WHEN 1 THEN 'forbidden' WHEN 2 THEN 'rate-limit' WHEN 3 THEN 'rate-limit' WHEN 4 THEN 'server' ELSE 'unknown' END AS kind,
  CASE event_id % 6 WHEN 2 THEN (event_id % 50) * 1000 END AS retry_ms, event_id % 6 = 3 AS daily FROM events""")
def llm13_classify_errors(spark, sf_dir: str) -> DataFrame:
    n = F.col("id") % 6
    status = F.element_at(F.array(*[F.lit(x) for x in (400, 403, 429, 429, 503, 404)]), (n + 1).cast("int"))
    body = (
        F.when(n == 0, F.lit('{"error":{"code":400,"message":"bad","details":[{"reason":"API_KEY_INVALID"}]}}'))
        .when(n == 2, F.concat(F.lit('{"error":{"code":429,"message":"slow down","details":[{"retryDelay":"'), (F.col("id") % 50).cast("string"), F.lit('s"}]}}')))
        .when(n == 3, F.lit('{"error":{"code":429,"message":"quota","details":[{"violations":[{"quotaId":"GenerateRequestsPerDayPerProject"}]}]}}'))
        .otherwise(F.lit("not json"))
    )
    return A.llm_calls(spark, sf_dir).select("id", slices.classify_error(status, body).alias("e")).select("id", "e.*")


@query(f"""WITH {A.CALLS}, p AS (SELECT book_id, part, sum(ms) AS part_ms, count(*) AS n, sum(CASE WHEN step = 'write' THEN ms ELSE 0 END) AS w, sum(CASE WHEN step = 'check' THEN ms ELSE 0 END) AS c, count(*) FILTER (used_up) AS u FROM calls GROUP BY ALL)
SELECT book_id, count(*) AS parts, sum(n)::BIGINT AS calls, sum(w)::BIGINT AS write_ms, sum(c)::BIGINT AS check_ms, round(avg(part_ms), 6) AS mean_part_ms, sum(u)::BIGINT AS used_up FROM p GROUP BY book_id""")
def llm14_run_totals(spark, sf_dir: str) -> DataFrame:
    return slices.run_totals(A.llm_calls(spark, sf_dir)).withColumn("mean_part_ms", F.round("mean_part_ms", 6))


def call_results(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls with tokens (thinking is often unknown), and what became of each part: a seventh is skipped."""
    n = F.col("id")
    c = A.llm_calls(spark, sf_dir).withColumns({"prompt_tokens": (n % 900 + 100).cast("int"), "output_tokens": (n % 70).cast("int"), "thinking_tokens": F.when(n % 3 == 0, (n % 11).cast("int"))})
    part = F.col("part")
    status = F.when(part % 7 == 3, "blocked").when(part % 21 == 5, "bad-output").otherwise("ok")
    return c, c.select("book_id", "part").distinct().withColumns({"status": status, "kept": (part % 5).cast("int"), "dropped": (part % 3).cast("int")})


@query(f"""WITH {A.CALLS}, t AS (SELECT *, id % 900 + 100 AS tin, id % 70 AS tout, CASE WHEN id % 3 = 0 THEN id % 11 ELSE 0 END AS think, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY book_id ORDER BY ts, id) AS pause FROM calls),
r AS (SELECT *, sum(CASE WHEN pause > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM t),
p AS (SELECT book_id, part, run, min(epoch_us(ts) // 1000000) AS began, max(epoch_us(ts) // 1000000) AS ended, count(*) AS calls, sum(ms) AS part_ms, {', '.join(f"sum(CASE WHEN step = '{step}' THEN {c} ELSE 0 END) AS {step}_{name}" for step in ("write", "check") for c, name in (("ms", "ms"), ("tin", "prompt_tokens"), ("tout", "output_tokens"), ("think", "thinking_tokens")))} FROM r GROUP BY ALL),
l AS (SELECT *, run = max(run) OVER (PARTITION BY book_id, part) AS last, part % 7 <> 3 AND part % 21 <> 5 AS ok FROM p)
SELECT book_id, run::BIGINT AS run, min(began) AS began, max(ended) AS ended, count(*) AS parts, sum(calls)::BIGINT AS calls, coalesce(sum(part % 5) FILTER (last AND ok), 0)::BIGINT AS kept, coalesce(sum(part % 3) FILTER (last AND ok), 0)::BIGINT AS dropped, count(*) FILTER (last AND NOT ok) AS skipped,
  round(avg(part_ms), 6) AS mean_part_ms, {', '.join(f"sum({step}_{name})::BIGINT AS {step}_{name}" for step in ("write", "check") for name in ("ms", "prompt_tokens", "output_tokens", "thinking_tokens"))} FROM l GROUP BY book_id, run""")
def llm14_run_report(spark, sf_dir: str) -> DataFrame:
    """Runs end at pauses of six hours: the given calls are few."""
    return slices.run_report(*call_results(spark, sf_dir), gap_seconds=21_600).withColumn("mean_part_ms", F.round("mean_part_ms", 6))


@query(f"WITH {A.CALLS} SELECT book_id, id, model, step, ms FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ts DESC, id DESC) AS n FROM calls) WHERE n <= 40")
def llm14_last_log_lines(spark, sf_dir: str) -> DataFrame:
    return slices.last_log_lines(A.llm_calls(spark, sf_dir))


@query(f"""WITH {A.CALLS}, d AS (SELECT *, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::DATE AS day FROM calls)
SELECT day, model, count(*) AS requests, bool_or(used_up) AS used_up, epoch((day + INTERVAL 1 DAY)::TIMESTAMP AT TIME ZONE 'America/Los_Angeles')::BIGINT AS resets_at FROM d GROUP BY day, model""")
def llm15_daily_usage(spark, sf_dir: str) -> DataFrame:
    return slices.daily_usage(A.llm_calls(spark, sf_dir))


# ---------------------------------------------------------------- bank and practice

_LIVE = "NOT coalesce(flagged, false)"


@query(f"WITH {A.QUESTIONS} SELECT book_id, count(*) FILTER (source = 'ai' AND {_LIVE}) AS ai, count(*) FILTER (source = 'cloze' AND {_LIVE}) AS cloze, count(*) FILTER (flagged) AS flagged, count(*) FILTER (source = 'cloze' AND style IS NULL) AS legacy FROM questions GROUP BY book_id")
def bnk1_bank_stats(spark, sf_dir: str) -> DataFrame:
    return bank.bank_stats(A.questions(spark, sf_dir))


@query(f"WITH {A.QUESTIONS} SELECT book_id, chapter, count(*) FILTER (source = 'ai') AS ai, count(*) FILTER (source = 'cloze') AS cloze, min(list_min(block_indexes)) AS first_block FROM questions WHERE {_LIVE} GROUP BY ALL")
def bnk2_chapter_stats(spark, sf_dir: str) -> DataFrame:
    return bank.chapter_stats(A.questions(spark, sf_dir))


@query(f"WITH {A.QUESTIONS} SELECT book_id, chapter, count(*) FILTER (source = 'ai') AS ai, count(*) FILTER (source = 'cloze') AS cloze, grouping(book_id, chapter) AS level FROM questions WHERE {_LIVE} GROUP BY GROUPING SETS ((book_id), (book_id, chapter))")
def bnk3_bank_rollup(spark, sf_dir: str) -> DataFrame:
    return bank.bank_rollup(A.questions(spark, sf_dir))


@query(f"WITH {A.QUESTIONS} SELECT DISTINCT book_id, chunk FROM questions WHERE chunk IS NOT NULL")
def bnk4_done_slices(spark, sf_dir: str) -> DataFrame:
    return bank.done_slices(A.questions(spark, sf_dir))


@query(f"""WITH {A.QUESTIONS}, changes AS (SELECT 'q' || (event_id * 7 % {A.DOCUMENT_COUNT}) AS id, event_id % 3 = 0 AS flagged, event_id // 5 AS "at" FROM events),
last AS (SELECT id, arg_max(flagged, "at" * 2 + flagged::INT) AS flagged, max("at") AS "at" FROM changes GROUP BY id)
SELECT q.id, CASE WHEN l.id IS NULL THEN q.flagged ELSE l.flagged END AS flagged, CASE WHEN l.id IS NULL THEN q.flagged_at ELSE l."at" END AS flagged_at FROM questions q LEFT JOIN last l ON q.id = l.id""")
def bnk5_flag_question(spark, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    changes = A.read(spark, sf_dir, "events").select(F.concat(F.lit("q"), (n * 7 % A.document_count(spark, sf_dir)).cast("string")).alias("id"), (n % 3 == 0).alias("flagged"), F.floor(n / 5).alias("at"))
    return bank.flag_question(A.questions(spark, sf_dir), changes).select("id", "flagged", "flagged_at")


@query(f"""WITH {A.QUESTIONS}, {A.ATTEMPTS.strip()} SELECT a.id, user_id, question_id, q.book_id, chosen, chosen = answer AS correct, "at" FROM attempts a JOIN questions q ON a.question_id = q.id""")
def bnk6_record_attempts(spark, sf_dir: str) -> DataFrame:
    return bank.record_attempts(A.attempts(spark, sf_dir), A.questions(spark, sf_dir))


@query(f"""WITH {A.ATTEMPTS} SELECT user_id, question_id, id, chosen, "at" FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY "at" DESC, id) AS n FROM attempts) WHERE n = 1""")
def bnk7_last_attempt(spark, sf_dir: str) -> DataFrame:
    return bank.last_attempt(A.attempts(spark, sf_dir))


@query(f"""WITH {A.QUESTIONS}, {A.ATTEMPTS.strip()}, wanted AS (SELECT DISTINCT user_id, 'b' || (user_id % {A.BOOK_COUNT}) AS book_id, CASE WHEN user_id % 5 = 0 THEN 'ai' END AS source FROM attempts),
last AS (SELECT a.user_id, a.question_id, a.chosen = q.answer AS correct, a."at" FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY "at" DESC, id) AS n FROM attempts) a JOIN questions q ON a.question_id = q.id WHERE n = 1),
pool AS (SELECT w.user_id, q.book_id, q.id AS question_id, CASE WHEN l.correct IS NULL THEN 0 WHEN NOT l.correct THEN 1 ELSE 2 END AS tier, l."at" FROM wanted w JOIN questions q ON w.book_id = q.book_id AND (w.source IS NULL OR w.source = q.source) LEFT JOIN last l ON l.user_id = w.user_id AND l.question_id = q.id WHERE {_LIVE})
SELECT user_id, book_id, position, question_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY user_id, book_id ORDER BY tier, CASE WHEN tier = 2 THEN "at" END NULLS FIRST, md5('0|' || user_id || '|' || question_id)) AS position FROM pool) WHERE position <= 60""")
def bnk8_pick_session(spark, sf_dir: str) -> DataFrame:
    q, a = A.questions(spark, sf_dir), A.attempts(spark, sf_dir)
    wanted = a.select("user_id", A.book_number(F.col("user_id"), A.document_count(spark, sf_dir)).alias("book_id"), F.when(F.col("user_id") % 5 == 0, "ai").alias("source"), F.lit(None).cast("string").alias("chapter")).distinct()
    return bank.pick_session(q, bank.record_attempts(a, q), wanted, 60)


@query(f"""WITH {A.QUESTIONS}, x AS (SELECT id, answer, options, unnest(range(4)) AS i FROM questions), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('0|' || id || '|' || i)) - 1 AS place FROM x)
SELECT id, string_agg(options[i + 1], ',' ORDER BY place) AS options, max(CASE WHEN i = answer THEN place END)::INT AS answer FROM o GROUP BY id""")
def bnk9_shuffle_options(spark, sf_dir: str) -> DataFrame:
    return bank.shuffle_options(A.questions(spark, sf_dir)).select("id", F.array_join("options", ",").alias("options"), "answer")


@query(f"""WITH {A.QUESTIONS}, {A.ATTEMPTS.strip()} SELECT user_id AS session_id, count(*) FILTER (chosen = answer) AS n_right, count(*) AS total,
  coalesce(string_agg(question_id || '=' || options[answer + 1], ',' ORDER BY question_id, options[answer + 1]) FILTER (chosen <> answer), '') AS wrong FROM attempts a JOIN questions q ON a.question_id = q.id GROUP BY user_id""")
def bnk10_session_summary(spark, sf_dir: str) -> DataFrame:
    s = bank.session_summary(A.attempts(spark, sf_dir).withColumnRenamed("user_id", "session_id"), A.questions(spark, sf_dir))
    return s.withColumn("wrong", F.array_join(F.transform("wrong", lambda w: F.concat(w["question_id"], F.lit("="), w["right_option"])), ","))


@query(f"WITH {A.BOOKS} SELECT 'T' || (imported_s % 180 // 60) AS title, count(*) AS n FROM books GROUP BY 1 HAVING count(*) > 1")
def bnk11_duplicate_titles(spark, sf_dir: str) -> DataFrame:
    b = A.books(spark, sf_dir).withColumn("title", F.concat(F.lit("T"), F.floor(F.unix_seconds("imported_at") % 180 / 60).cast("string")))
    return bank.duplicate_titles(b)


@query(f"""WITH {A.BOOKS}, p AS (SELECT user_id, 'b' || (event_id % {A.BOOK_COUNT}) AS book_id, event_id % 400 AS idx, event_id // 9 AS "at" FROM events), l AS (SELECT user_id, book_id, arg_max(idx, "at" * 1000 + idx) AS idx FROM p GROUP BY ALL)
SELECT l.user_id, b.id AS book_id, coalesce(idx, 0) AS idx FROM books b LEFT JOIN l ON l.book_id = b.id""")
def bnk12_reading_position(spark, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    p = A.read(spark, sf_dir, "events").select("user_id", A.book_number(n, A.document_count(spark, sf_dir)).alias("book_id"), (n % 400).alias("idx"), F.floor(n / 9).alias("at"))
    return bank.reading_position(A.books(spark, sf_dir), p)


# ---------------------------------------------------------------- merge


def _book_sides(spark, sf_dir: str):
    """Books here: those of an even number; there: all, some with a wrong block count."""
    n = F.substring("id", 2, 20).cast("long")
    b = A.books(spark, sf_dir).select("id", "title", F.col("block_count").cast("long").alias("block_count"))
    blocks = A.documents(spark, sf_dir).select("book_id", (F.col("doc_id") % 100).alias("idx"))
    return b.where(n % 2 == 0), b.withColumn("block_count", F.when(n % 5 == 3, F.col("block_count") + 1).otherwise(F.col("block_count"))), blocks


_BOOK_SIDES = A.BOOKS + """,
bh AS (SELECT * FROM books WHERE substring(id, 2)::BIGINT % 2 = 0),
bt AS (SELECT * REPLACE (CASE WHEN substring(id, 2)::BIGINT % 5 = 3 THEN block_count + 1 ELSE block_count END AS block_count) FROM books),
bc AS (SELECT 'b' || (doc_id // 100) AS id, count(*) AS n, count(DISTINCT doc_id % 100) AS d FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL),
incomplete AS (SELECT t.id, title FROM bt t LEFT JOIN bc c ON t.id = c.id WHERE t.id NOT IN (SELECT id FROM bh) AND (coalesce(n, 0) <> block_count OR coalesce(d, 0) <> coalesce(n, 0))),
added AS (SELECT * FROM bt WHERE id NOT IN (SELECT id FROM bh) AND id NOT IN (SELECT id FROM incomplete))"""


@query(f"WITH {_BOOK_SIDES} SELECT id, title FROM bh UNION ALL SELECT id, title FROM added")
def mrg1_merge_books(spark, sf_dir: str) -> DataFrame:
    return merge.merge_books(*_book_sides(spark, sf_dir)).select("id", "title")


@query(f"WITH {_BOOK_SIDES} SELECT id, title FROM incomplete")
def mrg2_incomplete_books(spark, sf_dir: str) -> DataFrame:
    return merge.incomplete_books(*_book_sides(spark, sf_dir))


@query(f"WITH {_BOOK_SIDES}, x AS (SELECT 'b' || (doc_id // 100) AS book_id, doc_id % 100 AS idx FROM documents WHERE doc_id IS NOT NULL) SELECT book_id, idx FROM x WHERE book_id IN (SELECT id FROM bh) OR book_id IN (SELECT id FROM added)")
def mrg3_merge_blocks(spark, sf_dir: str) -> DataFrame:
    here, there, blocks = _book_sides(spark, sf_dir)
    mine = blocks.join(here.select(F.col("id").alias("book_id")), "book_id", "left_semi")
    return merge.merge_blocks(mine, blocks, merge.new_books(here, there, blocks))


@query(f"WITH {A.QUESTIONS} SELECT book_id, max(CASE WHEN source = 'cloze' THEN created_at END) AS set_time FROM questions GROUP BY book_id")
def mrg4_concept_set_time(spark, sf_dir: str) -> DataFrame:
    return merge.concept_set_time(A.questions(spark, sf_dir))


_STAMP = "coalesce({0}.flagged_at, CASE WHEN {0}.flagged THEN 1 ELSE 0 END)"
_PICK = f"""CASE WHEN t.created_at > h.created_at THEN t.stem ELSE h.stem END AS stem, greatest(t.created_at, h.created_at) AS created_at,
  CASE WHEN {_STAMP.format('t')} > {_STAMP.format('h')} THEN t.flagged ELSE h.flagged END AS flagged, CASE WHEN {_STAMP.format('t')} > {_STAMP.format('h')} THEN t.flagged_at ELSE h.flagged_at END AS flagged_at"""


@query(f"WITH {A.SIDES} SELECT h.id, {_PICK}, t.created_at > h.created_at OR {_STAMP.format('t')} > {_STAMP.format('h')} AS changed FROM here h JOIN there t ON h.id = t.id")
def mrg5_merge_question(spark, sf_dir: str) -> DataFrame:
    here, there = A.sides(spark, sf_dir)
    side = lambda df, n: df.select("id", F.struct(*df.columns).alias(n))
    pairs = side(here, "h").join(side(there, "t"), "id")
    return merge.merge_question(pairs, here.columns).select("id", "stem", "created_at", "flagged", "flagged_at", "changed")


_ACTIONS = A.SIDES + f""",
th AS (SELECT * FROM there WHERE substring(book_id, 2)::BIGINT % 4 <> 3),
hs AS (SELECT book_id, max(CASE WHEN source = 'cloze' THEN created_at END) AS s FROM here GROUP BY ALL), ts AS (SELECT book_id, max(CASE WHEN source = 'cloze' THEN created_at END) AS s FROM th GROUP BY ALL),
j AS (SELECT coalesce(h.book_id, t.book_id) AS book_id, coalesce(h.id, t.id) AS id, h.id IS NULL AS no_h, t.id IS NULL AS no_t, coalesce(h.source, t.source) AS source,
  CASE WHEN h.id IS NULL THEN t.stem WHEN t.id IS NULL THEN h.stem WHEN t.created_at > h.created_at THEN t.stem ELSE h.stem END AS stem,
  CASE WHEN h.id IS NULL THEN t.flagged WHEN t.id IS NULL THEN h.flagged WHEN {_STAMP.format('t')} > {_STAMP.format('h')} THEN t.flagged ELSE h.flagged END AS flagged,
  t.created_at > h.created_at OR {_STAMP.format('t')} > {_STAMP.format('h')} AS newer FROM here h FULL JOIN th t ON h.id = t.id AND h.book_id = t.book_id),
acts AS (SELECT j.*, CASE WHEN no_h THEN CASE WHEN source = 'cloze' AND NOT coalesce(hs.s IS NULL AND ts.s IS NOT NULL OR ts.s > hs.s, false) THEN 'skip' ELSE 'add' END
  WHEN no_t THEN CASE WHEN source = 'cloze' AND coalesce(hs.s IS NULL AND ts.s IS NOT NULL OR ts.s > hs.s, false) THEN 'remove' ELSE 'keep' END WHEN newer THEN 'update' ELSE 'keep' END AS action
  FROM j LEFT JOIN hs ON j.book_id = hs.book_id LEFT JOIN ts ON j.book_id = ts.book_id)"""


def _known(q: DataFrame) -> DataFrame:
    return q.where(F.substring("book_id", 2, 20).cast("long") % 4 != 3).select("book_id").distinct()


@query(f"WITH {_ACTIONS} SELECT id, stem, flagged, action FROM acts WHERE action NOT IN ('skip', 'remove')")
def mrg6_merge_questions(spark, sf_dir: str) -> DataFrame:
    here, there = A.sides(spark, sf_dir)
    return merge.question_actions(here, there, _known(there)).where("action NOT IN ('skip', 'remove')").select("id", "stem", "flagged", "action")


_ATTEMPT_SIDES = A.QUESTIONS + ", " + A.ATTEMPTS.strip() + """,
ra AS (SELECT a.id, user_id, question_id, q.book_id, chosen, "at" FROM attempts a JOIN questions q ON a.question_id = q.id),
ah AS (SELECT * FROM ra WHERE id % 3 <> 2), tr AS (SELECT * FROM ra WHERE id % 3 <> 0 AND substring(book_id, 2)::BIGINT % 2 = 1), af AS (SELECT * FROM ah UNION ALL SELECT * FROM tr WHERE id NOT IN (SELECT id FROM ah))"""


def _attempt_sides(spark, sf_dir: str):
    a = bank.record_attempts(A.attempts(spark, sf_dir), A.questions(spark, sf_dir)).select("id", "user_id", "question_id", "book_id", "chosen", "at")
    there = a.where("id % 3 <> 0")
    return a.where("id % 3 <> 2"), there.unionByName(there.where("id % 6 = 1")), a.where(F.substring("book_id", 2, 20).cast("long") % 2 == 1).select("book_id").distinct()


@query(f"WITH {_ATTEMPT_SIDES} SELECT * FROM af")
def mrg7_merge_attempts(spark, sf_dir: str) -> DataFrame:
    return merge.merge_attempts(*_attempt_sides(spark, sf_dir))


@query(f"""WITH {_ACTIONS}, {_BOOK_SIDES.strip()}, n AS (SELECT count(*) AS c FROM events WHERE event_id % 3 = 0)
SELECT count(*) FILTER (action = 'add') AS questions_added, count(*) FILTER (action = 'update') AS questions_updated, count(*) FILTER (action = 'remove') AS questions_removed,
  (SELECT coalesce(string_agg(title, ',' ORDER BY title), '') FROM added) AS books_added, (SELECT coalesce(string_agg(title, ',' ORDER BY title), '') FROM incomplete) AS books_incomplete, (SELECT c FROM n) AS attempts_added FROM acts""")
def mrg8_merge_summary(spark, sf_dir: str) -> DataFrame:
    here, there = A.sides(spark, sf_dir)
    bh, bt, blocks = _book_sides(spark, sf_dir)
    s = merge.merge_summary(merge.question_actions(here, there, _known(there)), merge.new_books(bh, bt, blocks), merge.incomplete_books(bh, bt, blocks), A.attempts(spark, sf_dir).where("id % 3 = 0"))
    return s.withColumns({"books_added": F.array_join("books_added", ","), "books_incomplete": F.array_join("books_incomplete", ",")})
