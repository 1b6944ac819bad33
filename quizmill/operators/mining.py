"""Text mining over books: sentences, laws and agencies, what they do, definitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.functions.scratch import written

# How laws and agencies are named.
_CONNECT = "(?:of|and|for|the|on|in|to|&)"
_CAP = "[A-Z][A-Za-z'’.-]*"
_NAME = f"(?:{_CAP}\\s+(?:{_CONNECT}\\s+)*)"
ENTITY_PATTERNS = (
    ("law", f"\\b{_NAME}{{1,9}}(?:Act|Rule|Regulation|Directive|Amendment|Shield|Framework)\\b"),
    ("agency", f"\\b{_NAME}{{1,6}}(?:Commission|Bureau|Agency|Administration|Board|Department|Office|Authority|Council)\\b"),
    ("agency", f"\\b(?:Department|Office|Bureau) of (?:the )?{_CAP}(?:\\s+(?:{_CONNECT}\\s+)*{_CAP})*\\b"),
)
# Verbs that say what a law or agency does.
DUTY_VERBS = (
    "requires|required|prohibits|prohibited|bans|banned|restricts|restricted|limits|limited|regulates|regulated|governs|governed|covers|covered|applies to|applied to|protects|"
    "protected|gives|gave|grants|granted|allows|allowed|permits|permitted|mandates|mandated|imposes|imposed|establishes|established|creates|created|preempts|preempted|"
    "enforces|enforced|oversees|oversaw|defines|defined|sets out|focuses on|addresses|obligates|directs|authorizes|authorized|amends|amended|provides|provided|guarantees|"
    "exempts|brings|investigates|issues|issued|administers|expanded|expands|introduced"
)
#: Where a name may end: before white space, a comma or a bracket.
_WORD_ENDS = "(?=[\\s,(])"
_ADVERB = "^(?:also|generally|specifically|now|still|further|explicitly|expressly|primarily|broadly)\\s+"
_ENACTED = "^(?:was|were) (?:enacted|passed|adopted|signed into law|created|established)(?: in \\d{4})?(?:\\s+(and|to)\\s+(.+))?\\z"


def sentences(passages: DataFrame) -> DataFrame:
    """(book_id, idx, pos, sentence, chapter, path) of paragraphs and list items."""
    text = passages.where(F.col("kind").isin("paragraph", "list-item"))
    return text.select("book_id", "idx", "path", T.chapter_of(F.col("path")).alias("chapter"), F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


#: An acronym in brackets right after a name.
_ACRONYM = T.js_blanks("\\s*\\(([A-Z][A-Z0-9&]{1,7})\\)")


def _flat(pattern: str) -> str:
    """An entity pattern with possessive loops and the same matches: any other loop calls itself for each word, and some 1,500 words overflow a task's stack, which ends its executor.

    What follows connecting words begins with a capital, so none is ever wanted back. A list of capitalised words gives back no more than its last word: not if that can end at a word's end, else only that word, since all before it can."""
    between = f"\\s+(?:{_CONNECT}\\s+)*"
    listed = f"(?:{_CAP}+{between}+(?=[A-Z])(?![A-Z][A-Za-z]*+[0-9_]))*+{_CAP}"
    return pattern.replace(f"{_CAP}(?:{between}{_CAP})*", listed).replace(f"(?:{_CONNECT}\\s+)*)", f"(?:{_CONNECT}\\s+)*+)")


def _mentions(sentence: Column) -> Column:
    """Matches of all patterns in one pass each: (pattern, n, kind, raw, acronym). No name holds a bracket, so the acronym after a match is cut off behind it."""

    def of(p: int, kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(sentence, F.lit(f"((?:{T.ascii_bounds(T.js_blanks(_flat(pattern)))})(?:{_ACRONYM})?)"), F.lit(1))
        return F.transform(found, lambda m, i: F.struct(F.lit(p).alias("pattern"), i.alias("n"), F.lit(kind).alias("kind"), F.regexp_replace(m, f"{_ACRONYM}\\z", "").alias("raw"), F.regexp_extract(m, f"{_ACRONYM}\\z", 1).alias("acronym")))

    return F.concat(*[of(p, kind, pattern) for p, (kind, pattern) in enumerate(ENTITY_PATTERNS)])


def find_entities(sents: DataFrame) -> DataFrame:
    """(book_id, key, name, kind, acronym): laws and agencies. The first mention in reading order names the entity; the first acronym found right after any mention is its acronym."""
    hits = sents.where(F.col("sentence").rlike("[A-Z]")).select("book_id", "idx", "pos", F.explode(_mentions(F.col("sentence"))).alias("m"))
    named = hits.withColumn("name", T.strip_leading(F.col("m.raw"))).where(F.size(T.js_words(F.col("name"))) >= 2)
    order = F.struct("idx", "pos", "m.pattern", "m.n")
    return named.groupBy("book_id", T.key_of(F.col("name")).alias("key")).agg(
        F.min_by("name", order).alias("name"), F.min_by("m.kind", order).alias("kind"),
        F.min_by(F.when(F.col("m.acronym") != "", F.col("m.acronym")), F.when(F.col("m.acronym") != "", order)).alias("acronym"),
    )


def find_duties(sents: DataFrame, entities: DataFrame) -> DataFrame:
    """(book_id, idx, pos, key, name, kind, acronym, predicate, under, sentence, chapter): sentences that begin with a known law or agency and say what it does.

    Names are found by an equi join on the beginnings of the sentence that end at a word's end, not by trying every entity. Of several names the longest decides, even if its sentence then fails."""
    body = F.regexp_replace("sentence", "\\.\\z", "")
    lead_pattern = T.js_blanks("^(Under (?:the )?|The\\s+)?")
    lead = F.regexp_extract(body, lead_pattern, 1)
    form = lambda lead, rest: F.struct(lead.alias("lead"), rest.alias("rest"))
    # "The X" may also be a name that begins with The
    forms = F.concat(F.array(form(lead, F.substring(body, F.length(lead) + 1, F.length(body)))), F.when(lead.startswith("The"), F.array(form(F.lit(""), body))).otherwise(F.array().cast("array<struct<lead:string,rest:string>>")))
    seen = sents.where(F.col("sentence").rlike("^[A-Z]")).select("book_id", "idx", "pos", F.explode(forms).alias("f"))
    names = entities.select("book_id", "key", "name", "kind", "acronym", F.explode(F.filter(F.array("name", "acronym"), lambda x: x.isNotNull())).alias("start"))
    # a sentence whose first word begins no name goes no further; of the others the beginnings of as many words as such names have
    pieces = F.split("start", T.js_blanks(_WORD_ENDS))
    firsts = names.groupBy("book_id", pieces[0].alias("_first")).agg(F.collect_set(F.size(pieces)).alias("_sizes"))
    cut = seen.select("book_id", "idx", "pos", "f.lead", "f.rest", F.split("f.rest", T.js_blanks(_WORD_ENDS)).alias("_words")).withColumn("_first", F.get("_words", 0))
    few = cut.join(firsts, ["book_id", "_first"])
    starts = F.transform(F.filter("_sizes", lambda n: n <= F.size("_words")), lambda n: F.array_join(F.slice("_words", F.lit(1), n), ""))
    begun = few.select("book_id", "idx", "pos", (F.col("lead") != "").alias("led"), F.explode(starts).alias("start"))
    # only what was hit meets its sentence again
    hit = begun.join(names, ["book_id", "start"]).join(sents.select("book_id", "idx", "pos", "sentence", "chapter"), ["book_id", "idx", "pos"])
    hit = hit.withColumn("_body", body).withColumn("_lead", F.when(F.col("led"), F.regexp_extract("_body", lead_pattern, 1)).otherwise(F.lit("")))
    rest_from = F.length("_lead") + F.length("start") + 1
    after = F.substring("_body", rest_from, F.length("_body"))
    under = F.col("_lead").startswith("Under")
    acronym = "(?:\\s*\\([A-Z][A-Z0-9&]{1,7}\\))?"
    after_name = lambda pattern: F.regexp_extract(after, T.js_blanks(pattern), 1)
    said = F.when(under, after_name(f"^{acronym},\\s+(.+)\\z")).otherwise(after_name(f"^{acronym}(?:,\\s+[^,]{{3,90}},)?\\s+(.+)\\z"))
    framed = hit.withColumns({"said": said, "under": under}).where("said != ''")
    best = Window.partitionBy("book_id", "idx", "pos").orderBy(F.length("name").desc(), "key")
    first = framed.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    passed = T.js_blanks(_ENACTED)
    was, rest_said = F.regexp_extract("said", passed, 1), F.regexp_extract("said", passed, 2)
    enacted = F.col("said").rlike(passed)
    plain = F.regexp_replace(F.when(was == "and", rest_said).otherwise(F.col("said")), T.js_blanks(_ADVERB), "")
    predicate = F.when(F.col("under"), F.col("said")).when(enacted & (was == "to"), F.concat(F.lit("was enacted to "), rest_said)).when((~enacted | (was == "and")) & plain.rlike(T.ascii_bounds(f"^(?:{DUTY_VERBS})\\b")), plain)
    told = first.withColumn("predicate", predicate).where(F.col("predicate").isNotNull() & F.size(T.js_words(F.col("predicate"))).between(4, 40))
    inside = lambda name: F.coalesce(F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower("predicate"), "[^a-z0-9_]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace(F.lower(name), "[^a-z0-9_]+", " "), F.lit(" "))), F.lit(False))
    clean = told.where(~inside("name") & ~inside("acronym"))
    return clean.select("book_id", "idx", "pos", "key", "name", "kind", "acronym", F.regexp_replace("predicate", "[.;:,]+\\z", "").alias("predicate"), "under", "sentence", "chapter")


def first_duty(duties: DataFrame) -> DataFrame:
    """The first duty of each entity in reading order."""
    rest = [c for c in duties.columns if c not in ("book_id", "key")]
    return duties.groupBy("book_id", "key").agg(F.min_by(F.struct(*rest), F.struct("idx", "pos")).alias("_d")).select("book_id", "key", "_d.*")


def _in_glossary(path: Column) -> Column:
    return F.exists(path, lambda p: p.rlike(T.GLOSSARY_SECTION))


def glossary_candidates(passages: DataFrame) -> DataFrame:
    """(book_id, idx, pos, term, definition, sentence, chapter) from glossary sections: an entry in one block, or a short block and the definition in the block after it."""
    study = passages.where(F.col("kind").isin("paragraph", "list-item"))
    w = Window.partitionBy("book_id").orderBy("idx")
    inside = study.withColumns({"_next": F.lead("text").over(w), "_at": F.lead("idx").over(w)}).where(_in_glossary(F.col("path")))  # before the patterns run
    short = (F.col("_at") == F.col("idx") + 1) & ~F.col("text").rlike("[.!?]\\z") & (F.size(T.js_words(F.col("text"))) <= 6) & T.plausible_term(F.col("text"))
    tried = F.struct(T.glossary_entry(F.col("text")).alias("entry"), F.when(short, T.clean_definition(F.col("_next"))).alias("after"))
    rows = inside.withColumn("_t", F.explode(F.array(tried)))  # an explode, so that the patterns run once a row
    found = lambda idx, pos, term, definition, sentence: F.struct(idx.alias("idx"), F.lit(pos).alias("pos"), term.alias("term"), definition.alias("definition"), sentence.alias("sentence"))
    one = found(F.col("idx"), 0, F.col("_t.entry.term"), F.col("_t.entry.definition"), F.col("text"))
    two = found(F.col("_at"), -1, F.col("text"), F.col("_t.after"), F.col("_next"))
    either = F.when(F.col("_t.entry").isNotNull(), one).when(F.col("_t.after").isNotNull() & T.plausible_definition(F.col("_t.after")), two)
    return rows.select("book_id", T.chapter_of(F.col("path")).alias("chapter"), F.explode(F.array(either)).alias("_f")).where(F.col("_f").isNotNull()).select("book_id", "_f.*", "chapter")


def sentence_candidates(sents: DataFrame) -> DataFrame:
    """The same columns from sentences outside glossaries and prefaces."""
    rows = sents.where(~_in_glossary(F.col("path")) & ~F.col("chapter").rlike(T.NOT_CONCEPT_SECTION) & F.col("sentence").rlike(T.js_blanks("\\s(?:is|are|refers to|means|denotes)\\s")))
    found = rows.withColumn("entry", F.explode(F.array(T.definition_in_sentence(F.col("sentence"))))).where(F.col("entry").isNotNull())  # an explode, so that the patterns run once a row
    return found.select("book_id", "idx", "pos", "entry.*", "sentence", "chapter")


#: Blocks of a book whose texts are counted together.
PIECE = 20_000


def _count_keys(most: int | None):
    """A sorted stream of (book_id, piece, key, low): the keys of a piece, then its texts, each read once. Memory: a piece's keys and a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        at, found, automaton, counts = None, None, None, {}

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["book_id", "key", "n"])

        for batch in batches:
            for book, piece, key, low in zip(*(batch.column(c).to_pylist() for c in ("book_id", "piece", "key", "low")), strict=True):
                if (book, piece) != at:
                    if counts:
                        yield done()
                    at, automaton, counts, found = (book, piece), ahocorasick.Automaton(), {}, False
                if low is None:
                    automaton.add_word(key, key)
                    continue
                if not found:
                    if not len(automaton):
                        continue
                    automaton.make_automaton()
                    found = True
                ends: dict[str, int] = {}  # where the last counted occurrence in this text ends
                for last, key in automaton.iter(low):
                    if last - len(key) >= ends.get(key, -1) and (most is None or counts.get(key, 0) < most):
                        ends[key] = last
                        counts[key] = counts.get(key, 0) + 1
        if counts:
            yield done()

    return run


def term_counts(terms: DataFrame, passages: DataFrame, most: int | None = None) -> DataFrame:
    """(book_id, key, n): non-overlapping occurrences of each key in the lower-cased passages of its book, counted up to `most` if it is given.

    Keys begin at any character, so there is no token to join on: the texts of a book run through an automaton of its keys. A book is cut into pieces of PIECE blocks, which hold a copy of its keys each; a text moves once and is read once."""
    keys = terms.select("book_id", "key").distinct()
    text = passages.where(F.col("kind").isin("paragraph", "list-item")).select("book_id", F.floor(F.col("idx") / PIECE).cast("int").alias("piece"), F.lit(None).cast("string").alias("key"), F.lower("text").alias("low"))
    pieces = passages.groupBy("book_id").agg(F.floor(F.max("idx") / PIECE).cast("int").alias("last"))
    held = keys.join(pieces, "book_id").select("book_id", F.explode(F.sequence(F.lit(0), "last")).alias("piece"), "key", F.lit(None).cast("string").alias("low"))
    stream = held.unionByName(text).repartition("book_id", "piece").sortWithinPartitions("book_id", "piece", F.col("low").isNotNull())
    counted = stream.mapInArrow(_count_keys(most), "book_id string, key string, n long").groupBy("book_id", "key").agg(F.sum("n").alias("n"))
    counted = keys.join(counted, ["book_id", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted if most is None else counted.withColumn("n", F.least("n", F.lit(most)))


def definitions(glossary: DataFrame, from_sentences: DataFrame, counts: DataFrame) -> DataFrame:
    """One definition for each (book, key): those that name their own key go, those from sentences need two mentions in the book, then the first in reading order stays."""
    both = glossary.withColumn("glossary", F.lit(True)).unionByName(from_sentences.withColumn("glossary", F.lit(False))).withColumn("key", T.key_of(F.col("term")))
    fine = both.where(~F.contains(F.lower("definition"), F.col("key"))).join(counts, ["book_id", "key"], "left")
    fine = fine.where(F.col("glossary") | (F.coalesce("n", F.lit(0)) >= 2))
    row = F.struct("term", "definition", "idx", "pos", "sentence", "chapter")
    return fine.groupBy("book_id", "key").agg(F.min_by(row, F.struct("idx", "pos")).alias("_d")).select("book_id", "key", "_d.*")


def book_definitions(passages: DataFrame) -> DataFrame:
    """All steps from study passages (a written table: it is read three times) to definitions. Candidates are written, since both the counts and the definitions need them; only two mentions are counted."""
    from_sentences = written(sentence_candidates(sentences(passages)), "candidates")
    keys = from_sentences.select("book_id", T.key_of(F.col("term")).alias("key"))
    return definitions(glossary_candidates(passages), from_sentences, term_counts(keys, passages, most=2))
