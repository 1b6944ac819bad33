"""Column functions for book text. Patterns, word lists and templates are fixed values: results depend on them letter by letter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What JavaScript calls white space.
WS = "[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"

# Abbreviations that do not end a sentence.
ABBREVIATIONS = (
    "U.S U.K E.U U.N e.g i.e etc cf al vs v viz approx Inc Corp Co Ltd LLC No Nos Mr Mrs Ms Dr Prof Jr Sr St Art Arts Sec Secs Fed Reg "
    "Regs Stat Pub L C.F.R U.S.C Cir Cal Civ Ct App Supp Rev Ch ch para Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Gov Dept Assn Ass"
).split()
_CLOSERS = '["”’)\\]]*'
_ABBREVIATED = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
_AHEAD = '(?=["“(]?[A-Z0-9])'
# Code points that Unicode keeps out of text: one ends a sentence, the other says that none ends here.
_END, _GOES_ON = "\uFDD0", "\uFDD1"

# Words that may lead a name without being part of it.
LEADING = "The|A|An|This|That|These|Those|Its|Their|Under|In|By|Since|Unlike|Like|Both|Each|Also|Only|When|While|After|Before|Although|However|Because|If|As|For|Of|And|To|On|the|of|and|for|to|on|in"

# First words that no term has.
NOT_TERMS = (
    "it this that these those they there here such our your my his her their its some many most all each every both "
    "one another what which who how why when if and but or so also including using knowing following framing result "
    "goal problem answer key point question challenge difference reason idea way thing issue case focus fact example "
    "rest first second next last other others same following above below chapter section book guide figure table note "
    "for from although though yet nor much in on at with without after before because since while whereas thus hence "
    "therefore perhaps even never about approximately nearly over under few several"
).split()
# Words after an article that make an opinion of a definition.
EVALUATIVE = (
    "difficult easy good great bad important crucial critical key major big simple complex highly very bit lot friend "
    "failing bright best worst real tricky matter question problem challenge way thing issue case focus first last "
    "little long short better worse common popular natural obvious perfect poor strong weak huge small nice useful "
    "answer solution must-read following"
).split()
# Words after is or are that describe and do not define.
NOT_DEFINING = (
    "not|also|sometimes|always|never|rarely|frequently|generally|mostly|largely|simply|actually|really|probably|certainly|clearly|increasingly|rather|quite|fairly|pretty|somewhat|"
    "relatively|particularly|especially|extremely|incredibly|almost|nearly|entirely|fully|often|usually|typically|very|so|too|more|less|still|just|only|now|being|then|already|likely|"
    "unlikely|able|unable|important|necessary|required|available|possible|used|based|essential|subject|responsible|considered|expected|designed|meant|intended|known for"
)
# The frames of definitions and glossary entries.
DEFINITION = "^(?:The (?:term|phrase|concept of) )?[\"“]?(?:(?:A|An|The) )?([A-Za-z][\\w’'()/ -]{1,60}?)[\"”]?(?:\\s*\\([A-Z][A-Z0-9&]{1,7}\\))?,?\\s+(is|are|refers to|means|is defined as|denotes)\\s+(.+?)[.]?\\z"
GLOSSARY = "^([A-Z][^.:—–]{1,60}?)\\s*(?:\\.|:|—|–| - )\\s+(?:See also [^.]+\\.\\s+)?(.+)\\z"
GLOSSARY_SECTION = "(?i)glossary|terminology|definitions|key terms|vocabulary"
NOT_CONCEPT_SECTION = "(?i)^(?:foreword|preface|introduction to this (?:book|edition)|about this book)"
SKIPPED_SECTION = "(?i)^(?:(?:table of )?contents|index|copyright|acknowledge?ments?|about the (?:authors?|editors?|contributors?)|dedication|also by.*|bibliography|references|endnotes|notes)\\z"
# What a term does not hold, how it does not end, and an action with its object.
TERM_SIGNS = '[,;:?!<>=“”"]|\\d|percent'
TERM_ENDS = "(?i)^(?:a|an|the|of|to|and|or|is|are)\\z"
TERM_WORDS = "\\b(?:whether|that|which|who|if|when|you|your|we|our|I)\\b"
GERUND = "(?i)ing\\z"
GERUND_OBJECT = "(?i)^(?:a|an|the|every|each|your|our)\\z"
# Signs and first words that no definition has; what stands before the word that defines, and a clause that defines without an article.
DEFINITION_SIGNS = '[!?]|[,.]["”’](?:\\s|\\z)|["”’][,.]?\\s+(?:said|cried|interrupted|asked|replied)|[<>{}=]'
DEFINITION_STARTS = "(?i)^(?:the following|this (?:specification|section|chapter|book|guide|document)|for example|see\\b)"
ARTICLE = "^(?:a|an|the|any|one of the|one of)\\s+(\\S+)"
CLAUSE = "^\\S+(?:\\s+\\S+){0,8}?\\s+(?:that|which|who|whose|where)\\b"
# Words of the person who speaks, as they are written; they make no definition.
PERSON = "\\b(?:I|I’m|I'm|you|your|we|our)\\b"
NUMBERED = "^\\d{1,3}[.)]?\\s+\\S"
CITATION = "(?i)https?://|www\\.|\\b(?:U\\.S\\.C|C\\.F\\.R|Fed\\. Reg|F\\.\\s?(?:2d|3d|4th|Supp)|S\\. Ct|Id\\.|Ibid|supra|infra|accessed|retrieved|available at|press release)\\b"
NOTE_LIKE = "^\\d{1,3}[.)]?\\s+[\"“‘]|\\b(?:1[89]|20)\\d{2}\\b|\\sv\\.\\s"


def ascii_bounds(pattern: str) -> str:
    """The pattern with \\b between ASCII words only, whatever other letters the text has; Java counts all letters."""
    return pattern.replace("\\b", "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def js_blanks(pattern: str) -> str:
    """The pattern with \\s and \\S for what JavaScript calls white space; Java's are ASCII. \\S must not stand in brackets."""
    return pattern.replace("\\S", f"[^{WS[1:]}").replace("\\s", WS)


def _as_meant(pattern: str) -> str:
    return ascii_bounds(js_blanks(pattern))


def js_words(t: Column) -> Column:
    return F.split(t, f"{WS}+")


def js_trim(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+\\z", "")


def normalize_text(t: Column) -> Column:
    """Soft hyphens out, white space to single blanks, trimmed."""
    return js_trim(F.regexp_replace(F.regexp_replace(t, "\\u00AD", ""), f"{WS}+", " "))


def _decoded(t: Column) -> Column:
    """Percent-decoding that leaves + alone and keeps invalid escapes as they are."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(t, "\\+", "%2B")), t)


def resolve_path(from_file: Column, href: Column) -> Column:
    """The archive path that href names, seen from from_file; an empty path is from_file itself."""
    path = _decoded(F.split(href, "#", 2)[0])
    base = F.when(path.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(F.split(from_file, "/"), 1, F.size(F.split(from_file, "/")) - 1))
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.when(path == "", from_file).otherwise(F.array_join(F.aggregate(F.split(path, "/"), base, step), "/"))


def fragment_of(href: Column) -> Column:
    """What follows the first #, decoded; null when there is nothing."""
    return F.nullif(_decoded(F.regexp_extract(href, "(?s)#(.*)", 1)), F.lit(""))


def split_sentences(t: Column) -> Column:
    """Array of sentences, trimmed, without empty ones. A run of letters and dots that is an abbreviation or an initial is marked first, so that its dot ends nothing."""
    short = js_blanks(f"(?<![A-Za-z.])(\\.*(?:{_ABBREVIATED}|[A-Z])\\.{_CLOSERS})(?=\\s+{_AHEAD})")
    marked = F.regexp_replace(t, short, f"$1{_GOES_ON}")
    cut = F.replace(F.regexp_replace(marked, js_blanks(f"([.!?]{_CLOSERS})\\s+{_AHEAD}"), f"$1{_END}"), F.lit(_GOES_ON), F.lit(""))
    return F.filter(F.transform(F.split(cut, _END), js_trim), lambda s: s != "")


def key_of(t: Column) -> Column:
    return js_trim(F.regexp_replace(F.replace(F.lower(t), F.lit("’"), F.lit("'")), f"{WS}+", " "))


def strip_leading(t: Column) -> Column:
    """The name without leading words. The loop over them is possessive (nothing after it can want a word back): any other calls itself for each word, and some 1,600 words overflow a task's stack, which ends its executor."""
    return F.regexp_replace(js_trim(t), js_blanks(f"^(?:(?:{LEADING})\\s+)++"), "")


# Letters that have a capital of their own, though Unicode's full mapping, which is Spark's, writes it as several letters (ß as SS).
_SMALL = "ß" + "".join(map(chr, (*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3)))
_CAPITAL = "ẞ" + "".join(map(chr, (*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0), 0x1FBC, 0x1FCC, 0x1FFC)))


def capitalised(t: Column) -> Column:
    """The first letter as its one capital, as SQL has it; one that has none stays."""
    first = F.substring(t, 1, 1)
    upper = F.when(F.length(F.upper(first)) > 1, F.translate(first, _SMALL, _CAPITAL)).otherwise(F.upper(first))
    return F.concat(upper, F.substring(t, F.lit(2), F.length(t)))


def clean_definition(t: Column) -> Column:
    """First sentence without "See also", lead-ins, closing marks and an unclosed aside; capitalised."""
    first = F.coalesce(F.get(split_sentences(js_trim(F.regexp_replace(t, _as_meant("\\bSee also [^.]+\\.\\s*"), ""))), 0), F.lit(""))
    tidy = js_trim(F.regexp_replace(F.regexp_replace(first, js_blanks("(?i)^(?:defined as|known as)\\s+"), ""), "[.;:]+\\z", ""))
    tidy = F.regexp_replace(tidy, js_blanks("^(.+?)[\\s,;:]*\\([^()]*\\z"), "$1")
    return capitalised(tidy)


def plausible_term(t: Column) -> Column:
    words = js_words(t)
    n = F.size(words)
    return (
        n.between(1, 6) & (F.length(t) >= 3) & ~F.lower(words[0]).isin(NOT_TERMS) & ~t.rlike(TERM_SIGNS)
        & ~F.element_at(words, -1).rlike(TERM_ENDS)
        & ~t.rlike(_as_meant(TERM_WORDS))
        & ~(words[0].rlike(GERUND) & F.coalesce(F.get(words, 1).rlike(GERUND_OBJECT), F.lit(False)))
    )


def plausible_definition(d: Column) -> Column:
    n = F.size(js_words(d))
    return (
        n.between(5, 45)
        & ~d.rlike(js_blanks(DEFINITION_SIGNS))
        & ~d.rlike(_as_meant(DEFINITION_STARTS))
        & ~d.rlike(_as_meant(PERSON))
    )


def _entry(ok: Column, term: Column, definition: Column) -> Column:
    return F.when(ok, F.struct(term.alias("term"), definition.alias("definition")))


def definition_in_sentence(s: Column) -> Column:
    """struct(term, definition) or null."""
    part = lambda i: F.regexp_extract(s, js_blanks(DEFINITION), i)
    term, verb = js_trim(part(1)), part(2)
    explicit = part(3).rlike(js_blanks("^defined as\\s+"))
    body = js_trim(F.regexp_replace(part(3), js_blanks("^defined as\\s+"), ""))
    article = F.regexp_extract(body, js_blanks(ARTICLE), 1)
    plain = verb.isin("is", "are") & ~explicit
    described = body.rlike(_as_meant(f"^(?:{NOT_DEFINING})\\b"))
    opinion = F.regexp_replace(F.lower(article), "\\W", "").isin(EVALUATIVE)
    clause = body.rlike(_as_meant(CLAUSE))
    good = F.when(plain, ~described & F.when(article != "", ~opinion).otherwise(clause)).otherwise(~body.rlike(_as_meant("(?i)^that\\b")))
    found = (verb != "") & ~s.rlike("^[\"“‘']|[!?]")
    return _entry(found & good & plausible_term(term) & plausible_definition(body), term, clean_definition(body))


def glossary_entry(t: Column) -> Column:
    """struct(term, definition) or null."""
    text = js_trim(t)
    term = js_trim(F.regexp_replace(F.regexp_extract(text, js_blanks(GLOSSARY), 1), js_blanks("\\s*\\([^)]*\\)\\z"), ""))
    definition = clean_definition(F.regexp_extract(text, js_blanks(GLOSSARY), 2))
    return _entry(text.rlike(js_blanks(GLOSSARY)) & plausible_term(term) & plausible_definition(definition), term, definition)


def lower_first(t: Column) -> Column:
    return F.when(t.rlike("^[A-Z][a-z]"), F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))).otherwise(t)


def display_name(name: Column, acronym: Column) -> Column:
    return F.when(acronym.isNotNull(), F.concat(name, F.lit(" ("), acronym, F.lit(")"))).otherwise(name)


def related(a: Column, b: Column) -> Column:
    return (a == b) | F.contains(a, b) | F.contains(b, a)


def fnv1a32(t: Column) -> Column:
    """Unsigned 32-bit FNV-1a over the text's UTF-16 units."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(t, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * 16777619, F.lit(1 << 32)))


def question_id(seed: Column) -> Column:
    return F.concat(F.lit("concept-"), F.lower(F.conv(fnv1a32(seed).cast("string"), 10, 36)))


def seeded(seed: Column, key: Column) -> Column:
    """Sort key of a repeatable shuffle: it depends on values only, not on partitions."""
    return F.md5(F.concat_ws("|", seed.cast("string"), key.cast("string")))


def is_study_passage(kind: Column, path: Column) -> Column:
    return (kind != "heading") & ~F.exists(path, lambda p: js_trim(p).rlike(SKIPPED_SECTION))


def chapter_of(path: Column) -> Column:
    return F.coalesce(F.try_element_at(path, F.lit(1)), F.lit("Start of book"))


def snippet(text: Column, query: Column, radius: int = 80) -> Column:
    """struct(before, match, after) round the first match, case-insensitive."""
    q = F.trim(query)
    at = F.instr(F.lower(text), F.lower(q)) - 1
    end = at + F.length(q)
    lo, hi = F.greatest(F.lit(0), at - radius), F.least(F.length(text), end + radius)
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    dots = lambda c: F.when(c, F.lit("…")).otherwise(F.lit(""))
    hit = F.struct(F.concat(dots(lo > 0), cut(lo, at)).alias("before"), cut(at, end).alias("match"), F.concat(cut(end, hi), dots(hi < F.length(text))).alias("after"))
    miss = F.struct(F.substring(text, 1, 2 * radius).alias("before"), F.lit("").alias("match"), dots(F.length(text) > 2 * radius).alias("after"))
    return F.when(at >= 0, hit).otherwise(miss)


def highlight(text: Column, quote: Column) -> Column:
    """struct(before, match, after) at the first exact occurrence of the quote; without one all is before."""
    at = F.when(F.length(quote) > 0, F.instr(text, quote)).otherwise(0)
    hit = F.struct(F.substring(text, F.lit(1), at - 1).alias("before"), quote.alias("match"), F.substring(text, at + F.length(quote), F.length(text)).alias("after"))
    return F.when(at > 0, hit).otherwise(F.struct(text.alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))
