"""Preparing text for batch question writing, and checking what comes back. Requests and responses are tables; the call itself is not made here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.functions.text import chapter_of
from quizmill.operators.passages import study_passages

MAX_CHARS, MIN_CHARS = 36000, 4000

# What the requests ask for.
WRITE_RULES = (
    "Write exam-style multiple-choice questions from the passages below.",
    "Each question has exactly 4 options, one of them right, and 4 explanations, one for each option.",
    "Use only what the passages say, and cite the passage numbers that support the answer.",
    "Do not use options such as \"all of the above\".",
)
CHECK_RULES = (
    "Answer each question from the passages alone.",
    "Give the number of the question, the index of the right option (0 to 3), and whether more than one option could be right.",
)
DRAFT_SCHEMA = '{"questions":[{"stem":"string","options":["string"],"correctIndex":"integer","explanations":["string"],"sourcePassages":["string"]}]}'
CHECK_SCHEMA = '{"checks":[{"question":"integer","answer":"integer","ambiguous":"boolean","reason":"string"}]}'


def slice_runs(runs: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """Slices of each chapter run: `items` is the run's array of (idx, chars) in order. A slice closes when the next block would make it longer than `most`; one shorter than `least` joins the one before it if both stay within 1.3 times `most`."""
    item = lambda a, z, n: F.struct(a.cast("long").alias("a"), z.cast("long").alias("z"), n.cast("long").alias("n"))
    none = item(F.lit(None), F.lit(None), F.lit(0))
    start = F.struct(F.array().cast("array<struct<a:bigint,z:bigint,n:bigint>>").alias("done"), none.alias("open"))

    def close(acc):
        prev = F.try_element_at(acc["done"], F.lit(-1))
        joins = (acc["open"]["n"] < least) & (prev["n"] + acc["open"]["n"] <= most * 1.3)
        folded = F.concat(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(item(prev["a"], acc["open"]["z"], prev["n"] + acc["open"]["n"])))
        return F.when(acc["open"]["a"].isNull(), acc["done"]).when(joins, folded).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def step(acc, x):
        full = acc["open"]["a"].isNotNull() & (acc["open"]["n"] + x["chars"] > most)
        fresh = F.struct(F.when(full, close(acc)).otherwise(acc["done"]).alias("done"), F.when(full, none).otherwise(acc["open"]).alias("open"))
        return F.struct(fresh["done"].alias("done"), item(F.coalesce(fresh["open"]["a"], x["idx"]), x["idx"], fresh["open"]["n"] + x["chars"]).alias("open"))

    rows = runs.select("book_id", "run", "chapter", F.explode(F.aggregate("items", start, step, close)).alias("s"))
    return rows.select("book_id", "run", "chapter", F.concat_ws("-", F.col("s.a").cast("string"), F.col("s.z").cast("string")).alias("slice_key"), F.col("s.a").cast("int").alias("start"), F.col("s.z").cast("int").alias("stop"), F.col("s.n").alias("chars"))


def chapter_runs(passages: DataFrame) -> DataFrame:
    """(book_id, run, chapter, items): consecutive passages of one chapter; a chapter that comes again is another run."""
    w = Window.partitionBy("book_id").orderBy("idx")
    rows = passages.where(F.length("text") >= 20).select("book_id", "idx", chapter_of(F.col("path")).alias("chapter"), F.length("text").alias("chars"))
    fresh = rows.withColumn("_new", (~F.col("chapter").eqNullSafe(F.lag("chapter").over(w))).cast("int"))
    numbered = fresh.withColumn("run", F.sum("_new").over(w))
    return numbered.groupBy("book_id", "run", "chapter").agg(F.array_sort(F.collect_list(F.struct("idx", "chars"))).alias("items"))


def slice_book(blocks: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """(book_id, run, chapter, slice_key "first-last", start, stop, chars) of the study passages of 20 characters or more."""
    return slice_runs(chapter_runs(study_passages(blocks)), most, least)


def questions_wanted(chars: Column) -> Column:
    return F.least(F.lit(12), F.greatest(F.lit(2), F.floor(chars / 3000 + 0.5))).cast("int")


def parse_range(key: Column) -> Column:
    """struct(first, last) of "a-b", else null."""
    part = lambda i: F.regexp_extract(key, "^(\\d+)-(\\d+)\\z", i).try_cast("int")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("first"), part(2).alias("last")))


def blocks_to_do(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """Blocks outside all done ranges (book_id, chunk). Ranges may overlap: their ends are swept in block order, so no block meets more than its own row."""
    r = done.select("book_id", parse_range(F.col("chunk")).alias("r")).where(F.col("r").isNotNull())
    edges = r.select("book_id", F.col("r.first").alias("idx"), F.lit(1).alias("d")).unionByName(r.select("book_id", (F.col("r.last") + 1).alias("idx"), F.lit(-1).alias("d"))).groupBy("book_id", "idx").agg(F.sum("d").alias("d"))
    slim = blocks.select("book_id", "idx", F.lit(0).alias("d"), F.lit(1).alias("_block")).unionByName(edges.select("book_id", F.col("idx").cast("int").alias("idx"), "d", F.lit(0).alias("_block")))
    open_ = F.sum("d").over(Window.partitionBy("book_id").orderBy("idx", "_block").rowsBetween(Window.unboundedPreceding, 0))
    left = slim.withColumn("_open", open_).where("_block = 1 AND _open = 0").select("book_id", "idx")
    return blocks.join(left, ["book_id", "idx"], "left_semi")


def pending_slices(blocks: DataFrame, done: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    return slice_book(blocks_to_do(blocks, done), most, least)


def slice_plan(blocks: DataFrame, done: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """Per chapter, in book order of first_idx: slices to write, questions to expect and requests to make; a chapter with none is done."""
    chapters = study_passages(blocks).groupBy("book_id", chapter_of(F.col("path")).alias("chapter")).agg(F.min("idx").alias("first_idx"))
    todo = pending_slices(blocks, done, most, least).groupBy("book_id", "chapter").agg(F.count("*").alias("slices"), F.sum(questions_wanted(F.col("chars"))).alias("questions"))
    rows = chapters.join(todo, ["book_id", "chapter"], "left")
    n = F.coalesce("slices", F.lit(0))
    return rows.select("book_id", "chapter", "first_idx", n.alias("slices"), F.coalesce("questions", F.lit(0)).alias("questions"), (2 * n).alias("requests"), (n == 0).alias("done"))


def slice_blocks(slices: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book_id, slice_key, idx, text): the passages of each slice."""
    ids = slices.select("book_id", "slice_key", F.explode(F.sequence("start", "stop")).alias("idx"))
    rows = study_passages(blocks).where(F.length("text") >= 20)
    return ids.join(rows.select("book_id", "idx", "text"), ["book_id", "idx"])


def write_requests(slices: DataFrame, passages: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, slice_key, prompt, response_schema): title, section, numbered passages, rules, how many questions."""
    lines = passages.groupBy("book_id", "slice_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.concat(F.lit("[P"), x["idx"].cast("string"), F.lit("] "), x["text"])), "\n").alias("lines"))
    rows = slices.join(lines, ["book_id", "slice_key"]).join(books.select(F.col("id").alias("book_id"), "title"), "book_id")
    count = F.concat(F.lit("Write "), questions_wanted(F.col("chars")).cast("string"), F.lit(" questions."))
    prompt = F.concat_ws("\n", F.concat(F.lit("Book: "), "title"), F.concat(F.lit("Section: "), "chapter"), *[F.lit(r) for r in WRITE_RULES], count, F.lit(""), "lines")
    return rows.select("book_id", "slice_key", prompt.alias("prompt"), F.lit(DRAFT_SCHEMA).alias("response_schema"))


def parse_json_text(text: Column) -> Column:
    """A variant: the text as JSON, else its outermost braces, else null (bad output)."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(text, "(?s)(\\{.*\\})", 1), F.lit(""))))


_RESPONSE = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>,promptFeedback:struct<blockReason:string>,usageMetadata:struct<promptTokenCount:int,candidatesTokenCount:int,thoughtsTokenCount:int>>"
# Finish reasons that mean the model declined.
_DECLINED = ("SAFETY", "RECITATION", "PROHIBITED_CONTENT", "BLOCKLIST", "SPII")


def response_text(body: Column) -> Column:
    """struct(text, status, prompt_tokens, output_tokens, thinking_tokens); status is ok, blocked or bad-output."""
    r = F.from_json(body, _RESPONSE)
    first = F.get(r["candidates"], 0)
    parts = F.coalesce(first["content"]["parts"], F.array().cast("array<struct<text:string,thought:boolean>>"))
    text = F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    status = F.when(r["promptFeedback"]["blockReason"].isNotNull(), "blocked").when(text != "", "ok").when(first["finishReason"].isin(*_DECLINED), "blocked").otherwise("bad-output")
    u = r["usageMetadata"]
    return F.struct(text.alias("text"), status.alias("status"), u["promptTokenCount"].alias("prompt_tokens"), u["candidatesTokenCount"].alias("output_tokens"), u["thoughtsTokenCount"].alias("thinking_tokens"))


_DRAFTS = "struct<questions:array<struct<stem:string,options:array<string>,correctIndex:string,explanations:array<string>,sourcePassages:array<string>>>>"
_CHECKS = "struct<checks:array<struct<question:string,answer:string,ambiguous:boolean,reason:string>>>"


def _json_text(text: Column) -> Column:
    """The text if it is JSON, else its outermost braces."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.regexp_extract(text, "(?s)(\\{.*\\})", 1))


def validate_drafts(responses: DataFrame, passages: DataFrame) -> DataFrame:
    """Drafts (book_id, slice_key, pos, stem, options, answer, explanations, sources) of `responses` (book_id, slice_key, text) that hold: a stem, four distinct options, an index 0 to 3, cited passages of the slice."""
    ids = passages.groupBy("book_id", "slice_key").agg(F.collect_set("idx").alias("ids"))
    rows = responses.join(ids, ["book_id", "slice_key"]).select("book_id", "slice_key", "ids", F.posexplode(F.from_json(_json_text(F.col("text")), _DRAFTS)["questions"]).alias("pos", "d"))
    options = F.transform("d.options", lambda o: F.trim(F.regexp_replace(F.trim(o), "^[A-Da-d][.)]\\s+", "")))
    low = F.transform("options", lambda o: F.lower(o))
    sources = F.array_distinct(F.filter(F.transform("d.sourcePassages", lambda s: F.regexp_extract(F.trim(s), "^[Pp]?(\\d+)\\z", 1).try_cast("int")), lambda i: i.isNotNull() & F.array_contains("ids", i)))
    rows = rows.withColumns({"options": options, "answer": F.col("d.correctIndex").try_cast("int"), "sources": sources})
    bad = F.exists("options", lambda o: (o == "") | F.lower(o).rlike("^(?:all|none|both|any) of the (?:above|options|answers)")) | (F.size(F.array_distinct(low)) < 4)
    fine = rows.where((F.trim(F.coalesce("d.stem", F.lit(""))) != "") & (F.size("options") == 4) & ~bad & F.col("answer").between(0, 3) & (F.size("sources") >= 1))
    return fine.select("book_id", "slice_key", "pos", F.trim("d.stem").alias("stem"), "options", "answer", F.when(F.size("d.explanations") == 4, F.col("d.explanations")).alias("explanations"), "sources")


def check_requests(drafts: DataFrame, passages: DataFrame) -> DataFrame:
    """(book_id, slice_key, prompt, response_schema, temperature): numbered questions with numbered options, and the passages."""
    shown = F.concat(F.lit("Question "), F.col("n").cast("string"), F.lit(": "), F.col("stem"), F.lit("\n"), F.array_join(F.transform("options", lambda o, i: F.concat(i.cast("string"), F.lit(") "), o)), "\n"))
    numbered = drafts.withColumn("n", F.row_number().over(Window.partitionBy("book_id", "slice_key").orderBy("pos")))
    asked = numbered.groupBy("book_id", "slice_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", shown.alias("q")))), lambda x: x["q"]), "\n\n").alias("asked"))
    lines = passages.groupBy("book_id", "slice_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.concat(F.lit("[P"), x["idx"].cast("string"), F.lit("] "), x["text"])), "\n").alias("lines"))
    return asked.join(lines, ["book_id", "slice_key"]).select("book_id", "slice_key", F.concat_ws("\n", *[F.lit(r) for r in CHECK_RULES], F.lit(""), "lines", F.lit(""), "asked").alias("prompt"), F.lit(CHECK_SCHEMA).alias("response_schema"), F.lit(0.0).alias("temperature"))


def apply_check(drafts: DataFrame, responses: DataFrame) -> DataFrame:
    """Drafts whose first check agrees on the answer and does not call them ambiguous; a draft without a check goes. The n-th draft of a slice is question n."""
    c = responses.select("book_id", "slice_key", F.posexplode(F.from_json(_json_text(F.col("text")), _CHECKS)["checks"]).alias("at", "c")).select("book_id", "slice_key", "at", F.col("c.question").try_cast("int").alias("n"), F.col("c.answer").try_cast("int").alias("said"), F.coalesce("c.ambiguous", F.lit(False)).alias("ambiguous"))
    first = c.groupBy("book_id", "slice_key", "n").agg(F.min_by(F.struct("said", "ambiguous"), "at").alias("_c"))
    numbered = drafts.withColumn("n", F.row_number().over(Window.partitionBy("book_id", "slice_key").orderBy("pos")))
    return numbered.join(first, ["book_id", "slice_key", "n"]).where((F.col("_c.said") == F.col("answer")) & ~F.col("_c.ambiguous")).drop("n", "_c")


def slice_results(slices: DataFrame, drafts: DataFrame, kept: DataFrame) -> DataFrame:
    """(book_id, slice_key, wanted, valid, kept, dropped): dropped = those missing from what was wanted and those that failed the check."""
    v, k = drafts.groupBy("book_id", "slice_key").agg(F.count("*").alias("valid")), kept.groupBy("book_id", "slice_key").agg(F.count("*").alias("kept"))
    rows = slices.select("book_id", "slice_key", questions_wanted(F.col("chars")).alias("wanted")).join(v, ["book_id", "slice_key"], "left").join(k, ["book_id", "slice_key"], "left").fillna(0, ["valid", "kept"])
    return rows.withColumn("dropped", F.greatest(F.lit(0), F.col("wanted") - F.col("valid")) + F.col("valid") - F.col("kept"))


def question_rows(kept: DataFrame, slices: DataFrame, model: Column, created_at: Column) -> DataFrame:
    """Checked drafts as questions of the bank: source "ai", the slice as chunk, its chapter, the model, the cited blocks. The id comes from book, slice, stem and options, so the same draft has the same id however often it is made."""
    seed = F.concat_ws("|", "book_id", "slice_key", "stem", F.array_join("options", "|"))
    return kept.join(slices.select("book_id", "slice_key", "chapter"), ["book_id", "slice_key"]).select(
        F.concat(F.lit("ai-"), F.md5(seed)).alias("id"), "book_id", F.lit("ai").alias("source"), "stem", "options", "answer", "explanations", F.col("sources").alias("block_indexes"),
        "chapter", F.col("slice_key").alias("chunk"), model.alias("model"), created_at.alias("created_at"),
    )


def save_questions(bank: DataFrame, made: DataFrame) -> DataFrame:
    """What is to be appended to the bank: questions of slices that it has none of; of several answers to a slice the earliest (by created_at, then model). Saving the same rows again appends nothing."""
    order = F.struct("created_at", "model")
    first = made.groupBy("book_id", "chunk").agg(F.min(order).alias("_first"))
    stored = bank.where(F.col("chunk").isNotNull()).select("book_id", "chunk").distinct()
    fresh = made.join(first, ["book_id", "chunk"]).where(order == F.col("_first")).drop("_first")
    return fresh.join(stored, ["book_id", "chunk"], "left_anti").dropDuplicates(["id"]).select(*made.columns)


_ERROR = "struct<error:struct<code:int,message:string,status:string,details:array<struct<reason:string,retryDelay:string,violations:array<struct<quotaId:string>>>>>>"


def classify_error(status: Column, body: Column) -> Column:
    """struct(kind, retry_ms, daily): invalid-key, forbidden, rate-limit, server or unknown."""
    e = F.from_json(body, _ERROR)["error"]
    details = F.coalesce(e["details"], F.array().cast("array<struct<reason:string,retryDelay:string,violations:array<struct<quotaId:string>>>>"))
    message = F.coalesce(e["message"], F.lit(""))
    invalid = F.exists(details, lambda d: F.coalesce(d["reason"] == "API_KEY_INVALID", F.lit(False))) | message.rlike("(?i)api key not valid")
    kind = F.when((status == 401) | ((status == 400) & invalid), "invalid-key").when(status == 403, "forbidden").when(status == 429, "rate-limit").when(status >= 500, "server").otherwise("unknown")
    delay = F.get(F.filter(F.transform(details, lambda d: F.regexp_extract(F.coalesce(d["retryDelay"], F.lit("")), "^([\\d.]+)s\\z", 1).try_cast("double")), lambda x: x.isNotNull()), 0)
    retry = F.ceil(delay * 1000).cast("long")
    per_day = F.exists(details, lambda d: F.exists(F.coalesce(d["violations"], F.array().cast("array<struct<quotaId:string>>")), lambda v: F.coalesce(v["quotaId"].rlike("(?i)per_?day"), F.lit(False))))
    daily = (kind == "rate-limit") & (per_day | message.rlike("(?i)per day|daily") | F.coalesce(retry > 600000, F.lit(False)))
    return F.struct(kind.alias("kind"), retry.alias("retry_ms"), daily.alias("daily"))


def run_totals(calls: DataFrame) -> DataFrame:
    """Per book: parts, calls, milliseconds by step, mean time of a part, calls that used a model up."""
    ms = lambda step: F.sum(F.when(F.col("step") == step, F.col("ms")).otherwise(0)).alias(f"{step}_ms")
    parts = calls.groupBy("book_id", "part").agg(F.sum("ms").alias("part_ms"), F.count("*").alias("n"), ms("write"), ms("check"), F.count_if("used_up").alias("used"))
    return parts.groupBy("book_id").agg(F.count("*").alias("parts"), F.sum("n").alias("calls"), F.sum("write_ms").alias("write_ms"), F.sum("check_ms").alias("check_ms"), F.avg("part_ms").alias("mean_part_ms"), F.sum("used").alias("used_up"))


def runs(calls: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """calls with run: a book's calls belong to one run until it pauses for more than the gap. Calls of equal time are ordered by id."""
    order = Window.partitionBy("book_id").orderBy("ts", "id")
    pause = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order) > gap_seconds * 1_000_000
    return calls.withColumn("_new", F.coalesce(pause, F.lit(False)).cast("int")).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_report(calls: DataFrame, results: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Per book and run: when it began and ended, parts and calls, kept, dropped and skipped, mean time of a part, milliseconds and tokens by step.

    calls: book_id, id, ts, part, step ("write" or "check"), ms, prompt_tokens, output_tokens, thinking_tokens (null: unknown, 0). results: book_id, part, status, kept, dropped; a status other than "ok" is a part that was skipped. A part that goes on in a later run has its result there."""
    of = lambda c, step: F.sum(F.when(F.col("step") == step, F.coalesce(c, F.lit(0))).otherwise(0)).alias(f"{step}_{c}")
    measures = [(c, step) for step in ("write", "check") for c in ("ms", "prompt_tokens", "output_tokens", "thinking_tokens")]
    seconds = F.unix_seconds("ts")
    parts = runs(calls, gap_seconds).groupBy("book_id", "part", "run").agg(F.min(seconds).alias("began"), F.max(seconds).alias("ended"), F.count("*").alias("calls"), F.sum("ms").alias("part_ms"), *(of(c, step) for c, step in measures))
    last = parts.groupBy("book_id", "part").agg(F.max("run").alias("run"))
    done = results.join(last, ["book_id", "part"]).select("book_id", "part", "run", "status", "kept", "dropped")
    both = parts.join(done, ["book_id", "part", "run"], "left")
    ok = F.col("status") == "ok"
    return both.groupBy("book_id", "run").agg(
        F.min("began").alias("began"), F.max("ended").alias("ended"), F.count("*").alias("parts"), F.sum("calls").alias("calls"), F.coalesce(F.sum(F.when(ok, F.col("kept"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(ok, F.col("dropped"))), F.lit(0)).alias("dropped"), F.count_if(~ok).alias("skipped"), F.avg("part_ms").alias("mean_part_ms"), *(F.sum(f"{step}_{c}").alias(f"{step}_{c}") for c, step in measures),
    )


def last_log_lines(calls: DataFrame, lines: int = 40) -> DataFrame:
    """The latest calls of each book."""
    w = Window.partitionBy("book_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    return calls.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= lines).select("book_id", "id", "model", "step", "ms")


def daily_usage(calls: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """Requests of each model by Pacific day, whether it was used up, and when the day's allowance comes back (the next Pacific midnight, as epoch seconds)."""
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    rows = calls.groupBy(day.alias("day"), "model").agg(F.count("*").alias("requests"), F.bool_or("used_up").alias("used_up"))
    return rows.withColumn("resets_at", F.unix_seconds(F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp"), zone)))
