"""Question bank and practice: statistics, flags, attempts, sessions. Questions, attempts and positions of any number of books and learners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.functions.text import seeded

def _live() -> Column:
    return ~F.coalesce("flagged", F.lit(False))


def bank_stats(questions: DataFrame) -> DataFrame:
    """Per book: usable questions by source, flagged ones, and cloze ones without a style (flagged or not)."""
    return questions.groupBy("book_id").agg(
        F.count_if((F.col("source") == "ai") & _live()).alias("ai"), F.count_if((F.col("source") == "cloze") & _live()).alias("cloze"),
        F.count_if(~_live()).alias("flagged"), F.count_if((F.col("source") == "cloze") & F.col("style").isNull()).alias("legacy"),
    )


def chapter_stats(questions: DataFrame) -> DataFrame:
    """Usable questions of each chapter by source; `first_block` gives the order of chapters."""
    return questions.where(_live()).groupBy("book_id", "chapter").agg(F.count_if(F.col("source") == "ai").alias("ai"), F.count_if(F.col("source") == "cloze").alias("cloze"), F.min(F.array_min("block_indexes")).alias("first_block"))


def bank_rollup(questions: DataFrame) -> DataFrame:
    """Usable questions by source for each book (chapter null) and each chapter, in one pass."""
    return questions.where(_live()).rollup("book_id", "chapter").agg(F.count_if(F.col("source") == "ai").alias("ai"), F.count_if(F.col("source") == "cloze").alias("cloze"), F.grouping_id().alias("level")).where("level < 3")


def done_slices(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("chunk").isNotNull()).select("book_id", "chunk").distinct()


def flag_question(questions: DataFrame, changes: DataFrame) -> DataFrame:
    """`changes` (id, flagged, at): the latest change of each id sets flagged and flagged_at."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("flagged", "at"), F.struct("at", "flagged")).alias("_new"))
    joined = questions.join(last, "id", "left")
    changed = F.col("_new").isNotNull()
    return joined.withColumns({"flagged": F.when(changed, F.col("_new.flagged")).otherwise(F.col("flagged")), "flagged_at": F.when(changed, F.col("_new.at")).otherwise(F.col("flagged_at"))}).drop("_new")


def record_attempts(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with the question's book and whether they are right; answers to unknown questions are left out."""
    q = questions.select(F.col("id").alias("question_id"), "book_id", "answer")
    return answers.join(q, "question_id").withColumn("correct", F.col("chosen") == F.col("answer")).drop("answer")


def last_attempt(attempts: DataFrame) -> DataFrame:
    """The latest attempt of each learner at each question; of equal times the lowest id. One aggregation, no sort."""
    key = F.struct(F.col("at"), -F.col("id"))
    rest = [c for c in attempts.columns if c not in ("user_id", "question_id")]
    best = attempts.groupBy("user_id", "question_id").agg(F.max_by(F.struct(*rest), key).alias("_row"))
    return best.select("user_id", "question_id", "_row.*")


def pick_session(questions: DataFrame, attempts: DataFrame, wanted: DataFrame, size: int = 20, seed: str = "0") -> DataFrame:
    """For each row of `wanted` (user_id, book_id, optional source, chapter): `size` usable questions: unseen ones first (shuffled), then last-wrong (shuffled), then last-right (oldest first).

    Only ids travel through the ranking; a learner's pool is one book."""
    pool = questions.where(_live()).select(F.col("id").alias("question_id"), "book_id", "source", "chapter")
    asked = wanted.select("user_id", "book_id", F.col("source").alias("_source"), F.col("chapter").alias("_chapter"))
    pool = pool.join(asked, "book_id").where((F.col("_source").isNull() | (F.col("_source") == F.col("source"))) & (F.col("_chapter").isNull() | (F.col("_chapter") == F.col("chapter"))))
    last = last_attempt(attempts).select("user_id", "question_id", "correct", "at")
    seen = pool.join(last, ["user_id", "question_id"], "left")
    tier = F.when(F.col("correct").isNull(), 0).when(~F.col("correct"), 1).otherwise(2)
    order = Window.partitionBy("user_id", "book_id").orderBy("tier", F.when(F.col("tier") == 2, F.col("at")), seeded(F.concat_ws("|", F.lit(seed), "user_id"), F.col("question_id")))
    ranked = seen.withColumn("tier", tier).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= size).select("user_id", "book_id", "position", "question_id", "tier")


def shuffle_options(questions: DataFrame, seed: str = "0") -> DataFrame:
    """Options and explanations in a repeatable order; `answer` follows its option."""
    at = lambda c, i: F.get(F.col(c), i)
    items = F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: F.struct(seeded(F.concat_ws("|", F.lit(seed), F.col("id")), i).alias("k"), i.alias("i")))
    order = F.transform(F.array_sort(items), lambda x: x["i"])
    return questions.withColumn("_order", order).withColumns({
        "answer": (F.array_position("_order", F.col("answer")) - 1).cast("int"),
        "options": F.transform("_order", lambda i: at("options", i)), "explanations": F.transform("_order", lambda i: at("explanations", i)),
    }).drop("_order")


def session_summary(session: DataFrame, questions: DataFrame) -> DataFrame:
    """`session` (session_id, question_id, chosen): right answers, total, and the wrong ones with their right option."""
    q = questions.select(F.col("id").alias("question_id"), "answer", "options")
    rows = session.join(q, "question_id")
    wrong = F.when(F.col("chosen") != F.col("answer"), F.struct("question_id", F.get("options", F.col("answer")).alias("right_option")))
    return rows.groupBy("session_id").agg(F.count_if(F.col("chosen") == F.col("answer")).alias("n_right"), F.count("*").alias("total"), F.sort_array(F.collect_list(wrong)).alias("wrong"))


def duplicate_titles(books: DataFrame) -> DataFrame:
    return books.groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


def reading_position(books: DataFrame, positions: DataFrame) -> DataFrame:
    """Last position of each learner in each book they opened, 0 where none is stored."""
    last = positions.groupBy("user_id", "book_id").agg(F.max_by("idx", F.struct("at", "idx")).alias("idx"))
    return last.join(books.select(F.col("id").alias("book_id")), "book_id", "right").select("user_id", "book_id", F.coalesce("idx", F.lit(0)).alias("idx"))
