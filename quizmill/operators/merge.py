"""Merging two data sets: books, blocks, questions, attempts. Strictly newer stamps win; ties stay as they are here; unset stays unset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_questions(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert by id: a new row replaces the whole old one."""
    return existing.join(rows.select("id"), "id", "left_anti").select(*existing.columns).unionByName(rows)


def delete_books(ids: DataFrame, books: DataFrame, *by_book: DataFrame) -> list[DataFrame]:
    """The tables without the books in `ids` (book_id): books by id, all others by book_id."""
    gone = ids.select("book_id").distinct()
    return [books.join(gone.withColumnRenamed("book_id", "id"), "id", "left_anti"), *[t.join(gone, "book_id", "left_anti") for t in by_book]]


def incomplete_books(here: DataFrame, there: DataFrame, blocks: DataFrame) -> DataFrame:
    """Unknown books whose blocks are not block_count many or repeat an index: id, title."""
    counts = blocks.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("idx").alias("distinct_n"))
    unknown = there.join(here.select("id"), "id", "left_anti").join(counts, "id", "left")
    return unknown.where((F.coalesce("n", F.lit(0)) != F.col("block_count")) | (F.coalesce("distinct_n", F.lit(0)) != F.coalesce("n", F.lit(0)))).select("id", "title")


def new_books(here: DataFrame, there: DataFrame, blocks: DataFrame) -> DataFrame:
    """Unknown and complete books."""
    return there.join(here.select("id"), "id", "left_anti").join(incomplete_books(here, there, blocks).select("id"), "id", "left_anti")


def merge_books(here: DataFrame, there: DataFrame, blocks: DataFrame) -> DataFrame:
    return here.unionByName(new_books(here, there, blocks).select(*here.columns))


def merge_blocks(here: DataFrame, there: DataFrame, added: DataFrame) -> DataFrame:
    """Blocks here and those of newly added books (`added`: id)."""
    return here.unionByName(there.join(added.select(F.col("id").alias("book_id")), "book_id", "left_semi").select(*here.columns))


def concept_set_time(questions: DataFrame) -> DataFrame:
    """Latest created_at of each book's concept questions; null stands for none."""
    return questions.groupBy("book_id").agg(F.max(F.when(F.col("source") == "cloze", F.col("created_at"))).alias("set_time"))


def flag_stamp(flagged: Column, flagged_at: Column) -> Column:
    return F.coalesce(flagged_at, F.when(flagged, F.lit(1)).otherwise(F.lit(0)))


def merge_question(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """`pairs` has structs h and t of one id: content of the strictly newer created_at, flags of the strictly newer stamp; changed tells whether anything is newer."""
    newer = F.col("t.created_at") > F.col("h.created_at")
    flag = flag_stamp(F.col("t.flagged"), F.col("t.flagged_at")) > flag_stamp(F.col("h.flagged"), F.col("h.flagged_at"))
    pick = lambda c: F.when(flag if c in ("flagged", "flagged_at") else newer, F.col(f"t.{c}")).otherwise(F.col(f"h.{c}")).alias(c)
    return pairs.select(*[pick(c) for c in columns], (newer | flag).alias("changed"))


def question_actions(here: DataFrame, there: DataFrame, known: DataFrame) -> DataFrame:
    """Every question of either side with action: keep, update, add, remove, skip. `known`: book_id of the books here or just added.

    A concept set is replaced as a whole: only by a strictly newer one."""
    cols = here.columns
    t = there.join(known.select("book_id").distinct(), "book_id", "left_semi").select(*cols)
    ht, tt = concept_set_time(here).withColumnRenamed("set_time", "_ht"), concept_set_time(t).withColumnRenamed("set_time", "_tt")
    side = lambda df, name: df.select("book_id", "id", F.struct(*cols).alias(name))
    both = side(here, "h").join(side(t, "t"), ["book_id", "id"], "full_outer").join(ht, "book_id", "left").join(tt, "book_id", "left")
    newer_set = F.col("_tt").isNotNull() & (F.col("_ht").isNull() | (F.col("_tt") > F.col("_ht")))
    pairs = both.withColumn("newer_set", newer_set)
    newer = F.col("t.created_at") > F.col("h.created_at")
    flag = flag_stamp(F.col("t.flagged"), F.col("t.flagged_at")) > flag_stamp(F.col("h.flagged"), F.col("h.flagged_at"))
    concept = lambda s: F.col(f"{s}.source") == "cloze"
    action = (
        F.when(F.col("h").isNull(), F.when(concept("t") & ~F.col("newer_set"), "skip").otherwise("add"))
        .when(F.col("t").isNull(), F.when(concept("h") & F.col("newer_set"), "remove").otherwise("keep"))
        .when(newer | flag, "update").otherwise("keep")
    )
    pick = lambda c: F.when(F.col("h").isNull(), F.col(f"t.{c}")).when(F.col("t").isNull(), F.col(f"h.{c}")).when(flag if c in ("flagged", "flagged_at") else newer, F.col(f"t.{c}")).otherwise(F.col(f"h.{c}")).alias(c)
    return pairs.select(*[pick(c) for c in cols], action.alias("action"))


def merge_questions(here: DataFrame, there: DataFrame, known: DataFrame) -> DataFrame:
    return question_actions(here, there, known).where("action NOT IN ('remove', 'skip')").drop("action")


def merge_attempts(here: DataFrame, there: DataFrame, known: DataFrame, order: str = "at") -> DataFrame:
    """Attempts here and the new ones of known books, one for each id (the last by `order`)."""
    own = there.join(known.select("book_id").distinct(), "book_id", "left_semi").join(here.select("id"), "id", "left_anti")
    last = own.groupBy("id").agg(F.max_by(F.struct(*[c for c in there.columns if c != "id"]), order).alias("_row")).select("id", "_row.*")
    return here.unionByName(last.select(*here.columns))


def merge_summary(actions: DataFrame, added_books: DataFrame, incomplete: DataFrame, attempts_added: DataFrame) -> DataFrame:
    """One row: titles added and left out, questions added, updated, removed, attempts added."""
    q = actions.agg(F.count_if(F.col("action") == "add").alias("questions_added"), F.count_if(F.col("action") == "update").alias("questions_updated"), F.count_if(F.col("action") == "remove").alias("questions_removed"))
    b = added_books.agg(F.sort_array(F.collect_list("title")).alias("books_added"))
    i = incomplete.agg(F.sort_array(F.collect_list("title")).alias("books_incomplete"))
    return q.join(b, F.lit(True)).join(i, F.lit(True)).join(attempts_added.agg(F.count("*").alias("attempts_added")), F.lit(True))


def replace_concepts(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per book of `fresh`: concept questions that are not made any more go, the rest is replaced and keeps its flags; other questions stay."""
    mine = fresh.select("book_id").distinct()
    stay = existing.join(mine.withColumn("_made", F.lit(True)), "book_id", "left").where(~((F.col("source") == "cloze") & F.col("_made").isNotNull())).join(fresh.select("id"), "id", "left_anti")
    flags = existing.select("id", F.col("flagged").alias("_flagged"), F.col("flagged_at").alias("_at"))
    kept = fresh.join(flags, "id", "left").withColumns({"flagged": F.coalesce("_flagged", "flagged"), "flagged_at": F.coalesce("_at", "flagged_at")})
    return stay.select(*existing.columns).unionByName(kept.select(*existing.columns))
