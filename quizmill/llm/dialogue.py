"""Repair of conversations by cheapest edits.

A conversation's roles shall read `(s?(ua)+)?` by their initials. Rows may be kept (0), given the role user or assistant (1) or deleted (2), empty turns may be inserted (5); blank and repeated rows must go, a truncated row that stays costs 5 more. Of the cheapest edits those whose initials are ASCII-least are taken.

The search sees one letter a row (initial and fault). It goes backward over them and stores state-cost vectors at every sqrt(n)-th row only; walking forward, it recomputes one block of vectors after another and takes the least tight edit. Texts stay in Spark: they meet their conversation's edits in a sorted stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import stash

INITIALS = "suao"  #: o: any other
#: A row's letter: LETTERS[3 * initial + fault] with fault 0 none, 1 truncated, 2 must be deleted.
LETTERS = "abcdefghijkl"
RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a row of each initial, and behind an inserted or re-tagged turn, whose role follows from the state.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEW = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs to finish behind the last row, by state.
FINISH = (0, 2 * INSERT, INSERT, 0)
BLOCK = 65_536


def _step(after: tuple[int, ...], letter: str) -> tuple[int, ...]:
    """Costs before a row from those behind it."""
    initial, fault = divmod(LETTERS.index(letter), 3)
    stay = TRUNCATED * (fault == 1)
    costs = []
    for state in range(4):
        options = [DELETE + after[state]]
        if fault < 2:
            options.append(RETAG + stay + after[NEW[state]])
            if (to := NEXT[state].get(INITIALS[initial])) is not None:
                options.append(stay + after[to])
        costs.append(min(options))
    return tuple(min(costs[q], INSERT + costs[NEW[q]], 2 * INSERT + costs[NEW[NEW[q]]]) for q in range(4))


class _Steps(dict):
    """(costs less their least, letter) -> (how much the least grows, new costs less their least): there are few, so each is worked out once."""

    def __missing__(self, key):
        made = _step(*key)
        self[key] = found = (min(made), tuple(c - min(made) for c in made))
        return found


_STEPS = _Steps()


def _edit(state: int, before: int, after: tuple[int, ...], here: tuple[int, ...], letter: str) -> str:
    """The ASCII-least edit that loses nothing: `before` is the cost in this state before the row, `here` the costs before and `after` those behind it, on one scale."""
    initial, fault = divmod(LETTERS.index(letter), 3)
    stay = TRUNCATED * (fault == 1)
    if DELETE + after[state] == before:
        return "D"
    if INSERT + here[NEW[state]] == before:
        return "I"
    to = NEXT[state].get(INITIALS[initial])
    return "K" if fault < 2 and to is not None and stay + after[to] == before else "R"


def cheapest_edits(letters: str) -> tuple[int, str]:
    """Cost and audit of a conversation's rows. Memory: the letters and edits, and about 2 sqrt(n) vectors."""
    n = len(letters)
    width = isqrt(n) + 1
    least, costs, marks = 0, FINISH, {}
    for k in range(n - 1, -1, -1):
        if (k + 1) % width == 0:
            marks[k + 1] = costs
        grown, costs = _STEPS[costs, letters[k]]
        least += grown
    cost, out, state = least + costs[START], [], START
    for begin in range(0, n, width):
        end = min(begin + width, n)
        vectors = [(0, marks.get(end, FINISH) if end < n else FINISH)]  # how much the least grew, costs; the last row's first
        for k in range(end - 1, begin - 1, -1):
            vectors.append(_STEPS[vectors[-1][1], letters[k]])
        for k in range(begin, end):
            after = vectors[end - k - 1][1]
            here = tuple(c + vectors[end - k][0] for c in vectors[end - k][1])
            while (edit := _edit(state, here[state], after, here, letters[k])) == "I":
                out.append("I")
                state = NEW[state]
            out.append(edit)
            if edit == "R":
                state = NEW[state]
            elif edit == "K":
                state = NEXT[state][INITIALS[LETTERS.index(letters[k]) // 3]]
    out.append("I" * (FINISH[state] // INSERT))
    return cost, "".join(out)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows that are left, by crc32 of `conv_id:turn` mod 20: 0 the row is dropped, 1 its text is empty, 2 its text has no stops, 3 it stands twice, 4 its role is user. A null counts as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20
    return rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _tagged(rows: DataFrame) -> DataFrame:
    """The conversation as text, told apart from none; a hash of the text. Equal turns are ordered by role and hash."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    fine = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), fine("role").alias("role"), fine("text").alias("text"), copies.alias("copies")).withColumn("key", F.sha2("text", 256))


ORDER = ("turn", "role", "key")


def faults(tagged: DataFrame) -> DataFrame:
    """One row for each different row of a conversation: conv, turn, role, key, n (how often it stands), blank, duplicate, truncated (how many have that as first fault) and letters (one for each).

    Equal rows are counted before they are shuffled; whether a text has been seen is known from the least turn of (conv, role, text)."""
    last = F.substring(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+\\z", ""), -1, 1)
    slim = tagged.select("conv", *ORDER, "copies", (~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).alias("empty"), (~last.isin(".", "!", "?")).alias("open"))
    each = slim.groupBy("conv", *ORDER).agg(F.sum("copies").alias("n"), F.first("empty").alias("empty"), F.first("open").alias("open"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))  # no turn comes first
    each = stash(each.withColumn("place", place), "turns")
    firsts = each.groupBy("conv", "role", "key").agg(F.min("place").alias("first"))
    each = each.join(firsts, ["conv", "role", "key"])
    seen = F.col("place") > F.col("first")
    initial = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1))  # no role at all: 1, so it is asked for first
    initial = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    fault = F.when(F.col("empty") | seen, 2).when(F.col("open"), 1).otherwise(0)
    letter = lambda f: F.substring(F.lit(LETTERS), initial * 3 + f + 1, F.lit(1))
    zero = F.lit(0).cast("long")
    return each.select(
        "conv", *ORDER, "n", F.when(F.col("empty"), F.col("n")).otherwise(zero).alias("blank"), F.when(F.col("empty"), zero).when(seen, F.col("n")).otherwise(F.col("n") - 1).alias("duplicate"),
        F.when(F.col("empty") | seen | ~F.col("open"), zero).otherwise(F.lit(1).cast("long")).alias("truncated"), F.concat(letter(fault), F.repeat(letter(F.lit(2)), (F.col("n") - 1).cast("int"))).alias("letters"),
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of the sorted rows of a partition, joined within conversations in blocks of about BLOCK."""
    part, conv, held, size, number = TaskContext.get().partitionId(), None, [], 0, 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv": [conv], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int64()), "letters": ["".join(held)]})

    for batch in batches:
        for name, letters in zip(batch.column("conv").to_pylist(), batch.column("letters").to_pylist(), strict=True):
            if held and (name != conv or size >= BLOCK):
                yield block()
                held, size, number = [], 0, number + 1
            conv = name
            held.append(letters)
            size += len(letters)
    if held:
        yield block()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    legal = {"su", "ua", "au"}
    for batch in batches:
        rows = []
        for conv, letters in zip(batch.column("conv").to_pylist(), batch.column("letters").to_pylist(), strict=True):
            roles = [INITIALS[LETTERS.index(x) // 3] for x in letters]
            rows.append((conv, sum(a + b not in legal for a, b in zip(roles, roles[1:], strict=False)), *cheapest_edits(letters)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv", "illegal", "cost", "audit"])


def edits(found: DataFrame) -> DataFrame:
    """conv, illegal, cost and audit of the conversations of `faults`.

    Rows are put in order over range partitions, so a long conversation is sorted by many tasks; only its letters, a byte a row as in the audit that it returns, meet in one."""
    ordered = found.select("conv", *ORDER, "letters").repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    blocks = ordered.select("conv", "letters").mapInArrow(_blocks, "conv string, part int, number long, letters string")
    joined = blocks.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "number", "letters"))), lambda b: b["letters"]), "").alias("letters"))
    return joined.mapInArrow(_search, "conv string, illegal long, cost long, audit string")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str, str | None, str]]:
    """Each edit of the stream (a conversation's audit, then its rows in order) as conv, edit, role, text. An `E` ends each conversation."""
    conv, audit, at, state = None, "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEW[state]
            yield conv, "I", ROLE[state], ""

    for batch in batches:
        for name, edits_, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text", "copies")), strict=True):
            if edits_ is not None:
                if conv is not None:
                    yield from inserted()
                    yield conv, "E", "", ""
                conv, audit, at, state = name, edits_, 0, START
                continue
            for _ in range(copies):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "R":
                    state = NEW[state]
                    role_now = ROLE[state]
                else:
                    role_now = role
                    if edit == "K":
                        state = NEXT[state][role[0]]
                yield conv, edit, role_now, text
    if conv is not None:
        yield from inserted()
        yield conv, "E", "", ""


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, out, size = 0, [], 0
    schema = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema, strict=True)], names=["conv", "place", "edit", "role", "text"])
    for conv, edit, role, text in _replay(batches):
        place = 0 if edit == "E" else place + (edit != "D")
        if edit in "KRI":
            out.append((conv, place, edit, role, text))
            size += len(text)
        if size > 4_000_000 or len(out) > 4_000:
            yield pack()
            out, size = [], 0
    if out:
        yield pack()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash goes on from row to row: a conversation's text is never held."""
    digest, first, out = hashlib.sha256(), True, []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["conv", "repaired_sha256"])
    for conv, edit, role, text in _replay(batches):
        if edit == "E":
            out.append((conv, digest.hexdigest()))
            digest, first = hashlib.sha256(), True
            if len(out) == 4_000:
                yield pack()
                out = []
        elif edit != "D":
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
    if out:
        yield pack()


def _stream(tagged: DataFrame, found: DataFrame) -> DataFrame:
    """Audits before the rows of their conversations, in order. A digest and a repaired conversation are sequences, so a conversation streams through one task; it holds the audit and a batch of rows."""
    texts = tagged.select("conv", *ORDER, "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    return texts.unionByName(heads).withColumn("head", F.col("audit").isNull()).repartition("conv").sortWithinPartitions("conv", "head", *ORDER)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, place (from 1), edit (K kept, R given a role, I inserted), role, text. Input: conv_id, turn, role, text, and copies if rows stand for several. Rows of equal turn are ordered by role and hash of the text; rows without conversation are one."""
    tagged = _tagged(rows)
    out = _stream(tagged, edits(faults(tagged))).mapInArrow(_rows, "conv string, place long, edit string, role string, text string")
    conv = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(rows.schema["conv_id"].dataType)
    return out.select(conv.alias("conv_id"), "place", "edit", "role", "text")


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """For every conv_id of `conversations` (null is one): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its rows; without rows zeros, '' and the hash of ''."""
    tagged = _tagged(rows)
    each = stash(faults(tagged), "faults")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0).cast("long"))
    totals = each.groupBy("conv").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    found = stash(edits(each), "edits")
    hashes = _stream(tagged, found).mapInArrow(_digests, "conv string, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    out = ids.join(totals, "conv", "left").join(found, "conv", "left").join(hashes, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(damaged(conversations), conversations)
