"""Secret scans with an incremental blob ledger.

Every historical version is content-addressed (SHA-256 of its text). A ledger holds what each rule version found in each blob, so a later run scans only (blob, rule version) pairs it has not seen; findings are joined back to every path that ever held the blob."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import packed, stash, text_of, unpacked

#: Fixed patterns: kind, pattern, group whose length counts, least length.
BASE_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 1),
)
RULE_VERSIONS = {1: BASE_RULES, 2: MORE_RULES}
KINDS = [kind for rules in RULE_VERSIONS.values() for kind, *_ in rules]
#: A text without any of these (lower-cased for assign) has no match of the kind.
_NEEDLES = {"assign": ("passw", "secret", "token", "api"), "access": ("AKIA",), "pem": ("-----BEGIN",), "jwt": ("eyJ",), "forge": ("gh",)}
#: Runs shorter than the least length hold no longer one, so the scan may skip them.
_FASTER = {"hex": r"[0-9a-f]{24,}"}
_COMPILED = {kind: re.compile(_FASTER.get(kind, pattern), re.ASCII) for rules in RULE_VERSIONS.values() for kind, pattern, _, _ in rules}
_SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_spans(text: str, rules: tuple) -> list[dict]:
    """Leftmost non-overlapping matches of each rule, in code points, without those that are too short."""
    out, low = [], None
    for kind, _, group, least in rules:
        needles = _NEEDLES.get(kind)
        if kind == "assign":
            low = text.lower() if low is None else low
        if needles and not any(n in (low if kind == "assign" else text) for n in needles):
            continue
        out += [{"kind": kind, "start": m.start(), "end": m.end()} for m in _COMPILED[kind].finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rule_versions: list[int]) -> DataFrame:
    """blob, holder (one path that has it) and todo (the rule versions not yet run on it)."""
    blobs = versions.groupBy("blob").agg(F.min("path").alias("holder"))
    wanted = F.array(*[F.lit(v) for v in rule_versions])
    if ledger is None:
        return blobs.withColumn("todo", wanted)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<int>")))
    return blobs.join(seen, "blob", "left").select("blob", "holder", todo.alias("todo")).where(F.size("todo") > 0)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for frame in frames:
        rows = []
        for blob, data, todo in zip(frame["blob"], frame["packed"], frame["todo"], strict=True):
            if blob == last:
                continue  # a repeated row: they come one after another
            last, text = blob, unpacked(data)
            rows += [(blob, int(v), find_spans(text, RULE_VERSIONS[int(v)])) for v in todo]
        yield pd.DataFrame(rows, columns=["blob", "rule_version", "spans"])


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rule_versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """New ledger rows: blob, rule_version, spans. `versions` has path and text (any history: a path may come many times).

    Each unseen blob is read from one of the paths that hold it, so a group of copies is scanned once; rows are moved by path and blob, packed, so a hot blob does not fill a task; rows that are equal in both are one before they are moved. Null texts are empty texts; a null path is a path."""
    addressed = versions.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), text_of().alias("text")).withColumn("blob", blob_id(F.col("text")))
    todo = unseen_blobs(addressed.select("path", "blob"), ledger, list(rule_versions)).withColumnsRenamed({"blob": "_blob", "holder": "_path"})
    once = packed(addressed).groupBy("path", "blob").agg(F.first("packed").alias("packed"))  # repeated rows meet before they are moved; the join goes on with this dealing
    texts = once.join(todo.hint("merge"), (F.col("path") == F.col("_path")) & (F.col("blob") == F.col("_blob")))
    found = texts.select("blob", "packed", "todo").mapInPandas(_scan, f"blob string, rule_version int, spans {_SPAN}")
    return found.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))


def scan_history(runs: list[tuple[DataFrame, tuple[int, ...]]]) -> DataFrame:
    """The ledger after some runs, each over (versions so far, rule versions so far). A run scans the pairs that the ledger does not hold yet; what it finds is written and added."""
    ledger = None
    for versions, rules in runs:
        new = stash(scan_versions(versions, ledger, rules), "secret-ledger")
        ledger = new if ledger is None else ledger.unionByName(new)
    return ledger


def findings_by_path(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """All rows of `versions` (path, text, more) without text, with blob and spans: all rule versions' findings in the blob, by start, then kind as listed. Columns of these two names are replaced."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    by_blob = ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("all"))
    ordered = F.transform(F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    by_blob = stash(by_blob.select("blob", ordered.alias("spans")), "findings")  # written, so that a hot blob's rows can be split in the join
    held = versions.drop("spans").withColumn("blob", blob_id(text_of())).drop("text")
    return held.join(by_blob.hint("merge"), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Two runs, as in an archive that grows: the first has half of the versions and rule version 1, the second all versions and both. The second scans what the first has not; all documents get their findings from the ledger of both."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    early = docs.where(F.pmod(F.xxhash64("path"), F.lit(2)) == 0)
    found = findings_by_path(docs, scan_history([(early, (1,)), (docs, (1, 2))]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([kind for kind, *_ in BASE_RULES]))
    return found.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
