"""WARC archives with revisit records, and a capture index merged from locally sorted runs.

Archives are written by Spark's text sink (records end with CRLF CRLF, so the sink's line separator makes well-formed files) and read back whole; how many there are follows from the payloads' bytes. The sink packs a file as one gzip stream, so a record's offset counts in the unpacked archive."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import scratch_path, stash

LEAST_REVISIT_BYTES = 100
#: Payload bytes of an archive, on average, and captures that one task merges, on average.
ARCHIVE_BYTES, MERGE_ROWS = 1 << 24, 500_000
_END = "\r\n\r\n"
#: An index line as Python sees it: ids are texts there, so that a null among them makes no floats of the others.
_INDEX = "url_key string, timestamp string, page_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, archive string, offset long, place long"


def record_kinds(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, refers_to: of equal payloads of 100 bytes or more, all but the smallest page_id refer to it. Dealt by page over as many partitions as there will be archives.

    Digests meet without their payloads: the table of (page, digest) is written, counted with a partial aggregation and joined by digest, where a hot digest can be split; payloads move once, by page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({"payload_digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("long")})
    slim = stash(rows.select("page_id", "payload_digest", "payload_bytes"), "payloads")
    groups = slim.where(F.col("payload_bytes") >= LEAST_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("origin"), F.max("page_id").alias("other")).where(F.col("origin") < F.col("other"))
    groups = stash(groups.select("payload_digest", "origin"), "shared-payloads")
    revisits = slim.join(groups.hint("merge"), "payload_digest").where(F.col("page_id") != F.col("origin")).distinct()
    # fewer partitions than the session's would be dealt anew for the join
    archives = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(slim.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()[0]) // archive_bytes))
    marks = revisits.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("origin").alias("refers_to"))
    same = (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    return rows.repartition(archives, "page_id", "payload_digest").join(marks.repartition(archives, "_page", "_digest").hint("merge"), same, "left").drop("_page", "_digest")


def _header(name: str, value: Column) -> Column:
    """Empty if the value is null; control characters in values are percent-encoded."""
    safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def warc_record(date: Column) -> Column:
    """One record without its closing CRLF CRLF. A revisit has the HTTP head only."""
    revisit = F.col("refers_to").isNotNull()
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", urn(F.col("page_id"))),
        _header("WARC-Date", date),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("X-Payload-Length", F.when(revisit, F.col("payload_bytes"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(head) + F.octet_length(body)),
        F.lit("\r\n"), head, body,
    )


def capture_date(page_id: Column) -> Column:
    """The tables have no capture time: one minute per page id from 2024-01-01, which starts over after 2^25 ids."""
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1 << 25)) * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Gzipped WARC files of about archive_bytes of payload each, or less: there are at least as many as the session's shuffle partitions."""
    records = record_kinds(pages, archive_bytes).select(warc_record(capture_date(F.col("page_id"))).alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").text(path)


def parse_archive(name: str, data: bytes) -> Iterator[tuple]:
    """Records of one archive, found by their Content-Length: headers, payload bytes, offset in the unpacked archive."""
    raw = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in raw[at:stop].decode().split("\r\n")[1:])
        end = stop + 4 + int(head["Content-Length"])
        body = raw.index(b"\r\n\r\n", stop + 4, end) + 4
        yield head, raw[body:end], at
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: record at {at} does not end after its Content-Length")
        at = end + 4


def _page(urn: str | None) -> str | None:
    return (urn or "")[len("<urn:page:") : -1] or None


def _numbered(index: DataFrame) -> DataFrame:
    return index.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, no scheme, www or fragment, lower-case host."""
    rest = (url or "").split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    labels = host.lower().split(":")[0].split(".")
    return ",".join(reversed(labels[1:] if labels[0] == "www" and len(labels) > 1 else labels)) + ")" + slash + path


def _index_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _INDEX.split(", ")]
    for frame in frames:
        for name, data in zip(frame["path"], frame["content"], strict=True):
            run = []
            for head, payload, offset in parse_archive(name, bytes(data)):
                revisit = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(head["X-Payload-Length"]) if revisit else len(payload)
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{name}: payload at {offset} does not match its digest")
                run.append((url_key(head.get("WARC-Target-URI")), head["WARC-Date"], _page(head["WARC-Record-ID"]), head["WARC-Type"], _page(head.get("WARC-Refers-To")), digest, size, name.rsplit("/", 1)[-1], offset))
            run.sort(key=_capture_order)
            yield pd.DataFrame([(*r, i) for i, r in enumerate(run)], columns=columns)


def _capture_order(row: tuple) -> tuple:
    """URL key, timestamp, page (none: first)."""
    return row[0], row[1], -math.inf if pd.isna(row[2]) else int(row[2])


def capture_runs(spark, path: str) -> DataFrame:
    """The archives' index lines, each archive a run sorted by URL key and timestamp, numbered in `place`; payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return _numbered(files.mapInPandas(_index_rows, _INDEX))


class LoserTree:
    """k-way merge of sorted lists: inner nodes hold losers, so each step compares along one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.width = 1
        while self.width < max(1, len(runs)):
            self.width *= 2
        self.losers = [-1] * self.width
        self.winner = self._build(1)

    def _head(self, run: int):
        """None stands for an exhausted run."""
        return self.key(self.runs[run][self.at[run]]) if run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def _build(self, n: int) -> int:
        if n >= self.width:
            return n - self.width
        a, b = self._build(2 * n), self._build(2 * n + 1)
        win, self.losers[n] = (a, b) if self._beats(a, b) else (b, a)
        return win

    def __iter__(self):
        while self._head(self.winner) is not None:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            n = (run + self.width) // 2
            while n:
                if self._beats(self.losers[n], run):
                    run, self.losers[n] = self.losers[n], run
                n //= 2
            self.winner = run


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come run by run, each in its own order; the tree takes them from all runs at once."""
    runs, columns, name = [], None, None
    for frame in frames:
        columns = list(frame.columns)
        for row in frame.itertuples(index=False, name=None):
            if row[7] != name:
                name = row[7]
                runs.append([])
            runs[-1].append(row)
    out = []
    for row in LoserTree(runs, _capture_order):
        out.append(row)
        if len(out) == 10_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def merged_index(runs: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """All captures, globally ordered by URL key, timestamp and page: ranges of these, of merge_rows captures each on average, go to tasks, so a hot URL is split by time. A shuffle does not keep the order of its blocks, so Spark's own (spilling) sort puts each task's pieces of runs in place again; a loser tree merges them."""
    ranges = max(1, -(-runs.count() // merge_rows), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.repartitionByRange(ranges, "url_key", "timestamp", "page_id").sortWithinPartitions("archive", "place")
    texts = dealt.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return _numbered(texts.mapInPandas(_merge, _INDEX)).drop("place")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives, read them back and return the merged capture index.

    Null html is an empty payload; null url has no target; a null page_id is kept; repeated rows give a record each (those of the smallest page_id are all responses)."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return merged_index(stash(capture_runs(spark, path), "capture-runs"))


def op5_warc_index(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), o AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS origin FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id > origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > origin THEN origin END AS refers_to
FROM o
"""
