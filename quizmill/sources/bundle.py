"""Transfer bundles: a header and four tables as gzipped JSON lines, written and read by Spark, checked before they are merged."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APP, FORMAT = "quizmill", 1
TABLES = ("books", "blocks", "questions", "attempts")

#: Required fields of each table and their JSON kinds.
SHAPES = {
    "books": {"id": "string", "title": "string", "block_count": "number"},
    "blocks": {"book_id": "string", "idx": "number", "kind": "string", "text": "string", "path": "array"},
    "questions": {"id": "string", "book_id": "string", "source": "string", "stem": "string", "options": "array", "answer": "number", "block_indexes": "array", "chapter": "string", "created_at": "number"},
    "attempts": {"id": "any", "question_id": "string", "book_id": "string", "chosen": "number", "at": "number"},
}


def bundle_name(now: Column) -> Column:
    return F.concat(F.lit(f"{APP}-"), F.date_format(now, "yyyy-MM-dd-HHmm"))


def export_bundle(tables: dict[str, DataFrame], path: str, now_ms: int) -> None:
    """Writes header, books, blocks, questions, attempts; nothing else is ever exported."""
    spark = next(iter(tables.values())).sparkSession
    header = spark.range(1).select(F.lit(APP).alias("app"), F.lit(FORMAT).alias("format"), F.lit(now_ms).alias("exported_at"))
    for name, df in {"header": header, **{t: tables[t] for t in TABLES}}.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def read_bundle(spark, path: str, schemas: dict) -> dict[str, DataFrame]:
    """The tables back, by declared schemas; a line that is no JSON has its text in _corrupt_record."""
    out = {}
    for name in TABLES:
        schema = schemas[name].add("_corrupt_record", "string") if "_corrupt_record" not in schemas[name].names else schemas[name]
        out[name] = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{path}/{name}")
    return out


def read_raw(spark, path: str, table: str) -> DataFrame:
    return spark.read.text(f"{path}/{table}")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of files (path, content) as (file, value, error): gzip is told by its first two bytes, whatever a file is called. A file that cannot be read to its end is one more row: damaged (broken or cut off gzip) or undecodable (no UTF-8)."""

    def pieces(content: bytes) -> Iterator[bytes]:
        at = 0
        while content[:2] == b"\x1f\x8b" and at < len(content):  # members may follow each other
            unzip, some = zlib.decompressobj(31), content[at : at + STEP]
            while some:
                yield unzip.decompress(some)
                at += len(some) - len(unzip.unused_data)
                some = b"" if unzip.eof else content[at : at + STEP]
            if not unzip.eof:
                raise zlib.error("cut off")
        if content[:2] != b"\x1f\x8b":
            yield from (content[i : i + STEP] for i in range(0, len(content), STEP))

    def pack(file: str, values: list, error: str | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(values)), pa.array(values, pa.string()), pa.array([error] * len(values), pa.string())], names=["file", "value", "error"])

    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rest = b""
            try:
                for piece in pieces(content):
                    *lines, rest = (rest + piece).split(b"\n")
                    if lines:
                        yield pack(file, [x.decode().removesuffix("\r") for x in lines])
                if rest:
                    yield pack(file, [rest.decode()])
            except zlib.error:
                yield pack(file, [None], "damaged")
            except UnicodeDecodeError:
                yield pack(file, [None], "undecodable")


STEP = 1 << 20


def decoded_lines(files: DataFrame) -> DataFrame:
    """(file, value, error) of files (path, content), as Spark's binaryFile source gives them: a file that cannot be read is a row with an error and no failed job."""
    return files.select("path", "content").mapInArrow(_lines, "file string, value string, error string")


def read_files(spark, path: str, table: str) -> DataFrame:
    """decoded_lines of a table's files."""
    return decoded_lines(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{table}"))


def _kind(v: Column, field: str) -> Column:
    s = F.schema_of_variant(F.variant_get(v, f"$.{field}", "variant"))
    return F.when(s == "STRING", "string").when(s.rlike("^ARRAY"), "array").when(s.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), "number").when(s.rlike("^BOOLEAN"), "boolean").when(s == "VOID", F.lit(None)).otherwise("other")


def row_is_whole(value: Column, table: str) -> Column:
    """Whether a JSON line has the table's required fields in their kinds."""
    v = F.try_parse_json(value)
    good = F.lit(True)
    for field, kind in SHAPES[table].items():
        found = F.coalesce(_kind(v, field), F.lit("absent"))
        good = good & ((found != "absent") if kind == "any" else (found == kind))
    return F.coalesce(v.isNotNull() & good, F.lit(False))


def check_bundle(header: DataFrame, raw: dict[str, DataFrame | None]) -> DataFrame:
    """One row: verdict and bad rows of each table. not_ours before too_new before damaged; a missing table is damage, a file that could not be read is a bad row, and a header whose gzip is broken is damage whatever it was."""
    v = F.try_parse_json(F.col("value"))
    app, fmt = F.try_variant_get(v, "$.app", "string"), F.try_variant_get(v, "$.format", "double")
    numeric = F.coalesce(_kind(v, "format") == "number", F.lit(False))
    head = header.agg(F.max(F.struct((F.coalesce(app == APP, F.lit(False)) & numeric).alias("ours"), F.coalesce(fmt, F.lit(0.0)).alias("format"))).alias("h"))
    if "error" in header.columns:
        head = head.join(header.agg(F.count_if(F.col("error") == "damaged").alias("broken")), F.lit(True))
    else:
        head = head.withColumn("broken", F.lit(0).cast("long"))
    counts = head.select("broken", F.coalesce("h.ours", F.lit(False)).alias("ours"), F.coalesce("h.format", F.lit(0.0)).alias("format"))
    for name in TABLES:
        df = raw.get(name)
        if df is None:
            counts = counts.withColumn(f"bad_{name}", F.lit(None).cast("long"))
        else:
            counts = counts.join(df.agg(F.count_if(~row_is_whole(F.col("value"), name)).alias(f"bad_{name}")), F.lit(True))
    whole = F.lit(True)
    for name in TABLES:
        whole = whole & F.coalesce(F.col(f"bad_{name}") == 0, F.lit(False))
    verdict = F.when(F.col("broken") > 0, "damaged").when(~F.col("ours"), "not_ours").when(F.col("format") > FORMAT, "too_new").when(~whole, "damaged").otherwise("ok")
    return counts.select(verdict.alias("verdict"), *[f"bad_{n}" for n in TABLES])
