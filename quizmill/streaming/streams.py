"""Attempts, flags and model calls as streams. Results do not depend on the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_events(spark, path: str, schema) -> DataFrame:
    """A stream over Parquet files as they arrive; `ts` becomes a timestamp that a watermark accepts."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def attempts_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each id once, as long as its repeats come within `late` of it; state older than that is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def append_new(path: str, run: str, buckets: int = 64):
    """foreachBatch sink that is exact however late a repeat comes: rows whose id is not stored yet are appended.

    The table is dealt by run (the name of a checkpoint), batch and a hash bucket of the id. A batch reads the buckets that its own ids fall into (at most `buckets` numbers come to the driver), and writes its own directory: a batch that is played again replaces what it wrote and adds nothing."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(["id"]).withColumns({"run": F.lit(run), "batch": F.lit(n), "bucket": F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")})
        touched = [r["bucket"] for r in once.select("bucket").distinct().collect()]
        if stored(spark, path):
            own = (F.col("run") == run) & (F.col("batch") >= n)
            known = spark.read.parquet(path).where(F.col("bucket").isin(touched) & ~own).select("id")
            once = once.join(known, "id", "left_anti")
        once.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch", "bucket").parquet(path)

    return write


def stored(spark, path: str) -> bool:
    """Whether the table has been written before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def last_attempt_stream(events: DataFrame) -> DataFrame:
    """Running last attempt of each learner at each question: by time, then the lowest id; late rows lose by time."""
    best = F.max_by(F.struct("id", "chosen", "at"), F.struct(F.col("at"), -F.col("id")))
    return events.groupBy("user_id", "question_id").agg(best.alias("last")).select("user_id", "question_id", "last.*")


def flag_stream(changes: DataFrame) -> DataFrame:
    """Newest flag of each question."""
    return changes.groupBy("id").agg(F.max_by("flagged", F.struct("at", "flagged")).alias("flagged"), F.max("at").alias("at"))


def newest_by_key(stream: DataFrame, keys: list[str], values: list[str], less_is_better: bool = False) -> DataFrame:
    """An update-mode stream of the keys whose newest row changed: the greatest first value (a time), of equal ones the greatest second value (with less_is_better: the least). Keyed state holds one row a key; late rows lose by time, and a row that was seen before changes nothing: of equal rows the one of the earlier batch stays, and only rows of the batch at hand leave it. The first two values are numbers."""
    batch = F.unix_micros(F.current_timestamp())  # one time for all rows of a batch, the same when it is played again
    tie = -F.col(values[1]) if less_is_better else F.col(values[1])
    best = F.max_by(F.struct(*values, "_batch"), F.struct(F.col(values[0]), tie, -F.col("_batch")))
    found = stream.withColumn("_batch", batch).groupBy(*keys).agg(best.alias("_best"))
    return found.where(F.col("_best._batch") == batch).select(*keys, *[F.col(f"_best.{c}") for c in values])


def upsert(path: str, run: str):
    """foreachBatch sink of a versioned table: each batch adds its changed rows in a directory of its own (a batch that is played again replaces it); current() reads the newest of each key."""

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.withColumns({"run": F.lit(run), "version": F.lit(n)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "version").parquet(path)

    return write


def current(spark, path: str, keys: list[str]) -> DataFrame:
    """The table as of its last batch: of each key the row of the highest version, without run and version. One run wrote it."""
    table = spark.read.parquet(path)
    rest = [c for c in table.columns if c not in (*keys, "run", "version")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(*keys, "_r.*")


def run_upserts(stream: DataFrame, path: str, checkpoint: str, run: str = "one") -> None:
    """Run an update-mode stream over what is there now into a versioned table. Keyed state lies in Spark's RocksDB store, not in the heap."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.foreachBatch(upsert(path, run)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)


_STORE = "spark.sql.streaming.stateStore.providerClass"


def daily_usage_stream(calls: DataFrame, zone: str = "America/Los_Angeles", late: str = "2 days") -> DataFrame:
    """Requests of each model by Pacific day."""
    local = calls.withColumn("ts_local", F.from_utc_timestamp("ts", zone)).withWatermark("ts_local", late)
    return local.groupBy(F.window("ts_local", "1 day"), "model").agg(F.count("*").alias("requests"), F.bool_or("used_up").alias("used_up")).select(F.to_date("window.start").alias("day"), "model", "requests", "used_up")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run an aggregating stream over what is there now; its table is written to `path` by the executors and returned."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_into(stream: DataFrame, sink, checkpoint: str) -> None:
    """Run a stream over what is there now into a foreachBatch sink."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
