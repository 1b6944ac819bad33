"""What the operators of this subpackage share: a shared scratch folder, running sums over hot keys, token hashes."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII whitespace as the contracts name it: `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Unset: a local one in local mode, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="quizmill-")
    else:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """A list of the folders that are asked for inside it, by this thread (or context) only: two runs at a time have a list each."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def delete_scratch(spark: SparkSession, paths: list[str], keep: tuple[str, ...] = ()) -> None:
    """Delete the folders of a scope and take them off its list, but for those in `keep`. For callers who have written what they wanted: frames that still read the folders fail afterwards."""
    for path in [p for p in paths if p not in keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        paths.remove(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet: the name, with underscores if need be. Spark's names ignore case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hidden(df: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns renamed that begin with two underscores, as helper columns do, but for those in `own`; and the new names of the old ones, for shown()."""
    names: dict[str, str] = {}
    for c in df.columns:
        if c.startswith("__") and c not in own:
            names[c] = free_name(df, f"kept{len(names)}")
    return df.withColumnsRenamed(names), names


def shown(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({new: old for old, new in names.items()})


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a (slim) frame to the shared folder and read it back: later readers do not compute it again, and no executor is its only holder."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(df: DataFrame) -> Column:
    """A text that is equal for rows that are equal in all columns and differs for others: 128 bits of hashes of all values and of which are null. Columns of map type cannot be hashed."""
    columns = [*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").isNull() for c in df.columns]]
    return F.concat(F.lower(F.hex(F.xxhash64(*columns))), F.lit("-"), F.lower(F.hex(F.xxhash64(F.lit(7), *columns))))


def hash_bucket(col: Column, buckets: int) -> Column:
    """0 .. buckets-1 from the md5 of the value as text (the same in any engine); null counts as the empty text."""
    word = F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 7)
    return F.pmod(F.conv(word, 16, 10).cast("long"), F.lit(buckets))


def running_sum(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of `group` that come before this one in the order (bucket, *order).

    Two levels, so that no task sees a whole hot group: sums by (group, bucket), running sums of those few sums, and a window inside each bucket. `group` may be null."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("__g"), F.col(bucket).alias("__b"), F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = rows.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col(bucket) == F.col("__b")))
    return joined.withColumn(out, F.col("__inside") + F.col("__offset")).drop("__inside", "__offset", "__g", "__b")


# ---------------------------------------------------------------- token hashes, for the Arrow-batched operators

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(2 * _SEGMENT + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Tokens:
    """Hashed tokens of a batch of texts: `hashes` of all texts one after another; text i owns hashes[starts[i]:starts[i + 1]].

    `prefixes[k]` has the hashes of the tokens' first k bytes. Tokens are runs of bytes that are no ASCII blanks; with punct=True runs of punctuation are tokens of their own; with words=True they are left out. With lower=True A-Z count as a-z."""

    def __init__(self, texts: list[str | None], lower: bool = True, punct: bool = False, words: bool = False, prefixes: tuple[int, ...] = ()):
        data = [(t or "").encode() for t in texts]
        ends = np.cumsum([len(d) + 1 for d in data], dtype=np.int64) if data else np.zeros(0, np.int64)
        buffer = np.frombuffer(b" ".join([*data, b""]), np.uint8)
        found, positions = [], []
        heads: dict[int, list[np.ndarray]] = {k: [] for k in prefixes}
        for at, piece in _segments(buffer):
            starts, stops = _bounds(piece, punct, words)
            if not len(starts):
                continue
            values = _BYTE[_LOWER[piece] if lower else piece]
            up, down = _powers() if len(piece) <= 2 * _SEGMENT else _long_powers(len(piece))
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values * up[: len(piece)], out=sums[1:])
            found.append(mix((sums[stops] - sums[starts]) * down[starts]))
            for k in prefixes:
                heads[k].append(mix((sums[np.minimum(starts + k, stops)] - sums[starts]) * down[starts] + np.uint64(k)))
            positions.append(starts + at)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hashes = join(found, np.uint64)
        self.prefixes = {k: join(v, np.uint64) for k, v in heads.items()}
        self.starts = np.concatenate([[0], np.searchsorted(join(positions, np.int64), ends)]).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def _long_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For a segment with no blank to cut at."""
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _segments(buffer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of about _SEGMENT bytes, cut at blanks."""
    at, n = 0, len(buffer)
    while at < n:
        end = min(n, at + _SEGMENT)
        step = 4096
        while end < n and not _BLANK[buffer[end - 1]]:
            blanks = np.flatnonzero(_BLANK[buffer[end : end + step]])
            end = min(n, end + (int(blanks[0]) + 1 if len(blanks) else step))
        yield at, buffer[at:end]
        at = end


def _bounds(piece: np.ndarray, punct: bool, words: bool) -> tuple[np.ndarray, np.ndarray]:
    if words:
        kind = _WORDLIKE[piece].astype(np.int8)
    elif punct:
        kind = np.where(_BLANK[piece], 0, np.where(_WORDLIKE[piece], 1, 2)).astype(np.int8)
    else:
        kind = (~_BLANK[piece]).astype(np.int8)
    edges = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    # an edge may both end one token and start the next
    starts = edges[(edges < len(piece)) & (np.take(kind, np.minimum(edges, len(piece) - 1)) > 0)]
    stops = edges[(edges > 0) & (np.take(kind, np.maximum(edges - 1, 0)) > 0)]
    return starts, stops


def shingles(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` tokens inside each text, and where each text's begin; a text with fewer tokens has one shingle of all of them, one with no token none."""
    h, starts, counts = tokens.hashes, tokens.starts, tokens.counts
    sizes = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if not begins[-1]:
        return np.zeros(0, np.uint64), begins
    first = np.repeat(starts[:-1] - begins[:-1], sizes) + np.arange(begins[-1])
    last = np.repeat(starts[1:], sizes)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    out = np.zeros(begins[-1], np.uint64)
    for k in range(width):
        step = np.where(first + k < last, padded[first + k], np.uint64(0x5555))
        out = (out + step) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return mix(out), begins


def packed(df: DataFrame) -> DataFrame:
    """`df` with the string column text as zlib-packed UTF-8 in `packed` (binary): for texts that must be shuffled. All other columns must be strings or never null."""
    kept = [c for c in df.columns if c != "text"]

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            out = frame[kept].copy()
            out["packed"] = [zlib.compress(t.encode(), 1) for t in frame["text"]]
            yield out

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept], "packed binary"])
    return df.select(*kept, "text").mapInPandas(run, schema)


def unpacked(data: bytes) -> str:
    return zlib.decompress(data).decode()


def batches(frame, rows: int = 256, chars: int = 1_000_000) -> Iterator:
    """Slices of a pandas frame with a column `text`: at most so many rows, and few rows where texts are long."""
    lengths = frame["text"].str.len().fillna(0).to_numpy()
    at = 0
    while at < len(frame):
        end, total = at, 0
        while end < len(frame) and end - at < rows and (end == at or total + lengths[end] <= chars):
            total += lengths[end]
            end += 1
        yield frame.iloc[at:end]
        at = end
