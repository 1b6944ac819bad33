"""Mixing sources to target weights [native]: fixed-length token blocks, multinomial draws by output shard, pseudorandom index permutations.

Each source's words are packed into blocks of a fixed length. A source needs a number of block slots to reach its target; multinomial draws say how many of them each output shard gets; a slot finds its block through the permutation of its source and epoch; slots and blocks are joined by that index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import WORD_PATTERN, hidden, running_sum, shown, stash, text_of

BLOCK, OUT_SHARDS = 512, 64
#: Rounds of the permutation: two neighbours stay side by side with a chance of about 2^-ROUNDS.
ROUNDS = 16
#: Slots that are laid out from one row at most, and documents of one source that are numbered in one window, on average.
CHUNK, PER_BUCKET = 1 << 16, 100_000


def token_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """row (a number of its own for each row), doc_id, source, size (the number of runs of other than ASCII blanks; null text: 0), tie and spread (28 bits of md5 of the id, or of the text where the id is null), and the columns `keep`. Written once; all else works on this slim table."""
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), text_of())), 1, 7), 16, 10).cast("long")
    size = F.regexp_count(text_of(), F.lit(WORD_PATTERN)).cast("long")
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text_of()).alias("tie"), spread.alias("spread"), *keep)
    return stash(slim.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def source_targets(counts: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """rank, source, source_size, target: `share` of all sizes split by repeating weights over the sources in code-point order (null last).

    No target is above `most` times its source's size; the excess goes to the others by weight, again and again, until none is above: two sums over the sources a round, so that any number of sources will do. Ranks come from a range partitioning and its counts."""
    listed = counts.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = stash(listed.repartitionByRange(F.col("source").asc_nulls_last()).withColumns({"_part": F.spark_partition_id(), "_all": F.lit(0), "_one": F.lit(1)}), "mix-sources")
    ranked = running_sum(ranged, "_all", "_part", [F.col("source").asc_nulls_last()], "_one", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = stash(ranked.select("rank", "source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap")), "mix-weights")
    total, free = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    held, level = 0.0, 0.0
    while free:
        level = (total - held) / free
        capped = F.col("cap") / F.col("weight") <= F.lit(level)
        held, left = s.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if left == free:
            break
        free = left
    target = F.when(F.col("cap") / F.col("weight") <= F.lit(level), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return s.select("rank", "source", "source_size", target.alias("target"))


def _number(word: Column) -> Column:
    """60 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long")


def round_keys(seed: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: _number(F.concat_ws(":", F.lit("round"), seed, r.cast("string"))))


def permuted(index: Column, n: Column, seed: Column, keys: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. n-1, any n ("swap or not"): a round pairs x with key - x mod n and swaps the pair if a hashed bit of the larger says so. Each round is its own inverse. `keys` is a column with round_keys(seed)."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.get(keys, r) - x, n)
        swap = F.md5(F.concat_ws(":", seed, r.cast("string"), F.greatest(x, partner).cast("string"))) < "8"
        return F.when(swap, partner).otherwise(x)

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, index.cast("long"), step)


def _seed(epoch: Column) -> Column:
    """The key of a source's permutation in an epoch."""
    return F.concat_ws(":", F.md5(F.coalesce("source", F.lit(""))), epoch.cast("string"))


def source_plans(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """`targets` with blocks, tail (words of the last block), slots and last (words of the last slot; the others take their whole block).

    A source takes its blocks in the order of the epoch's permutation, epoch after epoch, until floor(target) words are taken."""
    p = targets.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    p = p.withColumn("tail", F.col("source_size") - (F.col("blocks") - 1) * F.lit(block))
    p = p.withColumn("whole", F.floor(F.floor("target") / F.greatest(F.col("source_size"), F.lit(1))))
    p = p.withColumn("left", F.floor("target") - F.col("whole") * F.col("source_size")).withColumn("seed", _seed(F.col("whole")))
    p = stash(p.withColumn("keys", round_keys(F.col("seed"))), "mix-plans")
    p = p.withColumn("tail_at", permuted(F.col("blocks") - 1, F.greatest(F.col("blocks"), F.lit(1)), F.col("seed"), F.col("keys"), inverse=True))
    words = lambda m: m * F.lit(block) - F.when(F.col("tail_at") < m, F.lit(block) - F.col("tail")).otherwise(0)
    some = F.ceil(F.col("left") / F.lit(block))
    p = p.withColumn("_some", F.when(words(some) >= F.col("left"), some).otherwise(some + 1))
    cut = F.when(F.col("_some") > 0, F.col("left") - words(F.col("_some") - 1))
    return stash(p.select("rank", "source", "source_size", "target", "blocks", "tail", (F.col("whole") * F.col("blocks") + F.col("_some")).alias("slots"), cut.alias("last")), "mix-plans")


def _laid_out(rows: DataFrame, count: str, out: str) -> DataFrame:
    """Each row `count` times, numbered 0 .. count-1 in `out`, no more than CHUNK from one row at a time."""
    chunks = rows.where(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / F.lit(CHUNK))))).repartition("rank", "_chunk")
    first = F.col("_chunk") * F.lit(CHUNK)
    return chunks.withColumn(out, F.explode(F.sequence(first, F.least(first + F.lit(CHUNK), F.col(count)) - 1))).drop("_chunk")


def shard_counts(plans: DataFrame, out_shards: int = OUT_SHARDS) -> DataFrame:
    """The multinomial draws: rank, out_shard, n, begin. Each of a source's slots is one trial; n trials fell on the shard, which therefore gets the slots begin .. begin+n-1 of the source."""
    trial = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("draw"), F.md5(F.coalesce("source", F.lit(""))), F.col("trial").cast("string"))), 1, 7), 16, 10).cast("long")
    drawn = _laid_out(plans.select("rank", "source", "slots"), "slots", "trial").groupBy("rank", (trial % out_shards).cast("int").alias("out_shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("out_shard").rowsBetween(Window.unboundedPreceding, -1)
    return stash(drawn.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))), "mix-draws")


def block_slots(plans: DataFrame, draws: DataFrame, block: int = BLOCK) -> DataFrame:
    """rank, slot, out_shard, epoch, block (the index that the permutation gives), take (words of the block that the slot holds)."""
    owned = _laid_out(draws, "n", "_i").join(plans, "rank").withColumn("slot", F.col("begin") + F.col("_i"))
    keyed = owned.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
    keys = stash(keyed.select("rank", "source", "epoch").distinct().withColumn("seed", _seed(F.col("epoch"))).withColumn("keys", round_keys(F.col("seed"))).drop("source"), "mix-keys")
    rows = keyed.join(keys, ["rank", "epoch"]).withColumn("block", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("seed"), F.col("keys")))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(block))
    take = F.when((F.col("slot") == F.col("slots") - 1) & F.col("last").isNotNull(), F.col("last")).otherwise(length)
    return rows.select("rank", "slot", "out_shard", "epoch", "block", take.alias("take"))


def mix_blocks(counts: DataFrame, targets: DataFrame, block: int = BLOCK, out_shards: int = OUT_SHARDS) -> DataFrame:
    """The mix: a row per piece of a document in a slot: the columns of counts, source_size, target, out_shard, epoch, slot, first, n (words first .. first+n-1 of the document; n can be 0). A document without a slot has one row with n = 0 and null slot.

    Documents of a source are laid end to end in an order by hash and cut into blocks."""
    plans = source_plans(targets, block)
    slots = block_slots(plans, shard_counts(plans, out_shards), block)
    buckets = max(256, -(-counts.count() // PER_BUCKET))
    sized = counts.withColumn("_bucket", F.col("spread") % buckets)
    ranks = plans.select("rank", F.col("source").alias("_source"), "source_size", "target")
    rows = sized.join(ranks, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = running_sum(rows, "rank", "_bucket", ["doc_id", "size", "tie"], "size", "_start").drop("_bucket")
    last = F.col("_start") + F.col("size") - 1
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("_start") / F.lit(block)), F.floor(last / F.lit(block)))).otherwise(F.array(F.lit(-1).cast("long")))
    pieces = laid.withColumn("block", F.explode(spans))
    lo = F.greatest(F.col("block") * F.lit(block), F.col("_start"))
    hi = F.least((F.col("block") + 1) * F.lit(block), F.col("_start") + F.col("size"))
    pieces = pieces.withColumns({"_lo": lo - F.col("block") * F.lit(block), "_hi": hi - F.col("block") * F.lit(block), "first": lo - F.col("_start")})
    joined = pieces.join(slots, ["rank", "block"], "left")
    n = F.greatest(F.least(F.col("_hi"), F.coalesce("take", F.lit(0))) - F.col("_lo"), F.lit(0))
    return joined.withColumn("n", F.when(F.col("block") >= 0, n).otherwise(0).cast("long")).select(*counts.columns, "source_size", "target", "out_shard", "epoch", "slot", "first", "n")


def _mix(docs: DataFrame, block: int, out_shards: int, keep: tuple[str, ...] = ()) -> DataFrame:
    counts = token_counts(docs, keep)
    return mix_blocks(counts, stash(source_targets(counts), "mix-targets"), block, out_shards)


def taken_words(docs: DataFrame, block: int = BLOCK, out_shards: int = OUT_SHARDS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (the words of it that the mix holds, repeats counted) and shards (shard:words by output shard, comma-joined).

    Rows that repeat a doc_id are documents of their own; a null doc_id or source is a value; an empty text takes no word."""
    who = ["row", "doc_id", "source", "size", "source_size", "target"]
    by_shard = _mix(docs, block, out_shards).groupBy(*who, "out_shard").agg(F.sum("n").alias("words"))
    held = F.filter(F.array_sort(F.collect_list(F.when(F.col("words") > 0, F.struct("out_shard", "words")))), lambda s: s.isNotNull())
    rows = by_shard.groupBy(*who).agg(F.sum("words").cast("long").alias("taken"), held.alias("_held"))
    listed = F.array_join(F.transform("_held", lambda s: F.concat_ws(":", s["out_shard"].cast("string"), s["words"].cast("string"))), ",")
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", listed.alias("shards"))


def mixed_texts(docs: DataFrame, block: int = BLOCK, out_shards: int = OUT_SHARDS, key: str | None = None) -> DataFrame:
    """The mix as documents: a row per document, epoch and output shard with the words taken there, in order; columns as `docs`, whatever their names are. `key` names a column of docs that is equal for equal rows only (without it doc_id must tell the rows apart). Texts without words are never taken.

    A document that is taken whole into one shard keeps its text as it is; else the pieces are cut at word starts."""
    docs, names = hidden(docs)
    own = names.get(key, key) or "doc_id"
    mix = _mix(docs.withColumn("__key", F.col(own).cast("string")), block, out_shards, ("__key",)).where(F.col("n") > 0)
    pieces = mix.groupBy("__key", "row", "size", "epoch", "out_shard").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("pieces"), F.sum("n").alias("n"))
    parts = pieces.groupBy(F.col("__key").alias("__key2"), "row", F.col("size").alias("__size")).agg(F.array_sort(F.collect_list(F.struct("epoch", "out_shard", "n", "pieces"))).alias("__parts")).drop("row")
    texts = docs.withColumn("__key", F.col(own).cast("string")).dropDuplicates(["__key"])
    joined = texts.join(stash(parts, "mix-parts").hint("merge"), F.col("__key").eqNullSafe(F.col("__key2")))
    words = F.split(text_of(), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text_of().rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = lambda w, part: F.array_join(F.flatten(F.transform(part["pieces"], lambda p: F.slice(w, (p["first"] + 1 + lead).cast("int"), p["n"].cast("int")))), "")
    # the one-element array binds the words, so that a text is split once and not once a piece
    every = F.flatten(F.transform(F.array(words), lambda w: F.transform("__parts", lambda part: F.when(part["n"] == F.col("__size"), F.col("text")).otherwise(cut(w, part)))))
    out = joined.withColumn("__texts", every).withColumn("text", F.explode("__texts"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns).transform(shown, names)


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("source")


OP8_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 7))::BIGINT % greatest(256, ((SELECT count(*) FROM documents) + 99999) // 100000) AS bucket FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rank % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, rank, source_size, ceil(source_size / 512.0)::BIGINT AS blocks,
    CASE WHEN ratio <= level THEN cap ELSE max(CASE WHEN ratio > level THEN level END) OVER () * weight END AS target FROM l
), tries AS (
  SELECT *, unnest(range(floor(target)::BIGINT // greatest(source_size, 1) + 1)) AS epoch FROM t WHERE source_size > 0
), walk AS (
  SELECT rank, epoch, j AS slot, j AS x, 0 AS r, blocks, md5(coalesce(source, '')) || ':' || epoch AS seed FROM (SELECT *, unnest(range(blocks)) AS j FROM tries)
  UNION ALL
  SELECT rank, epoch, slot, CASE WHEN md5(seed || ':' || r || ':' || greatest(x, partner)) < '8' THEN partner ELSE x END, r + 1, blocks, seed
  FROM (SELECT *, ((('0x' || substr(md5('round:' || seed || ':' || r), 1, 15))::BIGINT - x) % blocks + blocks) % blocks AS partner FROM walk WHERE r < 16)
), slots AS (
  SELECT k.rank, k.epoch, k.slot, k.x AS block, t.source, t.target, t.source_size,
    sum(CASE WHEN k.x = t.blocks - 1 THEN t.source_size - (t.blocks - 1) * 512 ELSE 512 END) OVER (PARTITION BY k.rank ORDER BY k.epoch, k.slot) AS upto,
    CASE WHEN k.x = t.blocks - 1 THEN t.source_size - (t.blocks - 1) * 512 ELSE 512 END AS length,
    row_number() OVER (PARTITION BY k.rank ORDER BY k.epoch, k.slot) - 1 AS place
  FROM walk k JOIN t ON k.rank = t.rank WHERE k.r = 16
), used AS (
  SELECT *, least(length, length - upto + floor(target))::BIGINT AS take FROM slots WHERE upto - length < floor(target)
), draws AS (
  SELECT rank, ('0x' || substr(md5('draw:' || md5(coalesce(source, '')) || ':' || place), 1, 7))::BIGINT % 64 AS out_shard, count(*) AS n FROM used GROUP BY ALL
), owned AS (
  SELECT *, sum(n) OVER (PARTITION BY rank ORDER BY out_shard) AS stop FROM draws
), dealt AS (
  SELECT u.rank, u.block, u.take, o.out_shard FROM used u JOIN owned o ON u.rank = o.rank AND u.place < o.stop AND u.place >= o.stop - o.n
), laid AS (
  SELECT z.*, t.rank, t.source_size, t.target,
    (coalesce(sum(size) OVER (PARTITION BY t.rank ORDER BY bucket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM sizes z JOIN t ON z.source IS NOT DISTINCT FROM t.source
), pieces AS (
  SELECT *, unnest(CASE WHEN size > 0 THEN range((start // 512)::BIGINT, ((start + size - 1) // 512)::BIGINT + 1) ELSE [-1::BIGINT] END) AS block FROM laid
), taken AS (
  SELECT p.doc_id, p.size, p.source_size, p.target, d.out_shard,
    greatest(least(p.start + p.size - p.block * 512, coalesce(d.take, 0)) - greatest(p.start - p.block * 512, 0), 0) AS n
  FROM pieces p LEFT JOIN dealt d ON p.rank = d.rank AND p.block = d.block
), words AS (
  SELECT doc_id, size, source_size, target, out_shard, sum(n)::BIGINT AS n FROM taken GROUP BY ALL
)
SELECT doc_id, size, source_size, target, sum(n)::BIGINT AS taken, coalesce(string_agg(out_shard || ':' || n, ',' ORDER BY out_shard) FILTER (n > 0), '') AS shards
FROM words GROUP BY doc_id, size, source_size, target
"""
