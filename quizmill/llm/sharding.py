"""Hierarchical weighted hash tree [native]: rows descend region, rack and shard by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import hash_bucket, hidden, running_sum, shown, text_of

#: Rows that are numbered in one window of a shard, on average, at most.
PER_BUCKET = 100_000


@dataclass(frozen=True)
class Node:
    """A shard (with its number) or an inner node; the weight of an inner node is the sum of its children's."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = ()


def node(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), None, tuple(children))


def tree(shards: int = 16, per_rack: int = 4, racks: int = 2) -> Node:
    """Regions of `racks` racks of `per_rack` shards, filled in order."""
    leaves = [Node(f"shard{i}", 1.0, i) for i in range(shards)]
    rack = [node(f"rack{i}", leaves[i * per_rack : (i + 1) * per_rack]) for i in range(-(-shards // per_rack))]
    return node("root", [node(f"region{i}", rack[i * racks : (i + 1) * racks]) for i in range(-(-len(rack) // racks))])


def grow(root: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region and rack of its own: no other subtree's weight changes, so rows move only into it."""
    number = 1 + max(n.shard for n in leaves(root))
    new = node(f"region-of-{number}", [node(f"rack-of-{number}", [Node(f"shard{number}", weight, number)])])
    return node(root.name, [*root.children, new])


def leaves(root: Node) -> list[Node]:
    return [root] if root.shard is not None else [x for c in root.children for x in leaves(c)]


def draw(key: Column, n: Node) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of the md5 of key and node: the least draw of siblings wins with a chance in proportion to its weight."""
    word = F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(n.name))), 1, 13)
    return -F.log((F.conv(word, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))) / F.lit(float(n.weight))


def descend(key: Column, root: Node) -> Column:
    """The shard number of a key: one weighted draw among the children at each level."""
    if root.shard is not None:
        return F.lit(root.shard)
    if len(root.children) == 1:
        return descend(key, root.children[0])
    won = F.array_min(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(root.children)]))["i"]
    out = F.when(won == 0, descend(key, root.children[0]))
    for i, c in enumerate(root.children[1:], 1):
        out = out.when(won == i, descend(key, c))
    return out


def grown_shard(key: Column, root: Node, shard: Column) -> Column:
    """The shard in grow(root), given the one in root: the old regions' draws are what they were, so only the new one's is compared with the least of them."""
    new = grow(root).children[-1]
    return F.when(draw(key, new) < F.array_min(F.array(*[draw(key, c) for c in root.children])), F.lit(leaves(new)[0].shard)).otherwise(shard)


def shard_rows(rows: DataFrame, key: str = "doc_id", root: Node | None = None, per_bucket: int = PER_BUCKET) -> DataFrame:
    """`rows` with shard (int), grown_shard (int: the shard with one more) and slot (long: gapless from 0 in each shard).

    Columns of these names are replaced, all others stay whatever their names are (`key` must not be a helper's). A null key is a key like any other; rows that repeat a key share its shard and get slots of their own. Slots come from two-level counts over buckets of all text and whole-number columns, so neither a shard nor the rows of a hot or null key are numbered in one task; only rows that are equal in all those columns stay together."""
    root = root or tree()
    rows, names = hidden(rows, key)
    order = [key, *[c for c, kind in rows.dtypes if c not in (key, "shard", "slot", "grown_shard") and kind in ("bigint", "int", "string")]]
    buckets = max(256, -(-rows.count() // per_bucket))
    bucket = hash_bucket(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in order]), buckets)
    placed = rows.withColumns({"shard": descend(F.col(key), root).cast("int"), "__bucket": bucket, "__one": F.lit(1).cast("long")})
    placed = placed.withColumn("grown_shard", grown_shard(F.col(key), root, F.col("shard")).cast("int"))
    return shown(running_sum(placed.drop("slot"), "shard", "__bucket", order, "__one", "slot").drop("__bucket", "__one"), names)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1) and text_crc32 (of the UTF-8 bytes; null: as empty)."""
    return docs.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))


def op7_hash_tree_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_rows(sizes(docs)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _nodes(root: Node) -> list[tuple[str, Node]]:
    """(parent's name, node) of all nodes below root."""
    return [x for c in root.children for x in [(root.name, c), *_nodes(c)]]


def _sql_nodes(root: Node) -> str:
    return ", ".join(f"('{parent}', '{n.name}', {n.weight}::DOUBLE, {'NULL' if n.shard is None else n.shard}::INT)" for parent, n in _nodes(root))


def _sql_descent(name: str, root: Node) -> str:
    """A winner for each document and inner node, and the way down three levels of them."""
    return f"""
{name}_nodes(parent, child, weight, shard) AS (VALUES {_sql_nodes(root)}),
{name}_won AS (
  SELECT k, parent, arg_min(child, -ln((('0x' || substr(md5(k || ':' || child), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight) AS child
  FROM (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS k FROM documents) CROSS JOIN {name}_nodes GROUP BY k, parent
), {name} AS (
  SELECT a.k, n.shard FROM {name}_won a JOIN {name}_won b ON a.k = b.k AND b.parent = a.child JOIN {name}_won c ON a.k = c.k AND c.parent = b.child JOIN {name}_nodes n ON n.child = c.child WHERE a.parent = 'root'
)"""


OP7_SQL = f"""
WITH {_sql_descent("now", tree())}, {_sql_descent("grown", grow(tree()))}, steps AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), raw AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM raw, steps
), placed AS (
  SELECT s.*, now.shard, grown.shard AS grown_shard, ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, size::VARCHAR, text_crc32::VARCHAR)), 1, 7))::BIGINT % greatest(256, ((SELECT count(*) FROM documents) + {PER_BUCKET - 1}) // {PER_BUCKET}) AS bucket
  FROM sized s JOIN now ON s.k = now.k JOIN grown ON s.k = grown.k
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM placed
"""
