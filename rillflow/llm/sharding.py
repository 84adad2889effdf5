"""Sharding by a hierarchical weighted hash tree.

Shards stand in racks and racks in regions. Every shard draws -ln(u) / weight for a document, u in (0, 1] a hash of the
document's key and the shard's number; a rack draws the least of its shards' draws, and a region the least of its racks'.
A document descends from the root to the region, the rack and the shard of the least draw. The least of some exponential
draws is one at the rate of their sum, so a subtree of weight w gets a share of w at every level, and it needs no draw of
its own: when the weight of a shard grows, or a shard is added anywhere in the tree, only the draws of the nodes above
it change, they only fall, and what falls there descends to that shard. So documents move into a changed subtree
alone, and for every number of shards one more takes documents only into itself. A draw of a shard costs half a digest, so a row costs as many as there are shards.

Only the key and the number of shards decide the shard (law ``key``). Slots number a shard's documents from 0 without
gaps: a shard is cut into blocks by another hash of the row, blocks are numbered by themselves, and the counts of the
blocks before are added, so no task holds a shard.

Defined results: a null key draws as the text ``null``; a null text has size 1 and the CRC of no bytes, 0. Equal rows
share a shard and a block, and get slots of their own, in any order. An empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.common import checkpointed

#: Digits of the digest that make a draw: 13 hexadecimal ones, 52 bits, exact in a double.
DIGITS, SPAN = 13, 16.0**13
#: Rows that a block of slots has, about.
BLOCK_ROWS = 200_000


def topology(shards: int, weights: list[float] | None = None, racks_in_region: int = 2, shards_in_rack: int = 4) -> list[list[list[tuple[int, float]]]]:
    """Regions of racks of (shard, weight), filled in order of the shard."""
    flat = [(k, float(weights[k]) if weights else 1.0) for k in range(shards)]
    racks = [flat[k : k + shards_in_rack] for k in range(0, shards, shards_in_rack)]
    return [racks[k : k + racks_in_region] for k in range(0, len(racks), racks_in_region)]


def draws(key: Column, weights: list[float]) -> list[Column]:
    """One exponential draw for each shard, at the rate of its weight; two shards share a digest."""
    digests = [F.md5(F.concat(key, F.lit(f"/{k}")).cast("binary")) for k in range(-(-len(weights) // 2))]
    u = [(F.conv(F.substring(digests[k // 2], 1 + DIGITS * (k % 2), DIGITS), 16, 10).cast("double") + 1.0) / F.lit(SPAN) for k in range(len(weights))]
    return [-F.ln(x) / F.lit(float(w)) if w > 0 else F.lit(float("inf")) for x, w in zip(u, weights, strict=True)]


def place(drawn: Column, tree: list) -> Column:
    """The shard at which a descent along the least draws ends. drawn: the array of all shards' draws."""

    def winner(node) -> Column:
        if isinstance(node, tuple):
            return F.struct(F.get(drawn, F.lit(node[0])).alias("draw"), F.lit(node[0]).alias("shard"))
        return F.array_min(F.array(*map(winner, node)))

    return winner(tree)["shard"].cast("int")


def sharded(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document. grown_weight: of the shard that is added."""
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards or not any(w > 0 for w in weights):
        raise ValueError("give every shard a weight, and one of them more than none")
    weights.append(grown_weight)
    base = docs.select(F.col(f"`{key}`").alias("doc_id"), name.alias("_name"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = base.withColumn("_draws", F.array(*draws(F.col("_name"), weights)))
    placed = placed.withColumn("shard", place(F.col("_draws"), topology(shards, weights))).withColumn("grown_shard", place(F.col("_draws"), topology(shards + 1, weights)))
    placed = checkpointed(placed.drop("_name", "_draws"))
    rows = placed.count()
    blocks = max(1, math.ceil(rows / shards / BLOCK_ROWS))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int") if blocks > 1 else F.lit(0))
    counts = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each shard and block
    before = counts.select(F.col("shard").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("_own", own).join(before, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b"))).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_own") + F.col("_before")).cast("long").alias("slot"), "grown_shard")


SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS name, encode(coalesce(text, '')) AS body FROM documents
), sized AS (
  SELECT r, doc_id, name, CAST(octet_length(body) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(body), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc
), draws AS (
  SELECT r, CAST(k AS INTEGER) AS k, -ln((CAST('0x' || substr(md5(name || '/' || (k // 2)), CASE WHEN k % 2 = 0 THEN 1 ELSE 14 END, 13) AS BIGINT) + 1.0::DOUBLE) / 4503599627370496.0::DOUBLE) AS draw FROM sized, range(17) t(k)
), placed AS (
  SELECT r, arg_min(k, draw) FILTER (k < 16) AS shard, arg_min(k, draw) AS grown_shard FROM draws GROUP BY r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM sized JOIN placed USING (r)
"""
