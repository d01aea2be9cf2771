"""Sharding by weighted rendezvous hashing (native: DataFrame expressions only).

Every shard scores every key; the key goes to the shard with the highest score. A further shard only takes keys that it now wins,
so growing from n to n + 1 shards moves about 1 / (n + 1) of the rows, all into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heapstone.llm.common import hash60, pick, running_before, slices_for


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 to len(weights) - 1) with the highest score -weight / ln(u), u uniform from key and shard. Ties: the lower shard. A null key is a key of its own."""
    def score(shard: int, weight: float) -> Column:
        u = (hash60(key, F.lit(f"shard{shard}")) + F.lit(0.5)) / F.lit(float(1 << 60))
        return -F.lit(float(weight)) / F.log(u)

    scores = F.array(*(F.struct(score(s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)))
    return (-F.array_max(scores)["shard"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """``df`` with its shard; a projection, no shuffle. All columns stay, but one already called ``out`` is replaced."""
    return df.withColumn(out, rendezvous(F.col(f"`{key}`"), weights))


def shard_documents(docs: DataFrame, shards: int = 16, weights: list[float] | None = None) -> DataFrame:
    """Digest of all documents by the ``key`` law: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null text has size 1 and the CRC of no bytes; a null doc_id is one key. Equal rows (same id, size and CRC) take slots next to each other.
    A slot is the rank in its shard by hash of the key (of CRC and size for rows without one), then doc_id, size and CRC. The shard is cut into slices of the hash range, each numbered
    by itself; equal rows are counted before the shuffle, so no id and no shard has to fit one task. An empty table gives no rows.
    """
    weights = weights or [1.0] * shards
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, doc_id="long", text="string").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    placed = assign_shards(counted, "doc_id", weights).withColumn("grown_shard", rendezvous(F.col("doc_id"), [*weights, sum(weights) / len(weights)])).withColumn("_h", F.when(F.col("doc_id").isNotNull(), hash60(F.col("doc_id"))).otherwise(hash60(F.col("text_crc32"), F.col("size"))))
    cuts = slices_for(docs.count())
    order = ["_h", F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    slots = running_before(placed, ["shard"], order, "_n", "_first", F.shiftright("_h", 60 - cuts.bit_length() + 1))
    each = slots.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_k")).alias("slot"), "grown_shard")
