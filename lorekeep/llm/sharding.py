"""Sharding by a hierarchical weighted hash tree (operator 3).

Every document descends region, rack and shard. At each level every child draws -ln(u) / weight, where u is a
uniform hash of (key, level, child), and the smallest draw wins. A child's draw depends on nothing but the key, its
name and its own weight, so a change of weight moves rows only into or out of the subtrees whose weights change.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, table, text_or_empty


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> list[Leaf]:
    """`shards` equal leaves, filled rack by rack and region by region."""
    return [Leaf(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(shards)]


def _draw(key: list[Column], level: str, choices: dict[int, float]) -> Column:
    """The child with the smallest weighted draw; the smaller id on a tie."""
    bits = 2**52

    def cost(child: int, weight: float) -> Column:
        u = (F.pmod(F.xxhash64(*key, F.lit(level), F.lit(child)), F.lit(bits)) + F.lit(0.5)) / F.lit(float(bits))
        return -F.log(u) / F.lit(float(weight))

    if len(choices) == 1:
        return F.lit(next(iter(choices)))
    return F.array_min(F.array(*[F.struct(cost(c, w).alias("cost"), F.lit(c).alias("child")) for c, w in sorted(choices.items())]))["child"]


def _weights(leaves: Iterable[Leaf], name: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            out[getattr(leaf, name)] = out.get(getattr(leaf, name), 0.0) + leaf.weight
    return out


def shard_of(key: list[Column], leaves: list[Leaf]) -> Column:
    """The shard of a key, by draws from the top of the tree to the bottom. Leaves of weight 0 take nothing."""
    if not _weights(leaves, "shard"):
        raise ValueError("no shard has weight")

    def below(level: int, at: list[Leaf]) -> Column:
        names = ("region", "rack", "shard")
        choices = _weights(at, names[level])
        won = _draw(key, names[level], choices)
        if level == 2:
            return won
        out = None
        for child in sorted(choices):
            sub = below(level + 1, [x for x in at if getattr(x, names[level]) == child])
            out = F.when(won == child, sub) if out is None else out.when(won == child, sub)
        return out

    return below(0, leaves).cast("int")


def with_slots(rows: DataFrame, by: str = "shard", order: str = "doc_id") -> DataFrame:
    """Numbers the rows of each value of `by` from 0 without gaps.

    The rows are checkpointed, so that partition numbers hold when a task is run again. A row's slot is the count of its
    shard's rows in earlier partitions plus its place among its own partition's; no task sees more of a shard than one
    partition holds, however many rows share a key. Equal rows take different slots.
    """
    fixed = checkpointed(rows).withColumn("_part", F.spark_partition_id())
    before = (
        fixed.groupBy("_part", by).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
        .select("_part", by, F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    placed = fixed.withColumn("_at", F.row_number().over(W.partitionBy("_part", by).orderBy(order)) - 1)
    return placed.join(before, ["_part", by]).withColumn("slot", (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_before", "_at")


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the tree decide. A null text counts as empty: size 1, crc32 0. A null doc_id is a key
    like any other. Repeated rows share a shard and take a slot each. An empty table gives no rows; other columns are
    not read.
    """
    key = [F.col("doc_id")]
    text = text_or_empty().cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, leaves).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), topology(8), topology(9))


QUERIES = {"op3_hash_tree_shards": op3_hash_tree_shards}
ORACLE_SQL: dict[str, str] = {}
