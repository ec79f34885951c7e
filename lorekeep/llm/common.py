"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this package.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset, only a local session has one, in
    its warehouse; a cluster's executors wouldn't see a folder of the driver's own, so that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of `df`, cut from their lineage and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: list[list[str]] = []
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, tables that `written` makes are deleted at its end; those to `keep` outlive it, up to the scratch around it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for name in _SCRATCH.pop():
            _deleted(spark, name)


def _deleted(spark: SparkSession, name: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, keep: bool = False, compression: str = "snappy") -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again.

    Meanwhile the session sends Arrow batches of 8 MB at most, which bounds the memory of executors whatever is set else."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(path)
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, str(8 << 20))
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_BATCH_BYTES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


@contextmanager
def bucketed(df: DataFrame, key: str, order: str, name: str) -> Iterator[DataFrame]:
    """`df` as a table in the shared folder, bucketed by `key` and in `order` within it, for passes that group or join by the
    key without a shuffle of its rows. It is deleted at the end."""
    spark, n = df.sparkSession, partitions(df.sparkSession)
    name, path = f"{name}_{uuid.uuid4().hex}", shared_path(spark, name)
    try:
        # one file for each bucket
        rows = df.repartition(n, key).sortWithinPartitions(key, order)
        rows.write.bucketBy(n, key).sortBy(key, order).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _deleted(spark, path)


def discard(rows: DataFrame) -> None:
    """Deletes a table that `written` gave, before its scratch ends."""
    for paths in _SCRATCH:
        if rows._written_path in paths:
            paths.remove(rows._written_path)
    _deleted(rows.sparkSession, rows._written_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about `most_bytes`, which bounds what a worker makes of one, however long the texts are."""
    for batch in batches:
        rows = max(1, batch.num_rows * most_bytes // max(batch.nbytes, 1))
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker gives the memory that it has freed back to the system, as it lives on, idle or in other
    stages' tasks."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        # only glibc has it
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def in_arrow(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`rows` mapped by a function of small Arrow batches; what a task has freed is given back."""
    return rows.mapInArrow(lambda batches: released(function(small(batches))), schema)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def tokenizer_path(name: str) -> str:
    """A tokenizer file of the installed public collection; operators take any path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A node with more than this share of all edges is a hub; so there are fewer than twice its inverse.
HUB_SHARE = 1 / 1000
#: Edges that are one key in any case.
LEAST_HUB = 1000


def _by_node(edges: DataFrame, least: DataFrame, hubs: list[tuple[int, int]]) -> DataFrame:
    """`edges` (a, b) joined with `least` (a, m). A hub's edges are dealt over as many keys as it has such shares of the edges."""
    if not hubs:
        return edges.join(least, "a")
    known = F.broadcast(edges.sparkSession.createDataFrame(hubs, "a long, keys long"))
    dealt = edges.join(known, "a", "left").select("a", "b", F.when(F.col("keys").isNotNull(), F.pmod(F.xxhash64("b"), F.col("keys"))).otherwise(0).alias("key"))
    spread = least.join(known, "a", "left").select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("keys", F.lit(1)) - 1)).alias("key"))
    return dealt.join(spread, ["a", "key"]).drop("key")


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, comp: each node of `edges` (a, b: long) with the smallest node that links lead to.

    Alternates large-star and small-star steps, each an aggregation and a join on nodes, until every node has one edge to
    a root; every round is a written table. Counts and least neighbours are aggregated before the shuffle, and the edges of
    hubs are dealt over many keys. The driver holds the hubs alone, fewer than 2 / HUB_SHARE of them.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(most_rounds):
        both = now.select("a", "b", F.lit(1).alias("up")).union(now.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("up")))
        degrees = both.groupBy("a").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
        state = degrees.agg(F.bool_and((F.col("up") == 0) | (F.col("n") == 1)).alias("stars"), F.sum("up").alias("n")).first()
        if state.stars is None or state.stars:
            break
        both = both.drop("up")
        share = max(state.n * HUB_SHARE, LEAST_HUB)
        hubs = [(r.a, 1 + int(r.n / share)) for r in degrees.where(F.col("n") > share).collect()] if state.n > share else []
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _by_node(both, least, hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # each of these edges stems from one of its node's, so its hubs are among the known ones
        small = _by_node(large, large.groupBy("a").agg(F.min("b").alias("m")), hubs).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "components")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
