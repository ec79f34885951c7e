"""Exact top-k search by integer inner product (operator 2).

Candidates are packed into shards of a fixed number of vectors and queries into tiles. A grid cell, one shard and one
tile, is a matrix product; a tile keeps its k best per query over the shards of a branch that it meets one after the
other, and the lists of a query's branches are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, table

SHARD_ROWS = 512
TILE_ROWS = 2048
#: Below this the sums of a product of float64 matrices of integers are exact.
EXACT = 2.0**53


def quantised(embedding: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null where the vector is null, empty or holds a null or non-finite component."""
    x = F.col(embedding).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(good & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _narrow(matrix: np.ndarray) -> bytes:
    """One byte for the width of an integer, then the matrix in the narrowest integers that hold it."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    width = next(w for w in (2, 4, 8) if -(2 ** (8 * w - 1)) <= low and high < 2 ** (8 * w - 1))
    return bytes([width]) + matrix.astype(f"<i{width}").tobytes()


def _wide(packed: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def _packed(rows: DataFrame, block_rows: int, name: str) -> DataFrame:
    """Blocks of at most about `block_rows` rows with the same number of components: ids and a row-major matrix of longs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1)
            dims = np.diff(vectors.offsets.to_numpy())
            flat = vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py():]
            starts = np.concatenate([[0], np.cumsum(dims)[:-1]]) if len(dims) else dims
            out: dict[str, list] = {"dim": [], "ids": [], "matrix": []}
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), block_rows):
                    part = own[at : at + block_rows]
                    part = part[np.argsort(ids[part], kind="stable")]
                    out["dim"].append(int(dim))
                    out["ids"].append(ids[part].astype("<i8").tobytes())
                    out["matrix"].append(_narrow(flat[starts[part][:, None] + np.arange(dim)]))
            yield pa.RecordBatch.from_arrays([pa.array(out["dim"], pa.int32()), pa.array(out["ids"], pa.binary()), pa.array(out["matrix"], pa.binary())], ["dim", "ids", "matrix"])

    return rows.mapInArrow(pack, "dim int, ids binary, matrix binary").withColumnsRenamed({"ids": f"{name}_ids", "matrix": f"{name}_matrix"})


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray, k: int, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one shard for every query of a tile: positions of queries, candidate ids, scores. ids are ascending.

    Where each query has k rows already, `edge` is the score of its last; then all that reach it are given, which are few."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * shard.shape[1]
    scores = (queries.astype(np.float64) @ shard.T.astype(np.float64)).astype(np.int64) if bound < EXACT else queries @ shard.T
    own = query_ids[:, None] == ids[None, :]
    if edge is not None:
        rows, at = np.nonzero((scores >= edge[:, None]) & ~own)
        return rows, ids[at], scores[rows, at]
    n = scores.shape[1]
    take = min(k, n)
    if bound < 2.0**62 / max(n, 1):
        # the earlier, smaller id wins a tie; a query's own row sinks below all
        keyed = scores * n + (n - 1 - np.arange(n))
        keyed[own] = np.iinfo(np.int64).min
        at = np.argpartition(keyed, n - take, axis=1)[:, n - take :]
    else:
        at = np.stack([np.lexsort((np.arange(n), -s.astype(object), o))[:take] for s, o in zip(scores, own)]) if len(scores) else np.zeros((0, take), int)
    rows = np.repeat(np.arange(len(scores)), take)
    at = at.ravel()
    keep = ~own[rows, at]
    rows, at = rows[keep], at[keep]
    return rows, ids[at], scores[rows, at]


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best for each query of a tile, of the shards that it meets one after the other."""
    asked: bytes | None = None

    def best() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q[of]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    for batch in batches:
        names = batch.schema.names
        for row in range(batch.num_rows):
            cell = {name: batch.column(j)[row].as_py() for j, name in enumerate(names)}
            if cell["q_ids"] != asked:
                if asked is not None:
                    yield best()
                asked, q = cell["q_ids"], np.frombuffer(cell["q_ids"], "<i8")
                queries = _wide(cell["q_matrix"], len(q))
                of, ids, scores, edge = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), None
            c = np.frombuffer(cell["c_ids"], "<i8")
            found = _best(q, queries, c, _wide(cell["c_matrix"], len(c)), k, edge)
            of, ids, scores = (np.concatenate(x) for x in zip((of, ids, scores), found))
            # ~ turns the order round, as - would, without an overflow
            order = np.lexsort((ids, ~scores, of))
            of, ids, scores = of[order], ids[order], scores[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            full = scores[place == k - 1]
            edge = full if len(full) == len(q) else None
            of, ids, scores = of[place < k], ids[place < k], scores[place < k]
    if asked is not None:
        yield best()


def grid(tasks: int, rows: int, shards: int, asked: int, tiles: int, k: int) -> tuple[int, int]:
    """Branches of shards and of tiles, together about `tasks`, cut so that least is copied: shards go to each branch of tiles, and
    each branch of shards has the tiles and gives their lists."""
    across = max(1, min(tasks, tiles, round((tasks * asked * (1 + k / 4) / max(rows, 1)) ** 0.5)))
    return max(1, min(shards, tasks // across)), across


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, tile_rows: int = TILE_ROWS, branches: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `candidates` (vec_id, embedding) with the highest inner product.

    Ties go to the smaller vec_id. A row never answers the query with its own vec_id. Vectors that are null, empty or
    hold a null or non-finite component take no part, nor do rows with a null vec_id; vectors meet only vectors of their
    own length. A query id found on several rows counts once (its least vector); a repeated candidate row counts as often
    as it is there. Fewer candidates than k give fewer rows; empty tables give none.
    """
    spark = candidates.sparkSession
    clean = candidates.select("vec_id", quantised().alias("_v")).where(F.col("vec_id").isNotNull() & F.col("_v").isNotNull())
    asked = queries.select("vec_id", quantised().alias("_v")).where(F.col("vec_id").isNotNull() & F.col("_v").isNotNull())
    asked = asked.groupBy("vec_id").agg(F.min("_v").alias("_v"))
    # Each shard lies in one branch of shards and each tile in one of tiles, and each is copied to the other side's, so the work is
    # even whatever the vectors are. The copies aren't in Spark's estimates, by which it would send all of them through the driver;
    # a merge join holds one cell at a time.
    n, m = candidates.select("vec_id").count(), queries.select("vec_id").count()
    down, across = grid(branches or partitions(spark), n, -(-n // shard_rows), m, -(-m // tile_rows), k)

    def part(key: str, of: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(of)).cast("int")

    def each(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    shards = _packed(clean, shard_rows, "c").withColumn("_other", each(across)).withColumn("branch", part("c_ids", down) * across + F.col("_other")).drop("_other")
    tiles = _packed(asked, tile_rows, "q").withColumn("_other", each(down)).withColumn("branch", F.col("_other") * across + part("q_ids", across)).drop("_other")
    cells = tiles.hint("merge").join(shards, ["dim", "branch"]).select("q_ids", "q_matrix", "c_ids", "c_matrix")
    lists = cells.mapInArrow(lambda batches: _cells(batches, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_tiled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0)).select("query_id", "rank", "vec_id", "score")


QUERIES = {"op2_tiled_topk": op2_tiled_topk}
ORACLE_SQL = {
    "op2_tiled_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
}
