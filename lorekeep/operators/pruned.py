"""Exact nearest neighbours over clustered vectors: the triangle inequality leaves out what can't be among a query's k.

Vectors lie in shards of one cluster each, with the greatest distance of a shard's vectors to the cluster's centroid. A query first searches
its nearest clusters, which gives it a k-th distance; after that only shards that could hold something nearer. Centroids come from a
bounded sample and only steer the work: with any centroids the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import SHARD_ROWS, TILE_ROWS, _rows, best_of_cell

#: Clusters, rows of the sample that they are fitted on, and rounds of the fit.
CLUSTERS, SAMPLE, ROUNDS = 64, 8192, 8
#: The cluster of vectors that have another length than the centroids or no direction; always searched.
REST = -1
#: Shards of a cluster that one task of the search has, about.
BRANCH_SHARDS = 64
#: More than what distances lose by floating point.
_SLACK = 1e-6
_BLOCK = "cluster int, radius double, n int, ids array<long>, matrix binary"


@dataclass
class Clusters:
    centroids: np.ndarray
    #: Vectors and greatest distance by cluster.
    sizes: dict[int, int]
    radii: dict[int, float]


@dataclass
class Clustered:
    shards: DataFrame
    clusters: Clusters


def fit(chunks: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the sample with the smallest hashes of their ids; vectors of the most frequent length among them."""
    rows = chunks.where("embedding IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("embedding").cast("array<double>").alias("v")).toArrow()
    found: dict[int, list[np.ndarray]] = {}
    for batch in rows.to_batches():
        for _, unit in _rows(batch.column(0)):
            if unit.shape[1]:
                found.setdefault(unit.shape[1], []).append(unit[(unit * unit).sum(1) > 0.5])
    if not found:
        return np.zeros((0, 0))
    x = np.concatenate(max(found.values(), key=lambda parts: sum(map(len, parts))))
    # spread starts: each the farthest from those before
    c, near = x[:1], np.full(len(x), np.inf)
    while len(c) < min(clusters, len(x)):
        near = np.minimum(near, ((x - c[-1]) ** 2).sum(1))
        c = np.vstack([c, x[np.argmax(near)]])
    for _ in range(rounds):
        own = np.argmin(_squares(x, c), 1)
        c = np.stack([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def clustered(chunks: DataFrame, centroids: np.ndarray, shard_rows: int = SHARD_ROWS) -> Clustered:
    """The vectors of `chunks` (id, embedding) in shards by nearest centroid; large clusters are dealt over many tasks."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _rows(batch.column(1)):
                cluster, far = np.full(len(at), REST), np.zeros(len(at))
                good = (unit * unit).sum(1) > 0.5
                if centroids.size and unit.shape[1] == centroids.shape[1] and good.any():
                    apart = _squares(unit[good], centroids)
                    cluster[good] = np.argmin(apart, 1)
                    far[good] = np.sqrt(apart.min(1)) + _SLACK
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([x.tobytes() for x in unit.astype("<f8")], pa.binary()), pa.array(cluster.astype(np.int32)), pa.array(far)], ["id", "unit", "cluster", "far"])

    rows = chunks.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>")).mapInArrow(assign, "id long, unit binary, cluster int, far double")
    facts = {r.cluster: r for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    salts = _of({c: -(-r.n // shard_rows) for c, r in facts.items()}, 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, far = batch.column("cluster").to_numpy(), batch.column("far").to_numpy()
            size = np.array([len(x.as_py()) for x in batch.column("unit")])
            for c, dim in sorted(set(zip(cluster.tolist(), size.tolist()))):
                own = np.flatnonzero((cluster == c) & (size == dim))
                for k in range(0, len(own), shard_rows):
                    part = pa.array(own[k : k + shard_rows])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([c], pa.int32()), pa.array([float(far[part].max())]), pa.array([len(part)], pa.int32()), pa.array([batch.column("id").take(part).to_pylist()], pa.list_(pa.int64())),
                        pa.array([b"".join(batch.column("unit").take(part).to_pylist())], pa.binary()),
                    ], ["cluster", "radius", "n", "ids", "matrix"])

    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), salts)).repartition("cluster", "salt").sortWithinPartitions("cluster", "salt").drop("salt")
    return Clustered(dealt.mapInArrow(pack, _BLOCK), Clusters(centroids, {c: r.n for c, r in facts.items()}, {c: r.far for c, r in facts.items()}))


def _of(values: dict[int, int], other: int) -> Column:
    """A value by cluster; there are as many as clusters."""
    if not values:
        return F.lit(other)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in values.items() for x in kv]), F.col("cluster")), F.lit(other))


def _wanted(unit: np.ndarray, clusters: Clusters, k: int, theta: np.ndarray | None) -> np.ndarray:
    """Which clusters (columns; the last is REST) each query searches: first those nearest that have k vectors, then all others that reach within theta."""
    c = clusters.centroids
    out = np.zeros((len(unit), len(c) + 1), bool)
    good = (unit * unit).sum(1) > 0.5
    if not c.size or unit.shape[1] != c.shape[1]:
        good[:] = False
    first = np.ones_like(out)
    if good.any():
        apart = np.sqrt(_squares(unit[good], c))
        order = np.argsort(apart, 1, kind="stable")
        sizes = np.array([clusters.sizes.get(j, 0) for j in range(len(c))])
        before = np.cumsum(sizes[order], 1) - sizes[order]
        near = np.zeros_like(apart, bool)
        np.put_along_axis(near, order, before < k, 1)
        first[good] = np.column_stack([near, np.ones(len(near), bool)])
        if theta is not None:
            reach = apart - np.array([clusters.radii.get(j, 0.0) for j in range(len(c))]) <= theta[good][:, None]
            out[good] = np.column_stack([reach & ~near & (sizes > 0), np.zeros(len(near), bool)])
    return first if theta is None else out


def _asked(queries: DataFrame, clusters: Clusters, k: int, second: bool) -> DataFrame:
    """(query_id, unit, theta, cluster) of `queries` (query_id, vector and, the second time, theta)."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _rows(batch.column(1)):
                theta = batch.column(2).to_numpy(zero_copy_only=False)[at]
                of, cluster = np.nonzero(_wanted(unit, clusters, k, theta if second else None))
                cluster = np.where(cluster == len(clusters.centroids), REST, cluster)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[of])), pa.array([unit[j].astype("<f8").tobytes() for j in of], pa.binary()), pa.array(theta[of]), pa.array(cluster.astype(np.int32))], ["query_id", "unit", "theta", "cluster"])

    return queries.select("query_id", F.col("vector").cast("array<double>"), "theta").mapInArrow(run, f"query_id {kind}, unit binary, theta double, cluster int")


def _cells(asked: DataFrame, index: Clustered, k: int, tile_rows: int) -> DataFrame:
    """(query_id, id, similarity): each shard's k best for each query that asks for its cluster, unless the shard is out of reach."""
    kind = asked.schema["query_id"].dataType.simpleString()
    branches = _of({c: max(1, n // (SHARD_ROWS * BRANCH_SHARDS)) for c, n in index.clusters.sizes.items()}, 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, size = batch.column("cluster").to_numpy(), np.array([len(x.as_py()) for x in batch.column("unit")])
            for c, dim in sorted(set(zip(cluster.tolist(), size.tolist()))):
                own = np.flatnonzero((cluster == c) & (size == dim))
                for at in range(0, len(own), tile_rows):
                    part = pa.array(own[at : at + tile_rows])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([c], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column("query_id").take(part)),
                        pa.array([b"".join(batch.column("unit").take(part).to_pylist())], pa.binary()), pa.array([batch.column("theta").take(part).to_numpy().astype("<f8").tobytes()], pa.binary()),
                    ], ["cluster", "q_ids", "q_matrix", "theta"])

    tiles = asked.sortWithinPartitions("cluster").select("cluster", "query_id", "unit", "theta").mapInArrow(pack, f"cluster int, q_ids array<{kind}>, q_matrix binary, theta binary")
    tiles = tiles.withColumn("branch", F.explode(F.sequence(F.lit(0), branches - 1)))
    shards = index.shards.withColumn("branch", F.pmod(F.xxhash64("ids"), branches).cast("int"))
    centroids = index.clusters.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(j)[row] for j, n in enumerate(batch.schema.names)}
                q_ids, ids, theta = cell["q_ids"].values, cell["ids"].values, np.frombuffer(cell["theta"].as_py(), "<f8")
                q = np.frombuffer(cell["q_matrix"].as_py(), "<f8").reshape(len(q_ids), -1)
                c = np.frombuffer(cell["matrix"].as_py(), "<f8").reshape(len(ids), -1)
                near = np.arange(len(q))
                if cell["cluster"].as_py() != REST and q.shape[1] == centroids.shape[1]:
                    near = np.flatnonzero(np.sqrt(_squares(q, centroids[[cell["cluster"].as_py()]]))[:, 0] - cell["radius"].as_py() <= theta)
                if len(near):
                    of, at, scores = best_of_cell(q[near], c, ids.to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(near[of])), ids.take(pa.array(at)), pa.array(scores)], ["query_id", "id", "similarity"])

    met = shards.join(tiles.hint("merge"), ["cluster", "branch"]).select("cluster", "radius", "ids", "matrix", "q_ids", "q_matrix", "theta")
    return met.mapInArrow(run, f"query_id {kind}, id long, similarity double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def pruned_search(index: Clustered, queries: DataFrame, k: int, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, similarity, rank) as `search.batch_vector_search` gives them, and (query_id, looked_at): the vectors in the clusters that each
    query searched, which among all of the index tells what was left out."""
    asked = queries.select("query_id", "vector", F.lit(float("inf")).alias("theta"))
    one = _asked(asked, index.clusters, k, False)
    first = _ranked(_cells(one, index, k, tile_rows), k)
    # the distance of unit vectors by their product; no k-th one yet: everything is in reach
    theta = first.where(F.col("rank") == k).select("query_id", (F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))) + _SLACK).alias("theta"))
    two = _asked(queries.select("query_id", "vector").join(theta, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(float("inf")))), index.clusters, k, True)
    hits = _ranked(first.drop("rank").unionByName(_cells(two, index, k, tile_rows)), k)
    looked = one.select("query_id", "cluster").unionByName(two.select("query_id", "cluster")).groupBy("query_id").agg(F.sum(_of(index.clusters.sizes, 0)).cast("long").alias("looked_at"))
    return hits, looked
