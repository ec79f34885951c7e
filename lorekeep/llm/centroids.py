"""Centroid clustering of integer vectors with Hamerly's bounds (operator 11).

Each vector keeps one upper bound of its distance to its centroid and one lower bound of its distance to the second nearest.
After centroids have moved, the bounds are loosened by how far; a vector whose upper bound still lies below the lower one, or
below half its centroid's distance to the next, keeps its centroid unseen. Else its own distance is taken exactly, and only where
that doesn't settle it, all distances are. Distances are sums of integers, so assignments and centroids are exact; bounds are
floats, rounded outwards.

Vectors and bounds lie in blocks, a table in the shared folder that each round writes anew without a shuffle. A task also gives
the change of each centroid's sum and count by the vectors that left or joined it, so no vector is summed twice.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_arrow, scratch, small, table, written

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK_ROWS = 1024
#: Up to this, float64 products and sums of 64 components are exact integers; larger ones are taken as Python's integers.
NARROW = 1 << 22
#: Bounds are rounded outwards by this share, many times what their arithmetic loses.
OUTWARDS = 1e-12
MOST_LONG = 2**63 - 1
BLOCK = "ids array<long>, matrix binary, own binary, upper binary, lower binary, cluster int, part int, limb int, value long"
_NAMES = [x.split()[0] for x in BLOCK.split(", ")]
_LIMB = 1 << 60


@dataclass
class Model:
    centroids: list[list[int]]
    #: For each assignment: vectors, those that moved, those whose own distance was taken, those that were fully scanned.
    rounds: list[dict[str, int]] = field(default_factory=list)

    def names(self) -> list[str]:
        """Lowercase hex sha256 of each centroid's components as decimal integers joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), without overflow."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def _packed(x: np.ndarray, scale: int) -> bytes:
    """A byte for the width, then the vectors as the narrowest integers that hold floor(scale * x), or as they are if none does."""
    with np.errstate(over="ignore"):
        n = np.floor(x * scale)
    most = float(np.abs(n).max(initial=0))
    if most > NARROW:
        return b"\x08" + x.astype("<f8").tobytes()
    width = 2 if most < 1 << 15 else 4
    return bytes([width]) + n.astype(f"<i{width}").tobytes()


def _unpacked(packed: bytes, rows: int, scale: int) -> np.ndarray:
    if packed[0] == 8:
        x = np.frombuffer(packed, "<f8", offset=1)
        return np.array([_whole(v, scale) for v in x.tolist()], object).reshape(rows, -1)
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def _narrow(rows: np.ndarray, centroids: list[list[int]]) -> bool:
    return rows.dtype != object and all(abs(v) <= NARROW for c in centroids for v in c)


def distances(rows: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact."""
    if _narrow(rows, centroids):
        x, c = rows.astype(float), np.array(centroids, float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    x, c = rows.astype(object), np.array(centroids, object)
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


def own_distances(rows: np.ndarray, centroids: list[list[int]], own: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its own centroid, exact."""
    apart = rows - (np.array(centroids, np.int64) if _narrow(rows, centroids) else np.array(centroids, object))[own]
    return (apart * apart).sum(1)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots as floats, rounded outwards."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(float)) * (1 + OUTWARDS if up else 1 - OUTWARDS)
    out = np.empty(len(squares))
    for k, v in enumerate(squares.tolist()):
        root = math.isqrt(v) + up
        out[k] = (root * (1 + OUTWARDS) if up else max(0.0, root * (1 - OUTWARDS))) if root < 1 << 1000 else math.inf if up else 2.0**1000
    return out


def _apart(one: list[int], two: list[int]) -> np.ndarray:
    return np.array([sum((x - y) ** 2 for x, y in zip(one, two))], object)


@dataclass
class Move:
    """What tasks know of a round: the centroids, how far they moved at most, and half their distance to the next at least."""

    centroids: list[list[int]]
    drift: np.ndarray
    half: np.ndarray

    @classmethod
    def between(cls, before: list[list[int]], after: list[list[int]]) -> Move:
        drift = np.array([float(_root(_apart(x, y), True)[0]) if x != y else 0.0 for x, y in zip(before, after)])
        half = [min((float(_root(_apart(x, y), False)[0]) / 2 for j, y in enumerate(after) if j != k), default=math.inf) for k, x in enumerate(after)]
        return cls(after, drift, np.array(half))

    def loosened(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        others = np.array([max(np.delete(self.drift, k), default=0.0) for k in range(len(self.drift))])
        return (upper + self.drift[own]) * (1 + OUTWARDS), lower - others[own] - np.abs(lower) * OUTWARDS

    def assigned(self, rows: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Centroids and bounds of rows, and how many rows were looked at and how many scanned; own is -1 where there is none."""
        new, known = own.copy(), np.flatnonzero(own >= 0)
        upper, lower = upper.copy(), lower.copy()
        upper[known], lower[known] = self.loosened(own[known], upper[known], lower[known])
        bound = np.full(len(own), -math.inf)
        bound[known] = np.maximum(lower[known], self.half[own[known]])
        open_ = np.flatnonzero(~(upper < bound))
        near = open_[own[open_] >= 0]
        if len(near):
            upper[near] = _root(own_distances(rows[near], self.centroids, own[near]), True)
        scan = open_[~(upper[open_] < bound[open_])]
        if len(scan):
            found = distances(rows[scan], self.centroids)
            best = np.argmin(found, 1)  # the first of equal ones
            new[scan] = best
            at = np.arange(len(scan))
            upper[scan] = _root(found[at, best], True)
            if found.shape[1] > 1:
                rest = np.array([[v for j, v in enumerate(r) if j != b] for r, b in zip(found.tolist(), best.tolist())], object).min(1) if found.dtype == object else np.partition(found, 1, 1)[:, 1]
                lower[scan] = _root(rest, False)
            else:
                lower[scan] = math.inf
        return new, upper, lower, len(near), len(scan)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        value, low = divmod(value, _LIMB)
        yield limb, sign * low
        limb += 1


def _blocks(columns: dict[str, list]) -> pa.RecordBatch:
    types = {"ids": pa.list_(pa.int64()), "matrix": pa.binary(), "own": pa.binary(), "upper": pa.binary(), "lower": pa.binary(), "cluster": pa.int32(), "part": pa.int32(), "limb": pa.int32(), "value": pa.int64()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), types[c]) for c in _NAMES], _NAMES)


def _fresh(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (vec_id, vector) that have no centroid yet."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        flat = vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].reshape(-1, dims)
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            x = flat[at : at + BLOCK_ROWS]
            nothing = np.zeros(len(x)).tobytes()
            yield _blocks({"ids": [ids.slice(at, len(x)).to_pylist()], "matrix": [_packed(x, scale)], "own": [np.full(len(x), -1, "<i4").tobytes()], "upper": [nothing], "lower": [nothing]})


def _round(batches: Iterator[pa.RecordBatch], move: Move, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """The blocks with new centroids and bounds; last, what changed of the centroids' sums and counts (part `dims`), and of
    cluster -1 how many vectors there are, have moved, were looked at and were scanned."""
    k = len(move.centroids)
    change, said = np.zeros((k, dims + 1), object), [0, 0, 0, 0]
    for batch in batches:
        for row in batch.select(_NAMES[:5]).to_pylist():
            if row["ids"] is None:
                continue
            n = len(row["ids"])
            rows, own = _unpacked(row["matrix"], n, scale), np.frombuffer(row["own"], "<i4").astype(np.int64)
            new, upper, lower, looked, scanned = move.assigned(rows, own, np.frombuffer(row["upper"]), np.frombuffer(row["lower"]))
            moved = np.flatnonzero(new != own)
            for c in range(k):
                joined, left = moved[new[moved] == c], moved[own[moved] == c]
                if len(joined) or len(left):
                    change[c, :dims] += rows[joined].sum(0).astype(object) - rows[left].sum(0).astype(object)
                    change[c, dims] += len(joined) - len(left)
            said = [x + y for x, y in zip(said, (n, len(moved), looked, scanned))]
            yield _blocks({"ids": [row["ids"]], "matrix": [row["matrix"]], "own": [new.astype("<i4").tobytes()], "upper": [upper.tobytes()], "lower": [lower.tobytes()]})
    out = [(c, p, limb, v) for c in range(k) for p in range(dims + 1) for limb, v in _limbs(int(change[c, p]))] + [(-1, p, 0, v) for p, v in enumerate(said)]
    yield _blocks(dict(zip(("cluster", "part", "limb", "value"), map(list, zip(*out)))))


def starts(vectors: DataFrame, clusters: int, seed: int) -> list[list[float]]:
    """The vectors whose `seed:vec_id` have the smallest sha256, in its order; a null vec_id comes last, equal ones by vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.v) for r in vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()]


def kept_vectors(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id, v (doubles): the vectors of exactly `dims` components, none of them null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where((F.size("embedding") == dims) & good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, Model]:
    """(vec_id, cluster, distance) for each vector of `vectors` (vec_id, embedding) that has `dims` finite components, and the model.

    A component x becomes floor(scale * x). Centroids start as the vectors with the smallest sha256 of `seed:vec_id`, as many as
    there are at most; each round assigns every vector to the nearest (ties: smaller number) and replaces every centroid that has
    vectors by floor(sum / count), componentwise; then vectors are assigned once more. Rounds end early where no centroid moves,
    as nothing can change after. Rows with other vectors take no part. Repeated rows and null vec_ids take part, each as a row.
    A squared distance beyond a long is given as the largest long, though compared as it is. Other columns are not read; an
    empty table gives no rows and no centroids.

    The driver holds the centroids and one row for each of their components.
    """
    spark = vectors.sparkSession
    clean = kept_vectors(vectors, dims)
    with scratch(spark):
        now = [[_whole(x, scale) for x in v] for v in starts(clean, clusters, seed)]
        model, state = Model(now), None
        if not now:
            return spark.createDataFrame([], "vec_id long, cluster int, distance long"), model
        sums = [[0] * (dims + 1) for _ in now]
        move = Move.between(now, now)
        for n in range(rounds + 1):
            before = state
            if before is None:
                made = in_arrow(clean, lambda batches, m=move: _round(small(_fresh(batches, dims, scale)), m, dims, scale), BLOCK)
            else:
                made = before.where("ids IS NOT NULL").mapInArrow(lambda batches, m=move: _round(batches, m, dims, scale), BLOCK)
            state = written(made, f"bounds-{n}")
            changes = state.where("ids IS NULL").groupBy("cluster", "part", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
            if before is not None:
                discard(before)
            for r in changes:
                if r.cluster >= 0:
                    sums[r.cluster][r.part] += int(r.value) * _LIMB**r.limb
            said = {r.part: int(r.value) for r in changes if r.cluster < 0}
            model.rounds.append({x: said.get(k, 0) for k, x in enumerate(("vectors", "moved", "looked_at", "scanned"))})
            if n == rounds:
                break
            after = [[s // t[dims] for s in t[:dims]] if t[dims] else c for t, c in zip(sums, now)]
            if after == now:
                break
            move, now = Move.between(now, after), after
        model.centroids = now

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    own = np.frombuffer(row["own"], "<i4").astype(np.int64)
                    apart = own_distances(_unpacked(row["matrix"], len(own), scale), now, own)
                    if apart.dtype == object:
                        apart = np.array([min(v, MOST_LONG) for v in apart], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(own.astype(np.int32)), pa.array(apart)], ["vec_id", "cluster", "distance"])

        out = state.where("ids IS NOT NULL").select("ids", "matrix", "own").mapInArrow(measured, "vec_id long, cluster int, distance long")
        return written(out, "clusters", keep=True), model


def op11_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model = cluster(table(spark, sf_dir, "embeddings"))
    # a row for each centroid
    sums = {r.cluster: int(r.n) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    of = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1) if values else F.lit(None).cast(kind)
    own = [min(sums.get(k, 0), MOST_LONG) for k in range(len(model.centroids))]
    return found.select("vec_id", "cluster", "distance", of(own, "long").alias("cluster_inertia"), F.lit(min(sum(sums.values()), MOST_LONG)).cast("long").alias("inertia"), of(model.names(), "string").alias("centroid_sha256"))


def _rounds_sql(rounds: int) -> str:
    """Each round as two steps in SQL: the nearest centroid of every vector, and the floors of the means."""
    near = "n{r} AS MATERIALIZED (SELECT rid, cluster, d FROM (SELECT rid, cluster, d, row_number() OVER (PARTITION BY rid ORDER BY d, cluster) AS place FROM (SELECT f.rid, c.cluster, sum((f.x - c.x) * (f.x - c.x)) AS d FROM flat f JOIN c{r} c ON c.p = f.p GROUP BY ALL)) WHERE place = 1)"
    mean = "c{s} AS MATERIALIZED (SELECT c.cluster, c.p, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT n.cluster, f.p, CASE WHEN sum(f.x) >= 0 THEN sum(f.x) // count(*) ELSE -((count(*) - 1 - sum(f.x)) // count(*)) END AS x FROM n{r} n JOIN flat f ON f.rid = n.rid GROUP BY ALL) m ON m.cluster = c.cluster AND m.p = c.p)"
    return ",\n".join(x for r in range(rounds + 1) for x in ([near.format(r=r), mean.format(r=r, s=r + 1)] if r < rounds else [near.format(r=r)]))


QUERIES = {"op11_hamerly_clusters": op11_hamerly_clusters}
ORACLE_SQL = {
    "op11_hamerly_clusters": f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS MATERIALIZED (SELECT rid, unnest(range(1, {DIMS + 1})) AS p, unnest(v) AS x FROM v),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1)::INTEGER AS cluster, unnest(range(1, {DIMS + 1})) AS p, unnest(v) AS x
  FROM (SELECT vec_id, v FROM v ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {CLUSTERS})),
{_rounds_sql(ROUNDS)},
names AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT v.vec_id, n.cluster, n.d::BIGINT AS distance, (sum(n.d) OVER (PARTITION BY n.cluster))::BIGINT AS cluster_inertia, (sum(n.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM v JOIN n{ROUNDS} n ON n.rid = v.rid JOIN names ON names.cluster = n.cluster"""
}
