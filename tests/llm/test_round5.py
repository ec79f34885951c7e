"""Operator 2: copies of tiles and shards are shuffled, and a tile keeps its rows over the shards that it meets."""

import numpy as np

from lorekeep.llm import exact_topk


def test_copies_do_not_go_through_the_driver(spark):
    # by Spark's estimates, which don't know the copies, tiles are small enough to be broadcast
    v = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 8), x -> float(hash(id, x) % 100 / 100.0)) AS embedding")
    found = exact_topk.top_k(v, v.where("vec_id % 50 = 0"), shard_rows=64, tile_rows=16, branches=24)
    assert found.count() == 300
    plan = found._jdf.queryExecution()
    assert found.collect() and "Broadcast" not in plan.executedPlan().toString()


def test_a_tile_keeps_its_rows_over_shards(spark):
    rng = np.random.default_rng(5)
    # ties, a candidate found twice, vectors of another length, and integers beyond those that doubles hold
    v = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(200)] + [(7, [9.0, 9.0, 9.0, 9.0])]
    v += [(300 + k, [float(x) for x in rng.integers(-2, 3, 3)]) for k in range(4)] + [(400 + k, [float(k) * 2**18, 2.0**20, 1.0, 1.0, 1.0]) for k in range(12)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3)
    good = [(k, [int(np.floor(256 * x)) for x in e]) for k, e in v]
    want = {}
    for q, a in good:
        if q % 5 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), k) for k, b in good if k != q and len(a) == len(b))[:5]
            want |= {(q, n + 1): (k, -s) for n, (s, k) in enumerate(best)}
    for branches in (1, 4, 50):
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.top_k(df, df.where("vec_id % 5 = 0"), shard_rows=8, tile_rows=7, branches=branches).collect()]
        assert len(got) == len(want) and {(q, n): (k, s) for q, n, k, s in got} == want


def test_shards_and_tiles_are_copied_as_needed():
    # 600,000 vectors and 12,000 queries in 600 tasks: tiles were copied 600 times
    down, across = exact_topk.grid(600, 600_000, 1172, 12_000, 6, 5)
    assert down * across <= 600 and across * 600_000 + down * 12_000 < 600 * 12_000 / 1.5
    assert exact_topk.grid(12, 0, 0, 0, 0, 5) == (1, 1)
