"""Pruned search against a scan."""

import numpy as np
import pytest

from lorekeep.operators import pruned, search

SCHEMA = "id long, embedding array<float>"


def both(spark, rows, asked, k, **how):
    chunks, queries = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "query_id long, vector array<double>")
    index = pruned.clustered(chunks, pruned.fit(chunks, **how), shard_rows=16)
    hits, looked = pruned.pruned_search(index, queries, k)
    names = ["query_id", "id", "similarity", "rank"]
    want = sorted(tuple(r[n] for n in names) for r in search.batch_vector_search(chunks, queries, k).collect())
    assert sorted(tuple(r[n] for n in names) for r in hits.collect()) == want
    return {r.query_id: r.looked_at for r in looked.collect()}


@pytest.mark.parametrize("k", [1, 5, 40])
def test_same_rows_as_a_scan_and_less_looked_at(spark, k):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 0.02, 8)]) for i in range(600)]
    asked = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 0.02, 8)]) for i in range(30)]
    looked = both(spark, rows, asked, k, clusters=12)
    assert sum(looked.values()) < 0.5 * 600 * 30 if k < 40 else True


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(0, 2, 4)]) for i in range(150)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, []), (903, [0.0] * 4), (904, [1.0]), (905, [1.0, 0.0, 0.0, 0.0, 5.0])]
    asked = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0] * 4), (3, [1.0, 1.0]), (4, None), (5, [0.1, 0.9, 0.3, 0.3])]
    for clusters in (1, 7):
        both(spark, rows, asked, 6, clusters=clusters)


def test_nothing(spark):
    assert both(spark, [], [(1, [1.0])], 3) in ({}, {1: 0}) and both(spark, [(1, None)], [(1, [1.0])], 3) in ({}, {1: 0})
    assert both(spark, [(1, [1.0, 0.0])], [], 3) == {}
