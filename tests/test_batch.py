"""What batch search does for each pair of a question and a chunk."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorekeep.operators import search


def test_only_pairs_that_reach_the_last_kept_are_summed(monkeypatch):
    rng = np.random.default_rng(2)
    q, shards, summed = rng.normal(size=(16, 8)), [rng.normal(size=(200, 8)) for _ in range(9)], []
    shards[3][:7] = shards[0][:7]  # ties
    shards[5][4] = np.nan
    unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
    dots = search._dots
    monkeypatch.setattr(search, "_dots", lambda a, b: summed.append(len(a)) or dots(a, b))
    q, shards = unit(q), [unit(s) for s in shards]
    cells = [{"q_ids": list(range(16)), "q_matrix": q.tobytes(), "c_ids": [1000 * (8 - n) + i for i in range(200)], "c_matrix": s.tobytes()} for n, s in enumerate(shards)]
    schema = pa.schema([("q_ids", pa.list_(pa.int64())), ("q_matrix", pa.binary()), ("c_ids", pa.list_(pa.int64())), ("c_matrix", pa.binary())])
    found = pa.Table.from_batches(list(search._best_of_cells(iter(pa.RecordBatch.from_pylist([c], schema) for c in cells), 5))).to_pylist()
    want = {}
    for a in range(16):
        each = [(float(dots(q[a : a + 1], s[i : i + 1])[0]), 1000 * (8 - n) + i) for n, s in enumerate(shards) for i in range(200)]
        want[a] = sorted(each, key=lambda x: (-np.inf if np.isnan(x[0]) else -x[0], x[1]))[:5]
    got = {a: [(r["similarity"], r["id"]) for r in found if r["query_id"] == a] for a in range(16)}
    assert repr(got) == repr(want)
    # each shard gave five rows a question before
    assert 16 * 5 <= sum(summed) < 16 * 5 * 9 / 2


def test_blocks_meet_in_as_many_tasks_as_there_are_branches(spark):
    sides = [spark.range(n).select(F.col("id").alias(c), (F.col("id") % 12).cast("int").alias("branch")) for n, c in ((60, "q"), (40, "c"))]
    met = search.met(*sides, 12)
    assert met.count() == sum(5 * len([c for c in range(40) if c % 12 == b]) for b in range(12))
    # small as they are, Spark doesn't put them together
    assert met.rdd.getNumPartitions() == 48
