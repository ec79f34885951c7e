import os
import random
import sqlite3

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import texts, words
from lorekeep.operators import chunking, limits, queue, search
from lorekeep.plans import registry
from lorekeep.sources import tables
from lorekeep.streaming import jobs


def plain_match(a, b):
    a, b = sorted((words.fold_word(a), words.fold_word(b)), key=len)
    return a == b or (len(a) >= 6 and b.startswith(a) and b[len(a):] in words.SUFFIXES)


def test_match(spark):
    rows = [("pfandbecher", "pfandbechern", True), ("messe", "messer", False), ("größe", "grosse", True), ("café", "cafe", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.m == r.want for r in df.select("want", words.match(F.col("a"), F.col("b")).alias("m")).collect())


@given(st.text("abcdeinrsä", min_size=3, max_size=10), st.text("abcdeinrsä", max_size=4))
def test_forms_are_the_match(w, tail):
    for other in (w + tail, w[:6] + tail):
        assert (words.fold_word(other) in words.forms(w)) == plain_match(w, other)
        assert plain_match(w, other) == plain_match(other, w)


def test_chunk_windows():
    assert chunking.taken("x" * 400, 0, 340) == 340
    assert chunking.taken("x" * 389 + ". " + "y" * 50, 0, 340) == 340  # the window ends at 390, not 391
    assert chunking.taken("x" * 300 + "\n\n" + "y" * 500, 0, 340) == 302
    assert chunking.pieces("abc", 10, 2) == ["abc"] and chunking.pieces("", 10, 2) == []


@given(st.text("ab. \n", max_size=400), st.integers(5, 60), st.integers(0, 80))
def test_chunks_cover(text, target, overlap):
    text = text.strip(texts.TRIMMED)
    found = chunking.pieces(text, target, overlap, most=10_000)
    assert all(len(p) <= max(target, int(target * 1.15)) for p in found)
    assert set("".join(found)) >= set(text) - set(" \n")


def test_html():
    assert texts.clean_html("<p>a&amp;b</p><br>c<script>d</script> &copy; &bogus; x") == "a&b\n\ncd © &bogus; x"


def test_bm25_is_that_of_sqlite(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["messe", "haus"]), " ".join(rng.choice(["bier", "messe", "haus", "garten", "wein"]) for _ in range(rng.randint(1, 12)))) for k in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, chunk_text)")
    con.executemany("INSERT INTO t(rowid, title, chunk_text) VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT rowid, bm25(t, 2.0, 1.0) FROM t WHERE t MATCH '\"wein\"*'"))
    got = {r.id: r.bm25 for r in search.bm25(spark.createDataFrame(rows, "id long, title string, chunk_text string"), ["wein"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_lexical_hit_below_threshold(spark):
    c = spark.createDataFrame([(1, "p", 0, "t", "workshop here", [1.0, 0.0]), (2, "q", 10, "t", "nothing", [1.0, 0.0]), (3, "q", 2, "t", "nothing", [0.0, 0.0])], "id long, page_key string, chunk_index int, title string, chunk_text string, embedding array<float>")
    assert [r.id for r in search.hybrid_search(c, [0.0, 1.0], ["workshop"], 5, 0.9).collect()] == [1]
    assert [r.id for r in search.hybrid_search(c, [1.0, 0.0], [], 5, 0.5).orderBy("rank").collect()] == [1, 2]
    assert search.vector_search(c, [], 5).count() == 0


def test_batch_search(spark):
    rng = random.Random(4)

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    rows = [(k, [float(rng.randint(-2, 2)) for _ in range(4)]) for k in range(80)] + [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [2.0, 1.0])]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = chunks.where("id % 3 = 0 OR id >= 900").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.batch_vector_search(chunks, asked, 5, shard_rows=7, tile_rows=4)
    good = [(k, unit(v)) for k, v in rows if v and None not in v]
    want = {}
    for q, a in good:
        if q % 3 == 0 or q >= 900:
            best = sorted((-round(sum(x * y for x, y in zip(a, b)), 9), k) for k, b in good)
            want[q] = [-s for s, _ in best[:5]]
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(round(r.similarity, 9))
    assert got == want and found.count() == 5 * len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the same rows from one shard as from many
    many = search.batch_vector_search(chunks.repartition(40), asked, 5, shard_rows=100)
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, found.collect()), key=str)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastExchange" not in plan


def test_batch_query_takes_every_20th(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.vec_id for r in tables.table(spark, sf, "embeddings").where("vec_id % 20 = 0").collect()}
    assert len(want) > 20 and {r.query_id for r in registry.QUERIES["vector_batch_topk_every20"](spark, sf).collect()} == want


def test_documents_without_vectors_are_searched(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id for r in tables.extracted(spark, sf).select("doc_id").collect()}
    held = {r.id for r in tables.chunks(spark, sf).select("id").collect()}
    for name in ("lexical_coverage_every", "title_prefix_every"):
        found = [r.id for r in registry.QUERIES[name](spark, sf).select("id").collect()]
        assert set(found) == docs and len(found) == len(docs) > len(held)
    assert {r.id for r in registry.QUERIES["bm25_mode_every"](spark, sf).collect()} - held
    c = spark.createDataFrame([(1, "p", 0, "t", "workshop here", None), (2, "q", 1, "t", "nothing", [1.0, 0.0])], "id long, page_key string, chunk_index int, title string, chunk_text string, embedding array<float>")
    hits = search.hybrid_search(c, [1.0, 0.0], ["workshop"], 5, 0.5).orderBy("id").collect()
    assert [(r.id, r.similarity, r.semantic_rank, r.lexical_rank) for r in hits] == [(1, None, None, 1), (2, 1.0, 1, None)]
    assert [r.id for r in search.hybrid_search(c, [1.0, 0.0], [], 5, -1.0).collect()] == [2]


@pytest.mark.parametrize("name", sorted(n for n in registry.SQL if n.endswith("_every")))
def test_every_as_sql(spark, name):
    # sf0.001 has a vector for every document, so the SQL is compared where documents lack one
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.01").select(*[f"`{c}`" for c in want.columns])

    def plain(rows):
        return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)

    assert plain(got.collect()) == plain(want.fetchall())


def test_coupled_limits(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 300), "a", str(rng.randint(0, 3)), str(rng.randint(0, 2))) for k in range(200)]
    df = spark.createDataFrame(rows, "request_id long, at long, action string, session string, ip string")
    b, want = limits.Buckets(3, 5, 40), {}
    for k, at, _, s, i in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k] = b.consume(s, i, at)[0]
    assert {r.request_id: r.allowed for r in limits.coupled_limits(df, 3, 5, 40).collect()} == want
    b = limits.Buckets(1, 0, 5)
    assert [b.consume("s", "i", 0), b.consume("s", "i", 1), b.consume("s", "i", 60)] == [(True, 0), (False, 59), (True, 0)]


def test_revision_guards(spark):
    ev = spark.createDataFrame([("k", "a", "upsert", 1, 1), ("k", "b", "delete", 2, 2), ("k", "c", "upsert", 3, 3)], "page_key string, page_id string, operation string, enqueued_at long, seq long")
    q = queue.debounced(ev)
    assert q.select("page_id", "revision", "attempts").collect() == [("c", 3, 0)]
    assert queue.completed(q, spark.createDataFrame([("k", 2)], "page_key string, revision int")).count() == 1
    assert queue.completed(q, spark.createDataFrame([("k", 3)], "page_key string, revision int")).count() == 0


def test_streams(spark, tmp_path):
    rows = [(f"k{k % 7}", f"p{k}", "upsert", k, k) for k in range(50)]
    df = spark.createDataFrame(rows, "page_key string, page_id string, operation string, enqueued_at long, seq long")
    df.write.parquet(str(tmp_path / "in"))
    got = []
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.debounce(s, lambda b: got.extend(b.collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(got) == sorted(queue.debounced(df).collect())


def test_limits_of_a_stream_that_arrives_shuffled(spark, tmp_path):
    rng = random.Random(9)
    start = 86_400 * 3 - 900
    rows = [(k, start + k // 2, rng.choice("ab"), f"s{rng.randint(0, 12)}", f"i{rng.randint(0, 4)}") for k in range(3000)]
    schema = "request_id long, at long, action string, session string, ip string"
    # up to eight minutes late, over a day's end; then what closes the last minutes
    late = sorted(rows, key=lambda r: r[1] + rng.randint(0, 480))
    parts = [late[k : k + 500] for k in range(0, 3000, 500)] + [[(9_000 + k, start + 86_400 + k * 3600, "end", "s", "i")] for k in range(2)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
            os.utime(tmp_path / "in" / f"{k}-{f.name}", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds all done
        jobs.coupled_limits_stream(stream, 3, 25, 300, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(240)
    stage = jobs.DailyLimit(spark, str(tmp_path / "out"), 300)
    want = limits.coupled_limits(spark.createDataFrame(rows, schema), 3, 25, 300)
    assert sorted(stage.answers().where("request_id < 9000").collect()) == sorted(want.collect())
    assert 0 < want.where("allowed").count() < 3000 and want.where("retry_after > 60").count() > 0
    # a batch that is run again changes nothing
    number = int(stage.tables.head().meta["batch"])
    stage(spark.createDataFrame([(1, "a", start, True, 0, 0)], jobs.MINUTE), number)
    assert stage.tables.head().meta["batch"] == str(number) and stage.answers().where("request_id = 1").count() == 1


def test_embedding_provider(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("",)], "chunk_text string")
    rows = tables.embedded(df, tables.HashedEmbeddings(8), batch=2).collect()
    assert len(rows) == 3 and rows[0].embedding == rows[1].embedding and rows[0].dims == 8


def test_unit_vectors_are_those_of_the_sql_to_the_sign_of_zero(spark, tmp_path):
    import duckdb

    rows = [(0, [1.0, -1e-8, 1e-8]), (1, [0.0, 0.0]), (2, [3.0, None, 4.0]), (3, None), (4, []), (5, [None]), (6, [-0.0, -2.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES["vector_normalize"](spark, str(tmp_path)).orderBy("vec_id").collect()
    sql = registry.SQL["vector_normalize"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet' ORDER BY vec_id")
    want = duckdb.sql(sql).fetchall()
    assert repr([(r.vec_id, r.unit) for r in got]) == repr([(i, u) for i, u in want]) and "-0.0" in repr(want)
