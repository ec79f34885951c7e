"""The store: commits, metadata of moved pages, failures of single pages, deadlines, streams and statistics."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions.texts import chunk_normalized
from lorekeep.operators import chunking, index, queue
from lorekeep.operators.store import Store
from lorekeep.sources import tables
from lorekeep.sources.folders import Folders
from lorekeep.sources.manifest import BucketedTables, LostCommit

PROSE = "The workshop in the old garden opens at nine and closes when the last guest has gone home. "
SCHEMA = "page_key string, page_id string, url string, title string, text string, modified long, is_draft boolean, is_listed boolean, template string, exclude boolean"


def made_pages(spark, n, **changes):
    rows = [(f"page://{k}", f"p/{k}", f"/p/{k}", f"T{k}", PROSE * (1 + k % 3 * 15), k, False, True, "default", False) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA).withColumns(changes)


def store_of(spark, root, pages, provider=None, **more):
    return Store(spark, str(root), pages, provider or tables.HashedEmbeddings(8), wait=0, **({"buckets": 4} | more))


def test_moved_pages_keep_chunks_and_get_their_new_ids(spark, tmp_path):
    pages = made_pages(spark, 6)
    store_of(spark, tmp_path, pages).rebuild()
    before = {r.id: r.embedding for r in store_of(spark, tmp_path, pages).chunks().collect()}
    moved = store_of(spark, tmp_path, pages.withColumns({"page_id": F.concat(F.lit("new/"), "page_id"), "url": F.concat(F.lit("/new"), "url")}))
    assert moved.rebuild(at=1)["skipped"] == 6
    found = moved.chunks().collect()
    assert all(r.page_id.startswith("new/p/") and r.url.startswith("/new/p/") for r in found) and {r.id: r.embedding for r in found} == before
    assert moved.status()["stale"] == 0 and moved.queue().count() == 0
    # nothing has changed since, so nothing is written but the queue
    folders = moved.tables.head().tables["chunks"]
    assert moved.rebuild(at=2)["skipped"] == 6 and moved.tables.head().tables["chunks"] == folders


def test_a_drain_writes_the_buckets_it_touches(spark, tmp_path):
    pages = made_pages(spark, 60)
    store = store_of(spark, tmp_path, pages, buckets=32)
    store.rebuild()
    first = store.tables.head()
    later = store_of(spark, tmp_path, pages.withColumn("text", F.when(F.col("page_id").isin("p/3", "p/40"), F.lit(PROSE * 2)).otherwise(F.col("text"))), buckets=7)
    later.enqueue(later.pages.where("page_id IN ('p/3', 'p/40')").select("page_key", F.lit("upsert").alias("operation")), 5)
    assert later.drain(50) == {"indexed": 2, "skipped": 0, "deleted": 0, "failed": 0, "waiting": 0, "pending": 0}
    second = later.tables.head()
    assert second.buckets == 32
    changed = {b for b in first.tables["chunks"] if first.tables["chunks"][b] != second.tables["chunks"].get(b)}
    assert 1 <= len(changed) <= 2 and later.chunks().where("page_id = 'p/3'").count() == 1
    assert later.chunks().select("page_key").distinct().count() == 60
    # old folders stay for those who read them, until they are cleared
    assert later.tables.vacuum(keep=1) > 0 and later.chunks().select("page_key").distinct().count() == 60


def test_status_from_states_equals_the_scan(spark, tmp_path):
    store = store_of(spark, tmp_path, made_pages(spark, 40), buckets=8)
    store.rebuild()
    for fingerprint in (store.fingerprint, "other"):
        store.fingerprint = fingerprint
        want, got = index.statistics(store.chunks(), fingerprint).first().asDict(), store.status()
        assert {k: got[k] for k in want} == want
    # several configurations of one page
    rows = [("a", "f", "m", 3, 10), ("a", "f", "m2", 3, 20), ("a", "g", "m", 4, 5), ("b", "g", "m", 4, 7), ("b", "g", "m", 4, 8), ("c", None, None, None, None)]
    chunks = spark.createDataFrame(rows, "page_key string, index_fingerprint string, embedding_model string, dims int, indexed_at long")
    states = index.partial_states(chunks, F.pmod(F.xxhash64("page_key"), F.lit(2)).cast("int"))
    for fingerprint in ("f", "g", "h"):
        assert index.merged_statistics(states, fingerprint).collect() == index.statistics(chunks, fingerprint).collect()


def test_one_of_two_writers_of_a_bucket_loses(spark, tmp_path):
    schemas = {"t": "page_key string, n int"}
    one, two = (BucketedTables(spark, str(tmp_path), schemas, 4) for _ in range(2))
    rows = lambda *x: spark.createDataFrame(list(x), schemas["t"])
    base = one.head()
    put = lambda t, b, r: {"t": t.staged("t", b, r, t.touched(b, r))}
    first = one.commit(base, put(one, base, rows(("a", 1))))
    assert first.version == 1
    with pytest.raises(LostCommit):
        two.commit(base, put(two, base, rows(("a", 2))))
    # another bucket may still be changed on what was read before
    other = next(k for k in "bcdefgh" if one.touched(base, rows((k, 1))) != one.touched(base, rows(("a", 1))))
    assert two.commit(base, put(two, base, rows((other, 3)))).version == 2
    assert {(r.page_key, r.n) for r in one.read("t").collect()} == {("a", 1), (other, 3)}
    # a manifest of a number is made once
    assert not Folders(spark).created(f"{tmp_path}/manifests/{2:020d}.json", "{}")
    with pytest.raises(ValueError):
        one.staged("t", base, rows(("a", 1), (other, 1)), one.touched(base, rows(("a", 1))))


def test_a_lost_commit_is_made_again(spark, tmp_path):
    pages = made_pages(spark, 8)
    store, other = store_of(spark, tmp_path, pages), store_of(spark, tmp_path, pages)
    store.enqueue(pages.select("page_key", F.lit("upsert").alias("operation")), 1)
    outcomes, met = store.outcomes, []

    def meanwhile(*a):
        if not met:
            met.append(other.drain(None))
        return outcomes(*a)

    store.outcomes = meanwhile
    # the other run did it all, so this one finds nothing left
    assert store.drain(None) == {"indexed": 0, "skipped": 0, "deleted": 0, "failed": 0, "waiting": 0, "pending": 0} and met[0]["indexed"] == 8
    assert store.chunks().groupBy("id").count().where("count > 1").count() == 0 and store.queue().count() == 0


def test_one_page_fails_and_the_others_are_indexed(spark, tmp_path):
    class Refusing(tables.HashedEmbeddings):
        def embed(self, texts):
            if any("refuse" in t for t in texts):
                raise RuntimeError("not this one")
            return tables.HashedEmbeddings.embed(self, texts)

    bad = F.when(F.col("page_id") == "p/4", F.concat(F.col("text"), F.lit("refuse"))).otherwise(F.col("text"))
    store = store_of(spark, tmp_path, made_pages(spark, 9, text=bad), Refusing(8))
    assert store.rebuild() == {"indexed": 8, "skipped": 0, "deleted": 0, "failed": 1, "waiting": 0, "pending": 1}
    assert [(r.page_key, r.attempts, r.last_error) for r in store.queue().collect()] == [("page://4", 1, "not this one")]
    store.drain()
    store.drain()
    assert store.drain() == {"indexed": 0, "skipped": 0, "deleted": 0, "failed": 0, "waiting": 0, "pending": 0}
    assert store.queue().first().attempts == 3 and store.status()["state"] == "error" and store.status()["failed"] == 1
    assert [(r.page_id, r.error) for r in store.errors().orderBy("run", "place").collect()] == [("p/4", "not this one")] * 3
    # an old state of a page that fails stays
    good = store_of(spark, tmp_path, made_pages(spark, 9), tables.HashedEmbeddings(8))
    assert good.chunks().where("page_id = 'p/4'").count() == 0


def test_behind_a_failed_deletion_all_wait(spark, tmp_path):
    class Failing:
        def remove(self, page_key):
            if page_key == "page://2":
                raise RuntimeError("locked")

    pages = made_pages(spark, 6)
    store_of(spark, tmp_path, pages).rebuild()
    store = store_of(spark, tmp_path, pages.where("page_id NOT IN ('p/1', 'p/2', 'p/3')"), remover=Failing())
    events = [("page://1", "p/1", "delete", 10, 1), ("page://2", "p/2", "delete", 11, 2), ("page://3", "p/3", "delete", 12, 3), ("page://0", "p/0", "upsert", 1, 4)]
    assert store.apply(spark.createDataFrame(events, "page_key string, page_id string, operation string, enqueued_at long, seq long"), 0) == {"indexed": 0, "skipped": 0, "deleted": 1, "failed": 1, "waiting": 2, "pending": 3}
    assert {(r.page_key, r.attempts) for r in store.queue().collect()} == {("page://2", 1), ("page://3", 0), ("page://0", 0)}
    assert {r.page_key for r in store.chunks().select("page_key").distinct().collect()} == {f"page://{k}" for k in (0, 2, 3, 4, 5)}
    store.remover = None
    assert store.drain() == {"indexed": 0, "skipped": 1, "deleted": 2, "failed": 0, "waiting": 0, "pending": 0}


def test_withdrawn_pages_leave_and_count_as_skipped(spark, tmp_path):
    pages = made_pages(spark, 4)
    store_of(spark, tmp_path, pages).rebuild()
    store = store_of(spark, tmp_path, pages.withColumn("is_draft", F.col("page_id") == "p/1"))
    store.enqueue(pages.select("page_key", F.lit("upsert").alias("operation")), 3)
    assert store.drain()["skipped"] == 4 and store.chunks().where("page_id = 'p/1'").count() == 0


def test_what_is_due_after_the_deadline_waits(spark, tmp_path):
    store = store_of(spark, tmp_path, made_pages(spark, 5))
    assert store.rebuild(deadline=time.time() - 1) == {"indexed": 0, "skipped": 0, "deleted": 0, "failed": 0, "waiting": 5, "pending": 5}
    assert store.queue().agg(F.max("attempts")).first()[0] == 0
    assert store.drain(deadline=time.time() + 600)["indexed"] == 5


def test_answers_out_of_order_and_retries(spark):
    class Shuffled(tables.HashedEmbeddings):
        """Answers backwards, and only on the second try; refuses one text."""

        def __init__(self, dims):
            super().__init__(dims)
            self.calls = 0

        def embed_items(self, texts):
            self.calls += 1
            if self.calls % 2:
                raise TimeoutError()
            if "bad" in texts:
                raise RuntimeError("bad text")
            return list(enumerate(self.embed(texts)))[::-1]

    rows = [(f"p{k // 3}", f"word {k}" if k != 7 else "bad", k) for k in range(250)]
    df = spark.createDataFrame(rows, "page_key string, chunk_text string, n int").coalesce(1)
    got = {r.n: r for r in tables.embedded_or_failed(df, Shuffled(8), batch=96, tries=3, wait=0).collect()}
    plain = tables.HashedEmbeddings(8)
    assert len(got) == 250 and {n for n, r in got.items() if r.error} == {6, 7, 8}
    assert all(got[n].error in ("bad text", "TimeoutError") and got[n].embedding is None and got[n].dims is None for n in (6, 7, 8))
    assert all(r.embedding == plain.embed([r.chunk_text])[0] and r.dims == 8 for n, r in got.items() if n not in (6, 7, 8))


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    pages = made_pages(spark, 3)
    pages.select("page_key", "page_id", F.lit("upsert").alias("operation"), F.lit(4).cast("long").alias("enqueued_at"), F.col("modified").alias("seq")).write.parquet(str(tmp_path / "in"))
    store = store_of(spark, tmp_path / "kb", pages)
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert store.apply(batch, 0, n=0) == {"indexed": 0, "skipped": 0, "deleted": 0, "failed": 0, "waiting": 0, "pending": 3}
    # the run broke off before the drain
    assert store.apply(batch, 0)["indexed"] == 3 and store.apply(batch, 0)["skipped"] == 0
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        store.follow(stream, str(tmp_path / "progress"), "files").awaitTermination(120)
    assert store.tables.head().meta["batch:files"] == "0" and store.queue().count() == 0


def test_search_queues_stale_pages_once(spark, tmp_path):
    pages = made_pages(spark, 4)
    store_of(spark, tmp_path, pages).rebuild()
    edited = store_of(spark, tmp_path, pages.withColumn("text", F.concat(F.col("text"), F.lit("Edited."))))
    assert edited.find("workshop garden", threshold=0.0).count() == 0
    assert {r.page_key for r in edited.queue().collect()} == {f"page://{k}" for k in range(4)}
    version = edited.tables.head().version
    edited.find("workshop garden", threshold=0.0)
    assert edited.tables.head().version == version
    assert edited.drain()["indexed"] == 4 and edited.find("workshop garden", threshold=0.0).count() > 0


def test_places_of_jobs_of_one_time(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("page_key"), F.when(F.col("id") % 5 == 0, "delete").otherwise("upsert").alias("operation"), F.lit(7).cast("long").alias("enqueued_at"), F.xxhash64("id").alias("first_seq"))
    got = queue.positions(rows.repartition(6))
    order = [r.page_key for r in rows.orderBy(*queue.order()).collect()]
    assert [r.page_key for r in got.orderBy("position").collect()] == order and {r.position for r in got.collect()} == set(range(1, 20_001))
    sizes = [r["count"] for r in queue.placed(rows, "first_seq").withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000
    with pytest.raises(ValueError):
        queue.drained(rows, rows, rows, rows, None, 5.0)


def test_all_errors_of_runs(spark):
    runs = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, None), (4, ["a"] * 150)], "run long, errors array<string>")
    got = [(r.run, r.place, r.error) for r in index.all_errors(runs, "run").orderBy("run", "place").collect()]
    assert got == [(1, 0, "b"), (1, 1, "a")] + [(4, k, "a") for k in range(150)]


def test_vectors_leave_a_task_as_they_are_asked_for(spark):
    """A task holds the vectors of one batch, however many rows Arrow brings at once."""
    rows = spark.range(1000).selectExpr("concat('page://', id div 3) AS page_key", "concat('word ', id) AS chunk_text").coalesce(1)
    for made in (tables.embedded(rows, tables.HashedEmbeddings(4), batch=96), tables.embedded_or_failed(rows, tables.HashedEmbeddings(4), batch=96, wait=0)):
        want = {r.chunk_text: r.embedding for r in made.collect()}
        assert len(want) == 1000 and all(len(v) == 4 for v in want.values())
        assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()


def counted_pages(spark, n):
    """Pages, and an accumulator of the texts that were read."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    pages = made_pages(spark, n)
    return pages.withColumn("text", F.udf(read, "string").asNondeterministic()("text")), seen


def test_a_rebuild_reads_texts_once_to_queue_them(spark, tmp_path):
    pages, seen = counted_pages(spark, 12)
    store = store_of(spark, tmp_path, pages)
    store.enqueue(queue.rebuild_plan(store.chunks(), store.live()), 0)
    assert store.queue().count() == 12 and seen.value == 12


def test_a_drain_without_embeddings_reads_texts_once(spark, tmp_path):
    store_of(spark, tmp_path, made_pages(spark, 12)).rebuild()
    pages, seen = counted_pages(spark, 12)
    moved = store_of(spark, tmp_path, pages.withColumn("page_id", F.concat(F.lit("new/"), "page_id")))
    moved.enqueue(moved.pages.select("page_key", F.lit("upsert").alias("operation")), 1)
    seen.value = 0
    assert moved.drain(None)["skipped"] == 12 and seen.value == 12
    assert moved.chunks().where("startswith(page_id, 'new/')").count() == moved.chunks().count() > 0


def test_few_buckets_are_written_by_many_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = store_of(spark, tmp_path, made_pages(spark, 40), buckets=2)
        store.rebuild()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    found = store.tables.head().tables["chunks"]
    assert len(found) == 2 and store.chunks().select("page_key").distinct().count() == 40
    assert all(sum(n.startswith("part-") for n in Folders(spark).names(p)) > 1 for p in found.values())


def test_hashed_words_are_those_of_md5():
    text = "Dear Ada \x0b\fdear  BOB\tİx\x1cy\n" + " ".join(f"w{k}" for k in range(50))
    out = np.zeros(6)
    for w in re.findall(r"[^ \t\n\r\f\v]+", text.lower()):
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        out[h // 2 % 6] += 1 if h % 2 else -1
    assert tables.HashedEmbeddings(6).embed([text, ""]) == [(out / np.sqrt((out * out).sum())).astype(np.float32).tolist(), [0.0] * 6]


def test_texts_are_normalized_as_columns_are(spark):
    texts = ["a \t b", " a\r\nb\rc ", "a\n\n\n\nb", "x \n \n \n y\x0b", "a\n \n\nb", "", " ", "a  b\x00", "plain", "a\r \r\n\r\tb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunk_normalized(F.col("t")).alias("n")).collect()
    assert [chunking.normalized(r.t) for r in rows] == [r.n for r in rows]
