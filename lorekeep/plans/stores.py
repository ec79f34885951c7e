"""Queries of the store: each fills a knowledge base from all documents, works on it and reads what it then holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store
from ..sources import tables as S
from ..sources.folders import Folders, checkpointed, shared_folder
from .providers import BEGIN, Failing, Refusing
from .registry import CUT, query

def _pages(spark: SparkSession, d: str) -> DataFrame:
    return S.extracted(spark, d).select(
        "doc_id", "page_key", "page_id", "url", "title", "text", (F.lit(1_700_000_000) + F.col("doc_id")).alias("modified"), F.lit(False).alias("is_draft"), F.lit(True).alias("is_listed"),
        F.lit("default").alias("template"), (F.col("doc_id") % 11 == 0).alias("exclude"),
    )


def _with_store(spark: SparkSession, work) -> DataFrame:
    """What `work(root)` gives, kept beyond the store that it makes."""
    root = shared_folder(spark, "store")
    try:
        return checkpointed(work(root))
    finally:
        Folders(spark).delete(root)


def _store(spark: SparkSession, root: str, pages: DataFrame, remover=None) -> Store:
    return Store(spark, root, pages, Refusing(16), buckets=8, remover=remover, wait=0)


#: Chunks of the pages that may be indexed; `bad` are those of which a chunk is refused, with the first one's error.
_FILLED = CUT[: CUT.index("SELECT doc_id, chunk_index::INTEGER")] + f""", made AS (SELECT n.doc_id, chunk_index::INTEGER AS chunk_index, md5(CASE WHEN n.title = '' OR starts_with(p, n.title) THEN p ELSE n.title || chr(10) || chr(10) || p END) AS chunk
  FROM numbered n JOIN docs d ON d.doc_id = n.doc_id WHERE n.doc_id % 11 <> 0 AND length(trim(d.text, ' ' || chr(9) || chr(10) || chr(13) || chr(11))) >= 80),
bad AS (SELECT doc_id, 'refused ' || arg_min(chunk, chunk_index) AS error FROM made WHERE starts_with(chunk, '{BEGIN}') GROUP BY doc_id),
good AS (SELECT m.*, d.page_key, d.page_id, d.url FROM made m JOIN docs d USING (doc_id) WHERE m.doc_id NOT IN (SELECT doc_id FROM bad))
"""


@query("store_rebuild", _FILLED + "SELECT page_key, page_id, url, chunk_index, chunk FROM good")
def store_rebuild(spark, d):
    def work(root):
        store = _store(spark, root, _pages(spark, d))
        store.rebuild()
        return store.chunks().select("page_key", "page_id", "url", "chunk_index", F.md5(F.col("chunk_text").cast("binary")).alias("chunk"))

    return _with_store(spark, work)


@query("store_failed_jobs", _FILLED + "SELECT page_key, 1 AS attempts, error AS last_error FROM bad JOIN docs USING (doc_id)")
def store_failed_jobs(spark, d):
    def work(root):
        store = _store(spark, root, _pages(spark, d))
        store.rebuild()
        return store.queue().select("page_key", "attempts", "last_error")

    return _with_store(spark, work)


@query("store_moved_pages", _FILLED + "SELECT page_key, 'moved/' || page_id AS page_id, '/moved' || url AS url, chunk_index, chunk FROM good")
def store_moved_pages(spark, d):
    """Every page has moved and kept its text: only the metadata of its chunks change."""

    def work(root):
        pages = _pages(spark, d)
        _store(spark, root, pages).rebuild()
        later = _store(spark, root, pages.withColumns({"page_id": F.concat(F.lit("moved/"), "page_id"), "url": F.concat(F.lit("/moved"), "url")}))
        later.rebuild(at=1)
        return later.chunks().select("page_key", "page_id", "url", "chunk_index", F.md5(F.col("chunk_text").cast("binary")).alias("chunk"))

    return _with_store(spark, work)


@query(
    "store_statistics",
    _FILLED + "SELECT (SELECT count(*) FROM good) AS chunks, (SELECT count(DISTINCT doc_id) FROM good) AS pages, (SELECT count(*) FROM bad) AS pending, 0::BIGINT AS failed, (SELECT count(DISTINCT doc_id) FROM made) AS eligible, 0::BIGINT AS stale, CASE WHEN (SELECT count(*) FROM bad) > 0 THEN 'updating' ELSE 'ready' END AS state",
)
def store_statistics(spark, d):
    """The status, from the parts that each bucket keeps."""
    names = {"chunks": "long", "pages": "long", "pending": "long", "failed": "long", "eligible": "long", "stale": "long", "state": "string"}

    def work(root):
        store = _store(spark, root, _pages(spark, d))
        store.rebuild()
        said = store.status()
        return spark.createDataFrame([tuple(said[n] for n in names)], ", ".join(f"{n} {t}" for n, t in names.items()))

    return _with_store(spark, work)


@query(
    "store_failed_deletion",
    _FILLED + """, jobs AS (SELECT doc_id, 'page://' || doc_id AS page_key, 1000 + doc_id % 50 AS since FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY since, doc_id) AS place, md5(page_key) < '2' AS bad FROM jobs WHERE doc_id % 3 = 0),
first AS (SELECT coalesce(min(place), 1000000000) AS f FROM placed WHERE bad)
SELECT page_key, CASE WHEN place = f THEN 1 ELSE 0 END AS attempts, CASE WHEN place = f THEN 'kept ' || page_key END AS last_error FROM placed, first WHERE place >= f
UNION ALL SELECT page_key, 0, NULL FROM jobs, first WHERE doc_id % 3 = 1 AND f < 1000000000
UNION ALL SELECT d.page_key, 1, error FROM bad JOIN docs d USING (doc_id), first WHERE doc_id % 3 = 1 AND f = 1000000000""",
)
def store_failed_deletion(spark, d):
    """A batch of a stream's events: deletions of every third page, upserts of every third. Behind the first deletion that fails all wait."""

    def work(root):
        pages = _pages(spark, d)
        store = _store(spark, root, pages, Failing())
        events = pages.where("doc_id % 3 < 2").select("page_key", "page_id", F.when(F.col("doc_id") % 3 == 0, "delete").otherwise("upsert").alias("operation"), (1000 + F.col("doc_id") % 50).alias("enqueued_at"), F.col("doc_id").alias("seq"))
        store.apply(events, 0)
        return store.queue().select("page_key", "attempts", "last_error")

    return _with_store(spark, work)
