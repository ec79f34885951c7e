"""Searches over chunks as documents are cut into, several a page; pages known by their ids; states and lists of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, index, queue, search
from ..sources import tables as S
from .registry import _Q0, CHUNKS, CUT, DEBOUNCED, DOCS, EVENTS, HYBRID, WORDS, _HIT, _hits, _queue, _vector, query
from .stores import _FILLED, _pages, _store, _with_store

# ---- real chunks: all chunks of a document share its vector, so similarities tie within a page
_PIECES = CUT[: CUT.index("SELECT doc_id, chunk_index::INTEGER")].replace("WITH RECURSIVE", "WITH RECURSIVE vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),", 1) + """,
chunks AS (SELECT d.doc_id * 1000 + chunk_index AS id, page_key, page_id, url, d.title, chunk_index::INTEGER AS chunk_index, content_hash, CASE WHEN d.title = '' OR starts_with(p, d.title) THEN p ELSE d.title || chr(10) || chr(10) || p END AS chunk_text,
  CASE WHEN v.n <= 0 THEN v.v ELSE list_transform(v.v, lambda x: x * (1 / v.n)) END AS e FROM numbered m JOIN docs d ON d.doc_id = m.doc_id JOIN vecs v ON v.vec_id = d.doc_id)"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    vectors = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return chunking.chunked(S.extracted(spark, d)).join(vectors, "doc_id").withColumn("id", F.col("doc_id") * 1000 + F.col("chunk_index"))


@query("hybrid_search_pieces", (HYBRID + _HIT).replace(f"WITH {CHUNKS}", _PIECES).replace("POOL", "80").replace("THRESHOLD", "0.25").replace("WANTED", "20"))
def hybrid_search_pieces(spark, d):
    return _hits(search.hybrid_search(_pieces(spark, d), _vector(spark, d), WORDS, 20, 0.25))


@query("vector_topk_pieces", _PIECES + f", {_Q0} SELECT id, page_key, chunk_index FROM chunks, q ORDER BY list_dot_product(e, qe) DESC, id LIMIT 30")
def vector_topk_pieces(spark, d):
    return search.vector_search(_pieces(spark, d), _vector(spark, d), 30).select("id", "page_key", "chunk_index")


@query("chunk_cap", CUT.replace("coalesce(text, '') AS text", "repeat(coalesce(text, ''), CASE WHEN length(text) > 12000 THEN 20 ELSE 1 END) AS text", 1))
def chunk_cap(spark, d):
    """Long documents are made twenty times as long, so that they reach the greatest number of chunks."""
    docs = S.extracted(spark, d).withColumn("text", F.when(F.char_length("text") > 12000, F.repeat("text", 20)).otherwise(F.col("text")))
    return chunking.chunked(docs).select("doc_id", "chunk_index", F.md5(F.col("chunk_text").cast("binary")).alias("chunk"))


# ---- pages known by their ids
@query(
    "fresh_hits_by_id",
    (HYBRID + """, l AS (SELECT doc_id, page_id || CASE WHEN doc_id % 3 = 0 THEN '-moved' ELSE '' END AS live_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE content_hash END AS live_hash FROM docs)
SELECT id, rank::INTEGER AS rank FROM hits h JOIN l ON CASE WHEN id % 2 = 0 THEN l.live_id = h.page_id ELSE l.doc_id = h.id END WHERE rank <= 20 AND live_hash = content_hash""").replace("POOL", "80").replace("THRESHOLD", "0.25"),
)
def fresh_hits_by_id(spark, d):
    """Half of the chunks were indexed under keys made of ids, and a third of the pages have another id since: those of them that only an id names are hidden."""
    by_id = F.concat(F.lit("page-id://"), "page_id")
    hits = search.hybrid_search(S.chunks(spark, d), _vector(spark, d), WORDS, 20, 0.25)
    hits = hits.withColumn("page_key", F.when(F.col("id") % 2 == 0, by_id).otherwise(F.col("page_key")))
    live = S.extracted(spark, d).withColumns({"page_id": F.when(F.col("doc_id") % 3 == 0, F.concat("page_id", F.lit("-moved"))).otherwise(F.col("page_id")), "content_hash": F.when(F.col("doc_id") % 7 == 0, "new").otherwise(F.col("content_hash"))})
    return search.fresh_hits(hits, live).select("id", "rank")


# ---- states of sources
@query(
    "index_states_by_source",
    f"""WITH {DOCS}, f AS (SELECT title AS source, count(*) FILTER (doc_id % 5 <> 0) AS eligible, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 4 <> hash_of) AS pages,
  count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 4 <> hash_of AND NOT (hash_of = 2 AND doc_id % 3 = 0)) AS fits, count(*) FILTER (hash_of = 3 AND doc_id % 10 = 1) AS pending, count(*) FILTER (hash_of = 1 AND doc_id % 17 = 1) AS failed
  FROM (SELECT *, length(title) % 2 + CASE WHEN title > 'src2' THEN 2 ELSE 0 END AS hash_of FROM docs) GROUP BY title)
SELECT source, CASE WHEN failed > 0 OR pages > fits THEN 'error' WHEN eligible > 0 AND fits >= eligible AND pending = 0 THEN 'ready' WHEN pending > 0 THEN 'updating'
  WHEN eligible = 0 AND pages = 0 THEN 'empty' WHEN pages = 0 THEN 'not_configured' ELSE 'incomplete' END AS state FROM f""",
)
def index_states_by_source(spark, d):
    """The state of each source as an index of its own, from its documents."""
    k, kind = F.col("doc_id"), F.char_length("title") % 2 + F.when(F.col("title") > "src2", 2).otherwise(0)
    rows = S.extracted(spark, d).withColumn("kind", kind)
    held = (k % 11 != 0) & (k % 4 != F.col("kind"))
    facts = rows.groupBy(F.col("title").alias("source")).agg(
        F.count_if(k % 5 != 0).alias("eligible"), F.count_if(held).alias("pages"), F.count_if(held & ~((F.col("kind") == 2) & (k % 3 == 0))).alias("compatible_pages"),
        F.count_if((F.col("kind") == 3) & (k % 10 == 1)).alias("pending"), F.count_if((F.col("kind") == 1) & (k % 17 == 1)).alias("failed"),
    )
    return facts.withColumns({"stale": F.lit(0), "lifecycle_error": F.lit("")}).select("source", index.index_state().alias("state"))


# ---- emptying
@query("store_forced_rebuild", _FILLED + "SELECT page_key, chunk_index, chunk FROM good WHERE doc_id % 2 = 0")
def store_forced_rebuild(spark, d):
    """An index of all pages, emptied and built again when only half of them are left."""

    def work(root):
        pages = _pages(spark, d)
        _store(spark, root, pages).rebuild()
        later = _store(spark, root, pages.where("doc_id % 2 = 0"))
        later.rebuild(force=True, at=1)
        return later.chunks().select("page_key", "chunk_index", F.md5(F.col("chunk_text").cast("binary")).alias("chunk"))

    return _with_store(spark, work)


@query("queue_after_clear", f"WITH {EVENTS}, {DEBOUNCED} SELECT page_key, 1 AS revision FROM q WHERE operation = 'upsert'")
def queue_after_clear(spark, d):
    """A queue that is cleared and filled again begins its revisions anew."""
    old = _queue(spark, d)
    events = old.where("operation = 'upsert'").select("page_key", "page_id", "operation", "enqueued_at", F.lit(1).cast("long").alias("seq"))
    return queue.enqueued(queue.cleared(old), events).select("page_key", "revision")


@query("run_errors_all", "SELECT event_id AS run, range::INTEGER AS place, 'e' || event_id || '-' || range AS error FROM events, range(5) WHERE range < event_id % 4")
def run_errors_all(spark, d):
    """Every error of every run, none cut, in the order in which they came."""
    n = F.col("event_id") % 4
    runs = S.table(spark, d, "events").select(F.col("event_id").alias("run"), F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit("-"), k.cast("string")))).alias("errors"))
    return index.all_errors(runs, "run")
