"""More queries of the retrieval operators: extraction, draining, states, settings, ranked search; each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as T
from ..operators import extraction, index, limits, queue, search
from ..sources import tables as S
from .registry import BM25, CHUNKS, DEBOUNCED, DOCS, EVENTS, HYBRID, PAGES, STORED, _HIT, _PLAIN, _Q0, _events, _hits, _pages, _queue, _requests, _round, _stored, _vector, query, sql_fold, sql_match

# ---- the index's state over all combinations of facts
_DIGITS = {"lifecycle": (2, 1), "failed": (2, 2), "stale": (2, 4), "pending": (2, 8), "pages": (4, 16), "fitting": (4, 64), "eligible": (4, 256)}


@query(
    "index_states",
    """WITH f AS (SELECT range AS id, CASE WHEN range % 2 = 1 THEN 'e' ELSE '' END AS err, range // 2 % 2 AS failed, range // 4 % 2 AS stale, range // 8 % 2 AS pending,
  range // 16 % 4 AS pages, least(range // 16 % 4, range // 64 % 4) AS fits, range // 256 % 4 AS eligible FROM range(1024))
SELECT id, CASE WHEN err <> '' OR failed > 0 OR stale > 0 OR greatest(0, pages - fits) > 0 THEN 'error'
  WHEN eligible > 0 AND least(eligible, fits) = eligible AND pending = 0 AND failed = 0 AND stale = 0 AND pages - fits <= 0 THEN 'ready'
  WHEN pending > 0 THEN 'updating' WHEN eligible = 0 AND pages = 0 THEN 'empty' WHEN pages = 0 THEN 'not_configured' ELSE 'incomplete' END AS state,
  CASE WHEN eligible < 1 THEN 0 ELSE least(100, round(100.0 * least(eligible, fits) / eligible)) END::INTEGER AS percent FROM f""",
)
def index_states(spark, d):
    facts = spark.range(1024).select("id", *[(F.floor(F.col("id") / by) % n).alias(k) for k, (n, by) in _DIGITS.items()])
    facts = facts.withColumns({"lifecycle_error": F.when(F.col("lifecycle") == 1, "e").otherwise(""), "compatible_pages": F.least("pages", "fitting")})
    return facts.select("id", index.index_state().alias("state"), index.percent(F.least("eligible", "compatible_pages"), F.col("eligible")).alias("percent"))


# ---- extraction
_LABEL = "map<string,string>"


def _cells(spark, d):
    """Cells of made-up fields of the documents: plain, secret, typed, nested, blocks and relations."""
    docs = S.table(spark, d, "documents").select("doc_id", "source", "lang")
    k = F.col("doc_id")

    def label(**names):
        return F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.lit(None).cast(_LABEL)

    def cell(field, name, kind, value, labels, item=None, item_type=None, hidden=None, place=None, inner=None, inner_kind=None, inner_label=None, targets=None):
        null = F.lit(None)
        return F.struct(
            F.lit(field).alias("field"), F.lit(name).alias("field_name"), F.lit(kind).alias("field_type"), labels.alias("field_label"), F.lit(item).cast("int").alias("item"), F.lit(item_type).cast("string").alias("item_type"),
            (null if hidden is None else hidden).cast("boolean").alias("item_hidden"), F.lit(place).cast("int").alias("cell"), F.lit(inner).cast("string").alias("name"), F.lit(inner_kind).cast("string").alias("type"),
            (label() if inner_label is None else inner_label).alias("label"), value.cast("string").alias("value"), (null if targets is None else targets).cast("array<string>").alias("targets"),
        )

    made = F.array(
        cell(0, "title", "text", F.concat(F.lit("<b>T</b> "), "source"), label(en="Title", de="Titel")),
        cell(1, "apiKey", "text", F.lit("hidden"), label()),
        cell(2, "intro", "Textarea", F.concat(F.lit("<p>a &amp; b</p>"), "lang"), label()),
        cell(3, "mail", "email", F.lit("x@example.org"), label()),
        cell(4, "rows", "structure", k, label(en="Rows"), 1, None, None, 1, "size", "text", label(en="Size")),
        cell(4, "rows", "structure", F.col("lang"), label(en="Rows"), 1, None, None, 0, "kind", "select"),
        cell(4, "rows", "structure", F.lit("0"), label(en="Rows"), 0, None, None, 0, "Color", "text"),
        cell(4, "rows", "structure", F.col("source"), label(en="Rows"), 0, None, None, 1, "name", "writer"),
        cell(5, "body", "blocks", F.lit("in a block"), label(), 0, "text", F.lit(False), 0, "text", "writer"),
        cell(5, "body", "blocks", F.lit("x = 1"), label(), 1, "code", F.lit(False), 0, "text", "textarea"),
        cell(5, "body", "blocks", F.lit("unknown"), label(), 2, "own-block", F.lit(False), 0, "text", "text"),
        cell(5, "body", "blocks", F.lit("sometimes"), label(), 3, "list", k % 2 == 1, 0, "text", "list", label(de="Liste")),
        cell(6, "more", "pages", F.lit(None), label(de="Mehr"), targets=F.array(F.concat(F.lit("page://"), (k + 2).cast("string")), F.concat(F.lit("page://"), (k + 1).cast("string")))),
    )
    return docs.select(F.concat(F.lit("page://"), k.cast("string")).alias("page_key"), F.explode(made).alias("c")).select("page_key", "c.*")


@query(
    "fields_text",
    f"""WITH {DOCS}, {PAGES}, s AS (SELECT doc_id, 'Titel: ' || title || chr(10) || 'Kurzbeschreibung: ' || lang AS s FROM pages_ WHERE NOT is_draft AND template NOT IN ('search-settings', 'error') AND NOT exclude),
r AS (SELECT d.doc_id, string_agg(s, chr(10) || chr(10) ORDER BY s.doc_id DESC) AS rel FROM documents d JOIN s ON s.doc_id IN (d.doc_id + 1, d.doc_id + 2) GROUP BY d.doc_id)
SELECT 'page://' || d.doc_id AS page_key, concat_ws(chr(10) || chr(10), 'Titel: T ' || source, 'a & b' || chr(10) || lang, 'Rows: ' || source || chr(10) || chr(10) || lang || chr(10) || 'Size: ' || d.doc_id,
  'in a block', CASE WHEN d.doc_id % 2 = 0 THEN 'Liste: sometimes' END, 'Mehr: ' || rel) AS text FROM documents d LEFT JOIN r USING (doc_id)""".replace(
        "'in a block', CASE WHEN d.doc_id % 2 = 0 THEN 'Liste: sometimes' END", "'in a block' || CASE WHEN d.doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Liste: sometimes' ELSE '' END"
    ),
)
def fields_text(spark, d):
    summaries = extraction.page_summaries(_pages(spark, d).select("page_key", "title", F.lit(" ").alias("teaser"), F.lit("[1]").alias("intro"), F.col("lang").alias("text"), "is_draft", "template", "page_id", "exclude"), index.indexable())
    return extraction.fields_text(_cells(spark, d), ["text", "code", "list"], summaries)


# ---- draining
_TROUBLE = "CASE WHEN doc_id % 19 = 0 THEN 'failed ' || doc_id END"
_JOBS = f"""jobs AS (SELECT page_key, page_id, doc_id, CASE WHEN doc_id % 9 = 0 THEN 'delete' ELSE 'upsert' END AS operation, doc_id AS first_seq, 1000 + doc_id % 50 AS since,
  CASE WHEN doc_id % 9 <> 0 AND doc_id % 19 = 0 OR doc_id = DELETED THEN 'failed ' || doc_id END AS error FROM docs WHERE doc_id % 4 <> 3 AND doc_id % 6 <> 5),
placed AS (SELECT *, row_number() OVER (ORDER BY CASE operation WHEN 'delete' THEN 0 ELSE 1 END, since, first_seq) AS place FROM jobs),
cut AS (SELECT *, coalesce(bool_or(operation = 'delete' AND error IS NOT NULL) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR place > LATE AS waits FROM placed WHERE place <= 200)
SELECT c.page_key, 2 AS revision, CASE WHEN waits THEN 'waiting' WHEN error IS NOT NULL THEN 'failed' WHEN operation = 'delete' OR c.doc_id % 11 = 0 THEN 'removed'
  WHEN s.stored_hash = d.content_hash THEN 'skipped' ELSE 'indexed' END AS outcome, CASE WHEN NOT waits THEN error END AS error
FROM cut c JOIN docs d ON d.page_key = c.page_key LEFT JOIN stored s ON s.page_key = c.page_key"""


def _drain(spark, d, deleted, budget):
    docs = S.extracted(spark, d).where("doc_id % 4 <> 3 AND doc_id % 6 <> 5")
    k = F.col("doc_id")
    delete = k % 9 == 0
    jobs = docs.select(
        "page_key", "page_id", F.when(delete, "delete").otherwise("upsert").alias("operation"), (1000 + k % 50).alias("enqueued_at"), F.lit(0).alias("attempts"), F.lit(2).alias("revision"),
        F.lit(None).cast("string").alias("last_error"), k.alias("first_seq"), F.lit(0.5).alias("cost"),
    )
    bad = docs.where((~delete & (k % 19 == 0)) | (k == deleted)).select("page_key", F.concat(F.lit("failed "), k.cast("string")).alias("error"))
    live = S.extracted(spark, d).where("doc_id % 11 <> 0")
    return jobs, queue.drained(jobs, _stored(spark, d), live, bad, 200, budget)


@query("drain_queue", f"WITH {CHUNKS}, {STORED}, {_JOBS}".replace("DELETED", "-1").replace("LATE", "120"))
def drain_queue(spark, d):
    return _drain(spark, d, -1, 60.0)[1]


@query("drain_stops_at_failed_deletion", f"WITH {CHUNKS}, {STORED}, {_JOBS}".replace("DELETED", "36").replace("LATE", "200"))
def drain_stops_at_failed_deletion(spark, d):
    return _drain(spark, d, 36, None)[1]


@query(
    "queue_after_drain",
    (f"WITH {CHUNKS}, {STORED}, {_JOBS.replace('SELECT c.page_key', ', o AS (SELECT c.page_key', 1)}) SELECT j.page_key, CASE WHEN o.outcome = 'failed' THEN 1 ELSE 0 END AS attempts, o.error AS last_error FROM jobs j LEFT JOIN o USING (page_key)"
     " WHERE o.outcome IS NULL OR o.outcome IN ('failed', 'waiting')").replace("DELETED", "-1").replace("LATE", "120"),
)
def queue_after_drain(spark, d):
    jobs, outcomes = _drain(spark, d, -1, 60.0)
    return queue.after_drain(jobs, outcomes).select("page_key", "attempts", "last_error")


@query(
    "drain_result",
    (f"WITH {CHUNKS}, {STORED}, {_JOBS.replace('SELECT c.page_key', ', o AS (SELECT c.page_key', 1)}) SELECT count(*) FILTER (outcome = 'indexed') AS indexed, count(*) FILTER (outcome = 'skipped') AS skipped,"
     " count(*) FILTER (outcome = 'removed') AS deleted, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'waiting') AS waiting FROM o").replace("DELETED", "-1").replace("LATE", "120"),
)
def drain_result(spark, d):
    return queue.drain_result(_drain(spark, d, -1, 60.0)[1])


@query("queue_positions", f"WITH {EVENTS}, {DEBOUNCED} SELECT page_key, row_number() OVER (ORDER BY CASE operation WHEN 'delete' THEN 0 ELSE 1 END, enqueued_at, first_seq)::BIGINT AS position FROM q")
def queue_positions(spark, d):
    return queue.positions(_queue(spark, d)).select("page_key", F.col("position").cast("long").alias("position"))


@query("queue_clear", f"WITH {EVENTS}, {DEBOUNCED} SELECT page_key, revision FROM q WHERE false")
def queue_clear(spark, d):
    return queue.cleared(_queue(spark, d)).select("page_key", "revision")


@query("forced_rebuild", "SELECT 'page://' || doc_id AS page_key, 'upsert' AS operation FROM documents WHERE doc_id % 11 <> 0")
def forced_rebuild(spark, d):
    return queue.rebuild_plan(index.truncated(_stored(spark, d)), S.extracted(spark, d).where("doc_id % 11 <> 0"), force=True)


@query(
    "moved_subtrees",
    f"""WITH {DOCS}, p AS (SELECT *, 'all/' || page_id AS pid, CASE WHEN doc_id % 2 = 0 THEN page_key ELSE 'page-id://all/' || page_id END AS k, doc_id % 5 <> 0 AS allowed FROM docs),
e AS (SELECT pid, k, allowed, 'was/' || substr(pid, 5) AS old_id FROM p WHERE starts_with(pid, 'all/src1/') OR starts_with(pid, 'all/src2/')),
m AS (SELECT *, CASE WHEN k LIKE 'page://%' THEN k ELSE 'page-id://' || old_id END AS old_key FROM e)
SELECT old_key AS page_key, old_id AS page_id, 'delete' AS operation FROM m WHERE old_key <> k UNION ALL
SELECT k, pid, CASE WHEN allowed THEN 'upsert' ELSE 'delete' END FROM m""",
)
def moved_subtrees(spark, d):
    page_id = F.concat(F.lit("all/"), "page_id")
    pages = S.extracted(spark, d).select(F.when(F.col("doc_id") % 2 == 0, F.col("page_key")).otherwise(F.concat(F.lit("page-id://"), page_id)).alias("page_key"), page_id.alias("page_id"), (F.col("doc_id") % 5 != 0).alias("allowed"))
    moves = spark.createDataFrame([("was/src1", "all/src1", 5), ("was/src2", "all/src2", 6)], "old_id string, new_id string, at long")
    return queue.lifecycle_events(queue.moved_subtrees(moves, pages)).select("page_key", "page_id", "operation")


# ---- search
RANKED_WORDS = ["nationen", "thing", "enden"]
_TERMS = ["nationen", "nation", "natione", "thing", "enden"]


def _ranked_sql(sql: str) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in RANKED_WORDS) + "]"
    cover = f"len(list_filter({words}, lambda q: len(list_filter(list_transform(regexp_extract_all(lower(title || chr(10) || chunk_text), '[\\p{{L}}\\p{{N}}]{{3,}}'), lambda t: {sql_fold('t')}), lambda t: {sql_match('q', 't')} )) > 0)) / {len(RANKED_WORDS)}.0"
    freq = " UNION ALL ".join(f"SELECT id, len, 2.0 * len(list_filter(t, lambda w: starts_with(w, '{w}'))) + len(list_filter(x, lambda w: starts_with(w, '{w}'))) AS f, '{w}' AS term FROM base" for w in _TERMS)
    from .registry import COVERAGE, _BM

    bm = BM25.replace(_BM, freq)
    sql = sql.replace(COVERAGE, cover).replace(f"WITH {CHUNKS}, {_Q0}, scored", f"WITH {CHUNKS}, {_Q0}, {bm}, scored")
    sql = sql.replace("AS cov FROM chunks, q)", "AS cov, coalesce(bm25, 'inf'::DOUBLE) AS b FROM q, chunks LEFT JOIN bm USING (id))")
    sql = sql.replace("(ORDER BY cov DESC, id) AS lr", "(ORDER BY cov DESC, b, id) AS lr").replace("coalesce(l.cov, 0) AS lexical", "coalesce(l.cov, 0) AS lexical, coalesce(l.b, 'inf'::DOUBLE) AS b")
    return sql.replace("ORDER BY lexical DESC, sim DESC, k) END", "ORDER BY lexical DESC, b, sim DESC, k) END")


@query("hybrid_search_ranked", _ranked_sql((HYBRID + _HIT).replace("POOL", "80").replace("THRESHOLD", "0.25").replace("WANTED", "20")))
def hybrid_search_ranked(spark, d):
    return _hits(search.ranked_search(S.chunks(spark, d), _vector(spark, d), RANKED_WORDS, 20, 0.25))


@query("compatible_search", f"WITH {CHUNKS}, {STORED}, {_Q0} SELECT id, round(list_dot_product(e, qe), 6) AS similarity FROM stored, q WHERE fp = 'fixture' AND dims = 64 ORDER BY list_dot_product(e, qe) DESC, id LIMIT 20")
def compatible_search(spark, d):
    fitting = S.compatible(_stored(spark, d), "fixture", 64, "fixture")
    return _round(search.vector_search(fitting, _vector(spark, d), 20).select("id", "similarity"), "similarity")


@query("stale_hits_requeued", (HYBRID + "SELECT page_key, page_id FROM hits WHERE rank <= 20 AND id % 7 = 0 AND id % 3 <> 0").replace("POOL", "80").replace("THRESHOLD", "0.25"))
def stale_hits_requeued(spark, d):
    from .registry import WORDS

    live = S.extracted(spark, d).withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "new").otherwise(F.col("content_hash"))).where("doc_id % 3 <> 0 OR doc_id % 7 <> 0")
    return search.stale_pages_of(search.hybrid_search(S.chunks(spark, d), _vector(spark, d), WORDS, 20, 0.25), live)


# ---- settings, hashes and formats
@query(
    "bounded_settings",
    "SELECT doc_id, least(20, greatest(1, coalesce(try_cast(v AS DOUBLE), 5)))::INTEGER AS top_k, least(1.0, greatest(0.0, coalesce(try_cast(v AS DOUBLE) / 10, 0.25)))::DOUBLE AS min_similarity FROM"
    " (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'many' WHEN 1 THEN NULL ELSE (doc_id % 40 - 5)::VARCHAR END AS v FROM documents)",
)
def bounded_settings(spark, d):
    k = F.col("doc_id") % 4
    v = F.when(k == 0, "many").when(k > 1, (F.col("doc_id") % 40 - 5).cast("string"))
    return S.table(spark, d, "documents").select("doc_id", S.bounded("top_k", v).alias("top_k"), S.bounded("min_similarity", v.try_cast("double") / 10).alias("min_similarity"))


@query(
    "index_fingerprint",
    """SELECT doc_id, sha256('{"embedding_base_url":"https://e.org/v' || doc_id || '","embedding_dimensions":64,"embedding_model":"m-' || lang || '","extractor_version":2,"chunk_chars":1200,"chunk_overlap":200}') AS fingerprint FROM documents""",
)
def index_fingerprint(spark, d):
    url = F.concat(F.lit(" HTTPS://E.org/v"), "doc_id", F.lit("/#top"))
    return S.table(spark, d, "documents").select("doc_id", T.index_fingerprint(url, F.lit(64), F.concat(F.lit("m-"), "lang"), F.lit(1200), F.lit(200)).alias("fingerprint"))


@query("normalized_url", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://me:Pw@e.org:80/A/b?q=1' WHEN 1 THEN 'ftp://e.org' WHEN 2 THEN 'no address' ELSE rtrim(regexp_replace(trim(url), '#.*$', ''), '/') END AS url FROM pages")
def normalized_url(spark, d):
    k = F.col("page_id") % 4
    own = F.concat(F.regexp_replace(F.regexp_replace("url", "^https://", "HTTPS://"), "^http://", "Http://"), F.lit("/ "))
    url = F.when(k == 0, "HTTP://me:Pw@E.ORG:80/A/b/?q=1#x").when(k == 1, "FTP://E.org//").when(k == 2, " no address/").otherwise(own)
    return S.table(spark, d, "pages").select("page_id", T.normalized_url(url).alias("url"))


@query(
    "date_formats",
    "SELECT event_id, strftime(ts, '%d.%m.%Y') AS day, day(ts) || '. ' || ['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember'][month(ts)] || ' ' || year(ts) AS long_day FROM events",
)
def date_formats(spark, d):
    return S.table(spark, d, "events").select("event_id", T.day_text(F.col("ts")).alias("day"), T.long_day_text(F.col("ts")).alias("long_day"))


@query("text_encodings", "SELECT doc_id, md5(url_encode(coalesce(text, ''))) AS url, md5(base64(encode(coalesce(text, '')))) AS base FROM documents")
def text_encodings(spark, d):
    t = F.coalesce("text", F.lit(""))
    return S.table(spark, d, "documents").select("doc_id", F.md5(T.raw_url(t).cast("binary")).alias("url"), F.md5(T.base64_text(t).cast("binary")).alias("base"))


@query("meta_read", "SELECT 'user-' || user_id AS key, CASE WHEN user_id % 2 = 0 THEN 'v' ELSE 'none' END AS value FROM (SELECT DISTINCT user_id FROM events)")
def meta_read(spark, d):
    users = S.table(spark, d, "events").select("user_id").distinct()
    key = F.concat(F.lit("user-"), "user_id")
    return S.meta_value(users.where("user_id % 2 = 0").select(key.alias("key"), F.lit("v").alias("value")), users.select(key.alias("key"), F.lit("none").alias("default")))


@query("run_errors", "SELECT error FROM (SELECT 'e' || event_id AS error FROM events WHERE event_type = 'error') ORDER BY error LIMIT 100")
def run_errors(spark, d):
    rows = S.table(spark, d, "events").where("event_type = 'error'")
    return index.run_errors(rows.select(F.array(F.concat(F.lit("e"), "event_id")).alias("errors")))


@query(
    "rate_limit_per_minute",
    "SELECT request_id, row_number() OVER (PARTITION BY ip, floor(t / 60) ORDER BY t, request_id) <= 1 AS allowed FROM (SELECT event_id AS request_id, floor(epoch(ts))::BIGINT AS t, user_id % 40 AS ip FROM events)",
)
def rate_limit_per_minute(spark, d):
    return limits.coupled_limits(_requests(spark, d), 0, 1, 0).select("request_id", "allowed")


@query(
    "index_lists",
    f"WITH {CHUNKS}, {STORED} SELECT list_sort(list(DISTINCT 'm' || id % 3)) AS models, list_sort(list(DISTINCT (dims + id % 2)::INTEGER)) AS dims, list_sort(list(DISTINCT fp)) AS fingerprints FROM stored",
)
def index_lists(spark, d):
    rows = _stored(spark, d).withColumns({"embedding_model": F.concat(F.lit("m"), (F.col("id") % 3).cast("string")), "dims": (F.col("dims") + F.col("id") % 2).cast("int")})
    return index.statistics(rows, "fixture").select("models", "dims", "fingerprints")


@query(
    "run_results_all",
    "SELECT sum(event_id % 3)::BIGINT AS indexed, sum(event_id % 5)::BIGINT AS skipped, sum(event_id % 2)::BIGINT AS deleted, count(*) FILTER (event_type = 'error')::BIGINT AS failed, sum(event_id % 7)::BIGINT AS chunks,"
    " sum(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END)::BIGINT AS n_errors, bool_or(user_id = 3) AS busy FROM events",
)
def run_results_all(spark, d):
    error = F.col("event_type") == "error"
    rows = S.table(spark, d, "events").select(
        *[(F.col("event_id") % n).alias(c) for c, n in (("indexed", 3), ("skipped", 5), ("deleted", 2), ("chunks", 7))], error.cast("int").alias("failed"), F.when(error, F.array(F.lit("a"), F.lit("b"))).alias("errors"), (F.col("user_id") == 3).alias("busy")
    )
    return index.merged_results(rows)
