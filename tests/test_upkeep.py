import hashlib
import hmac
import json
import random
import re
import sqlite3

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lorekeep.functions import texts, words
from lorekeep.operators import extraction, index, limits, queue, search
from lorekeep.sources import tables
from tests.test_parts import plain_match

SF = "/root/testdata/sf0.001"


def one(spark, column, *rows, kind="string"):
    """`column` of a value `x`, for each row."""
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r.y for r in df.select("k", column.alias("y")).orderBy("k").collect()]


MARKUP = [
    "<p>a&amp;b</p><br>c<script>d</script> &copy; &bogus; x", "", None, "plain", "a &lt;b&gt; &#8211; &#x2014;&nbsp;c", "<!-- a < b > c --> d", "x <b\nclass='y'>z</b> <unclosed", "1 < 2 and 3 > 2",
    "<H2>t</H2><LI>a</li><li>b</LI>\r\n\r\n\r\n\r\nend", "<div><p>q</p></div>\t\t tail  ", "&amp;lt; stays", "<br/><BR />x</p >", "a&b&c;", "<style>p{}</style>text",
]


def test_html_is_the_plain_version(spark):
    assert one(spark, texts.html_text(F.col("x")), *MARKUP) == [None if m is None else texts.clean_html(m) for m in MARKUP]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html", texts.html_text(F.col("html")).alias("text")).collect()
    assert all(r.text == texts.clean_html(r.html) for r in pages)


def test_keyed_hash(spark):
    for key in ("secret", "k" * 64, "k" * 65, ""):
        want = [hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest() for v in ("1", "ä", "unknown", "unknown")]
        assert one(spark, texts.keyed_hash(key, F.col("x")), "1", "ä", "", None) == want


def test_addresses_and_fingerprint(spark):
    given = ["HTTP://E.org/A/", " https://e.ORG ", "http://U:P@E.org:80/x/?q=A#f", "localhost/v1/", "https://e.org//"]
    want = ["http://e.org/A", "https://e.org", "http://U:P@e.org:80/x?q=A", "localhost/v1", "https://e.org"]
    assert one(spark, texts.normalized_url(F.col("x")), *given) == want
    payload = {"embedding_base_url": "https://e.org/v1", "embedding_dimensions": 64, "embedding_model": 'm"1', "extractor_version": 2, "chunk_chars": 1200, "chunk_overlap": 200}
    made = texts.index_fingerprint(F.col("x"), F.lit(64), F.lit('m"1'), F.lit(1200), F.lit(200))
    assert one(spark, made, "https://E.org/v1/") == [hashlib.sha256(json.dumps(payload, separators=(",", ":")).encode()).hexdigest()]


def test_formats(spark):
    assert one(spark, texts.raw_url(F.col("x")), "a b+c*~/ä", "") == ["a%20b%2Bc%2A~%2F%C3%A4", ""]
    assert one(spark, texts.base64_text(F.col("x")), "a" * 90) == ["YWFh" * 30]
    assert one(spark, texts.long_day_text(F.col("x").cast("date")), "2026-03-01", "2028-02-29") == ["1. März 2026", "29. Februar 2028"]


def test_bounds(spark):
    assert one(spark, tables.bounded("top_k", F.col("x")), "0", "7", "99", "many", None, "3.9") == [1, 7, 20, 5, 5, 3]
    assert one(spark, tables.bounded("min_similarity", F.col("x")), "-1", "0.5", "2", None) == [0.0, 0.5, 1.0, 0.25]


@given(st.text("abcdeinorsußäöü", min_size=3, max_size=10), st.text("abcdeinrsäß", max_size=4))
def test_pattern_is_the_match(w, tail):
    import pyarrow.compute as pc

    for other in (w + tail, w[:6] + tail, words.fold_word(w)):
        told = len(other) >= 3 and other not in words.STOP_WORDS and plain_match(w, other)
        assert pc.match_substring_regex(f"x. {other}, y", words.word_pattern(w)).as_py() == told


def test_coverage_is_the_expression(spark):
    chunks = tables.chunks(spark, SF)
    for query in (["thing", "nationen", "welchen", "uber"], ["größe"]):
        got = {r.id: r.lexical for r in search.scored(chunks, [1.0] * 64, query, 10_000).collect()}
        words_of = words.tokens(F.concat_ws("\n", "title", "chunk_text"))
        want = {r.id: r.c for r in chunks.select("id", words.coverage(query, words_of).alias("c")).collect()}
        assert got == want
        assert {r.id: r.c for r in chunks.select("id", search.coverage(query).alias("c")).collect()} == want


def test_ranked_search_finds_stems_as_sqlite_does(spark):
    rng = random.Random(2)
    rows = [(k, "p", k, "t", " ".join(rng.choice(["pfandbecher", "pfandbechern", "bier", "pfand", "große", "grosse", "wein"]) for _ in range(rng.randint(1, 9))), None) for k in range(60)]
    c = spark.createDataFrame(rows, "id long, page_key string, chunk_index int, title string, chunk_text string, embedding array<float>")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, chunk_text)")
    con.executemany("INSERT INTO t(rowid, title, chunk_text) VALUES (?, ?, ?)", [(r[0], r[3], r[4]) for r in rows])
    for query in (["pfandbechern"], ["grosse", "wein"]):
        want: dict = {}
        for term in {t for q in query for t in words.stems(q)}:
            for rowid, score in con.execute("SELECT rowid, bm25(t, 2.0, 1.0) FROM t WHERE t MATCH ?", (f'"{term}"*',)):
                want[rowid] = min(score, want.get(rowid, 0.0))
        got = {r.id: r.bm25 for r in search.bm25(c, query).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        hits = search.ranked_search(c, [1.0], query, 25, 0.5).collect()
        covered = {k: sum(any(plain_match(q, t) for t in re.findall(r"\w+", text)) for q in query) for k, _, _, _, text, _ in rows}
        order = sorted((k for k in covered if covered[k]), key=lambda k: (-covered[k], want.get(k, float("inf")), "p\0" + str(k)))
        # a chunk that holds only the ß form has no bm25 and comes behind those of its coverage
        assert [r.id for r in sorted(hits, key=lambda r: r["rank"])] == order[: len(hits)] and len(hits) == min(25, len(order))


def test_search_reads_chunks_in_one_pass(spark):
    plan = search.hybrid_search(tables.chunks(spark, SF), [1.0] * 64, ["thing"], 5, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wide = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert wide and all("chunk_text" not in line.split("MapInArrow")[1] for line in wide)


def test_provider_order():
    assert tables.in_order([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]]
    for items in ([(0, [1.0])], [(0, [1.0]), (0, [2.0])], [(0, [1.0]), (2, [2.0])]):
        with pytest.raises(ValueError):
            tables.in_order(items, 2)
    assert [tables.within("top_k", v) for v in (None, 0, 7, 99)] == [5, 1, 7, 20]


def test_long_documents_have_no_cap_where_none_is_asked_for(spark):
    from lorekeep.operators import chunking

    text = "A sentence of some words. " * 12_000
    df = spark.createDataFrame([("t", text)], "title string, text string")
    want = len(chunking.pieces(text, 1200, 200, most=10**9))
    assert chunking.chunked(df).count() == chunking.MOST_CHUNKS < want == chunking.chunked(df, most=None).count()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, []), (5, [2.0, 0.0]), (6, [0.0, 0.0]), (7, [1.0])]
    c = spark.createDataFrame([(k, f"p{k}", 0, "t", "x", v) for k, v in rows], "id long, page_key string, chunk_index int, title string, chunk_text string, embedding array<float>")
    got = search.vector_search(c, [3.0, 0.0], 10).orderBy(F.desc("similarity"), "id").collect()
    assert [(r.id, r.similarity) for r in got] == [(1, 1.0), (5, 1.0), (7, 1.0), (4, 0.0), (6, 0.0)]


def test_wrong_vectors_fail(spark):
    fresh = tables.chunks(spark, SF).limit(3)
    assert index.replaced(fresh, fresh, 64).count() == 3
    with pytest.raises(PySparkException):
        index.replaced(fresh, fresh, 63).collect()


def test_extraction_edges(spark):
    empty = spark.createDataFrame([], extraction.CELLS)
    assert extraction.fields_text(empty, ["text"]).count() == 0
    pages = spark.createDataFrame([("a", "T", "", "{x}", "<b>d</b>", None), ("b", "", None, None, None, " "), ("c", "C", "t" * 600, None, None, None)], "page_key string, title string, teaser string, intro string, description string, text string")
    got = {r.page_key: r.summary for r in extraction.page_summaries(pages).collect()}
    assert got == {"a": "Titel: T\nKurzbeschreibung: d", "c": "Titel: C\nKurzbeschreibung: " + "t" * 500}


def test_day_without_one_task(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 3 * 86400), rng.choice("ab"), str(rng.randint(0, 20)), str(rng.randint(0, 5))) for k in range(3000)]
    df = spark.createDataFrame(rows, "request_id long, at long, action string, session string, ip string")
    for session, ip, daily in ((1, 2, 300), (0, 1, 0), (2, 0, 7)):
        want = {}
        buckets = {a: limits.Buckets(session, ip, daily) for a in "ab"}
        for k, at, action, s, i in sorted(rows, key=lambda r: (r[1], r[0])):
            want[k] = buckets[action].consume(s, i, at)
        assert {r.request_id: (r.allowed, r.retry_after) for r in limits.coupled_limits(df, session, ip, daily).collect()} == want


def test_queue_clearing_and_places(spark):
    q = spark.createDataFrame([("a", "upsert", 5, 1), ("b", "delete", 90_000, 2), ("c", "upsert", 4000, 3), ("d", "delete", 1, 4)], "page_key string, operation string, enqueued_at long, first_seq long")
    assert {r.page_key: r.position for r in queue.positions(q).collect()} == {"d": 1, "b": 2, "a": 3, "c": 4}
    assert queue.cleared(q).count() == 0 and queue.cleared(q).columns == q.columns


def test_store(spark, tmp_path, capsys):
    from lorekeep.__main__ import main
    from lorekeep.operators.store import Store

    prose = "The workshop in the old garden opens at nine and closes when the last guest has gone home. "
    rows = [(f"page://{k}", f"p/{k}", f"/p/{k}", f"T{k}", (prose if k else "short. ") * (1 + 20 * (k == 3)), k == 4, k == 5, k) for k in range(8)]
    schema = "page_key string, page_id string, url string, title string, text string, is_draft boolean, exclude boolean, modified long"
    pages = spark.createDataFrame(rows, schema).withColumns({"is_listed": F.lit(True), "template": F.lit("default")})
    store = Store(spark, str(tmp_path / "kb"), pages, tables.HashedEmbeddings(16))
    assert store.status()["state"] == "not_configured"
    assert store.rebuild() == {"indexed": 5, "skipped": 0, "deleted": 0, "failed": 0, "waiting": 0, "pending": 0}
    first = store.status()
    assert (first["state"], first["pages"], first["eligible"]) == ("ready", 5, 5) and first["chunks"] > 5
    assert store.rebuild()["skipped"] == 5
    # a page is changed, one is withdrawn
    later = Store(spark, str(tmp_path / "kb"), pages.withColumn("text", F.when(F.col("page_id") == "p/3", prose * 2).otherwise(F.col("text"))).withColumn("exclude", F.col("page_id").isin("p/5", "p/6")), tables.HashedEmbeddings(16))
    assert later.status()["state"] == "error"
    got = later.rebuild()
    assert (got["indexed"], got["skipped"], got["deleted"]) == (1, 3, 1)
    assert later.status()["state"] == "ready" and later.chunks().where("page_id = 'p/3'").count() == 1
    assert later.find("workshop garden").count() > 0
    # other settings make stored chunks unfit
    other = Store(spark, str(tmp_path / "kb"), pages, tables.HashedEmbeddings(8))
    assert other.status()["state"] == "error" and other.find("workshop").count() == 0
    assert other.rebuild(force=True)["indexed"] == 5 and other.status()["state"] == "ready"
    pages.write.parquet(str(tmp_path / "pages"))
    main([str(tmp_path / "cli"), str(tmp_path / "pages"), "rebuild"])
    main([str(tmp_path / "cli"), str(tmp_path / "pages"), "status"])
    main([str(tmp_path / "cli"), str(tmp_path / "pages"), "search", "garden workshop"])
    out = capsys.readouterr().out
    assert '"state": "ready"' in out and "URL: /p/" in out


def test_candidates_read_ids_and_texts_alone(spark):
    found = search.lexical_candidates(tables.read_chunks(spark, _stored_chunks(spark)), ["garden"], 5)
    read = [line for line in found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n") if line.startswith("ReadSchema")]
    assert any("chunk_text" in line and "embedding" not in line and "url" not in line for line in read)


def _stored_chunks(spark):
    from lorekeep.sources.folders import shared_folder

    path = shared_folder(spark, "chunks")
    tables.chunks(spark, SF).select(*[c.split()[0] for c in tables.CHUNKS.split(", ")]).write.parquet(path)
    return path
