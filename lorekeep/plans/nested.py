"""The query of nested content: blocks in structures, structures in blocks, columns of layouts, relations in objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction, index
from ..sources import tables as S
from .registry import DOCS, PAGES, _pages, query


def _nodes(spark, d):
    """Fields of every document, nested up to seven levels, with its columns as values."""
    k = F.col("doc_id")

    def node(path, kind, type_=None, value=None, name=None, label=None, hidden=None, targets=None):
        none = F.lit(None)
        return F.struct(
            F.array(*map(F.lit, path)).alias("path"), F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("name"), F.lit(type_).cast("string").alias("type"),
            (F.create_map(F.lit("de"), F.lit(label)) if label else none.cast("map<string,string>")).alias("label"), (none if hidden is None else hidden).cast("boolean").alias("hidden"),
            (none if value is None else value).cast("string").alias("value"), (none if targets is None else targets).cast("array<string>").alias("targets"),
        )

    made = F.array(
        node([0], "field", "text", F.col("source"), "title"),
        node([1], "field", "blocks", name="body"),
        node([1, 0], "block", "text", hidden=F.lit(False)), node([1, 0, 0], "field", "writer", F.lit("<p>in a block</p>"), "text"),
        node([1, 0, 1], "field", "structure", name="facts", label="Facts"),
        node([1, 0, 1, 0], "item"), node([1, 0, 1, 0, 0], "field", "text", k, "size", "Size"),
        node([1, 0, 1, 1], "item"), node([1, 0, 1, 1, 0], "field", "text", F.lit("hidden"), "apiKey"), node([1, 0, 1, 1, 1], "field", "select", F.col("lang"), "kind"),
        node([1, 1], "block", "code"), node([1, 1, 0], "field", "textarea", F.lit("x = 1"), "text"),
        node([1, 2], "block", "card", hidden=k % 2 == 1), node([1, 2, 0], "field", "object", name="target", label="Ziel"), node([1, 2, 0, 0], "item"),
        node([1, 2, 0, 0, 0], "field", "pages", name="pages", targets=F.array(F.concat(F.lit("page://"), (k + 2).cast("string")), F.concat(F.lit("page://"), (k + 1).cast("string")))),
        node([1, 2, 0, 0, 1], "field", "text", F.concat(F.lit("n"), k.cast("string")), "note"),
        node([2], "field", "structure", name="rows"), node([2, 0], "item"), node([2, 0, 0], "field", "blocks", name="content", label="Inhalt"),
        node([2, 0, 0, 0], "block", "text"), node([2, 0, 0, 0, 1], "field", "text", F.lit("deep"), "text"),
        node([2, 0, 0, 0, 0], "field", "structure", name="more"), node([2, 0, 0, 0, 0, 0], "item"), node([2, 0, 0, 0, 0, 0, 0], "field", "textarea", F.concat(F.lit("deepest "), F.col("source")), "text"),
        node([3], "field", "layout", name="grid"), node([3, 0], "row"), node([3, 0, 1], "column"), node([3, 0, 0], "column"),
        node([3, 0, 0, 0], "block", "text"), node([3, 0, 0, 0, 0], "field", "text", F.lit("left"), "text"),
        node([3, 0, 1, 0], "block", "list"), node([3, 0, 1, 0, 0], "field", "list", F.col("lang"), "text"), node([3, 0, 1, 1], "block", "own-block"), node([3, 0, 1, 1, 0], "field", "text", F.lit("unknown"), "text"),
        node([4], "field", "email", F.lit("x@example.org"), "mail"), node([5], "field", "blocks", name="secretBlocks"), node([5, 0], "block", "text"), node([5, 0, 0], "field", "text", F.lit("secret"), "text"),
    )
    return S.table(spark, d, "documents").select(F.concat(F.lit("page://"), k.cast("string")).alias("page_key"), F.explode(made).alias("n")).select("page_key", "n.*")


@query(
    "tree_text",
    f"""WITH {DOCS}, {PAGES}, s AS (SELECT doc_id, 'Titel: ' || title || chr(10) || 'Kurzbeschreibung: ' || lang AS s FROM pages_ WHERE NOT is_draft AND template NOT IN ('search-settings', 'error') AND NOT exclude),
r AS (SELECT d.doc_id, string_agg(s, chr(10) || chr(10) ORDER BY s.doc_id DESC) AS rel FROM documents d JOIN s ON s.doc_id IN (d.doc_id + 1, d.doc_id + 2) GROUP BY d.doc_id)
SELECT 'page://' || d.doc_id AS page_key, concat_ws(chr(10) || chr(10), source, 'in a block' || chr(10) || 'Facts: Size: ' || d.doc_id || chr(10) || chr(10) || lang,
  CASE WHEN d.doc_id % 2 = 0 THEN 'Ziel: ' || concat_ws(chr(10), rel, 'n' || d.doc_id) END, 'Inhalt: deepest ' || source || chr(10) || 'deep', 'left', lang) AS text FROM documents d LEFT JOIN r USING (doc_id)""",
)
def tree_text(spark, d):
    summaries = extraction.page_summaries(_pages(spark, d).select("page_key", "title", F.lit(" ").alias("teaser"), F.lit("[1]").alias("intro"), F.col("lang").alias("text"), "is_draft", "template", "page_id", "exclude"), index.indexable())
    return extraction.tree_text(_nodes(spark, d), ["text", "code", "card", "list"], summaries)
