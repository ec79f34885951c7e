"""Text of pages from their fields, nested items and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from ..sources.folders import checkpointed

#: One row for each value of a page. `field` is the place of a field of the page; of values within an object, a structure or
#: blocks, `item` is the place of the object, row or block and `cell` that of the value within it, else both are null.
#: `item_type` and `item_hidden` belong to blocks. Relations hold the keys of their pages in `targets`.
CELLS = (
    "page_key string, field int, field_name string, field_type string, field_label map<string,string>, item int, item_type string, item_hidden boolean,"
    " cell int, name string, type string, label map<string,string>, value string, targets array<string>"
)


def _kept(known_blocks: list[str]) -> Column:
    """Whether a cell may be read: no secret or merely technical name, and of blocks only shown ones of a known type without code."""
    page_field = ~F.col("field_name").rlike(T.SECRET) & ~F.col("field_name").isin(T.SKIP_PAGE_FIELDS)
    inner = F.col("item").isNull() | (~F.col("name").rlike(T.SECRET) & ~F.lower("name").isin(T.SKIP_BLOCK_FIELDS))
    block = F.lower("field_type").isin("blocks", "layout")
    # unknown blocks are left out, as their values may be anything
    shown = ~F.coalesce("item_hidden", F.lit(False)) & F.coalesce("item_type", F.lit("")).isin(known_blocks) & ~F.coalesce("item_type", F.lit("")).isin(T.CODE_BLOCKS)
    return page_field & inner & (~block | shown)


def page_summaries(pages: DataFrame, policy: Column | None = None) -> DataFrame:
    """page_key, summary of `pages` (page_key, title and any of teaser, intro, description, text): the cleaned title, and the first
    of these fields that has text and isn't a list or an object, cleaned and cut to 500 characters. Pages that `policy` hides have none."""
    rows = pages if policy is None else pages.where(policy)
    found = []
    for name in ("teaser", "intro", "description", "text"):
        if name in pages.columns:
            raw = T.trimmed(F.coalesce(name, F.lit("")))
            found.append(F.when((raw != "") & ~raw.rlike(r"^[\[{]"), F.nullif(T.html_text(raw), F.lit(""))))
    title, text = T.html_text(F.coalesce("title", F.lit(""))), F.coalesce(*found, F.lit(None).cast("string"))
    lines = F.array(F.when(title != "", F.concat(F.lit("Titel: "), title)), F.when(text.isNotNull(), F.concat(F.lit("Kurzbeschreibung: "), F.substring(text, 1, 500))))
    return rows.select("page_key", F.array_join(F.array_compact(lines), "\n").alias("summary")).where("summary <> ''")


def fields_text(cells: DataFrame, known_blocks: list[str], summaries: DataFrame | None = None) -> DataFrame:
    """page_key, text of pages with any text, from their CELLS: cleaned values under their labels, in order.

    Values of an item stand one a line, items and fields with a blank line between. Types are told apart: prose and plain fields
    are read, relations give the summaries (page_key, summary) of their pages, nested fields and blocks what they hold; all
    other types are no prose. Cells are dealt once, by page; all steps keep to that."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    container = F.lower("field_type").isin(*T.NESTED_TYPES, "blocks", "layout")
    rows = cells.where(_kept(known_blocks)).where(F.col("item").isNull() != container).withColumn("_type", F.when(F.col("item").isNull(), F.lower("field_type")).otherwise(kind))
    plain = rows.where(F.col("_type").isin(*T.PROSE_TYPES, *T.PLAIN_TYPES)).withColumn("_text", T.html_text(F.coalesce("value", F.lit(""))))
    place = ["page_key", "field", "item", "cell"]
    keep = [*place, "field_label", "label", "_text"]
    found = plain.select(*keep)
    if summaries is not None:
        asked = rows.where(F.col("_type").isin(T.RELATION_TYPES)).select(*place, "field_label", "label", F.posexplode("targets").alias("_pos", "_target"))
        met = asked.join(summaries.select(F.col("page_key").alias("_target"), "summary"), "_target")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "summary"))), lambda x: x["summary"]), "\n\n")
        related = met.groupBy(*place).agg(joined.alias("_text"), F.first(F.struct("field_label", "label")).alias("_l")).select(*place, "_l.field_label", "_l.label", "_text")
        found = found.unionByName(related)
    found = found.where("_text <> ''").repartition("page_key")

    def gathered(order: str, text: str, between: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), between)

    named = found.withColumn("_text", F.when(F.col("item").isNotNull(), T.labelled(T.first_label(F.col("label")), F.col("_text"))).otherwise(F.col("_text")))
    items = named.groupBy("page_key", "field", "item").agg(F.first("field_label").alias("field_label"), gathered("cell", "_text", "\n").alias("_text"))
    fields = items.groupBy("page_key", "field").agg(F.first("field_label").alias("field_label"), gathered("item", "_text", "\n\n").alias("_text"))
    fields = fields.withColumn("_text", T.labelled(T.first_label(F.col("field_label")), F.col("_text")))
    return fields.groupBy("page_key").agg(gathered("field", "_text", "\n\n").alias("text"))


#: One row for each node of a page's content, whatever its depth. `path` has the place at each level: a field of the page is [3], the rows of a
#: structure, the object of an object field or the blocks of a blocks field are [3, 0], [3, 1], ..., fields within one [3, 0, 2] and so on; a layout
#: has rows, these columns, and these blocks. `kind` is field, item, block, row or column, `type` that of a field or block.
NODES = "page_key string, path array<int>, kind string, name string, type string, label map<string,string>, hidden boolean, value string, targets array<string>"


def _node_kept(known_blocks: list[str]) -> Column:
    """Whether a node may be read: no secret or merely technical field, no hidden, unknown or code block. What lies below one that isn't goes with it."""
    inner, name = F.size("path") > 1, F.coalesce("name", F.lit(""))
    field = ~name.rlike(T.SECRET) & F.when(inner, ~F.lower(name).isin(T.SKIP_BLOCK_FIELDS)).otherwise(~name.isin(T.SKIP_PAGE_FIELDS))
    block = ~F.coalesce("hidden", F.lit(False)) & F.coalesce("type", F.lit("")).isin(known_blocks) & ~F.coalesce("type", F.lit("")).isin(T.CODE_BLOCKS)
    return F.when(F.col("kind") == "field", field).when(F.col("kind") == "block", block).otherwise(True)


def tree_text(nodes: DataFrame, known_blocks: list[str], summaries: DataFrame | None = None) -> DataFrame:
    """page_key, text of pages with any text, from their NODES, nested to any depth.

    Levels are folded from the deepest up: the texts of a node's children, in order, become its own, fields under their labels. Fields of an
    item or block stand one a line, all else has a blank line between. A field is read by its type: prose and plain ones have their value,
    relations the summaries (page_key, summary) of their pages, structures, objects, blocks and layouts what lies below; others nothing.
    Nodes are dealt once, by page, and every level keeps to that. The driver learns the greatest depth alone."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    rows = nodes.where(_node_kept(known_blocks)).withColumn("_type", F.when(F.col("kind") == "field", kind))
    leaf = F.col("_type").isin(*T.PROSE_TYPES, *T.PLAIN_TYPES)
    rows = rows.withColumn("_text", F.when(leaf, T.html_text(F.when(leaf, F.coalesce("value", F.lit(""))))))
    if summaries is not None:
        asked = rows.where(F.col("_type").isin(T.RELATION_TYPES)).select("page_key", "path", F.posexplode("targets").alias("_pos", "_target"))
        met = asked.join(summaries.select(F.col("page_key").alias("_target"), "summary"), "_target")
        related = met.groupBy("page_key", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "summary"))), lambda x: x["summary"]), "\n\n").alias("_related"))
        rows = rows.join(related, ["page_key", "path"], "left").withColumn("_text", F.coalesce("_text", "_related"))
    holds = (F.col("kind") != "field") | F.col("_type").isin(*T.NESTED_TYPES, "blocks", "layout")
    rows = rows.select("page_key", "path", "kind", holds.alias("_holds"), T.first_label(F.col("label")).alias("_label"), "_text").repartition("page_key")
    # kept once, as each level reads it
    rows = checkpointed(rows)
    below = None
    for depth in range(nodes.agg(F.max(F.size("path"))).first()[0] or 0, 0, -1):
        level = rows.where(F.size("path") == depth)
        if below is not None:
            level = level.join(below, ["page_key", "path"], "left").withColumn("_text", F.when(F.col("_holds"), F.col("_inner")).otherwise(F.col("_text")))
        text = F.when(F.col("kind") == "field", T.labelled(F.col("_label"), F.col("_text"))).otherwise(F.col("_text"))
        texts = level.where("_text <> ''").select("page_key", F.slice("path", 1, depth - 1).alias("path"), F.element_at("path", -1).alias("_at"), text.alias("_text"), (F.col("kind") == "field").alias("_field"))
        joined = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"])
        lines = F.bool_and("_field") & F.lit(depth > 1)
        below = texts.groupBy("page_key", "path").agg(F.when(lines, F.array_join(joined, "\n")).otherwise(F.array_join(joined, "\n\n")).alias("_inner"))
    if below is None:
        return nodes.select("page_key", F.lit("").alias("text")).limit(0)
    return below.select("page_key", F.col("_inner").alias("text"))
