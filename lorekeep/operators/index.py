"""Keeping an index in step with its pages, and reports about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS = 80
MOST_PAGES = 500


def indexable(listed_only: bool = False) -> Column:
    """Whether a page (is_draft, is_listed, template, page_id, exclude) may be indexed; missing flags don't forbid it."""
    listed = F.lit(True) if not listed_only else F.coalesce("is_listed", F.lit(False))
    return (
        ~F.coalesce("is_draft", F.lit(False)) & listed & ~F.coalesce("template", F.lit("")).isin("search-settings", "error")
        & (F.coalesce("page_id", F.lit("")) != "search-settings") & ~F.coalesce("exclude", F.lit(False))
    )


def changes(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """page_key, change: unchanged, changed, new or stale, by content hash; `stored` has a row for each chunk."""
    old = stored.groupBy("page_key").agg(F.min("content_hash").alias("_old"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("content_hash").isNull(), "stale").when(F.col("_old") == F.col("content_hash"), "unchanged").otherwise("changed")
    return docs.select("page_key", "content_hash").join(old, "page_key", "full_outer").select("page_key", change.alias("change"))


def stale_pages(stored: DataFrame, docs: DataFrame) -> DataFrame:
    return indexed_pages(stored).join(docs.select("page_key"), "page_key", "left_anti")


def indexed_pages(stored: DataFrame) -> DataFrame:
    return stored.groupBy("page_key").agg(F.min("page_id").alias("page_id"))


def replaced(stored: DataFrame, fresh: DataFrame, dims: int | None = None) -> DataFrame:
    """The snapshot after all chunks of the pages in `fresh` were replaced. With `dims`, a chunk without a vector of that length fails the job."""
    if dims is not None:
        wrong = F.col("embedding").isNull() | (F.size("embedding") != dims)
        fresh = fresh.withColumn("embedding", F.when(wrong, F.raise_error(F.lit("a chunk has no vector of the right length"))).otherwise(F.col("embedding")))
    return stored.join(fresh.select("page_key").distinct(), "page_key", "left_anti").select(*stored.columns).unionByName(fresh)


def deleted(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys.select("page_key"), "page_key", "left_anti").select(*stored.columns)


def refreshed(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """The snapshot with new page_id, url, title and page_modified where `pages` has them; vectors stay."""
    names = ["page_id", "url", "title", "page_modified"]
    new = pages.select("page_key", *[F.col(c).alias(f"_{c}") for c in names])
    return stored.join(new, "page_key", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in names}).select(*stored.columns)


def truncated(stored: DataFrame) -> DataFrame:
    return stored.limit(0)


def statistics(stored: DataFrame, fingerprint: str) -> DataFrame:
    """One row: chunks, pages, compatible chunks and pages, models, dims, fingerprints, last_indexed, incompatible_pages."""
    fits = F.col("index_fingerprint") == fingerprint
    return stored.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("page_key").alias("pages"), F.count_if(fits).alias("compatible_chunks"),
        F.count_distinct(F.when(fits, F.col("page_key"))).alias("compatible_pages"), F.sort_array(F.collect_set("embedding_model")).alias("models"),
        F.sort_array(F.collect_set("dims")).alias("dims"), F.sort_array(F.collect_set("index_fingerprint")).alias("fingerprints"), F.max("indexed_at").alias("last_indexed"),
    ).withColumn("incompatible_pages", F.greatest(F.lit(0), F.col("pages") - F.col("compatible_pages")))


def partial_states(stored: DataFrame, bucket: Column) -> DataFrame:
    """What `statistics` needs of each bucket, where a page's chunks lie in one: a row for each bucket and configuration (fingerprint,
    model, dims) with its chunks, pages, the time of its last one, and those pages counted here and under no earlier configuration of the
    page (own_pages), or of its fingerprint (fit_pages). States of other buckets are simply added."""
    config = F.struct(F.col("index_fingerprint").alias("fingerprint"), F.col("embedding_model").alias("model"), F.col("dims"))
    each = stored.select(bucket.alias("bucket"), "page_key", config.alias("config"), "indexed_at").groupBy("bucket", "page_key", "config").agg(F.count(F.lit(1)).alias("chunks"), F.max("indexed_at").alias("last"))
    pages = each.groupBy("bucket", "page_key").agg(F.sort_array(F.collect_list(F.struct("config", "chunks", "last"))).alias("c"))
    at = pages.select("bucket", "c", F.posexplode("c").alias("pos", "one"))
    fresh = (F.col("pos") == 0) | ~F.get("c", F.greatest(F.col("pos") - 1, F.lit(0)))["config"]["fingerprint"].eqNullSafe(F.col("one.config.fingerprint"))
    return at.groupBy("bucket", "one.config").agg(
        F.sum("one.chunks").alias("chunks"), F.count(F.lit(1)).alias("pages"), F.max("one.last").alias("last"), F.count_if(F.col("pos") == 0).alias("own_pages"), F.count_if(fresh).alias("fit_pages")
    ).select("bucket", "config.*", "chunks", "pages", "last", "own_pages", "fit_pages")


def merged_statistics(states: DataFrame, fingerprint: str) -> DataFrame:
    """The row of `statistics` from the states of all buckets."""
    fits = F.col("fingerprint") == fingerprint
    total = lambda c, where=None: F.coalesce(F.sum(c if where is None else F.when(where, F.col(c))), F.lit(0))
    return states.agg(
        total("chunks").alias("chunks"), total("own_pages").alias("pages"), total("chunks", fits).alias("compatible_chunks"), total("fit_pages", fits).alias("compatible_pages"),
        F.sort_array(F.collect_set("model")).alias("models"), F.sort_array(F.collect_set("dims")).alias("dims"), F.sort_array(F.collect_set("fingerprint")).alias("fingerprints"), F.max("last").alias("last_indexed"),
    ).withColumn("incompatible_pages", F.greatest(F.lit(0), F.col("pages") - F.col("compatible_pages")))


def index_state() -> Column:
    """The state of (pages, compatible_pages, eligible, pending, failed, stale, lifecycle_error: a text): the first that holds of

    error (a lifecycle error, failed jobs, stale pages or pages of another configuration), ready (all eligible pages are
    indexed and nothing waits), updating (jobs wait), empty (nothing eligible or stored), not_configured (nothing stored), incomplete."""
    c = F.col
    wrong = (F.coalesce("lifecycle_error", F.lit("")) != "") | (c("failed") > 0) | (c("stale") > 0) | (c("pages") > c("compatible_pages"))
    whole = (c("eligible") > 0) & (F.least("eligible", "compatible_pages") == c("eligible")) & (c("pending") == 0)
    return (
        F.when(wrong, "error").when(whole, "ready").when(c("pending") > 0, "updating")
        .when((c("eligible") == 0) & (c("pages") == 0), "empty").when(c("pages") == 0, "not_configured").otherwise("incomplete")
    )


def percent(indexed: Column, eligible: Column) -> Column:
    return F.when(eligible < 1, 0).otherwise(F.least(F.lit(100), F.round(100 * indexed / eligible).cast("int")))


#: Error texts that a report holds; `n_errors` counts all.
MOST_ERRORS = 100


def merged_results(results: DataFrame) -> DataFrame:
    """Run results (indexed, skipped, deleted, failed, chunks, errors, busy) as one row, with the number of errors; `run_errors` has their texts."""
    sums = [F.sum(c).alias(c) for c in ("indexed", "skipped", "deleted", "failed", "chunks")]
    return results.agg(*sums, F.sum(F.size(F.coalesce("errors", F.array()))).alias("n_errors"), F.bool_or("busy").alias("busy"))


def run_errors(results: DataFrame, most: int = MOST_ERRORS) -> DataFrame:
    """error: the first `most` error texts of all runs, in order; a report of bounded size, as any number of runs may fail."""
    return results.select(F.explode("errors").alias("error")).orderBy("error").limit(most)


def all_errors(results: DataFrame, run: str) -> DataFrame:
    """run, place, error: every error of every run, which in order of (run, place) stand as they came."""
    return results.select(run, F.posexplode("errors").alias("place", "error"))


def related_summaries(links: DataFrame, pages: DataFrame, most: int = 500, policy: Column | None = None) -> DataFrame:
    """page_key, summaries: those of each page's related pages (array `related`), in order, without pages that aren't there or that `policy` hides."""
    shown = pages if policy is None else pages.where(policy)
    each = links.select("page_key", F.posexplode("related").alias("pos", "other"))
    found = each.join(shown.select(F.col("page_key").alias("other"), F.concat(F.col("title"), F.lit(": "), F.substring("summary", 1, most)).alias("s")), "other")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])
    return found.groupBy("page_key").agg(F.array_join(texts, "\n").alias("summaries"))
