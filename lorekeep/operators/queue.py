"""A keyed work queue as tables: the latest state of each page, claimed in order, finished by revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.folders import checkpointed

MOST_ATTEMPTS = 3


def debounced(events: DataFrame) -> DataFrame:
    """The queue after events (page_key, page_id, operation, enqueued_at, seq): the newest of a page wins, its revision counts them all."""
    latest = F.max_by(F.struct("page_id", "operation", "enqueued_at"), F.struct("enqueued_at", "seq"))
    return events.groupBy("page_key").agg(latest.alias("e"), F.count(F.lit(1)).cast("int").alias("revision"), F.min("seq").alias("first_seq")).select(
        "page_key", "e.page_id", "e.operation", "e.enqueued_at", F.lit(0).alias("attempts"), "revision", F.lit(None).cast("string").alias("last_error"), "first_seq"
    )


def enqueued(queue: DataFrame, events: DataFrame) -> DataFrame:
    """The queue after more events: revisions go on, attempts and errors are cleared, and a page keeps its place."""
    new, old = debounced(events).alias("n"), queue.alias("q")
    pick = {c: F.coalesce(f"n.{c}", f"q.{c}") for c in ("page_id", "operation", "enqueued_at", "attempts")}
    return new.join(old, "page_key", "full_outer").select(
        "page_key", *[v.alias(k) for k, v in pick.items()], (F.coalesce("n.revision", F.lit(0)) + F.coalesce("q.revision", F.lit(0))).alias("revision"),
        F.when(F.col("n.revision").isNull(), F.col("q.last_error")).alias("last_error"), F.coalesce("q.first_seq", "n.first_seq").alias("first_seq"),
    )


def transitions(moves: DataFrame) -> DataFrame:
    """Moves (old_key, old_id, new_key, new_id, at) as events: the old page's deletion, then the new page's upsert a second later."""
    pair = F.array(
        F.struct(F.col("old_key").alias("page_key"), F.col("old_id").alias("page_id"), F.lit("delete").alias("operation"), F.col("at").alias("enqueued_at")),
        F.struct(F.col("new_key").alias("page_key"), F.col("new_id").alias("page_id"), F.lit("upsert").alias("operation"), (F.col("at") + 1).alias("enqueued_at")),
    )
    return moves.select(F.explode(pair).alias("e")).select("e.*")


def inserted_missing(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """The queue with rows for pages that it lacks; what is there stays as it is."""
    return queue.unionByName(rows.join(queue.select("page_key"), "page_key", "left_anti").select(*queue.columns))


def order() -> list[Column]:
    """Deletions first, then by age, then as they first came."""
    return [F.when(F.col("operation") == "delete", 0).otherwise(1), F.col("enqueued_at"), F.col("first_seq")]


def claimed(queue: DataFrame, n: int | None) -> DataFrame:
    """The next n jobs, or all, that haven't failed too often: deletions first, then by age."""
    rows = queue.where(F.col("attempts") < MOST_ATTEMPTS)
    return rows if n is None else rows.orderBy(*order()).limit(n)


def placed(rows: DataFrame, *by: Column | str) -> DataFrame:
    """`rows` with `position`, from 1, in the order of `by`. Rows are cut into ranges of the whole order, of which the driver only learns the
    bounds that Spark samples; each range is numbered by itself, behind the counts of those before it, of which there is one a task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_range").cast("long"), 33)))
    sums = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn("position", F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def positions(queue: DataFrame) -> DataFrame:
    """Jobs with their place in the queue, deletions first; jobs of one time are spread like others."""
    names = ["_first", "_since", "_seq"]
    rows = queue.withColumns(dict(zip(names, order())))
    return placed(rows, *names).drop(*names)


def cleared(queue: DataFrame) -> DataFrame:
    return queue.limit(0)


def drained(queue: DataFrame, stored: DataFrame, live: DataFrame, troubles: DataFrame, n: int | None, budget: float | None = None) -> DataFrame:
    """page_key, revision, outcome, error of the next `n` jobs, or all: removed, indexed, skipped, failed or waiting.

    `live` (page_id, content_hash; null where the policy forbids the page) has the pages that are there, `stored` (page_key,
    content_hash) the index, and `troubles` (page_key, error) the jobs whose work failed. A deletion, and a page that isn't
    there or isn't allowed any more, is removed; a page with the stored hash is skipped. Once a deletion fails, the jobs
    behind it wait, as a move's upsert must not overtake it. With `budget`, jobs wait that begin when earlier ones have
    cost (column `cost` of the queue) that much; only then, for the few jobs that one run claims, does a window order them all."""
    if budget is not None and n is None:
        raise ValueError("a budget needs a number of jobs")
    cost = F.col("cost") if budget is not None else F.lit(0.0)
    jobs = claimed(queue.withColumn("_cost", cost), n).select("page_key", "page_id", "operation", "revision", "_cost", F.struct(*order()).alias("_order"))
    jobs = jobs.join(troubles.select("page_key", F.col("error").alias("_error")), "page_key", "left")
    pages = live.select("page_id", F.col("content_hash").alias("_new"), F.lit(True).alias("_there"))
    old = stored.groupBy("page_key").agg(F.min("content_hash").alias("_old"))
    # one row: the first deletion that failed
    first = jobs.where((F.col("operation") == "delete") & F.col("_error").isNotNull()).agg(F.min("_order").alias("_first"))
    rows = jobs.join(F.broadcast(first)).join(pages, "page_id", "left").join(old, "page_key", "left")
    stopped = F.coalesce(F.col("_order") > F.col("_first"), F.lit(False))
    spent = F.lit(False)
    if budget is not None:
        earlier = W.orderBy("_order").rowsBetween(W.unboundedPreceding, -1)
        spent = F.coalesce(F.sum("_cost").over(earlier), F.lit(0.0)) >= budget
    gone = (F.col("operation") == "delete") | F.col("_there").isNull() | F.col("_new").isNull()
    outcome = F.when(stopped | spent, "waiting").when(F.col("_error").isNotNull(), "failed").when(gone, "removed").when(F.col("_new") == F.col("_old"), "skipped").otherwise("indexed")
    return rows.withColumn("outcome", outcome).select("page_key", "revision", "outcome", F.when(F.col("outcome") == "failed", F.col("_error")).alias("error"))


def after_drain(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue after a run: what was done is gone unless it changed meanwhile, and failures have an attempt more."""
    done = outcomes.where(F.col("outcome").isin("removed", "withdrawn", "indexed", "skipped"))
    return failed(completed(queue, done), outcomes.where("outcome = 'failed'").select("page_key", "revision", "error"))


def drain_result(outcomes: DataFrame) -> DataFrame:
    """One row: indexed, skipped, deleted, failed and waiting jobs of a run; a page that is there but not to be indexed (withdrawn) is skipped."""
    names = {"indexed": ["indexed"], "skipped": ["skipped", "withdrawn"], "deleted": ["removed"], "failed": ["failed"], "waiting": ["waiting"]}
    return outcomes.agg(*[F.count_if(F.col("outcome").isin(v)).alias(k) for k, v in names.items()])


def completed(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without finished jobs (page_key, revision) that weren't changed meanwhile."""
    return queue.join(done.select("page_key", "revision"), ["page_key", "revision"], "left_anti").select(*queue.columns)


def failed(queue: DataFrame, failures: DataFrame) -> DataFrame:
    """The queue with an attempt more and the error, cut to 500 characters, for failures (page_key, revision, error) of this revision."""
    f = failures.select("page_key", "revision", F.substring("error", 1, 500).alias("_error"), F.lit(1).alias("_hit"))
    return queue.join(f, ["page_key", "revision"], "left").withColumns({"attempts": F.col("attempts") + F.coalesce("_hit", F.lit(0)), "last_error": F.when(F.col("_hit") == 1, F.col("_error")).otherwise(F.col("last_error"))}).select(*queue.columns)


def counts(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("attempts") < MOST_ATTEMPTS).alias("pending"), F.count_if(F.col("attempts") >= MOST_ATTEMPTS).alias("failed"))


def latest_failures(queue: DataFrame, n: int) -> DataFrame:
    return queue.where(F.col("attempts") >= MOST_ATTEMPTS).orderBy(F.desc("enqueued_at"), "page_key").limit(n)


def rebuild_plan(stored: DataFrame, docs: DataFrame, most: int | None = None, force: bool = False) -> DataFrame:
    """page_key, operation: deletions of what isn't to be indexed any more, and upserts of the first `most` pages, or all.

    A forced rebuild begins with an empty index and queue (`index.truncated`, `cleared`), so there is nothing to delete."""
    if most is None and not force:
        # the pages are read once
        both = stored.select("page_key").distinct().join(docs.select("page_key", F.lit(True).alias("_there")), "page_key", "full_outer")
        return both.select("page_key", F.when(F.col("_there"), "upsert").otherwise("delete").alias("operation"))
    gone = stored.select("page_key").distinct().join(docs.select("page_key"), "page_key", "left_anti").select("page_key", F.lit("delete").alias("operation"))
    kept = docs.select("page_key") if most is None else docs.select("page_key").orderBy("page_key").limit(most)
    kept = kept.select("page_key", F.lit("upsert").alias("operation"))
    return kept if force else gone.union(kept)


def lifecycle_events(pages: DataFrame) -> DataFrame:
    """Edits (old_key, old_id, new_key, new_id, allowed, at) as events: not allowed deletes both keys, a new key is a move, else an upsert."""
    def event(key: str, page: str, operation: str, wait: int = 0) -> Column:
        return F.struct(F.col(key).alias("page_key"), F.col(page).alias("page_id"), F.lit(operation).alias("operation"), (F.col("at") + wait).alias("enqueued_at"))

    moved = F.col("old_key") != F.col("new_key")
    what = F.when(~F.col("allowed") & moved, F.array(event("old_key", "old_id", "delete"), event("new_key", "new_id", "delete")))
    what = what.when(~F.col("allowed"), F.array(event("new_key", "new_id", "delete")))
    what = what.when(moved, F.array(event("old_key", "old_id", "delete"), event("new_key", "new_id", "upsert", 1))).otherwise(F.array(event("new_key", "new_id", "upsert")))
    return pages.select(F.explode(what).alias("e")).select("e.*")


def moved_subtrees(moves: DataFrame, pages: DataFrame) -> DataFrame:
    """Edits for `lifecycle_events` of every page at or below a moved page: old_key, old_id, new_key, new_id, allowed, at.

    `moves` are (old_id, new_id, at), `pages` (page_key, page_id, allowed) the pages as they are now. A key that is the page's own
    stays; one made of its id changes with it. Each page looks its few ancestors up, so a large subtree is no hot key."""
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("page_id", "/"))), lambda k: F.array_join(F.slice(F.split("page_id", "/"), 1, k), "/"))
    below = pages.withColumn("new_id", F.explode(up)).join(moves.select("new_id", F.col("old_id").alias("_old"), "at"), "new_id")
    old_id = F.concat("_old", F.expr("substring(page_id, length(new_id) + 1)"))
    own = F.startswith("page_key", F.lit("page://"))
    return below.select(
        F.when(own, F.col("page_key")).otherwise(F.concat(F.lit("page-id://"), old_id)).alias("old_key"), old_id.alias("old_id"), F.col("page_key").alias("new_key"), F.col("page_id").alias("new_id"), "allowed", "at"
    )


def rekeyed(pages: DataFrame, old: str, new: str) -> DataFrame:
    """page_id, old_id of the pages below a moved page, which isn't any page whose name only begins alike."""
    return pages.where(F.startswith("page_id", F.lit(new + "/"))).select("page_id", F.concat(F.lit(old), F.right("page_id", F.char_length("page_id") - len(new))).alias("old_id"))
