"""A knowledge base in bucketed tables: queue, drain with per-page errors, status, search; every change is one commit."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as L
from ..functions.texts import content_hash, index_fingerprint, trimmed
from ..sources import tables as S
from ..sources.manifest import BUCKETS, BucketedTables, LostCommit, Manifest
from . import chunking, index, queue, search

CLAIM = 50
#: Up to so many jobs of a run, their keys are sent to the scans of pages and chunks instead of shuffling those.
FEW = 10_000
#: Beyond so many keys, they are hashed.
MANY = 1_000_000
#: Up to so many keys of pages that failed are sent to every task.
SENT = 200_000
ERRORS = "run long, place long, page_id string, page_key string, error string"
_STATE = ("fingerprint", "model", "dims", "chunks", "pages", "last", "own_pages", "fit_pages")


class Remover(Protocol):
    """What else must forget a page that is deleted; an exception counts as a failed deletion. May be asked again."""

    def remove(self, page_key: str) -> None: ...


class Store:
    """Chunks and jobs below `root`; `pages` (page_key, page_id, url, title, text, modified and the policy's columns; page_id is its key) is what
    should be indexed. Runs that meet are told apart by their commits: one that lost reads again, so nothing is done twice or half."""

    def __init__(
        self, spark: SparkSession, root: str, pages: DataFrame, provider: S.EmbeddingProvider, chunk_chars: int = 1200, overlap: int = 200,
        buckets: int = BUCKETS, most_chunks: int | None = chunking.MOST_CHUNKS, remover: Remover | None = None, tries: int = 3, wait: float = 0.5,
    ):
        self.spark, self.root, self.pages, self.provider, self.remover = spark, root.rstrip("/"), pages, provider, remover
        self.sizes, self.most_chunks, self.asks = (S.within("chunk_chars", chunk_chars), S.within("overlap", overlap)), most_chunks, (tries, wait)
        made = index_fingerprint(F.lit(getattr(provider, "base_url", "")), F.lit(provider.dims), F.lit(provider.model), *map(F.lit, self.sizes))
        self.fingerprint = spark.range(1).select(made.alias("f")).first().f
        self.tables = BucketedTables(spark, self.root, {"chunks": S.CHUNKS, "jobs": S.QUEUE + ", first_seq long"}, buckets)

    # ---- what is there

    def chunks(self) -> DataFrame:
        return self.tables.read("chunks")

    def queue(self) -> DataFrame:
        return self.tables.read("jobs")

    def errors(self) -> DataFrame:
        """run, place, page_id, page_key, error: all errors of all runs; by run and place they stand as they came."""
        path = f"{self.root}/errors"
        return self.spark.read.schema(ERRORS).parquet(path) if self.tables.folders.names(path) else self.spark.createDataFrame([], ERRORS)

    @staticmethod
    def _eligible() -> Column:
        return index.indexable() & (F.char_length(trimmed(F.coalesce("text", F.lit("")))) >= index.MIN_CHARS)

    def live(self) -> DataFrame:
        """Pages that may be indexed and are long enough, with their content hashes."""
        return self.pages.where(self._eligible()).withColumn("content_hash", content_hash(F.col("title"), F.col("text")))

    def _fitting(self, chunks: DataFrame) -> DataFrame:
        return S.compatible(chunks, self.provider.model, self.provider.dims, self.fingerprint)

    # ---- commits

    def _change(self, make: Callable[[Manifest], tuple], tries: int = 5):
        """Commits what `make` makes on the newest manifest: (changes, facts, meta, result); made anew where others came first."""
        for _ in range(tries):
            base = self.tables.head()
            changes, facts, meta, result = make(base)
            try:
                if changes or meta:
                    self.tables.commit(base, changes, facts, meta)
                return result
            except LostCommit:
                continue
        raise LostCommit(f"others came first {tries} times")

    def set_meta(self, **values: str) -> None:
        self._change(lambda base: ({}, {}, {k: str(v) for k, v in values.items()}, None))

    def _jobs(self, base: Manifest, rows: DataFrame, touched: set[int]) -> tuple[dict, dict]:
        """The changed buckets of the queue and how many of their jobs wait and have failed for good."""
        staged = self.tables.staged("jobs", base, rows, touched)
        new = self.tables.read("jobs", Manifest(0, base.buckets, {"jobs": {b: p for b, p in staged.items() if p}}))
        found = {r.b: [r.pending, r.failed] for r in new.groupBy(self.tables.bucket(base).alias("b")).agg(F.count_if(F.col("attempts") < queue.MOST_ATTEMPTS).alias("pending"), F.count_if(F.col("attempts") >= queue.MOST_ATTEMPTS).alias("failed")).collect()}
        return staged, {b: found.get(b) for b in touched}

    def _chunks(self, base: Manifest, rows: DataFrame, touched: set[int]) -> tuple[dict, dict]:
        """The changed buckets of the chunks and their part of the index's statistics."""
        staged = self.tables.staged("chunks", base, rows, touched)
        new = self.tables.read("chunks", Manifest(0, base.buckets, {"chunks": {b: p for b, p in staged.items() if p}}))
        states: dict[int, list | None] = dict.fromkeys(touched)
        for r in index.partial_states(new, self.tables.bucket(base)).collect():
            states[r.bucket] = [*(states[r.bucket] or []), [r[c] for c in _STATE]]
        return staged, states

    # ---- queueing

    def _enqueued(self, base: Manifest, events: DataFrame) -> tuple[dict, dict]:
        with self._staging() as kept:
            # what gives the events may read all pages, once
            events = kept(events, "events")
            touched = self.tables.touched(base, events)
            if not touched:
                return {}, {}
            staged, facts = self._jobs(base, queue.enqueued(self.tables.read("jobs", base, touched), events), touched)
            return {"jobs": staged}, {"jobs": facts}

    def enqueue(self, plan: DataFrame, at: int) -> None:
        """Adds operations (page_key, operation) to the queue, under the page's present id or else the one it was indexed under."""

        def make(base: Manifest) -> tuple:
            stored = index.indexed_pages(self.tables.read("chunks", base)).withColumnRenamed("page_id", "_old")
            known = plan.join(self.pages.select("page_key", "page_id"), "page_key", "left").join(stored, "page_key", "left")
            events = known.select("page_key", F.coalesce("page_id", "_old").alias("page_id"), "operation", F.lit(at).cast("long").alias("enqueued_at"), F.xxhash64("page_key").alias("seq"))
            return (*self._enqueued(base, events.where("page_id IS NOT NULL")), {}, None)

        self._change(make)

    def _emptied(self, base: Manifest) -> tuple:
        return {t: dict.fromkeys(x) for t, x in base.tables.items()}, {t: dict.fromkeys(x) for t, x in base.facts.items()}, {}, None

    def rebuild(self, force: bool = False, at: int = 0, deadline: float | None = None) -> dict:
        """Queues what an index of the live pages needs, and drains it; forced, index and queue begin empty."""
        if force:
            self._change(self._emptied)
        self.enqueue(queue.rebuild_plan(self.chunks(), self.live(), force=force), at)
        return self.drain(None, deadline)

    # ---- draining

    @contextmanager
    def _staging(self) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
        folder = f"{self.root}/staging/{uuid.uuid4().hex}"

        def staged(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{folder}/{name}")
            return self.spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

        try:
            yield staged
        finally:
            self.tables.folders.delete(folder)

    def drain(self, n: int | None = CLAIM, deadline: float | None = None) -> dict:
        """Works through the next n jobs, or all, and gives their counts. Embeddings that are due at `deadline` (seconds of the clock) wait.

        A page whose embedding fails keeps its old chunks, and its job an attempt more and the error; the others are indexed. Where a
        deletion fails, what is behind it waits, as a move's upsert must not overtake it. Only the buckets of what was done are written."""
        began = time.time_ns()

        def make(base: Manifest) -> tuple:
            with self._staging() as staged:
                return self._drained(base, n, deadline, began, staged)

        found = self._change(make)
        pending = sum(f[0] for f in self.tables.head().facts.get("jobs", {}).values())
        return {k: found[k] for k in ("indexed", "skipped", "deleted", "failed", "waiting")} | {"pending": pending}

    def outcomes(self, base: Manifest, n: int | None, deadline: float | None, staged: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """What becomes of the next jobs, each asked for once: (page_key, page_id, revision, target, outcome, error, place, changes), and the new chunks.

        target is the key under which the page's chunks lie; changes says whether the index has to be written for it."""
        claims = queue.claimed(self.tables.read("jobs", base), n).select("page_key", "page_id", "operation", "revision", F.struct(*queue.order()).alias("place"))
        claims = staged(claims, "claims")
        sent = _sent(jobs := claims.count())
        ids = claims.where("operation <> 'delete'").select("page_id").distinct()
        names = ["page_id", "page_key", "url", "title", F.col("modified").cast("long").alias("modified"), F.coalesce(self._eligible(), F.lit(False)).alias("ok"), content_hash(F.col("title"), F.col("text")).alias("hash")]
        # of many jobs' pages only the hashes are shuffled
        asked = self.pages if jobs > FEW else self.pages.join(sent(ids), "page_id", "left_semi")
        now = asked.select(*names).select("page_id", F.struct("page_key", "url", "title", "modified", "ok", "hash").alias("page"))
        # a deletion looks no page up
        jobs = claims.join(now, "page_id", "left").withColumn("page", F.when(F.col("operation") != "delete", F.col("page"))).withColumn("target", F.coalesce("page.page_key", "page_key"))
        jobs = staged(jobs, "jobs")
        stored = self.tables.read("chunks", base, self.tables.touched(base, jobs, "target"))
        fits = (F.col("embedding_model") == self.provider.model) & (F.col("dims") == self.provider.dims) & (F.col("index_fingerprint") == self.fingerprint)
        old = stored.groupBy(F.col("page_key").alias("target")).agg(F.min(F.when(fits, F.col("content_hash"))).alias("old_hash"), F.min(F.struct("page_id", "url", "title", "page_modified")).alias("old"))
        step = F.when(F.col("page").isNull(), "removed").when(~F.col("page.ok"), "withdrawn").when(F.col("page.hash") == F.col("old_hash"), "skipped").otherwise("indexed")
        jobs = staged(jobs.join(old, "target", "left").withColumn("step", step), "steps")

        # deletions come first, and stop what is behind one that fails
        errors, stop = None, None
        if self.remover is not None:
            errors = staged(_removed(jobs.where(F.col("step").isin("removed", "withdrawn")).select("page_key").distinct(), self.remover), "removed")
            stop = jobs.where("operation = 'delete'").join(errors.where("error IS NOT NULL"), "page_key").agg(F.min("place").alias("place")).first().place
        due_ids = jobs.where("step = 'indexed'").select("page_id").distinct()
        # where nothing is due no text is read
        due = self.pages.join(sent(due_ids), "page_id", "left_semi").where(F.lit(stop is None and not due_ids.isEmpty()))
        pieces = chunking.chunked(due.withColumn("content_hash", content_hash(F.col("title"), F.col("text"))), *self.sizes, self.most_chunks)
        fresh = pieces.select("page_key", "page_id", "url", "title", F.col("modified").cast("long").alias("page_modified"), "content_hash", "chunk_index", "chunk_text")
        fresh = staged(S.embedded_or_failed(fresh, self.provider, tries=self.asks[0], wait=self.asks[1], deadline=deadline), "fresh")
        bad = fresh.groupBy(F.col("page_key").alias("target")).agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_index"))).alias("ask_error"), F.bool_or("late").alias("late"))
        rows = jobs.join(bad, "target", "left")
        rows = rows.withColumn("error", F.lit(None).cast("string")) if errors is None else rows.join(errors, "page_key", "left")
        rows = rows.withColumn("error", F.when(F.col("step") == "indexed", F.col("ask_error")).otherwise(F.col("error")))
        waits = F.lit(False) if stop is None else F.col("place") > F.struct(*[F.lit(v).cast(t) for v, t in zip(stop, ("int", "long", "long"))])
        outcome = F.when(waits, "waiting").when(F.col("error").isNotNull(), "failed").when(F.col("late"), "waiting")
        # a page of which nothing is left to embed
        outcome = outcome.when((F.col("step") == "indexed") & F.col("late").isNull(), "withdrawn").otherwise(F.col("step"))
        moved = ~F.struct("page_id", "page.url", "page.title", "page.modified").eqNullSafe(F.struct("old.page_id", "old.url", "old.title", "old.page_modified"))
        changes = F.when(F.col("outcome") == "indexed", True).when(F.col("outcome") == "skipped", moved).otherwise(F.col("outcome").isin("removed", "withdrawn") & F.col("old").isNotNull())
        rows = rows.withColumn("outcome", outcome).withColumn("changes", changes)
        return staged(rows.select("page_key", "page_id", "revision", "target", "outcome", F.when(F.col("outcome") == "failed", F.col("error")).alias("error"), "place", "changes", "page"), "outcomes"), fresh

    def _drained(self, base: Manifest, n: int | None, deadline: float | None, run: int, staged: Callable[[DataFrame, str], DataFrame]) -> tuple:
        found, fresh = self.outcomes(base, n, deadline, staged)
        counts = queue.drain_result(found).first().asDict()
        changed, sent = found.where("changes"), _sent(sum(counts.values()))
        new_chunks, new_jobs, facts = {}, {}, {}
        if touched := self.tables.touched(base, changed, "target"):
            stored = self.tables.read("chunks", base, touched)
            gone = changed.where(F.col("outcome").isin("removed", "withdrawn", "indexed")).select(F.col("target").alias("page_key")).distinct()
            moved = changed.where("outcome = 'skipped'").select(F.col("target").alias("page_key"), "page_id", "page.url", "page.title", F.col("page.modified").alias("page_modified")).dropDuplicates(["page_key"])
            indexed = changed.where("outcome = 'indexed'").select(F.col("target").alias("page_key"))
            # the few pages that have failed are sent to the new chunks, so that these go straight to their buckets
            lost = staged(fresh.select("page_key").distinct().join(indexed, "page_key", "left_anti"), "lost")
            made = fresh.where("page_key IS NOT NULL").join(_sent(lost.count(), SENT)(lost), "page_key", "left_anti").select(
                F.xxhash64("page_key", "chunk_index").alias("id"), "page_key", "page_id", "url", "title", "chunk_index", "chunk_text", "embedding", "dims", F.lit(self.provider.model).alias("embedding_model"),
                F.lit(self.fingerprint).alias("index_fingerprint"), "content_hash", "page_modified", F.unix_timestamp().alias("indexed_at"),
            )
            new_chunks, facts["chunks"] = self._chunks(base, index.refreshed(index.deleted(stored, sent(gone)), sent(moved)).unionByName(made), touched)
        if touched := self.tables.touched(base, found.where("outcome <> 'waiting'")):
            new_jobs, facts["jobs"] = self._jobs(base, queue.after_drain(self.tables.read("jobs", base, touched), found), touched)
        if counts["failed"]:
            said = found.where("outcome = 'failed'").withColumn("place", F.struct("place", "page_key")).select("place", "page_id", "page_key", "error")
            said = queue.placed(said, "place").select(F.lit(run).alias("run"), F.col("position").alias("place"), "page_id", "page_key", "error")
            said.write.mode("append").parquet(f"{self.root}/errors")
        changes = {t: x for t, x in (("chunks", new_chunks), ("jobs", new_jobs)) if x}
        return changes, facts, {"last_drain_at": str(run // 1_000_000_000)}, counts

    def apply(self, events: DataFrame, batch: int, stream: str = "events", n: int | None = None) -> dict | None:
        """A stream's micro-batch of events (page_key, page_id, operation, enqueued_at, seq): queued once, whatever is run again, then drained."""
        name = f"batch:{stream}"

        def make(base: Manifest) -> tuple:
            if int(base.meta.get(name, -1)) >= batch:
                return {}, {}, {}, None
            return (*self._enqueued(base, events), {name: str(batch)}, None)

        self._change(make)
        return self.drain(n)

    def follow(self, events: DataFrame, checkpoint: str, stream: str = "events", every: str | None = None):
        """Starts a streaming query that applies the micro-batches of a stream of events."""
        out = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: self.apply(rows, batch, stream) and None)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()

    # ---- reports and search

    def status(self) -> dict:
        """The index's statistics, the queue's counts and the state. Statistics come from the buckets' own; only page keys are read of the chunks."""
        base = self.tables.head()
        states = [(b, *s) for b, x in base.facts.get("chunks", {}).items() for s in x]
        facts = index.merged_statistics(self.spark.createDataFrame(states, "bucket int, fingerprint string, model string, dims int, chunks long, pages long, last long, own_pages long, fit_pages long"), self.fingerprint).first().asDict()
        jobs = base.facts.get("jobs", {}).values()
        facts |= {"pending": sum(j[0] for j in jobs), "failed": sum(j[1] for j in jobs), "lifecycle_error": base.meta.get("lifecycle_error", ""), "last_drain_at": int(base.meta.get("last_drain_at", 0))}
        keys = self.pages.where(self._eligible()).select("page_key")
        facts["eligible"] = keys.count()
        facts["stale"] = index.stale_pages(self.tables.read("chunks", base), keys).count()
        kinds = {"pages": "long", "compatible_pages": "long", "eligible": "long", "pending": "long", "failed": "long", "stale": "long", "lifecycle_error": "string"}
        row = self.spark.createDataFrame([tuple(facts[k] for k in kinds)], ", ".join(f"{k} {v}" for k, v in kinds.items()))
        return facts | {"state": row.select(index.index_state().alias("s")).first().s}

    def find(self, text: str, top_k: int | None = None, threshold: float | None = None, most: int | None = None, requeue: bool = True) -> DataFrame:
        """The entries that a question finds among the chunks that the present settings can search; settings keep within their bounds.

        Hits of pages that have changed since are hidden, and, with `requeue`, such pages queued where they aren't yet."""
        fitting, live = self._fitting(self.chunks()), self.live()
        tokens = self.spark.range(1).select(L.tokens(F.lit(text)).alias("t")).first().t
        top_k, threshold = S.within("top_k", top_k), S.within("min_similarity", threshold)
        # a bounded list of hits, found once
        hits = search.hybrid_search(fitting, self.provider.embed([text])[0], tokens, search.pool_size(top_k), threshold)
        hits = self.spark.createDataFrame(hits.collect(), hits.schema)
        if requeue:
            stale = [(r.page_key, r.page_id) for r in search.stale_pages_of(hits, live).collect()]
            if stale:
                self._requeue(stale)
        return search.entries_of(search.fresh_hits(hits, live), top_k, S.within("max_chars", most))

    def _requeue(self, stale: list[tuple[str, str]]) -> None:
        """Queues an upsert of each page (key, id) that has no job; a job that is there keeps its attempts and place."""
        now = int(time.time())
        rows = self.spark.createDataFrame([(k, i, "upsert", now, 0, 1, None) for k, i in stale], S.QUEUE).withColumn("first_seq", F.xxhash64("page_key"))

        def make(base: Manifest) -> tuple:
            held = self.tables.read("jobs", base, self.tables.touched(base, rows))
            missing = rows.join(held.select("page_key"), "page_key", "left_anti")
            touched = self.tables.touched(base, missing)
            if not touched:
                return {}, {}, {}, None
            staged, facts = self._jobs(base, queue.inserted_missing(self.tables.read("jobs", base, touched), rows), touched)
            return {"jobs": staged}, {"jobs": facts}, {}, None

        self._change(make)


def _sent(n: int, most: int = FEW) -> Callable[[DataFrame], DataFrame]:
    """How n keys meet rows with texts: few go to every task, very many are hashed, as texts shouldn't be sorted; between those Spark chooses."""
    return F.broadcast if n <= most else lambda keys: keys.hint("shuffle_hash") if n > MANY else keys


def _removed(keys: DataFrame, remover: Remover) -> DataFrame:
    """page_key, error of each deletion that was tried."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said: list[str | None] = []
            for key in frame["page_key"]:
                try:
                    remover.remove(key)
                    said.append(None)
                except Exception as error:  # noqa: BLE001
                    said.append(str(error) or type(error).__name__)
            yield frame.assign(error=said)

    return keys.mapInPandas(run, "page_key string, error string")
