"""Sources and sinks: fixture tables, the chunk table, snapshots, settings and embedding providers."""

from __future__ import annotations

import functools
import hashlib
import time
from collections.abc import Iterator, Mapping
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import chunk_normalized, content_hash, with_title

CHUNKS = (
    "id long, page_key string, page_id string, url string, title string, chunk_index int, chunk_text string, embedding array<float>, dims int,"
    " embedding_model string, index_fingerprint string, content_hash string, page_modified long, indexed_at long"
)
QUEUE = "page_key string, page_id string, operation string, enqueued_at long, attempts int, revision int, last_error string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as extracted pages: page_key, page_id, url, title, text, content_hash."""
    d = table(spark, sf_dir, "documents")
    page_id = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return d.select(
        "doc_id", F.concat(F.lit("page://"), F.col("doc_id").cast("string")).alias("page_key"), page_id.alias("page_id"), F.concat(F.lit("/"), page_id).alias("url"),
        F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("text"), "lang",
    ).withColumn("content_hash", content_hash(F.col("title"), F.col("text")))


def chunks(spark: SparkSession, sf_dir: str, model: str = "fixture", fingerprint: str = "fixture", every: bool = False) -> DataFrame:
    """One chunk a document that has a vector, in the chunk table's columns; with `every` one a document, its embedding and dims null where it has no vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return extracted(spark, sf_dir).join(vectors, "doc_id", "left" if every else "inner").select(
        F.col("doc_id").alias("id"), "page_key", "page_id", "url", "title", F.lit(0).alias("chunk_index"),
        with_title(F.col("title"), chunk_normalized(F.col("text"))).alias("chunk_text"), "embedding", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"),
        F.lit(model).alias("embedding_model"), F.lit(fingerprint).alias("index_fingerprint"), "content_hash",
        (F.lit(1_700_000_000) + F.col("doc_id")).alias("page_modified"), (F.lit(1_700_000_100) + F.col("doc_id")).alias("indexed_at"),
    )


def compatible(rows: DataFrame, model: str, dims: int, fingerprint: str) -> DataFrame:
    """Chunks that the present settings can search; plain comparisons, so Parquet scans filter by them."""
    return rows.where((F.col("embedding_model") == model) & (F.col("dims") == dims) & (F.col("index_fingerprint") == fingerprint))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A stored chunk table; columns that older files lack are null."""
    return spark.read.schema(CHUNKS).option("mergeSchema", "true").parquet(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """A whole new table in a folder of its own; a table is never written over while it is read."""
    rows.write.mode("errorifexists").parquet(path)


def setting(*values: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


#: Least, greatest and default value of the settings.
LIMITS = {"top_k": (1, 20, 5), "min_similarity": (0.0, 1.0, 0.25), "max_chars": (500, 12000, 4000), "chunk_chars": (300, 4000, 1200), "overlap": (0, 1000, 200), "dims": (1, 32768, 1536)}


def bounded(name: str, value: Column) -> Column:
    """A setting within its bounds; one that is null or no number is the default."""
    low, high, default = LIMITS[name]
    kind = "double" if isinstance(low, float) else "int"
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(value.try_cast("double"), F.lit(float(default))))).cast(kind)


def within(name: str, value: float | None):
    """`bounded` for a value of the caller's."""
    low, high, default = LIMITS[name]
    return default if value is None else min(high, max(low, value))


def enabled_tools(rows: DataFrame) -> DataFrame:
    """Named and enabled tools of (name, enabled, pos, definition); a later row of a name replaces earlier ones."""
    named = rows.where((F.coalesce("name", F.lit("")) != "") & F.lower(F.col("enabled")).isin("1", "true", "on", "yes"))
    return named.groupBy("name").agg(F.max_by("definition", "pos").alias("definition"))


def upserted_meta(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Keys and values after the changes (key, value, seq): the latest wins."""
    every = stored.select("key", "value", F.lit(-1).cast("long").alias("seq")).union(changes.select("key", "value", "seq"))
    return every.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def meta_value(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """key, value of `keys` (key, default): what is stored, or else the default."""
    return keys.join(stored.select("key", "value"), "key", "left").select("key", F.coalesce("value", "default").alias("value"))


class EmbeddingProvider(Protocol):
    """Vectors in the order of the texts."""

    model: str
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def in_order(items: list[tuple[int, list[float]]], n: int) -> list[list[float]]:
    """The vectors of (index, vector) items by index, as services may answer in any order; each of the n indexes must be there once."""
    found = dict(items)
    if len(items) != n or sorted(found) != list(range(n)):
        raise ValueError("the provider's indexes aren't those of the texts")
    return [found[k] for k in range(n)]


class _WordPlaces(dict):
    """Hashes of words (UTF-8) below `n`. Of a text's words most are common ones, which come early and are hashed once; no more than `MOST` are held."""

    MOST = 1 << 18

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big") % self.n
        if len(self) < self.MOST:
            self[word] = found
        return found


#: One for all providers of a task.
_word_places = functools.lru_cache(maxsize=2)(_WordPlaces)


class HashedEmbeddings:
    """A provider without a network: counts of hashed words, so equal texts have equal vectors."""

    model = "hashed-words"

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out, place = np.zeros((len(texts), self.dims)), _word_places(2 * self.dims).__getitem__
        for row, text in zip(out, texts):
            # bytes are split at ASCII's white space alone
            n = np.bincount(np.fromiter(map(place, text.lower().encode().split()), np.int64), minlength=2 * self.dims)
            # odd hashes count up, even ones down
            row += n[1::2] - n[::2]
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(norms > 0, norms, 1)).astype(np.float32).tolist()


_VECTORS = pa.list_(pa.float32())


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def embedded(rows: DataFrame, provider: EmbeddingProvider, batch: int = 96) -> DataFrame:
    """`rows` (chunk_text) with embedding and dims, asked for in batches; a wrong count or width fails the task."""
    dims = provider.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # what is asked for at once is also given on at once, so that memory doesn't grow with Arrow's batches
            for k in range(0, whole.num_rows, batch):
                rows = whole.slice(k, batch)
                found = provider.embed(rows.column("chunk_text").to_pylist())
                if len(found) != rows.num_rows or any(len(v) != dims for v in found):
                    raise ValueError("the provider gave other vectors than asked for")
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, _VECTORS), pa.array([dims] * rows.num_rows, pa.int32())], [*rows.schema.names, "embedding", "dims"])

    kept = rows.drop("embedding", "dims")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, embedding array<float>, dims int")


class Answered:
    """What a provider says to a batch of texts: tried again with growing waits, brought into the texts' order, and checked."""

    def __init__(self, provider: EmbeddingProvider, tries: int = 3, wait: float = 0.5):
        self.provider, self.tries, self.wait = provider, tries, wait

    def once(self, texts: list[str]) -> list[list[float]]:
        # a service that answers in any order gives (index, vector) items
        items = getattr(self.provider, "embed_items", None)
        found = in_order(items(texts), len(texts)) if items else self.provider.embed(texts)
        if len(found) != len(texts) or any(len(v) != self.provider.dims for v in found):
            raise ValueError("the provider gave other vectors than asked for")
        return found

    def __call__(self, texts: list[str]) -> tuple[list[list[float]] | None, str | None]:
        """The vectors, or else the last error's text."""
        said = None
        for n in range(self.tries):
            if n:
                time.sleep(self.wait * 2 ** (n - 1))
            try:
                return self.once(texts), None
            except Exception as error:  # noqa: BLE001
                said = str(error) or type(error).__name__
        return None, said


def embedded_or_failed(rows: DataFrame, provider: EmbeddingProvider, batch: int = 96, tries: int = 3, wait: float = 0.5, deadline: float | None = None) -> DataFrame:
    """`rows` (page_key, chunk_text) with embedding, dims, error and late.

    Batches are filled across pages and Arrow batches. One that fails after all tries is asked for page by page, so that a page
    fails for its own texts alone; its rows have the error and no vector. From `deadline` (seconds of the clock) on, rows are late and
    not asked for. A task that is run again asks again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = Answered(provider, tries, wait)

        def with_answer(rows: pa.RecordBatch, vectors: list | None, error: str | None, late: bool) -> pa.RecordBatch:
            n = rows.num_rows
            dims = None if vectors is None else provider.dims
            more = [pa.array(vectors or [None] * n, _VECTORS), pa.array([dims] * n, pa.int32()), pa.array([error] * n, pa.string()), pa.array([late] * n)]
            return pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "embedding", "dims", "error", "late"])

        def answered(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if deadline is not None and time.time() >= deadline:
                yield with_answer(rows, None, None, True)
                return
            vectors, error = ask(rows.column("chunk_text").to_pylist())
            pages = rows.column("page_key").dictionary_encode(null_encoding="encode")
            if vectors is None and len(pages.dictionary) > 1:
                for p in range(len(pages.dictionary)):
                    yield from answered(rows.filter(pc.equal(pages.indices, p)))
            else:
                yield with_answer(rows, vectors, error, False)

        held: list[pa.RecordBatch] = []
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                held.append(whole.slice(at, batch - sum(x.num_rows for x in held)))
                at += held[-1].num_rows
                if sum(x.num_rows for x in held) == batch:
                    # the answers of single pages go on together
                    yield _joined([*answered(_joined(held))])
                    held = []
        if held:
            yield _joined([*answered(_joined(held))])

    kept = rows.drop("embedding", "dims", "error", "late")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, embedding array<float>, dims int, error string, late boolean")
