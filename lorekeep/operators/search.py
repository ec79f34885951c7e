"""Exact vector, lexical and hybrid search, and what is done with hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import words as L
from ..functions.texts import excerpt
from ..sources.folders import checkpointed

RRF = 60
MOST_CHARS = 4000
#: Rows of a shard of chunks, of one in batch search and of a block of queries there, and numbers in either of these.
SHARD_ROWS, BATCH_ROWS, TILE_ROWS, BLOCK_VALUES = 1024, 4096, 256, 1 << 18


def pool_size(wanted: int) -> int:
    """Candidates that each list offers for so many hits."""
    return min(100, max(20, 4 * wanted))


def unit(vector: list[float]) -> list[float]:
    n = sum(float(x) ** 2 for x in vector)
    return [float(x) * (1 / n**0.5) for x in vector] if n > 0 else [float(x) for x in vector]


def hit_key() -> Column:
    """Page and chunk as one string; ties are broken by it, so chunk 10 comes before chunk 2."""
    return F.concat("page_key", F.lit("\0"), F.col("chunk_index").cast("string"))


def _rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors of those that are there and have no null, by length; squares are summed in order, as `dot` does."""
    offsets, values = vectors.offsets.to_numpy(), vectors.values
    whole = np.append(0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False)))
    own = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & (whole[offsets[1:]] == whole[offsets[:-1]]))
    dims, flat = np.diff(offsets)[own], values.to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        at = own[dims == dim]
        rows = flat[offsets[at][:, None] + np.arange(dim)].astype(float)
        squares = np.zeros(len(rows))
        for j in range(dim):
            squares += rows[:, j] * rows[:, j]
        long = squares > 0
        rows[long] *= (1 / np.sqrt(squares[long]))[:, None]
        yield at, rows


def _dots(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The dot product of each row with the other, over the shorter length and in order."""
    out = np.zeros(len(rows))
    for j in range(min(rows.shape[1], others.shape[-1])):
        out += rows[:, j] * others[..., j]
    return out


#: What a chunk needs to be scored, and what is known of one that is scored.
SCORED = ("id", "similarity", "lexical", "bm25")


def _best(found: dict[str, np.ndarray], pool: int) -> dict[str, np.ndarray]:
    """The rows that either list can take: the `pool` best by similarity, and by coverage."""
    n = len(found["id"])
    down = np.where(np.isnan(found["similarity"]), np.inf, -found["similarity"])
    near = np.lexsort((found["id"], down))[:pool]
    near = near[~np.isnan(found["similarity"][near])]
    held = np.lexsort((found["id"], found["bm25"], -found["lexical"]))[:pool]
    keep = np.zeros(n, bool)
    keep[near] = True
    keep[held[found["lexical"][held] > 0]] = True
    return {k: v[keep] for k, v in found.items()}


def scored(chunks: DataFrame, vector: list[float], query: list[str], pool: int, ranked: DataFrame | None = None) -> DataFrame:
    """id, similarity, lexical, bm25 of the chunks that a list of `pool` can take, in one pass over vectors and text.

    Each task keeps its best rows, so what leaves it is bounded by `pool`; the lists are cut again by who asks. Ids are long."""
    wanted = np.array(unit(vector))
    patterns = [L.word_pattern(q) for q in query]
    text = _searched() if query else F.lit("")
    rows = chunks.select("id", "embedding", text.alias("text"))
    rows = rows.withColumn("bm25", F.lit(float("inf"))) if ranked is None else rows.join(ranked.select("id", "bm25"), "id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {"id": np.zeros(0, np.int64), **{c: np.zeros(0) for c in SCORED[1:]}}
        for batch in batches:
            n = batch.num_rows
            near, held = np.full(n, np.nan), _shares(batch.column("text"), patterns) if patterns else np.zeros(n)
            for at, unit_rows in _rows(batch.column("embedding")):
                near[at] = _dots(unit_rows, wanted)
            new = {"id": batch.column("id").to_numpy(), "similarity": near, "lexical": held, "bm25": batch.column("bm25").to_numpy()}
            kept = _best({k: np.concatenate([v, new[k]]) for k, v in kept.items()}, pool)
        yield pa.RecordBatch.from_arrays([pa.array(kept[c]) for c in SCORED], list(SCORED))

    found = rows.mapInArrow(run, "id long, similarity double, lexical double, bm25 double")
    # dealt by id, so that both lists read one shuffle of few rows and the chunks are read once
    return found.repartition("id").withColumn("similarity", F.when(~F.isnan("similarity"), F.col("similarity")))


def _fetched(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The chunks' columns for a few hits (id and others); the semi join lets a scan skip what it derives for other rows."""
    few = F.broadcast(hits)
    return chunks.join(few.select("id"), "id", "left_semi").join(few, "id")


def vector_search(chunks: DataFrame, vector: list[float], k: int, threshold: float | None = None) -> DataFrame:
    """The k chunks nearest to the vector, at the threshold or above: all columns and similarity. An empty vector or k < 1 finds none,
    and chunks without an embedding are never found."""
    if not vector or k < 1:
        return chunks.withColumn("similarity", F.lit(0.0)).limit(0)
    found = scored(chunks, vector, [], k).where("similarity IS NOT NULL").orderBy(F.desc("similarity"), "id").limit(k).select("id", "similarity")
    return _fetched(chunks, found if threshold is None else found.where(F.col("similarity") >= threshold))


def similarities(chunks: DataFrame, vector: list[float]) -> DataFrame:
    """id, similarity of chunks, null where there is no vector."""
    return pair_similarities(chunks.select("id", "embedding").withColumn("vector", F.array(*map(F.lit, map(float, vector))).cast("array<double>")))


def pair_similarities(pairs: DataFrame) -> DataFrame:
    """`pairs` with the cosine similarity of `embedding` and `vector` in place of both; null where one isn't there or has a null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("embedding", "vector"))
    names = [c for c in pairs.columns if c not in ("embedding", "vector")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides: list[dict[int, np.ndarray]] = [{}, {}]
            for side, name in zip(sides, ("embedding", "vector")):
                for at, rows in _rows(batch.column(name)):
                    side |= dict(zip(at.tolist(), rows))
            out: list[float | None] = [None] * batch.num_rows
            for k in sides[0].keys() & sides[1].keys():
                dot = 0.0
                for x, y in zip(sides[0][k].tolist(), sides[1][k].tolist()):
                    dot += x * y
                out[k] = dot
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.float64())], [*names, "similarity"])

    return pairs.select(*names, F.col("embedding").cast("array<double>"), F.col("vector").cast("array<double>")).mapInArrow(run, f"{schema}, similarity double")


def _blocks(rows: DataFrame, key: str, vector: str, most: int, name: str) -> DataFrame:
    """Unit vectors in blocks of at most `most`, by length of vector: <name>_ids and <name>_matrix, row-major doubles."""
    names = ["dim", "ids", "matrix"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, matrix in _rows(batch.column(1)):
                dim = matrix.shape[1]
                size = max(1, min(most, BLOCK_VALUES // max(dim, 1)))
                for at in range(0, len(own), size):
                    ids = batch.column(0).take(pa.array(own[at : at + size]))
                    part = matrix[at : at + size].astype("<f8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([part], pa.binary())], names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(vector).cast("array<double>")).mapInArrow(pack, f"dim int, ids array<{kind}>, matrix binary").withColumnsRenamed({n: f"{name}_{n}" for n in names})


#: Matrix products differ from sums in order by less than this for unit vectors.
_SLACK = 1e-9


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def branches(spark: SparkSession, shards: int, shard_bytes: int, tiles: int, tile_bytes: int) -> tuple[int, int]:
    """Branches of shards and of blocks of queries for a join of all with all: as many tasks as there is room for, and so cut that least is
    written. Shards are copied to the branches of queries, and each branch of shards has the blocks of queries and gives their rows."""
    n = max(1, min(shuffles(spark), max(12, 3 * spark.sparkContext.defaultParallelism)))
    across = max(1, min(n, tiles, round((n * tiles * tile_bytes / max(1, shards * shard_bytes)) ** 0.5)))
    down = max(1, min(shards, n // across))
    return down, max(1, min(tiles, n // down))


def in_branches(rows: DataFrame, key: str, own: int, others: int, tiles: bool = False) -> DataFrame:
    """Blocks in one of `own` branches by `key`, copied to all of the other side's: `branch` numbers both."""
    mine = F.pmod(F.xxhash64(key), F.lit(own)).cast("int")
    each = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    return each.withColumn("branch", F.col("_other") * own + mine if tiles else mine * others + F.col("_other")).drop("_other")


def met(tiles: DataFrame, shards: DataFrame, branches: int) -> DataFrame:
    """Each block of queries with the shards of its branch, one after the other. Work goes with queries times chunks, not with bytes, so
    tasks are as many as branches, and more, so that few branches share one; none are put together for being small."""
    return tiles.repartition(4 * branches, "branch").hint("merge").join(shards.repartition(4 * branches, "branch"), "branch")


def _best_of_cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best chunks for each query of a block, of the blocks of chunks that it meets one after the other: a matrix product leaves few
    pairs of each, which are summed in order, as `dot` does."""
    asked: pa.Array | None = None

    def best() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([asked.take(pa.array(held[0])), pa.array(held[1], kind), pa.array(held[2])], ["query_id", "id", "similarity"])

    for batch in batches:
        for row in range(batch.num_rows):
            cell = {n: batch.column(j)[row] for j, n in enumerate(batch.schema.names)}
            q_ids, c_ids = cell["q_ids"].values, cell["c_ids"].values
            q = np.frombuffer(cell["q_matrix"].as_py(), "<f8").reshape(len(q_ids), -1)
            c = np.frombuffer(cell["c_matrix"].as_py(), "<f8").reshape(len(c_ids), -1)
            ids, kind = c_ids.to_numpy(zero_copy_only=False), c_ids.type
            same = asked is not None and asked.equals(q_ids)
            if asked is not None and not same:
                yield best()
            of, at, scores = best_of_cell(q, c, ids, k, edge if same else None)
            found = (of, ids[at], scores)
            if same:
                found = tuple(np.concatenate(x) for x in zip(held, found)) if len(of) else held
            if same and len(of):
                order = np.lexsort((found[1], -np.where(np.isnan(found[2]), np.inf, found[2]), found[0]))
                found = tuple(x[order] for x in found)
                found = tuple(x[np.arange(len(found[0])) - np.searchsorted(found[0], found[0]) < k] for x in found)
            asked, held = q_ids, found
            # what the last of a query's k rows has, all others must reach
            last = np.arange(len(found[0])) - np.searchsorted(found[0], found[0]) == k - 1
            edge = np.full(len(q), -np.inf)
            edge[found[0][last]] = np.where(np.isnan(found[2][last]), np.inf, found[2][last])
    if asked is not None:
        yield best()


def best_of_cell(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of c and similarities of the k best of c for each of q, ties by id; of unit vectors that may differ in length.
    Where `edge` is given, only of those that reach it, about."""
    dim = min(q.shape[1], c.shape[1])
    rough = q[:, :dim] @ c[:, :dim].T
    rough[np.isnan(rough)] = np.inf
    take = min(k, rough.shape[1])
    if edge is None or np.isneginf(edge).any():
        edge = np.maximum(-np.inf if edge is None else edge, np.partition(rough, rough.shape[1] - take, axis=1)[:, rough.shape[1] - take])
    of, at = np.nonzero(rough >= edge[:, None] - _SLACK)
    scores = _dots(q[of], c[at])
    down = -np.where(np.isnan(scores), np.inf, scores)
    order = np.lexsort((ids[at], down, of))
    of, at, scores = of[order], at[order], scores[order]
    starts = np.searchsorted(of, np.arange(len(q)))
    best = np.arange(len(of)) - starts[of] < k
    return of[best], at[best], scores[best]


def batch_vector_search(chunks: DataFrame, queries: DataFrame, k: int, shard_rows: int = BATCH_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest chunks of each row of `queries` (query_id, vector), a table of any size.

    Blocks of queries meet the shards of a branch one after the other and keep k rows a query meanwhile, so no row is made for a
    pair, nor k for each shard. Rows without a vector take no part."""
    spark = chunks.sparkSession
    # shards and blocks are full however many files or partitions the rows come in
    n, m = (max(1, -(-rows.count() // size)) for rows, size in ((chunks.select("id"), shard_rows), (queries.select("query_id"), tile_rows)))
    down, across = branches(spark, n, shard_rows, m, tile_rows * (1 + k // 16))
    shards = _blocks(chunks.select("id", "embedding").repartition(min(n, shuffles(spark))), "id", "embedding", shard_rows, "c")
    tiles = _blocks(queries.select("query_id", "vector").repartition(min(m, shuffles(spark))), "query_id", "vector", tile_rows, "q")
    cells = met(in_branches(tiles, "q_ids", across, down, tiles=True), in_branches(shards, "c_ids", down, across), down * across).select("q_ids", "q_matrix", "c_ids", "c_matrix")
    kinds = [f"{to} {df.schema[c].dataType.simpleString()}" for to, c, df in (("query_id", "query_id", queries), ("id", "id", chunks))]
    scored = cells.mapInArrow(lambda batches: _best_of_cells(batches, k), f"{', '.join(kinds)}, similarity double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def coverage(query: list[str]) -> Column:
    """The share of query words that title or text match: one pattern a word over Arrow batches, which gives what `words.coverage` gives."""
    if not query:
        return F.lit(0.0)
    patterns = [L.word_pattern(q) for q in query]

    @F.arrow_udf("double")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array(_shares(texts, patterns))

    return held(_searched())


def _searched() -> Column:
    return F.lower(F.concat_ws("\n", "title", "chunk_text"))


def _shares(texts: pa.Array, patterns: list[str]) -> np.ndarray:
    hits = np.zeros(len(texts))
    for pattern in patterns:
        hits += pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    return hits / len(patterns)


def lexical_candidates(chunks: DataFrame, query: list[str], pool: int) -> DataFrame:
    """Chunks that hold a query word, the best `pool` by coverage. Only ids and texts are read for that, and then the rows of the best."""
    found = chunks.select("id", coverage(query).alias("lexical")).where("lexical > 0").orderBy(F.desc("lexical"), "id").limit(pool)
    return _fetched(chunks, found.withColumn("bm25", F.lit(float("inf"))))


_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(text), *_ACCENTS), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(chunks: DataFrame, query: list[str], title_weight: float = 2.0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, bm25 of chunks that a query word, or a stem of one, is a prefix in: the lowest, that is best, over these terms.

    One aggregation gives the statistics of all terms; they are a single row."""
    terms = [*dict.fromkeys(t for q in query for t in L.stems(q))]
    rows = chunks.select("id", plain_words(F.col("title")).alias("t"), plain_words(F.col("chunk_text")).alias("x"))

    def hits(column: str, term: str) -> Column:
        return F.size(F.filter(column, lambda w: F.startswith(w, F.lit(term))))

    counts = [hits("t", q) * title_weight + hits("x", q) for q in terms]
    # texts are read once; what is left of them, a few numbers a chunk, is kept for the statistics and the scores
    rows = checkpointed(rows.select("id", (F.size("t") + F.size("x")).alias("len"), *[c.cast("double").alias(f"f{k}") for k, c in enumerate(counts)]))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(terms))])
    both = rows.join(F.broadcast(stats))

    def score(k: int) -> Column:
        f = F.col(f"f{k}")
        idf = F.greatest(F.log((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5)), F.lit(1e-6))
        return F.when(f > 0, -idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg"))))

    return both.select("id", F.array_min(F.array_compact(F.array(*map(score, range(len(terms)))))).alias("bm25")).where("bm25 IS NOT NULL")


def hybrid_search(chunks: DataFrame, vector: list[float], query: list[str], wanted: int, threshold: float, ranked: DataFrame | None = None) -> DataFrame:
    """Hits of both lists by reciprocal rank fusion: all columns, similarity, lexical, bm25, semantic_rank, lexical_rank, score, rank.

    Chunks without an embedding are found by their words alone; their similarity is null. `query` are tokens; without any it is a vector search.
    The threshold admits to the semantic list only. `ranked` (id, bm25) breaks ties of coverage; a chunk that it lacks comes behind those
    of its coverage. The chunks are scored in one pass and read again for the hits; windows run over the two cut lists, never over the corpus."""
    if not query:
        found = vector_search(chunks, vector, wanted, threshold)
        rank = F.row_number().over(W.orderBy(F.desc("similarity"), "id"))
        return found.withColumns({"lexical": F.lit(0.0), "bm25": F.lit(float("inf")), "semantic_rank": rank, "lexical_rank": F.lit(None).cast("int"), "score": F.lit(0.0), "rank": rank})
    pool = pool_size(wanted)
    few = scored(chunks, vector, query, pool, ranked)
    return fused(chunks, few, few.where("lexical > 0").orderBy(F.desc("lexical"), "bm25", "id").limit(pool), wanted, threshold)


def fused(chunks: DataFrame, few: DataFrame, lexical: DataFrame, wanted: int, threshold: float) -> DataFrame:
    """The hits of `few`, of which the semantic list is cut, and the lexical list (both id, similarity, lexical, bm25), by reciprocal rank fusion."""
    pool = pool_size(wanted)
    semantic = few.where("similarity IS NOT NULL").orderBy(F.desc("similarity"), "id").limit(pool).where(F.col("similarity") >= threshold)
    # one of the semantic list alone counts as without words, whatever it holds
    semantic = semantic.select("id", "similarity").withColumns({"lexical": F.lit(0.0), "bm25": F.lit(float("inf")), "semantic_rank": F.row_number().over(W.orderBy(F.desc("similarity"), "id"))})
    lexical = lexical.select("id", "similarity", "lexical", "bm25").withColumn("semantic_rank", F.lit(None).cast("int"))
    # both lists hold whole scores of the same chunks, so the full outer merge is a union and a group of two rows at most
    merged = semantic.unionByName(lexical).groupBy("id").agg(F.max("similarity").alias("similarity"), F.max("lexical").alias("lexical"), F.min("bm25").alias("bm25"), F.min("semantic_rank").alias("semantic_rank"))
    merged = _fetched(chunks, merged)
    key = hit_key()
    order = W.partitionBy(F.col("lexical") > 0).orderBy(F.desc("lexical"), "bm25", F.desc("similarity"), key)
    merged = merged.withColumn("lexical_rank", F.when(F.col("lexical") > 0, F.row_number().over(order)))
    score = F.coalesce(F.lit(1.0) / (RRF + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce(F.lit(1.0) / (RRF + F.col("lexical_rank")), F.lit(0.0))
    final = [F.desc("score"), F.desc("lexical"), F.desc("similarity"), key]
    return merged.withColumn("score", score).withColumn("rank", F.row_number().over(W.orderBy(*final))).where(F.col("rank") <= wanted)


def ranked_search(chunks: DataFrame, vector: list[float], query: list[str], wanted: int, threshold: float) -> DataFrame:
    """`hybrid_search` where bm25, over words and their stems, breaks ties of coverage."""
    return hybrid_search(chunks, vector, query, wanted, threshold, bm25(chunks, query) if query else None)


def _with_live(hits: DataFrame, live: DataFrame) -> DataFrame:
    """Hits with the page found by key, or else by id: _key, _id and _hash."""
    page = F.struct("page_key", "page_id", "content_hash")
    by_key = live.select("page_key", page.alias("_k"))
    by_id = live.select("page_id", page.alias("_i"))
    joined = hits.join(by_key, "page_key", "left").join(by_id, "page_id", "left")
    known = F.coalesce(F.when(F.startswith("page_key", F.lit("page://")), F.col("_k")), F.col("_i"))
    return joined.withColumns({"_key": known["page_key"], "_id": known["page_id"], "_hash": known["content_hash"]}).drop("_k", "_i")


def fresh_hits(hits: DataFrame, live: DataFrame) -> DataFrame:
    """Hits whose page, found by key or else by id, still has their content hash; anything unclear is hidden."""
    return _with_live(hits, live).where((F.col("_hash") == F.col("content_hash")) & (F.col("content_hash") != "")).drop("_key", "_id", "_hash")


def stale_pages_of(hits: DataFrame, live: DataFrame) -> DataFrame:
    """page_key, page_id of the pages that are there but whose hits are hidden as they have another content hash: to be queued where they aren't yet."""
    stale = (F.coalesce("content_hash", F.lit("")) == "") | (F.col("_hash") != F.col("content_hash"))
    return _with_live(hits, live).where(F.col("_key").isNotNull() & stale).select(F.col("_key").alias("page_key"), F.col("_id").alias("page_id")).distinct()


def entry(rank: str = "rank") -> Column:
    """A hit as a numbered entry of the context."""
    return F.concat(F.format_string("[%d] %s\nURL: %s\nSemantische Ähnlichkeit: %.2f\n", F.col(rank), F.col("title"), F.col("url"), F.col("similarity")), excerpt(F.col("chunk_text")), F.lit("\n\n"))


def within_budget(entries: DataFrame, most: int = MOST_CHARS, rank: str = "rank", text: str = "entry") -> DataFrame:
    """Entries in rank order as long as all so far fit; the first always stays. Entries are a few hits of one search."""
    so_far = F.sum(F.char_length(text)).over(W.orderBy(rank).rowsBetween(W.unboundedPreceding, 0))
    return entries.withColumn("chars", so_far).where((F.col(rank) == 1) | (F.col("chars") <= most))


def knowledge_search(chunks: DataFrame, live: DataFrame, vector: list[float], query: list[str], top_k: int = 5, threshold: float = 0.25, most: int = MOST_CHARS) -> DataFrame:
    """Fresh hits within the budget: rank, page_id, url, title, similarity, entry. More are searched than asked for, as some may be stale."""
    return entries_of(fresh_hits(hybrid_search(chunks, vector, query, pool_size(top_k), threshold), live), top_k, most)


def entries_of(hits: DataFrame, top_k: int, most: int = MOST_CHARS) -> DataFrame:
    """The first `top_k` hits of one search within the budget, as entries."""
    hits = hits.withColumn("rank", F.row_number().over(W.orderBy("rank"))).where(F.col("rank") <= top_k)
    return within_budget(hits.withColumn("entry", entry()), most).select("rank", "page_id", "url", "title", "similarity", "entry")
