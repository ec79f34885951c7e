"""Substring deduplication with a count-min prefilter (operator 12).

Texts are dealt over blocks of bounded size, a bucketed table, so that what is found for a block meets its texts again without
shuffling them. Three passes read it:

1. each block sketches its windows: a count-min sketch of one row whose columns outnumber all windows 64 times, held sparsely as
   sorted columns and counts. Partial sketches are cut into ranges of columns and merged range by range; each block is answered
   by one bit a column it holds, whether the merged count is two or more. Counts are never too small, so no repeat is lost;
2. only windows in such columns are grouped exactly, by column and 64 further bits of their words' hashes, and answered alike;
3. words that repeated windows cover are removed.

A sketch of fixed size would be full beyond some input; here columns grow with the input, and nothing of that size is ever broadcast
or held by one task. A window shared by all documents is one column of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, partitions, scratch, table, text_or_empty, written

WORDS = 35
#: Bytes of texts of a block, and windows of a range of columns, about; both bound what a task holds.
BLOCK_BYTES, RANGE_WINDOWS = 4 << 20, 4_000_000
#: Blocks for each partition at least, so that partitions are even; and ranges at least.
SPREAD, LEAST_RANGES = 2, 8
#: Columns of the sketch for each byte of text: 64 for each word or so.
COLUMNS_A_BYTE = 12
#: Odd bases of the two rolling hashes of windows, and their inverses.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Windows:
    """The windows of `n` words of some texts: `starts` in the flat `words`, whose texts lie between `bounds`."""

    def __init__(self, texts: pa.Array, n: int):
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = pc.dictionary_encode(parts.flatten())
        self.names = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy()
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        # white space at an end leaves an empty word there
        empty = np.array([x == "" for x in self.names], bool)[at] if "" in self.names else np.zeros(len(at), bool)
        self.bounds = bounds - np.concatenate([[0], np.cumsum(empty)])[bounds]
        self.words, self.at, self.n = coded.filter(pa.array(~empty)), at[~empty], n
        text_of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        m = max(len(self.at) - n + 1, 0)
        self.starts = np.flatnonzero(text_of[:m] == text_of[n - 1 : n - 1 + m])

    def hashes(self, kind: int) -> np.ndarray:
        """A 64-bit hash of each window, of two kinds."""
        of = np.fromiter((xxhash.xxh3_64_intdigest(x, kind) for x in self.names), np.uint64, len(self.names))
        base = _BASES[kind]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of[self.at] * _powers(base, len(self.at)))])
            back = _powers(pow(base, -1, 1 << 64), len(self.at))[self.starts]
            return _mixed((sums[self.starts + self.n] - sums[self.starts]) * back)

    def kept(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Words of each text, those that windows at these places of `starts` cover, and the others joined by a space."""
        edges = np.zeros(len(self.at) + 1, np.int64)
        np.add.at(edges, self.starts[repeated], 1)
        np.add.at(edges, self.starts[repeated] + self.n, -1)
        gone = np.cumsum(edges[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])[self.bounds]
        left = pa.ListArray.from_arrays(pa.array(self.bounds - total, pa.int32()), self.words.filter(pa.array(~gone)).cast(pa.string()))
        return np.diff(self.bounds), np.diff(total), pc.binary_join(left, " ")


def packed(ascending: np.ndarray) -> tuple[int, bytes]:
    """The first of ascending numbers, and the steps between them as planes of bytes, of which the upper ones are nearly empty."""
    steps = np.diff(ascending)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return int(ascending[0]), steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(first: int, n: int, planes: bytes) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    if n > 1:
        wide[1:, : len(planes) // (n - 1)] = np.frombuffer(planes, np.uint8).reshape(-1, n - 1).T
    out = wide.view("<u8").ravel()
    out[:1] = first
    return np.cumsum(out)


def _ranges(columns: np.ndarray, width: int, ranges: int) -> Iterator[tuple[int, slice]]:
    """Ranges that ascending columns of `width` bits fall in, and where."""
    found = (columns >> np.uint64(max(0, width - 32))) * np.uint64(ranges) >> np.uint64(min(width, 32))
    for r in np.unique(found).tolist():
        yield r, slice(int(np.searchsorted(found, r)), int(np.searchsorted(found, r, "right")))


SLICE = "range int, block long, n int, first long, steps binary, counts binary, more binary"
ANSWER = "block long, kind int, range int, bits binary"


def _slices(block: int, columns: np.ndarray, counts: np.ndarray, more: np.ndarray | None, width: int, ranges: int) -> pa.Table:
    out = []
    for r, at in _ranges(columns, width, ranges):
        first, steps = packed(columns[at])
        out.append((r, block, at.stop - at.start, first, steps, np.minimum(counts[at], 255).astype(np.uint8).tobytes(), None if more is None else more[at].tobytes()))
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({x.split()[0]: pa.array(list(c), t) for x, c, t in zip(SLICE.split(", "), list(zip(*out)) or [[]] * 7, types)})


class Sketch:
    """A block's windows in order of their columns, with what is known of them."""

    def __init__(self, windows: Windows, width: int):
        column = windows.hashes(0) >> np.uint64(64 - width)
        self.columns, self.place, self.counts = np.unique(column, return_inverse=True, return_counts=True)

    def estimated(self, answers: dict[int, bytes], width: int, ranges: int) -> np.ndarray:
        """Places in `starts` of the windows whose merged count is two or more."""
        return np.flatnonzero(answered(self.columns, answers, width, ranges)[self.place])


def answered(columns: np.ndarray, answers: dict[int, bytes], width: int, ranges: int) -> np.ndarray:
    out = np.zeros(len(columns), bool)
    for r, at in _ranges(columns, width, ranges):
        if r in answers:
            out[at] = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=at.stop - at.start).astype(bool)
    return out


class Exact:
    """The estimated windows of a block as (column, further bits), each pair once, in order."""

    def __init__(self, sketch: Sketch, windows: Windows, asked: np.ndarray):
        column, more = sketch.columns[sketch.place[asked]], windows.hashes(1)[asked]
        order = np.lexsort((more, column))
        column, more = column[order], more[order]
        new = np.ones(len(order), bool)
        new[1:] = (column[1:] != column[:-1]) | (more[1:] != more[:-1])
        heads = np.flatnonzero(new)
        self.columns, self.more = column[heads], more[heads]
        self.counts = np.diff(np.append(heads, len(order)))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1


def _answers(rows: pa.Table, kind: int) -> dict[int, bytes]:
    own = rows.filter(pc.equal(rows.column("kind"), kind))
    return dict(zip(own.column("range").to_pylist(), own.column("bits").to_pylist()))


def _merged(slices: pa.Table, kind: int) -> pa.Table:
    """One range of the sketch, or of the exact groups: a block's answer has a bit for each column, or pair, that it sent."""
    rows = slices.to_pylist()
    columns = np.concatenate([unpacked(r["first"], r["n"], r["steps"]) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows])
    keys = (columns,) if kind == 1 else (np.concatenate([np.frombuffer(r["more"], np.uint64) for r in rows]), columns)
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    heads = np.flatnonzero(new)
    twice = np.add.reduceat(counts[order].astype(np.int64), heads) >= 2
    found = np.empty(len(order), bool)
    found[order] = twice[np.cumsum(new) - 1]
    out, at = [], 0
    for r in rows:
        own = found[at : at + r["n"]]
        at += r["n"]
        if own.any():
            out.append((r["block"], kind, r["range"], np.packbits(own).tobytes()))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table({x.split()[0]: pa.array(list(c), t) for x, c, t in zip(ANSWER.split(", "), list(zip(*out)) or [[]] * 4, types)})


def dedup_substrings(docs: DataFrame, words: int = WORDS, block_bytes: int = BLOCK_BYTES, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept for each row of `docs` (doc_id, text).

    Words are parted by \\x20 and \\x09-\\x0D and left as they are. A word goes if a window of `words` words of its text covers it
    whose words also stand anywhere else in order, in this or another text or row; windows may overlap, and all are judged on the
    texts as given. kept: the other words, joined by a space. A null or empty text, or one of white space, has no words; a text
    shorter than a window loses none. Repeated rows are texts like others, so all words of long ones go; null doc_ids give rows.
    Other columns are not read; an empty table gives no rows.

    Windows are told apart by a column of the sketch and 64 bits more, 97 bits or more together. The driver learns the
    texts' total bytes alone.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    size = docs.agg(F.sum(F.octet_length(text)).cast("long")).first()[0] or 0
    width = min(62, max(33, (size * COLUMNS_A_BYTE).bit_length()))
    blocks = max(SPREAD * partitions(spark), -(-size // block_bytes))
    # ranges grow with the windows alone, as every block may send a slice to each
    ranges = min(1 << 31, max(LEAST_RANGES, -(-size // (6 * range_windows))))
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)))
    # rows are named and dealt once and then read from the table, so their names and order stay
    with scratch(spark), bucketed(rows, "block", "at", "texts") as stored:

        def ordered(block: pa.Table) -> pa.Table:
            return block.sort_by("at").combine_chunks()

        def windows_of(block: pa.Table) -> Windows:
            found = block.column("text").combine_chunks()
            return Windows(found.chunk(0) if isinstance(found, pa.ChunkedArray) else found, words)

        def sketched(block: pa.Table) -> pa.Table:
            block = ordered(block)
            found = Sketch(windows_of(block), width)
            return _slices(block.column("block")[0].as_py(), found.columns, found.counts, None, width, ranges)

        def grouped(block: pa.Table, answers: pa.Table) -> pa.Table:
            if not block.num_rows or not answers.num_rows:
                return _slices(0, np.zeros(0, np.uint64), np.zeros(0), None, width, ranges)
            block = ordered(block)
            windows = windows_of(block)
            sketch = Sketch(windows, width)
            exact = Exact(sketch, windows, sketch.estimated(_answers(answers, 1), width, ranges))
            return _slices(block.column("block")[0].as_py(), exact.columns, exact.counts, exact.more, width, ranges)

        def removed(block: pa.Table, answers: pa.Table) -> pa.Table:
            block = ordered(block)
            windows, repeated = windows_of(block), np.zeros(0, np.int64)
            if answers.num_rows:
                sketch = Sketch(windows, width)
                asked = sketch.estimated(_answers(answers, 1), width, ranges)
                exact = Exact(sketch, windows, asked)
                repeated = asked[answered(exact.columns, _answers(answers, 2), width, ranges)[exact.place]]
            n, gone, kept = windows.kept(repeated)
            return pa.table({"doc_id": block.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": kept})

        texts = stored.select("block", "at", "text").groupBy("block")
        first = texts.applyInArrow(sketched, SLICE).groupBy("range").applyInArrow(lambda t: _merged(t, 1), ANSWER)
        first = written(first, "estimated")
        second = texts.cogroup(first.groupBy("block")).applyInArrow(grouped, SLICE).groupBy("range").applyInArrow(lambda t: _merged(t, 2), ANSWER)
        answers = first.union(written(second, "repeated"))
        kind = dict(docs.dtypes)["doc_id"]
        out = stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(removed, f"doc_id {kind}, n_words long, n_removed long, kept string")
        return written(out, "kept", keep=True, compression="zstd")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op12_substring_dedup": op12_substring_dedup}
ORACLE_SQL = {
    "op12_substring_dedup": f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT rid, p, array_to_string(w[p:p + {WORDS - 1}], ' ') AS g FROM w, unnest(range(1, len(w) - {WORDS - 2})) AS t(p)),
repeated AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (
  SELECT rid, list(DISTINCT q) AS qs FROM (SELECT rid, unnest(range(p, p + {WORDS})) AS q FROM windows SEMI JOIN repeated USING (g)) GROUP BY rid),
kept AS (
  SELECT w.rid, count(*) AS n, string_agg(w[q], ' ' ORDER BY q) AS body
  FROM w LEFT JOIN gone ON gone.rid = w.rid, unnest(range(1, len(w) + 1)) AS t(q) WHERE NOT coalesce(list_contains(qs, q), false) GROUP BY w.rid)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.rid = w.rid"""
}
