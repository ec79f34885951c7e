"""Packing by sum-of-squares placement (operator 10).

Each task packs the documents of its partition as they come. A level array counts the windows that are partially filled,
by fill in steps of length / levels; a run of ids goes where the sum of the squared counts grows least: into a window of
level f, which turns one count of f into one of the level of its new fill, or into a new window. A window that a run ends,
or would pass by less than a step, closes: the run is cut there, and what is left of it is placed like any other run.

At most MOST_OPEN windows are open. Beyond that no window is opened: a run may then be cut at any window, still the one
whose change of the squared counts is least, so memory doesn't grow with the partition. Documents longer than a
window fill whole ones first. What is open when the partition ends, less than MOST_OPEN windows, is closed by cutting:
the emptiest windows fill the gaps of the fullest, and the last is cut at powers of two, where no padding is due.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import in_arrow, table, text_or_empty, tokenizer_path
from .tokens import encoder, slices

LENGTH = 4096
END = 2
#: Levels of the array: fills are counted in steps of LENGTH / LEVELS.
LEVELS = 64
#: Partially filled windows of a task.
MOST_OPEN = 256
#: Characters that a worker encodes at once: fewer take less memory and more time.
SLICE_CHARS = 6_000_000
#: Sequences of one task; its ids start at its partition's number times this.
PER_TASK = 1 << 40

#: A run of a document's ids: the document, its ids before the run, and the run's ids.
Run = tuple[object, int, Sequence]


class Packer:
    """Places runs into windows; `closed` takes (sequence, runs) of each full one until the caller empties it."""

    def __init__(self, length: int = LENGTH, levels: int = LEVELS, most_open: int = MOST_OPEN):
        self.length, self.levels, self.most_open = length, levels, most_open
        self.step = -(-length // levels)
        self.counts = [0] * levels
        self.open: list[list[tuple[int, list[Run]]]] = [[] for _ in range(levels)]
        self.n_open = self.made = 0
        self.closed: list[tuple[int, list[Run]]] = []

    def _close(self, runs: list[Run]) -> None:
        self.closed.append((self.made, runs))
        self.made += 1

    def add(self, doc, ids: Sequence) -> None:
        start = 0
        while len(ids) - start >= self.length:
            self._close([(doc, start, ids[start : start + self.length])])
            start += self.length
        while start < len(ids):
            start += self._place((doc, start, ids[start:]))

    def choice(self, size: int) -> int:
        """The level to take a window from, or -1 for a new one: the least change of the sum of squared counts, ties to the fullest."""
        full = self.n_open >= self.most_open
        counts, most = self.counts, self.length + self.step
        # from level f to level g: counts[f] falls by one and counts[g] rises by one; a full window leaves the array
        best, least = -1, None if full else 2 * counts[size // self.step] + 1
        for level in range(self.levels - 1, -1, -1):
            here = counts[level]
            if here:
                after = self.open[level][-1][0] + size
                if full or after < most:
                    to = after // self.step
                    change = 1 - 2 * here if after >= self.length else 0 if to == level else 2 * (counts[to] - here) + 2
                    if least is None or change < least or (change == least and best < 0):
                        best, least = level, change
        return best

    def _take(self, level: int) -> tuple[int, list[Run]]:
        if level < 0:
            return 0, []
        fill, runs = self.open[level].pop()
        self.counts[level] -= 1
        self.n_open -= 1
        return fill, runs

    def _place(self, run: Run) -> int:
        """Places the run, or as much of it as fits, and gives the number of ids placed."""
        doc, start, ids = run
        fill, runs = self._take(self.choice(len(ids)))
        n = min(len(ids), self.length - fill)
        runs.append((doc, start, ids[:n]))
        fill += n
        if fill == self.length:
            self._close(runs)
        else:
            level = fill // self.step
            self.open[level].append((fill, runs))
            self.counts[level] += 1
            self.n_open += 1
        return n

    def finish(self) -> None:
        """Closes what is open: the emptiest windows are cut into the gaps of the fullest ones."""
        left = sorted((x for level in self.open for x in level), key=lambda x: x[0])
        low, spare = 0, []
        for high in range(len(left) - 1, -1, -1):
            if high < low:
                break
            fill, runs = left[high]
            if low == high:
                spare = runs + spare
                break
            while fill < self.length and (spare or low < high):
                if not spare:
                    spare = left[low][1]
                    low += 1
                doc, start, ids = spare.pop()
                take = min(len(ids), self.length - fill)
                at = len(ids) - take
                runs.append((doc, start + at, ids[at:]))
                fill += take
                if at:
                    spare.append((doc, start, ids[:at]))
            if fill == self.length:
                self._close(runs)
            else:
                spare = runs
        # what remains is less than two windows: whole ones, then powers of two
        while spare:
            total = sum(len(r[2]) for r in spare)
            room, runs = min(self.length, 1 << (total.bit_length() - 1)), []
            while room:
                doc, start, ids = spare.pop(0)
                take = min(len(ids), room)
                runs.append((doc, start, ids[:take]))
                room -= take
                if take < len(ids):
                    spare.insert(0, (doc, start + take, ids[take:]))
            self._close(runs)
        self.open, self.counts, self.n_open = [[] for _ in range(self.levels)], [0] * self.levels, 0


def pack_documents(
    docs: DataFrame, path: str, end: int = END, length: int = LENGTH, levels: int = LEVELS, most_open: int = MOST_OPEN, slice_chars: int = SLICE_CHARS, with_ids: bool = False
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each document; `with_ids`
    adds the piece's ids (array<int>).

    A document's ids are those of its whole text and then `end`, so a null or empty text has one id. Every id lies in
    one piece, a sequence holds at most `length` ids, its pieces lie one behind the other from offset 0, and
    sequence_ids are unique but not gapless. Sequences are full but for powers of two at the end of each partition, so
    nothing is padded. The placement follows the order of rows within a partition, which a re-run task reads again.
    Rows with a null doc_id and repeated rows are documents of their own; other columns are not read; an empty table
    gives no rows. A task holds the ids of one slice of texts and of `most_open` windows.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), Packer(length, levels, most_open)
        base = TaskContext.get().partitionId() * PER_TASK

        def out() -> pa.RecordBatch:
            rows, ids = [], []
            for sequence, runs in packer.closed:
                offset = 0
                for (doc_id, total), start, piece in runs:
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece), total, base + sequence, offset))
                    ids.append(piece)
                    offset += len(piece)
            packer.closed = []
            found = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(columns))]
            if with_ids:
                found.append(pa.array([p.astype(np.int32) for p in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(found, columns + ["ids"] * with_ids)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in slices(texts, slice_chars):
                flat, sizes = enc.ids(texts[s])
                ends = np.cumsum(sizes)
                flat, ends = np.insert(flat, ends, end).astype("<u4"), ends + np.arange(1, len(ends) + 1)
                for doc_id, low, high in zip(doc_ids[s], (ends - sizes - 1).tolist(), ends.tolist()):
                    packer.add((doc_id, high - low), flat[low:high])
                # what stays open must not keep the whole slice
                packer.open = [[(fill, [(doc, start, ids.copy() if ids.base is flat else ids) for doc, start, ids in runs]) for fill, runs in level] for level in packer.open]
                yield out()
        packer.finish()
        yield out()

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return in_arrow(rows, packed, ", ".join(f"{c} long" for c in columns) + ", ids array<int>" * with_ids)


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op10_sum_of_squares_packing": op10_sum_of_squares_packing}
ORACLE_SQL: dict[str, str] = {}
