"""Token-id files under an adaptive context-mixing range coder (operator 7).

Documents are put in ascending doc_id order and encoded to token ids. A task joins whole documents to frames; a frame's
ids are cut into blocks, each coded from a fresh model and checked by sums of its own, so any block can be read alone.

The model mixes three predictions of the next id. Order 0 counts the ids of the block so far. Order 1 and order 2 hold an
id for the last id and for the last two (hashed), with a confidence that grows with each hit and falls with each miss.
How much of the interval the two get is learned: for each pair of confidences, and whether both name the same id, the
block counts how often each was right. The rest goes to order 0. The mixture is one interval that drives a range coder.

A block is cut into lanes of equal length. All lanes of a block advance together and share its model, which learns from
all of them after each step; so the arithmetic runs on arrays, and a block of a million ids fills its tables.

A frame is: b"LKF3", then as little-endian unsigned 32-bit integers its number of ids, of blocks, of lanes of a block, of
steps of a lane, of different ids, the number of bytes and the crc32 of their list; for each block its number of bytes,
the crc32 of its ids' places in the list and the crc32 of its bytes; then the list, differences of ascending ids under
zlib; then the blocks: for each lane its number of 16-bit words, then the words, all as 16-bit integers. Frames are the
rows of a Parquet table, so Spark's committers make the files whole and any store can hold them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_arrow, partitions, shared_path, table, text_or_empty, tokenizer_path
from .tokens import encoder, slices

END = 0
FRAME_IDS = 2_000_000
BLOCK_IDS = 1 << 20
LANES = 2048
#: Least steps of a lane; smaller blocks have fewer lanes.
STEPS = 256
MAGIC = b"LKF3"
#: Slots of the table of order 2 of a block, and bits and levels of confidence.
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
BITS = 3
SURE = 1 << BITS
#: What an id adds to its count of order 0; ids not seen yet count 1.
GAIN = 16
#: Bits of the sum of order 0, more where a frame has very many different ids; in the mixture the shares of the three predictions take 16 more.
SCALE = 22
#: Bits of the steps by which the decoder looks ids of order 0 up.
NEAR = 6
_U = np.uint64
_LOW = _U(1 << 48)
#: Which order was right, by whether order 2 and order 1 name the id; and a confidence after a miss and after a hit.
_WHICH = np.array([2, 1, 0, 0])
_LEARNT = np.array([1, 1, *(k >> 1 for k in range(2, SURE)), *(min(k + 1, SURE - 1) for k in range(SURE))], np.int32)


class _Model:
    """The predictions for the next id of every lane; lanes of a block learn in common.

    The ids of block b stand for the numbers b * known and on, so that one table serves all blocks."""

    def __init__(self, blocks: int, lanes: int, known: int):
        of = np.repeat(np.arange(blocks), lanes)
        self.blocks, self.known, self.scale = blocks, known, max(SCALE, known.bit_length() + 2)
        #: Bits of the sum of the mixture.
        self.whole = self.scale + 16
        self.base, self.base2, self.floor = of * known, of * SLOTS, of << self.scale
        self.states = 2 * SURE * SURE
        self.base_state = of * self.states
        # an entry is an id times SURE plus its confidence
        self.one, self.two = np.zeros(blocks * known, np.int32), np.zeros(blocks * SLOTS, np.int32)
        #: How often order 2, order 1 and order 0 were right in each state; small first counts speak for order 0.
        self.right = np.tile(np.array([1.0, 1.0, 6.0]), (blocks * self.states, 1))
        self.counts = np.ones((blocks, known), np.int64)
        self.late: list[np.ndarray] = []
        self.met: list[np.ndarray] = []
        self.at1, self.p1, self.p2 = self.base, np.zeros(blocks * lanes, np.uint32), np.zeros(blocks * lanes, np.uint32)
        self.steps, self.next = 0, 1
        self._weigh()
        self._count()

    def _weigh(self) -> None:
        if self.met:
            self.right += np.bincount(np.concatenate(self.met), minlength=self.right.size).reshape(self.right.shape)
            self.met = []
        share = self.right * (65536 / self.right.sum(1, keepdims=True))
        # where both orders name the same id, order 2 has it
        self.f2 = np.clip(share[:, 0], 16, 60000).astype(np.int64)
        f1 = np.clip(share[:, 1], 16, 65536 - 2048 - self.f2).astype(np.int64)
        f1[1::2] = 0
        self.both = self.f2 + f1

    def _count(self) -> None:
        """Brings the counts of order 0 to a sum of 1 << scale in each block, at least 1 an id; `cum` runs on from block to block."""
        if self.late:
            self.counts += GAIN * np.bincount(np.concatenate(self.late), minlength=self.counts.size).reshape(self.counts.shape)
            self.late = []
        ends = np.cumsum(self.counts, axis=1)
        ends = ends * ((1 << self.scale) - self.known) // ends[:, -1:] + np.arange(1, self.known + 1)
        self.cum = np.concatenate([[0], (ends + (np.arange(self.blocks)[:, None] << self.scale)).ravel()])
        self.found = None

    def predict(self) -> None:
        mixed = (self.p1 * np.uint32(0x9E3779B1) + self.p2 * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOT_BITS)
        self.at2 = self.base2 + mixed
        self.e1, self.e2 = self.one.take(self.at1), self.two.take(self.at2)
        self.id1, self.id2 = self.e1 >> BITS, self.e2 >> BITS
        self.sure1, self.sure2 = self.e1 & (SURE - 1), self.e2 & (SURE - 1)
        self.state = self.base_state + (((self.sure2 << BITS) + self.sure1 << 1) + (self.id1 == self.id2))
        self.w2, self.skip = self.f2.take(self.state), self.both.take(self.state)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the ids' intervals within 1 << whole."""
        self.hit1, self.hit2 = ids == self.id1, ids == self.id2
        self.now = self.base + ids
        start = self.cum.take(self.now)
        room = 65536 - self.skip
        width = (self.cum.take(self.now + 1) - start) * room
        start = (start - self.floor) * room + (self.skip << self.scale)
        named = np.flatnonzero(self.hit1 | self.hit2)
        w2, second = self.w2.take(named), self.hit2.take(named)
        start[named] = np.where(second, 0, w2) << self.scale
        width[named] = np.where(second, w2, self.skip.take(named) - w2) << self.scale
        return start, width

    def id_at(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold the values, and these intervals' starts and widths."""
        high = value >> self.scale
        second = high < self.w2
        ids = np.where(second, self.id2, self.id1)
        start = np.where(second, 0, self.w2)
        width = np.where(second, self.w2, self.skip - start) << self.scale
        start <<= self.scale
        rest = np.flatnonzero(high >= self.skip)
        skip, floor = self.skip.take(rest), self.floor.take(rest)
        room = 65536 - skip
        skip <<= self.scale
        now = self._find((value.take(rest) - skip) // room + floor)
        low = self.cum.take(now)
        ids[rest] = now - self.base.take(rest)
        start[rest] = (low - floor) * room + skip
        width[rest] = (self.cum.take(now + 1) - low) * room
        self.hit1, self.hit2 = ids == self.id1, ids == self.id2
        self.now = self.base + ids
        return ids, start, width

    def _find(self, y: np.ndarray) -> np.ndarray:
        """The places in `cum` of the ids that hold the values: by the steps of NEAR that one id holds, else by search."""
        if self.found is None:
            # how many steps begin within each id
            begun = -(-self.cum // (1 << NEAR))
            self.found = np.append(np.repeat(np.arange(len(self.cum) - 1), np.diff(begun)), len(self.cum) - 2)
        step = y >> NEAR
        now = self.found.take(step)
        open_ = np.flatnonzero(now != self.found.take(step + 1))
        now[open_] = self.cum.searchsorted(y.take(open_), side="right") - 1
        return now

    def learn(self, ids: np.ndarray) -> None:
        """Takes the ids, 32 bits wide, whose intervals were asked for last."""
        self.met.append(self.state * 3 + _WHICH.take(self.hit2 * np.int8(2) + self.hit1))
        named = ids << BITS
        for entries, at, held, sure, hit in ((self.two, self.at2, self.e2, self.sure2, self.hit2), (self.one, self.at1, self.e1, self.sure1, self.hit1)):
            entries[at] = np.where(hit | (sure > 1), held - sure, named) + _LEARNT.take(sure + (hit * np.int8(SURE)))
        self.late.append(self.now)
        self.p2, self.p1, self.at1 = self.p1, ids.view(np.uint32), self.now
        self.steps += 1
        if self.steps == self.next:
            self._count()
            self.next = self.steps + 1 + self.steps // 8
        if self.steps < 32 or self.steps % 8 == 0:
            self._weigh()


def _turned(x: np.ndarray) -> np.ndarray:
    """The transpose, made in strips that fit a cache."""
    out = np.empty(x.shape[::-1], x.dtype)
    for k in range(0, len(x), 64):
        out[:, k : k + 64] = x[k : k + 64].T
    return out


def encode_blocks(ids: np.ndarray, known: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of `ids` (blocks, lanes, steps; 32 bits wide) the number of words of each lane, and the lanes' words joined."""
    blocks, lanes, steps = ids.shape
    n = blocks * lanes
    # lanes advance alike, so the words at one place of all lanes stand together; those above 16 bits hold a carry
    model, out, at = _Model(blocks, lanes, known), np.zeros((3 * steps + 8) * n, np.uint32), np.arange(n)
    low, span = np.zeros(n, _U), np.full(n, 2**64 - 1, _U)
    columns = _turned(ids.reshape(n, steps).view(np.int32))

    def carry(carried: np.ndarray) -> None:
        if len(carried):
            out[at.take(carried) - n] += np.uint32(1)

    for t in range(steps):
        model.predict()
        start, width = model.interval(columns[t])
        span >>= _U(model.whole)
        add = start.view(_U) * span
        low += add
        carry(np.flatnonzero(low < add))
        span *= width.view(_U)
        full = np.flatnonzero(span < _LOW)
        while len(full):
            lows, spans, places = low.take(full), span.take(full) << _U(16), at.take(full)
            out[places] = lows >> _U(48)
            at[full] = places + n
            low[full] = lows << _U(16)
            span[full] = spans
            full = full[spans < _LOW]
        model.learn(columns[t])
    # one word more names a number within the interval that ends in zeros
    add = (~low + _U(1)) & _U((1 << 48) - 1)
    low += add
    carry(np.flatnonzero(low < add))
    out[at] = low >> _U(48)
    sizes = at // n + 1
    words = _turned(out[: int(sizes.max()) * n].reshape(-1, n))
    flat = words[np.arange(words.shape[1]) < sizes[:, None]]
    # the number is below 1, so no carry leaves a lane
    while len(over := np.flatnonzero(flat >> np.uint32(16))):
        flat[over] &= np.uint32(0xFFFF)
        flat[over - 1] += np.uint32(1)
    ends = np.cumsum(sizes.reshape(blocks, lanes).sum(1))[:-1]
    return zip(sizes.reshape(blocks, lanes), np.split(flat, ends))


def decode_blocks(sizes: np.ndarray, flat: np.ndarray, steps: int, known: int) -> np.ndarray:
    """The ids of blocks (blocks, lanes, steps) from their lanes' numbers of words (blocks, lanes) and the words joined."""
    (blocks, lanes), n = sizes.shape, sizes.size
    words = np.zeros((n, int(sizes.max()) + 5), np.uint16)
    words[np.arange(words.shape[1]) < sizes.reshape(n, 1)] = flat
    words = _turned(words).ravel()
    model, at, last = _Model(blocks, lanes, known), np.arange(4 * n, 5 * n), len(words) - 1
    code = sum(words[k * n : (k + 1) * n].astype(_U) << _U(48 - 16 * k) for k in range(4))
    span = np.full(n, 2**64 - 1, _U)
    out = np.zeros((steps, n), np.int32)
    for t in range(steps):
        model.predict()
        span >>= _U(model.whole)
        # a damaged block may decode to anything; its checksum tells
        ids, start, width = model.id_at(np.minimum(code // span, _U((1 << model.whole) - 1)).view(np.int64))
        code -= start.view(_U) * span
        span *= width.view(_U)
        full = np.flatnonzero(span < _LOW)
        while len(full):
            spans, places = np.maximum(span.take(full), _U(1)) << _U(16), at.take(full)
            code[full] = code.take(full) << _U(16) | words.take(places, mode="clip")
            at[full] = places + n
            span[full] = spans
            full = full[spans < _LOW]
        model.learn(ids)
        out[t] = ids
    return _turned(out).reshape(blocks, lanes, steps)


def encode_frame(ids: np.ndarray) -> bytes:
    """The file format's bytes for a run of ids; the model codes their places in the frame's own list of ids."""
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    lanes = min(LANES, max(1, n // max(blocks, 1) // STEPS))
    steps = -(-n // max(blocks * lanes, 1))
    there = np.zeros(int(ids.max()) + 1 if n else 0, bool)
    there[ids] = True
    listed = np.flatnonzero(there)
    places = (np.cumsum(there) - 1).astype("<u4")[ids]
    names = zlib.compress(np.diff(listed, prepend=0).astype("<u4").tobytes())
    padded = np.zeros(blocks * lanes * steps, "<u4")
    padded[:n] = places
    cube = padded.reshape(blocks, lanes, steps)
    head, bodies = [n, blocks, lanes, steps, len(listed), len(names), zlib.crc32(names)], []
    for block, (sizes, words) in zip(cube, encode_blocks(cube, len(listed)) if n else []):
        bodies.append(sizes.astype("<u2").tobytes() + words.astype("<u2").tobytes())
        head += [len(bodies[-1]), zlib.crc32(block.tobytes()), zlib.crc32(bodies[-1])]
    return MAGIC + np.array(head, "<u4").tobytes() + names + b"".join(bodies)


def decode_frame(data: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a frame, or of one block of it; raises ValueError where the format or a checksum is wrong."""
    if data[:4] != MAGIC or len(data) < 32:
        raise ValueError("not a frame")
    n, blocks, lanes, steps, known, name_bytes, name_crc = np.frombuffer(data, "<u4", 7, 4).tolist()
    begin = 32 + 12 * blocks
    if len(data) < begin + name_bytes:
        raise ValueError("a frame of the wrong length")
    names = data[begin : begin + name_bytes]
    head = np.frombuffer(data, "<u4", 3 * blocks, 32).reshape(blocks, 3)
    ends = begin + name_bytes + np.cumsum(head[:, 0], dtype=np.int64)
    if len(data) != (ends[-1] if blocks else begin + name_bytes):
        raise ValueError("a frame of the wrong length")
    if zlib.crc32(names) != name_crc:
        raise ValueError("the list of ids is damaged")
    listed = np.cumsum(np.frombuffer(zlib.decompress(names), "<u4"), dtype=np.int64).astype("<u4")
    asked = range(blocks) if only is None else [only]
    sizes, words = [], []
    for k in asked:
        body = data[int(ends[k]) - int(head[k, 0]) : int(ends[k])]
        if zlib.crc32(body) != head[k, 2]:
            raise ValueError(f"block {k} is damaged")
        sizes.append(np.frombuffer(body, "<u2", lanes).astype(np.int64))
        words.append(np.frombuffer(body, "<u2", offset=2 * lanes))
    if not sizes:
        return np.zeros(0, "<u4")
    rows = decode_blocks(np.stack(sizes), np.concatenate(words), steps, known).view("<u4")
    for k, row in zip(asked, rows):
        if zlib.crc32(row.tobytes()) != head[k, 1]:
            raise ValueError(f"block {k} decodes to other ids")
    size = lanes * steps
    return listed[rows.ravel()[: n if only is None else max(0, min(size, n - only * size))]]


def write_token_files(docs: DataFrame, path: str, to: str, end: int = END, frame_ids: int = FRAME_IDS) -> None:
    """Writes the ids of all documents, each followed by `end`, to the folder `to`, in ascending doc_id order.

    A null or empty text has only `end`. Null doc_ids come first; rows with equal doc_ids stand together, ordered by a
    hash of their texts. Other columns are not read. Rows: part, frame, n_ids, doc_ids, doc_tokens, data; parts and the
    frames in them are in the order of the documents.
    """
    names = ["part", "frame", "n_ids", "doc_ids", "doc_tokens", "data"]

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, frame = encoder(path), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            columns = [pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([encode_frame(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in slices(texts):
                flat, counts = enc.ids(texts[s])
                ends = np.cumsum(counts)
                held.append(np.insert(flat, ends, end))
                doc_ids += own[s]
                sizes += (counts + 1).tolist()
                n += len(held[-1])
                if n >= frame_ids:
                    yield out()
                    frame += 1
                    doc_ids, sizes, held, n = [], [], [], 0
        if doc_ids:
            yield out()

    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    frames = in_arrow(ordered, framed, "part int, frame int, n_ids long, doc_ids array<long>, doc_tokens array<long>, data binary")
    frames.write.option("compression", "none").parquet(to)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files that `write_token_files` made."""
    frames = spark.read.schema("part int, frame int, n_ids long, doc_ids array<long>, doc_tokens array<long>, data binary").parquet(path)
    # one row a part; a part is a task's share of all documents
    before = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = frames.select("part", "frame", inside.alias("frame_start")).join(before, "part").select("part", "frame", (F.col("part_start") + F.col("frame_start")).alias("base"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = decode_frame(row["data"]), np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, row["part"], np.int32)), pa.array(np.full(k, row["frame"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                    ["part", "frame", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = frames.select("part", "frame", "doc_ids", "doc_tokens", "data").mapInArrow(decoded, "part int, frame int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "frame"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), to)
    return read_token_files(spark, to)


QUERIES = {"op7_context_mixing_files": op7_context_mixing_files}
ORACLE_SQL: dict[str, str] = {}
