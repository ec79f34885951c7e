"""Exact n-gram Jaccard join by a prefix tree (operator 9).

A text is a set of 63-bit n-gram tokens whose numeric order is the global order: the upper bits grow with how often the
corpus holds the n-gram, by a count over all documents in a table of fixed size, so common passages come last. The order
only steers the work; any order gives the same links. Two sets that link share a token among the first tokens of each
(the prefix filter). Sets that share such a token meet:

1. in blocks of bounded size with the least set of their token, which probes a prefix tree of the block; this already
   joins nearly all copies;
2. where the sets of a token still lie in different components, all with all, in tiles of bounded size. Sketches leave
   few of them; those that they would join, over all tokens, are searched together.

A prefix tree stores the ordered sets; a probe shares its overlaps along the paths and leaves out what the remaining
lengths can't bring to a link. Before sets are fetched, sketches of a few bytes rule out pairs that can't share enough.

Only links between sets not joined before are kept, which leaves the components of all links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, in_arrow, scratch, table, text_or_empty, written
from .tokens import slices

WORDS = 5
PERCENT = 75
#: Sets of one side of a tile.
BLOCK = 256
#: Bins of a set's sketch.
BINS = 128
#: Slots of the table of counts that orders the tokens, and tasks that sum such tables.
SLOTS = 1 << 15
SUMS = 16
#: Least and most bits of the filter of the sets that are needed: eight for each set, between these.
FILTER_BITS = (1 << 20, 1 << 28)
#: Sets that may share a 64-bit name with another one: a few hundred are likely among 10**11.
MOST_CLASHES = 10_000
_ODD = [np.uint64(xxhash.xxh3_64_intdigest(f"place {k}") | 1) for k in range(64)]


class Shingler:
    """The distinct n-word shingles of texts as 58-bit tokens, ascending."""

    def __init__(self, words: int = WORDS):
        self.n = words

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        return [x for s in slices(texts, 2_000_000) for x in self._sets(texts[s])]

    def _sets(self, texts: list[str]) -> list[np.ndarray]:
        # ascii_lower changes A-Z alone and ascii_split_whitespace parts at \x20 and \x09-\x0D alone
        words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        coded = pc.dictionary_encode(words.flatten())
        names = coded.dictionary.to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        at = coded.indices.to_numpy()
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        # white space at an end leaves an empty word there
        empty = np.array([x == "" for x in names], bool)[at] if "" in names else np.zeros(len(at), bool)
        bounds = bounds - np.concatenate([[0], np.cumsum(empty)])[bounds]
        h = hashes[at[~empty]]
        whole = self._mixed(h, self.n)
        out = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if high - low >= self.n:
                x = whole[low : high - self.n + 1]
            else:
                x = self._mixed(h[low:high], high - low) if high > low else h[:0]
            x = np.sort(x >> np.uint64(6))
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            out.append(x[keep].astype(np.int64))
        return out

    @staticmethod
    def _mixed(h: np.ndarray, n: int) -> np.ndarray:
        """A hash of every n words that follow each other."""
        m = max(len(h) - n + 1, 0)
        x = np.full(m, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m] * _ODD[k % 64]
                x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(32))


def _name(tokens: np.ndarray, seed: int = 0) -> int:
    """A 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed))))


def _summed(packed: DataFrame) -> np.ndarray:
    """The sum of packed vectors of counts: tasks sum what they have, and the driver one vector of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["counts"])

    sums = packed.repartition(SUMS).mapInArrow(run, "counts binary").collect()
    return sum((np.frombuffer(r.counts, "<i8") for r in sums), np.zeros(SLOTS, np.int64))


def _levels(counts: np.ndarray) -> np.ndarray:
    """For each slot the upper bits of its tokens: quarter octaves above the mean count."""
    mean = max(counts.mean(), 1.0)
    return np.clip(4 * np.log2(np.maximum(counts / mean, 1)), 0, 31).astype(np.int64) << 58


def _ordered(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return np.sort(tokens | levels[tokens & (SLOTS - 1)])


def least_overlap(size: int, percent: int) -> int:
    """The smallest overlap of a set of this size with any set it links with."""
    return -(-percent * size // 100)


class Tree:
    """A prefix tree of ascending arrays, compressed to branching points; nodes know the lengths and the group below."""

    __slots__ = ("edge", "depth", "low", "high", "shortest", "longest", "group", "children", "ends")

    def __init__(self, sets: list[np.ndarray], groups: list[int], low: int, high: int, depth: int):
        first, last = sets[low], sets[high - 1]
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:n] != last[depth:n])
        end = depth + int(differ[0]) if len(differ) else n
        self.edge, self.depth, self.low, self.high = first[depth:end], end, low, high
        sizes = [len(s) for s in sets[low:high]]
        self.shortest, self.longest = min(sizes), max(sizes)
        own = set(groups[low:high])
        self.group = own.pop() if len(own) == 1 else None
        self.children, at = [], low
        while at < high and len(sets[at]) == end:
            at += 1
        self.ends = range(low, at)
        while at < high:
            stop = at + 1
            while stop < high and sets[stop][end] == sets[at][end]:
                stop += 1
            self.children.append(Tree(sets, groups, at, stop, end))
            at = stop


def tree_links(sets: list[np.ndarray], groups: list[int], percent: int = PERCENT, probes: list[int] | None = None) -> list[tuple[int, int]]:
    """Positions of linked sets, enough to join all that link and have no common group; sets ascend within.

    With `probes`, only links of these positions are sought.
    """
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">i8").tobytes())
    sets, groups = [sets[k] for k in order], [groups[k] for k in order]
    root = Tree(sets, groups, 0, len(sets), 0)
    up: dict[int, int] = {g: g for g in groups}

    def top(g: int) -> int:
        while up[g] != g:
            up[g] = up[up[g]]
            g = up[g]
        return g

    out = []
    asked = None if probes is None else set(probes)
    for k, x in enumerate(sets):
        if asked is not None and order[k] not in asked:
            continue
        n = len(x)
        stack = [(root, 0, 0)]
        while stack:
            node, shared, at = stack.pop()
            if (asked is None and node.high <= k + 1) or (node.group is not None and top(node.group) == top(groups[k])):
                continue
            if len(node.edge):
                places = np.searchsorted(x, node.edge)
                shared += int((x[np.minimum(places, n - 1)] == node.edge).sum())
                at = int(np.searchsorted(x, node.edge[-1], side="right"))
            # the length below this node that could still overlap most, relative to what it must overlap
            length = min(max(node.depth + n - at, node.shortest), node.longest)
            if (100 + percent) * (shared + min(n - at, length - node.depth)) < percent * (n + length):
                continue
            for y in node.ends:
                if (asked is not None or y > k) and y != k and top(groups[y]) != top(groups[k]) and 100 * shared >= percent * (n + len(sets[y]) - shared):
                    out.append((order[k], order[y]))
                    up[top(groups[y])] = top(groups[k])
            stack += [(child, shared, at) for child in node.children]
    return out


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of the tokens over bins, BINS or a power of two times as many where a bin would hold more than 8 on average.

    Two sets share at most the sum of the smaller counts. A full bin says nothing."""
    bins = BINS << max(0, (len(tokens) - 1).bit_length() - (8 * BINS).bit_length() + 1)
    return np.minimum(np.bincount(tokens >> 20 & (bins - 1), minlength=bins), 255).astype(np.uint8).tobytes()


def _matrix(sketches: list[bytes], bins: int) -> np.ndarray:
    """Sketches of one length as rows, folded to `bins` bins."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    while rows.shape[1] > bins:
        half = rows.shape[1] // 2
        rows = np.minimum(rows[:, :half].astype(np.int16) + rows[:, half:], 255).astype(np.uint8)
    return rows


def may_link(one: np.ndarray, two: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of sketches of sets of n and m tokens leave room for a link."""
    least = np.minimum(one, two)
    bound = least.sum(-1, dtype=np.int64)
    near = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return near & ((least == 255).any(-1) | ((100 + percent) * bound >= percent * (n + m)))


def hopeful_pairs(low: list[bytes], high: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """`may_link` for pairs of sketches of any lengths."""
    ok = np.zeros(len(low), bool)
    a, b = np.array([len(x) for x in low], np.int64), np.array([len(x) for x in high], np.int64)
    for x, y in set(zip(a.tolist(), b.tolist())):
        at = np.flatnonzero((a == x) & (b == y))
        bins = min(x, y)
        for part in np.array_split(at, len(at) * max(x, y) // 10_000_000 + 1):
            ok[part] = may_link(_matrix([low[k] for k in part], bins), _matrix([high[k] for k in part], bins), n[part], m[part], percent)
    return ok


def hopeful_groups(sketches: list[bytes], n: np.ndarray, comp: np.ndarray, percent: int) -> list[list[int]]:
    """Sets that may link with another one of another component, grouped by what such links could join."""
    up: dict[int, int] = {}

    def top(k: int) -> int:
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    lengths, doublings = np.array([len(x) for x in sketches]), max(1, (-(-100 // percent) - 1).bit_length())
    for bins in np.unique(lengths).tolist():
        # sets that link differ in size by 100 / percent at most, so in length of sketch by as many doublings as that takes
        of_length = [np.flatnonzero(lengths == bins << k) for k in range(doublings + 1)]
        own, at = of_length[0], np.concatenate(of_length)
        rows = np.vstack([_matrix([sketches[k] for k in same], bins) for same in of_length if len(same)])
        for k in range(len(own)):
            other = np.arange(k + 1, len(at))
            x, y = at[k], at[other]
            other = other[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            if len(other):
                for z in at[other[may_link(rows[other], rows[k], n[at[other]], n[x], percent)]].tolist():
                    up[top(z)] = top(int(x))
    out: dict[int, list[int]] = {}
    for k in sorted(up):
        out.setdefault(top(k), []).append(k)
    return list(out.values())


def _first_seen(nodes: list[int], seen: set[int]) -> list[int]:
    """Positions of nodes that this task hasn't sent; the memory is emptied when it grows large."""
    if len(seen) > 200_000:
        seen.clear()
    return [k for k, x in enumerate(nodes) if not (x in seen or seen.add(x))]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys from sorted batches, with the runs' bounds."""
    carry = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([carry, t]).combine_chunks() if carry is not None and carry.num_rows else t
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        yield t.slice(0, starts[-1]), starts
        carry = t.slice(starts[-1])
    if carry is not None and carry.num_rows:
        yield carry, np.array([0, carry.num_rows])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (token, node) in order: the rows of tokens that two nodes or more hold, once each, with the least node."""
    names = ["token", "node", "low"]
    last_token = last_node = low = None
    sent = True  # whether the first row of the run at hand was sent
    for batch in batches:
        token, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(token):
            continue
        same = np.concatenate([[token[0] == last_token], token[1:] == token[:-1]])
        again = same & np.concatenate([[node[0] == last_node], node[1:] == node[:-1]])
        starts = np.flatnonzero(~same)
        run = np.cumsum(~same) - 1  # -1: the run carried over
        lows = np.concatenate([node[starts], [0 if low is None else low]])[run]
        more = same & ~again
        heads = np.zeros(len(token), bool)
        heads[starts[np.bincount(run[more & (run >= 0)], minlength=len(starts)) > 0]] = True
        out = more | heads
        t, n, l = token[out], node[out], lows[out]
        if not sent and (more & (run < 0)).any():
            t, n, l = np.concatenate([[last_token], t]), np.concatenate([[low], n]), np.concatenate([[low], l])
            sent = True
        if len(starts):
            low, sent = node[starts[-1]], bool(heads[starts[-1]])
        last_token, last_node = token[-1], node[-1]
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(l.astype(np.int64))], names)


def _bits(nodes: DataFrame) -> np.ndarray:
    """A filter of the nodes, whose size goes with their number; what passes it by chance only costs a little."""
    size = int(np.clip(1 << max(8 * nodes.count() - 1, 1).bit_length(), *FILTER_BITS))
    bits = np.zeros(size // 8, np.uint8)
    place = nodes.select(F.pmod("node", F.lit(size)).alias("p"))
    for r in place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect():
        # place 0 lies in bucket 0 alone; bucket k holds places (k - 1) * 32768 + 1 to k * 32768
        held = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little"))
        at = held + (r.bucket - 1) * 32768 + 1 if r.bucket else held * 0
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def shingle_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text).

    Words are parted by \\x20 and \\x09-\\x0D, A-Z lower-cased. A text of fewer than `words` words is one shingle, its
    whole sequence; a null or empty text has none and links with nothing: its component is itself. Two rows link when
    100 * overlap >= percent * union, equal sets among them. component_id is the smallest doc_id that links lead to.
    Repeated rows give a row each. A null doc_id takes its component's smallest doc_id, null if there is none. Other
    columns are not read; an empty table gives no rows. Sets are told apart by two
    64-bit hashes, shingles within two sets by 58 bits.
    """
    with scratch(docs.sparkSession):
        return written(_classes(docs, words, percent, block), "classes", keep=True)


def _classes(docs: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    texts = docs.select("doc_id", text_or_empty().alias("text"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts, seen = Shingler(words), np.zeros(SLOTS, np.int64), set()
        names = ["doc_id", "n", "node", "twin", "sketch", "counts"]
        for batch in batches:
            sets = shingles.sets(batch.column(1).to_pylist())
            if sets:
                counts += np.bincount(np.concatenate(sets) & (SLOTS - 1), minlength=SLOTS)
            n, nodes = len(sets), [_name(s) for s in sets]
            # a set is known by both names here, so that of two sets with one name both have a sketch
            new = set(_first_seen([(x, _name(s, 1)) for x, s in zip(nodes, sets)], seen))
            sketches = [sketch(s) if k in new else None for k, s in enumerate(sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array([_name(s, 1) for s in sets], pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.binary())], names)
        # a task's counts are one row
        nothing = [pa.nulls(1, pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*nothing, pa.nulls(1, pa.binary()), pa.array([zlib.compress(counts.astype("<i8").tobytes(), 1)], pa.binary())], names)

    read = written(in_arrow(texts, sized, "doc_id long, n long, node long, twin long, sketch binary, counts binary"), "sets")
    levels = _levels(_summed(read.where("counts IS NOT NULL").select("counts")))
    # different sets of one 64-bit name take their second name; there are none but in the very largest corpora
    clash = read.where("counts IS NULL").groupBy("node").agg((F.min("twin") != F.max("twin")).alias("c")).where("c").select("node").limit(MOST_CLASHES + 1)
    clashes = frozenset(r.node for r in clash.collect())
    if len(clashes) > MOST_CLASHES:
        raise RuntimeError("too many sets share a name")
    renamed = F.when(F.col("node").isin(list(clashes)), F.col("twin")).otherwise(F.col("node")) if clashes else F.col("node")
    read = read.where("counts IS NULL").withColumn("node", renamed)
    sized_docs = read.select("doc_id", "n", "node")
    # a table of its own, so that joins with it are plain ones, whose hot keys adaptive execution splits
    sketches = written(read.where("sketch IS NOT NULL").select("node", "n", "sketch").dropDuplicates(["node"]), "sketches")

    def name(tokens: np.ndarray) -> int:
        first = _name(tokens)
        return _name(tokens, 1) if first in clashes else first

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(words), set()
        for batch in batches:
            sets = [s for s in shingles.sets(batch.column(0).to_pylist()) if len(s)]
            nodes = [name(s) for s in sets]
            keep = _first_seen(nodes, seen)
            heads = [_ordered(sets[k], levels)[: len(sets[k]) - least_overlap(len(sets[k]), percent) + 1] for k in keep]
            lengths = [len(h) for h in heads]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *heads])), pa.array(np.repeat(np.array([nodes[k] for k in keep], np.int64), lengths))], ["token", "node"])

    postings = in_arrow(texts.select("text"), prefixes, "token long, node long")
    met = written(postings.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_met, "token long, node long, low long"), "met")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """node, tokens of these nodes, and of few others."""
        bits = _bits(nodes)

        def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, seen = Shingler(words), set()
            for batch in batches:
                sets = shingles.sets(batch.column(0).to_pylist())
                names = np.array([name(s) for s in sets], np.int64)
                place = names % (8 * len(bits))
                asked = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).tolist()
                asked = [asked[k] for k in _first_seen(names[asked].tolist(), seen)]
                yield pa.RecordBatch.from_arrays([pa.array(names[asked]), pa.array([_ordered(sets[k], levels) for k in asked], pa.list_(pa.int64()))], ["node", "tokens"])

        return written(in_arrow(texts.select("text"), needed, "node long, tokens array<long>").dropDuplicates(["node"]), "needed")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each run of (one, two): of its pivots with all others, or among all where it has no pivot."""
        for t, bounds in _runs(batches, ["one", "two"]):
            nodes, comps, pivot = t.column("node").to_numpy(), t.column("comp").to_pylist(), t.column("pivot").to_numpy()
            found = []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = t.column("tokens").slice(low, high - low).combine_chunks()
                if isinstance(part, pa.ChunkedArray):
                    part = part.chunk(0)
                ends = part.offsets.to_numpy()
                flat = part.values.to_numpy()
                sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]
                probes = np.flatnonzero(pivot[low:high]).tolist() or None
                found += [(int(nodes[low + x]), int(nodes[low + y])) for x, y in tree_links(sets, comps[low:high], percent, probes)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    def search(members: DataFrame) -> DataFrame:
        sets = sets_of(members.select("node"))
        rows = members.join(sets, "node").select("one", "two", "node", "comp", "pivot", "tokens")
        return rows.repartition("one", "two").sortWithinPartitions("one", "two").mapInArrow(searched, "a long, b long")

    # 1. each set with the least set of its tokens, in blocks, where the sketches leave room
    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = hopeful_pairs(batch.column("s").to_pylist(), batch.column("t").to_pylist(), batch.column("n").to_numpy(), batch.column("m").to_numpy(), percent)
            yield batch.select(["low", "node"]).filter(pa.array(ok))

    pairs = met.where("node <> low").select("low", "node").distinct()
    pairs = pairs.join(sketches.select("node", "n", F.col("sketch").alias("s")), "node").join(sketches.select(F.col("node").alias("low"), F.col("n").alias("m"), F.col("sketch").alias("t")), "low")
    pairs = written(pairs.mapInArrow(plausible, "low long, node long"), "pairs")
    blocks = pairs.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = pairs.join(blocks, "low").select(F.col("low").alias("one"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("two"), "node")
    pivots = dealt.select("one", "two").distinct().select("one", "two", F.col("one").alias("node"), F.lit(True).alias("pivot"))
    members = dealt.select("one", "two", "node", F.lit(False).alias("pivot")).union(pivots).withColumn("comp", F.col("node"))
    joined = components(search(written(members, "members")))

    # 2. tokens whose sets still lie apart, in tiles
    placed = written(met.join(joined, "node", "left").join(sketches.select("node", "n"), "node").select("token", "node", F.coalesce("comp", "node").alias("comp"), "n"), "placed")
    apart = placed.groupBy("token").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("n").alias("short"), F.max("n").alias("long")).where("c < d")
    # two sets alone can't link if their sizes are too far apart
    apart = apart.where((F.col("m") > 2) | (100 * F.col("short") >= percent * F.col("long")))
    # tokens with the same sets need one search
    apart = apart.groupBy("m", "x").agg(F.min("token").alias("token")).select("token")

    def tiled(rows: DataFrame, key: str) -> DataFrame:
        """`rows` (key, node, comp) as members of tiles (one, two): any two rows of a key meet in a tile, which is bounded."""
        blocks = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        return (
            rows.join(blocks, key).select(F.col(key).alias("one"), "node", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .select("one", (F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")).alias("two"), "node", "comp")
        )

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each tile's sets that may link: each with the first of its group."""
        for t, bounds in _runs(batches, ["one", "two"]):
            node, comp, n, s = t.column("node").to_numpy(), t.column("comp").to_numpy(), t.column("n").to_numpy(), t.column("sketch").to_pylist()
            pairs = [
                (int(node[low + group[0]]), int(node[low + k]))
                for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist())
                for group in hopeful_groups(s[low:high], n[low:high], comp[low:high], percent)
                for k in group[1:]
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

    tiles = tiled(placed.drop("n").join(apart, "token"), "token").join(sketches, "node").repartition("one", "two").sortWithinPartitions("one", "two")
    hope = components(tiles.mapInArrow(hopeful, "a long, b long"))
    if not hope.isEmpty():
        rest = hope.select("node", F.col("comp").alias("hope")).join(joined, "node", "left").select("hope", "node", F.coalesce("comp", "node").alias("comp"))
        rest = written(tiled(rest, "hope").withColumn("pivot", F.lit(False)), "rest")
        joined = components(search(rest).union(joined.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    classes = sized_docs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # a large component is one key: aggregated before the shuffle, then joined as a plain table
    classes = written(classes, "sets-by-component")
    least = written(classes.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    classes = classes.join(least, "comp").select("node", "component_id")
    return sized_docs.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all their columns, whose doc_id is their component's smallest; of equal rows one stays.

    A null doc_id ranks behind all others, as a number drawn from its text. Any column names are kept, whatever they are."""
    key = F.coalesce("doc_id", F.lit(1 << 62) + F.pmod(F.xxhash64(text_or_empty()), F.lit(1 << 61)))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), "text")
    classes = shingle_components(rows.select(F.col("key").alias("doc_id"), "text"), words, percent)
    chosen = classes.where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return rows.join(chosen, "key", "left_semi").dropDuplicates(["key", "text"]).select("row.*")


def op9_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"))


QUERIES = {"op9_prefix_tree_join": op9_prefix_tree_join}
#: All pairs that share a shingle, and all that links lead to.
ORACLE_SQL = {
    "op9_prefix_tree_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.y, r.low FROM r JOIN links l ON l.x = r.node WHERE r.low < l.y),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id"""
}
