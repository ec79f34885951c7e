"""Token ids of whole texts (used by operators 4, 7 and 10).

A byte-pair tokenizer never merges across pre-tokens, and for both kinds of file below no pre-token reaches from a word
over the white space behind it. So a text is cut before each run of white space; the ids of a text are those of these
pieces, its keys, joined. A worker's table holds the ids of keys that come again. The other keys of a slice of texts are
split by the tokenizer's own pattern and merged together in one call, parted by a character that no such text holds.

Merges run on the file's own vocabulary, whose ids stand in the order of its merges. Only keys that hold the string of
an added token, or a character on whose class the library's regular expressions and these may differ, are left to the
library, one by one, and the rest of their texts is not; `Encoder.left_out` counts such keys.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Keys kept by a worker's table before it is emptied.
TABLE_ROWS = 300_000
#: Longer keys are encoded but not kept.
KEPT_CHARS = 48
#: Parts keys and pre-tokens; a key that holds it is left to the library.
SEP = "\x7f"

# The splitting rules of the two kinds of file; SEP is told apart from punctuation and from what follows white space.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x7f]+|\s+(?![^\s\x7f])|\s+|\x7f"
#: The same for keys without SEP in which BREAK stands before the last character of white space that something follows; without a look
#: ahead, so that tiktoken's engine needn't try again at each place.
BREAK = "\x1f"
MERGE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x1f\x7f]+|\s+|\x1f|\x7f"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| "
WORD_END = "</w>"
#: White space to the library, where keys are cut; the control characters of _ODD may be white space elsewhere or part keys.
_RARE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"\t-\r {_RARE}"
_ODD = ("\x1c", "\x1d", "\x1e", BREAK, SEP)
#: Where one of these or of the rare ones is in a text, its white space isn't single spaces and line feeds alone.
_UNEVEN = ("  ", "\n\n", "\n ", " \n", "\t", "\x0b", "\x0c", "\r")
_RARE_SPACE = re.compile(f"[{_RARE}]")
_SPACES = re.compile(f"[{_SPACE}]+")
_BROKEN = re.compile(f"[{_SPACE}](?=[{_SPACE}][^{_SPACE}{SEP}])")
_CUT = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
#: The last code point looked at by `_agreed`; beyond lie planes without letters.
_LAST = 0x323AF


def _agreed() -> re.Pattern:
    """Runs of characters whose class (letter, number, white space, other) is the same in Unicode 3.2 and now, so that engines of any
    version between agree on it. Code points without a character now may get one in an engine's newer tables."""

    def kind(name: str) -> str:
        return name[0] if name[0] in "LNZ" else ""

    old = unicodedata.ucd_3_2_0.category
    same = [(now := unicodedata.category(c := chr(k))) not in ("Cn", "Cs") and kind(now) == kind(old(c)) and c not in _ODD for k in range(_LAST + 1)]
    edges = np.flatnonzero(np.diff([False, *same, False])).tolist()
    return re.compile("[" + "".join(rf"\U{a:08x}-\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2])) + "]*")


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself where printable, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + other.index(b)) for b in range(256)]


def parts(text: str, most: int) -> list[str]:
    """The text cut before white space into runs of about `most` characters, so that a very long text isn't keyed at once."""
    out, at = [], 0
    while len(text) - at > most and (m := _CUT.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Table:
    """Runs of ids by key, as arrays, so that a slice's keys are looked up in one call. `first` stays when it is emptied."""

    def __init__(self, first: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        self.first = (first, ids, sizes)
        self.names, self.ids, self.sizes = self.first

    def find(self, names: pa.Array) -> np.ndarray:
        """The place of each key, or -1."""
        return pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy().astype(np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        old = self.first if len(self.names) + len(names) > TABLE_ROWS else (self.names, self.ids, self.sizes)
        self.names, self.ids, self.sizes = pa.concat_arrays([old[0], names]), np.concatenate([old[1], ids]), np.concatenate([old[2], sizes])


class Encoder:
    """ids(text) equals Tokenizer.encode(text, add_special_tokens=False).ids for byte_bpe_50k.json and word_bpe_49k.json."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = self.tokenizer.normalizer is not None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(self.letters)}
        ranks = {}
        for letters, rank in self.tokenizer.get_vocab(with_added_tokens=False).items():
            ended = self.drops_space and letters.endswith(WORD_END)
            name = bytes(map(byte_of.__getitem__, letters[: -len(WORD_END)] if ended else letters))
            ranks[name + SEP.encode() * ended] = rank
        # of word files SEP is the end of a word, so that merges with it come first, as their ids are the lowest
        pattern = f"[^{SEP}]+{SEP}" if self.drops_space else MERGE_PATTERN
        self.merge = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.stop = ranks[b" " + SEP.encode()] if self.drops_space else ranks[SEP.encode()]
        self.broken = None if self.drops_space else ranks[BREAK.encode()]
        self.split = regex.compile(WORD_PATTERN if self.drops_space else BYTE_PATTERN).findall
        self.table = Table(pa.array([""], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64))
        self.count_tables: dict[int, Table] = {}
        self.agreed = _agreed().fullmatch
        self.left_out = self.seen = 0

    def library(self, keys: list[str]) -> list[list[int]]:
        """The library's own ids of keys that the method leaves to it."""
        self.left_out += len(keys)
        return [e.ids for e in self.tokenizer.encode_batch(keys, add_special_tokens=False)]

    def proven(self, keys: list[str]) -> np.ndarray:
        """Which keys the method may take: their characters, as the file's normalizer leaves them, are agreed on, and no added token is in them."""

        # almost always all are, which one look at all of them tells
        return np.ones(len(keys), bool) if self._fine(" ".join(keys)) else np.fromiter(map(self._fine, keys), bool, len(keys))

    def _fine(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        # one look at each character: normalizing composes characters of one version to none of a later one
        found = " ".join(_characters(text))
        return bool(self.agreed(found)) and (not self.drops_space or bool(self.agreed(self.tokenizer.normalizer.normalize_str(found))))

    def merged(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys, none of them empty, joined, and each key's number of ids."""
        part = " " if self.drops_space else SEP
        joined = _joined(keys, part)
        if joined.count(SEP) == (0 if self.drops_space else max(len(keys) - 1, 0)) and self._fine(joined.replace(SEP, " ")):
            return self._merged(joined)
        names = keys.to_pylist()
        proven = self.proven(names)
        values, own = self._merged(part.join(k for k, p in zip(names, proven) if p))
        left = self.library([k for k, p in zip(names, proven) if not p])
        sizes = np.zeros(len(names), np.int64)
        sizes[proven], sizes[~proven] = own, [len(x) for x in left]
        values = np.concatenate([values, *(np.array(x, "<u4") for x in left)])
        starts = np.zeros(len(names), np.int64)
        starts[proven] = np.cumsum(own) - own
        starts[~proven] = int(own.sum()) + np.cumsum(sizes[~proven]) - sizes[~proven]
        return _ragged(values, starts, sizes, np.arange(len(names))), sizes

    def _merged(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids and numbers of ids of proven keys, joined by spaces for word files and by SEP for others."""
        if not joined:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        breaks = 0
        if self.drops_space:
            joined = SEP.join(self.split(self.tokenizer.normalizer.normalize_str(joined))) + f"{SEP} "
        else:
            joined, breaks = _BROKEN.subn(rf"\g<0>{BREAK}", joined)
        found = np.array(self.merge(joined + SEP), "<u4")
        if breaks:
            found = found[found != self.broken]
        stops = found == self.stop
        return found[~stops], np.diff(np.flatnonzero(stops), prepend=-1) - 1

    def keyed(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The keys of texts, and where in them each text begins."""
        odd = [k for k, t in enumerate(texts) if any(c in t for c in _ODD)]
        if self.drops_space:
            keys = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        else:
            keys = pc.split_pattern(pa.array(map(_marked, texts), pa.large_string()), SEP)
        if odd:
            lists = keys.to_pylist()
            for k in odd:
                lists[k] = (_SPACES.split if self.drops_space else _cut)(texts[k])
            keys = pa.array(lists, pa.large_list(pa.large_string()))
        return pc.dictionary_encode(keys.flatten()), keys.offsets.to_numpy() - keys.offsets[0].as_py()

    def _looked_up(self, keys: pa.DictionaryArray, table: Table, made) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each of the dictionary's keys starts and how many it has, by the table or else by `made`."""
        names = keys.dictionary
        found = table.find(names)
        lost = np.flatnonzero(found < 0)
        rest = names.take(pa.array(lost))
        ids, counts = made(rest)
        ends = np.cumsum(table.sizes)
        starts, sizes = (ends - table.sizes)[found], table.sizes[found]
        starts[lost], sizes[lost] = len(table.ids) + np.cumsum(counts) - counts, counts
        values = np.concatenate([table.ids, ids])
        # keys that come again in this slice are likely to come again in others
        again = np.bincount(keys.indices.to_numpy(), minlength=len(names))[lost] > 1
        kept = np.flatnonzero(again & (pc.utf8_length(rest).to_numpy() <= KEPT_CHARS))
        table.add(rest.take(pa.array(kept)), _ragged(values, starts, sizes, lost[kept]) if len(ids) else ids, counts[kept])
        return values, starts, sizes

    def _by_text(self, texts: list[str], most: int) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The keys of texts, and the bounds of each one's keys."""
        self.seen += len(texts)
        cut = [parts(t, most) for t in texts]
        keys, bounds = self.keyed([x for c in cut for x in c])
        return keys, bounds[np.cumsum([0, *map(len, cut)])]

    def ids(self, texts: list[str], most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts as unsigned 32-bit integers, and each text's number of ids."""
        keys, bounds = self._by_text(texts, most)
        values, starts, sizes = self._looked_up(keys, self.table, self.merged)
        at = keys.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[bounds]
        return _ragged(values, starts, sizes, at), np.diff(ends)

    def counts(self, texts: list[str], whole: frozenset[str], most: int = 2_000_000) -> np.ndarray:
        """Each text's number of ids; keys and pre-tokens in `whole` are one id, and only the rest is merged."""

        def made(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            names = keys.to_pylist()
            proven = self.proven(names)
            kept = [k for k, p in zip(names, proven) if p]
            pieces = self.split(SEP.join(kept) + SEP) if kept else []
            one = np.array([p in whole for p in pieces], np.int64)
            stops = np.array([p == SEP for p in pieces], bool)
            unknown = np.flatnonzero((one == 0) & ~stops)
            one[unknown] = self.merged(pa.array([pieces[k] for k in unknown.tolist()], pa.large_string()))[1]
            sizes = np.zeros(len(names), np.int64)
            sizes[proven] = np.diff(np.cumsum(one * ~stops)[stops], prepend=0)
            sizes[~proven] = [len(x) for x in self.library([k for k, p in zip(names, proven) if not p])]
            return np.zeros(0, "<u4"), sizes

        if id(whole) not in self.count_tables:
            proven = sorted(whole)
            self.count_tables = {id(whole): Table(pa.array(["", *proven], pa.large_string()), np.zeros(0, "<u4"), np.array([0, *[1] * len(proven)], np.int64))}
        keys, bounds = self._by_text(texts, most)
        sizes = self._looked_up(keys, self.count_tables[id(whole)], made)[2]
        return np.diff(np.concatenate([[0], np.cumsum(sizes[keys.indices.to_numpy()])])[bounds])


def _joined(keys: pa.Array, part: str) -> str:
    """The keys joined, without a Python string of each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.scalar(part, keys.type))[0].as_py()


def _characters(text: str) -> set[str] | list[str]:
    """The different characters of a text."""
    if len(text) < 1000:
        return set(text)
    return [chr(c) for c in np.flatnonzero(np.bincount(np.frombuffer(text.encode("utf-32-le"), "<u4"))).tolist()]


def _marked(text: str) -> str:
    """SEP before each run of white space."""
    if any(x in text for x in _UNEVEN) or (not text.isascii() and _RARE_SPACE.search(text)):
        return _SPACES.sub(SEP + r"\g<0>", text)
    return text.replace(" ", f"{SEP} ").replace("\n", f"{SEP}\n")


def _cut(text: str) -> list[str]:
    """The text cut before each run of white space; SEP may be in it."""
    at = [m.start() for m in _SPACES.finditer(text)]
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def _ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs values[starts[i] : starts[i] + sizes[i]] of each i in `at`, joined."""
    own = sizes[at]
    total = np.cumsum(own)
    return values[np.arange(total[-1] if len(total) else 0) + np.repeat(starts[at] - (total - own), own)]


def slices(texts: list[str], chars: int = 6_000_000) -> Iterator[slice]:
    """Runs of about so many characters, at least one text each."""
    start = n = 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield slice(start, k + 1)
            start, n = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process: its table serves all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
