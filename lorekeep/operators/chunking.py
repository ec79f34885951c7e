"""Overlapping, title-prefixed chunks that end at paragraphs or sentences."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import TRIMMED, with_title

MOST_CHUNKS = 200
#: Texts that are cut at once.
AT_ONCE = 256
# the white space of Unicode, without the separators that only Python counts as such
_SPACES, _ROUND, _BLANK = re.compile("[ \t]+"), re.compile(" *\n *"), re.compile("\n{3,}")
_SENTENCE = re.compile(r"(?s:.*)[.!?][^\S\x1c-\x1f]")


def taken(text: str, offset: int, target: int) -> int:
    """Characters of the next chunk: to the last blank line of the window about the target, else its last sentence, else the target."""
    # the bounds are double products cut to integers, as 340 * 1.15 is 390
    low, high = int(target * 0.6), min(int(target * 1.15), len(text) - offset)
    if high <= low:
        return target
    window = text[offset + low : offset + high]
    at = window.rfind("\n\n")
    if at >= 0:
        return low + at + 2
    m = _SENTENCE.match(window)
    return low + m.end() if m else target


def normalized(text: str) -> str:
    """`chunk_normalized` of one text. Each pattern is only run where the text holds what it changes."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\t" in text or "  " in text:
        text = _SPACES.sub(" ", text)
    if " \n" in text or "\n " in text:
        text = _ROUND.sub("\n", text)
    if "\n\n\n" in text:
        text = _BLANK.sub("\n\n", text)
    return text.strip(TRIMMED)


def pieces(text: str, target: int, overlap: int, most: int = MOST_CHUNKS) -> list[str]:
    """Trimmed pieces of a normalized text; each starts `overlap` characters before the last one's end."""
    target = max(1, target)
    overlap = max(0, min(overlap, target - 1))
    out: list[str] = []
    offset = 0
    while offset < len(text) and len(out) < most:
        if len(text) - offset <= target:
            piece, offset = text[offset:], len(text)
        else:
            n = taken(text, offset, target)
            piece, offset = text[offset : offset + n], offset + max(1, n - overlap)
        if piece := piece.strip(TRIMMED):
            out.append(piece)
    return out


def chunked(docs: DataFrame, target: int = 1200, overlap: int = 200, most: int | None = MOST_CHUNKS) -> DataFrame:
    """`docs` (title, text and others) with chunk_index and chunk_text, a row for each chunk, the first `most` of a document or all.

    Where a chunk ends depends on the one before it, so a text is cut in one Arrow call; documents stay spread."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        # only so many texts and pieces at once are Python's strings
        cuts = ([pieces(normalized(t), target, overlap, most or len(t)) if t else [] for t in texts.slice(k, AT_ONCE).to_pylist()] for k in range(0, max(1, len(texts)), AT_ONCE))
        return pa.concat_arrays([pa.array(x, pa.list_(pa.string())) for x in cuts])

    rows = docs.select("*", F.posexplode(cut("text")).alias("chunk_index", "_piece"))
    return rows.withColumn("chunk_text", with_title(F.col("title"), F.col("_piece"))).drop("_piece")
