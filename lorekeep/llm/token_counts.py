"""Token counts by the whole-token shortcut (operator 4).

`whole_tokens` proves, once and offline, which strings of the vocabulary are one pre-token and encode alone as one
token. A pre-token found among them counts one without any merge; only the rest are merged.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table, text_or_empty, tokenizer_path
from .tokens import SEP, encoder, slices

LIMIT = 1024


_PROVEN: dict[tuple[str, int], frozenset[str]] = {}


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary's strings that the splitting rule leaves whole and the merges turn into one token; kept for each file."""
    key = (path, os.stat(path).st_mtime_ns)
    if key not in _PROVEN:
        enc = encoder(path)
        byte_of = {letter: byte for byte, letter in enumerate(enc.letters)}
        texts = []
        for letters in enc.tokenizer.get_vocab(with_added_tokens=False):
            try:
                texts.append(bytes(map(byte_of.__getitem__, letters)).decode())
            except UnicodeDecodeError:
                pass
        texts = [t for t in texts if t and SEP not in t and enc.split(t) == [t]]
        _PROVEN[key] = frozenset(t for t, n in zip(texts, enc.merged(pa.array(texts, pa.large_string()))[1].tolist()) if n == 1)
    return _PROVEN[key]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs` (doc_id, text), for a byte-level tokenizer file.

    n_tokens is what the tokenizers library gives for the whole text without added special tokens; an added token's
    string inside a text is that token, as the library has it by default. A null or empty text has 0 bytes and 0 tokens.
    Rows with a null doc_id or repeated rows give a row each; other columns are not read; an empty table gives no rows.
    """
    # one string for each vocabulary entry at most, so the size is fixed by the tokenizer
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(path), whole.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = np.concatenate([np.zeros(0, np.int64), *(enc.counts(texts[s], known) for s in slices(texts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return in_arrow(rows, counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op4_whole_token_counts": op4_whole_token_counts}
ORACLE_SQL: dict[str, str] = {}
