r"""Quality rules as a bitmask ledger (operator 5), with DataFrame functions only.

Every rule is evaluated once per document. The ledger holds the measurements and one failure bit a rule; policies are
masks over those bits, so a policy can be changed, versioned or ablated without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK, table, text_or_empty

#: Bit of each rule in `fail_bits`.
RULES = {
    "few_words": 0,
    "repeated_windows": 1,
    "symbols": 2,
    "duplicate_lines": 3,
    "word_length": 4,
}
#: Rules that a version of the policy enforces. `base` holds the two that the contract names.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length"),
}


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    min_mean_word: int = 2
    max_mean_word: int = 14


def mask_of(rules) -> int:
    return sum(1 << RULES[r] for r in rules)


def _repeat_words(words: str) -> str:
    """SQL for the number of words that lie in 3-word windows found twice or more in `words`, an array in scope.

    Windows are compared by a 64-bit hash of their three words; equal hashes stand next to each other once
    (hash, place) pairs are sorted, and the covered words follow from the gaps between the places of repeated windows.
    The one-element transforms name a value so that it is computed once.
    """
    return f"""
    CASE WHEN size({words}) < 4 THEN 0L ELSE
    transform(array(sort_array(transform(sequence(0, size({words}) - 3),
        i -> named_struct('h', xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), 'p', i)))), s ->
    transform(array(sort_array(transform(filter(sequence(0, size(s) - 1),
        k -> (k > 0 AND s[k].h = get(s, k - 1).h) OR coalesce(s[k].h = get(s, k + 1).h, false)), k -> s[k].p))), d ->
    aggregate(d, named_struct('last', -3, 'n', 0L),
        (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n))[0])[0] END"""


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of the documents with the measurements of every rule; see `ledger`."""
    text = text_or_empty()
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    # an empty array of words for a text without words
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))
    measured = docs.select(*keep, text.alias("_text"), words.alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = F.expr(f"transform(array(_words), w -> named_struct('n_words', size(w), 'n_repeat_words', {_repeat_words('w')}))[0]")
    two = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    return measured.select(
        *keep,
        one.alias("_m"),
        F.char_length(F.regexp_replace("_text", WORD_BREAK, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        two.cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
    ).select(
        *keep,
        F.col("_m.n_words").cast("long").alias("n_words"),
        "word_chars", "n_symbols", "n_dup_lines",
        F.col("_m.n_repeat_words").cast("long").alias("n_repeat_words"),
        "n_lines",
    )


def fail_bits(limits: Limits = Limits()) -> Column:
    n = F.col("n_words")
    failed = {
        "few_words": n < limits.min_words,
        "repeated_windows": 100 * F.col("n_repeat_words") > limits.max_repeat_percent * n,
        "symbols": 100 * F.col("n_symbols") > limits.max_symbol_percent * n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > limits.max_dup_line_percent * F.col("n_lines"),
        "word_length": (F.col("word_chars") < limits.min_mean_word * n) | (F.col("word_chars") > limits.max_mean_word * n),
    }
    out = F.lit(0)
    for rule, bit in RULES.items():
        out = out.bitwiseOR(F.when(failed[rule], F.lit(1 << bit)).otherwise(F.lit(0)))
    return out


def ledger(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row a document: doc_id, the measurements, fail_bits (bit RULES[r] is set where rule r fails).

    A null or empty text, or one of white space, has no words and fails `few_words`. Repeated rows and null doc_ids give
    a row each. Only doc_id and text are read, so other columns may have any name. An empty table gives no rows.
    """
    return measures(docs).withColumn("fail_bits", fail_bits(limits))


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """base_failed: a base rule failed. kept: no rule of the policy's version failed."""
    base, mask = mask_of(POLICIES["base"]), mask_of(POLICIES[version])
    return rows.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(base)) != 0,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(base | mask)) == 0,
    })


def passing(docs: DataFrame, version: str = "v1", limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs`, all their columns, that the policy keeps; columns may have any name."""
    rows = measures(docs.select(F.struct("*").alias("_row"), "text"), ("_row",)).withColumn("fail_bits", fail_bits(limits))
    return apply_policy(rows, version).where("kept").select("_row.*")


def ablations(rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (all of these the policy would win back
    without the rule), and those kept without it. The ledger is first reduced to one row for each set of failure bits."""
    mask = mask_of(POLICIES[version])
    sets = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).alias("bit")) for r in POLICIES[version]])).alias("r")
    return (
        sets.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit").groupBy("rule").agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
            F.sum(F.when((F.col("bits") == F.col("bit")) | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def rules_sql(source: str = "documents", limits: Limits = Limits()) -> str:
    """The ledger in DuckDB's SQL: rows of doc_id, measurements, fail_bits, base_failed, kept."""
    return f"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM {source}),
places AS (
  SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM words),
threes AS (
  SELECT doc_id, p, x, lead(x, 1) OVER (PARTITION BY doc_id ORDER BY p) AS y, lead(x, 2) OVER (PARTITION BY doc_id ORDER BY p) AS z FROM places),
windows AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM threes WHERE z IS NOT NULL),
repeated AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM windows WHERE n > 1) GROUP BY doc_id),
measured AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines
  FROM words LEFT JOIN repeated ON words.doc_id = repeated.doc_id),
failed AS (
  SELECT *,
    (CASE WHEN n_words < {limits.min_words} THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * n_repeat_words > {limits.max_repeat_percent} * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > {limits.max_symbol_percent} * n_words THEN 4 ELSE 0 END)
  + (CASE WHEN 100 * n_dup_lines > {limits.max_dup_line_percent} * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < {limits.min_mean_word} * n_words OR word_chars > {limits.max_mean_word} * n_words THEN 16 ELSE 0 END) AS fail_bits
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
       fail_bits::INTEGER AS fail_bits
FROM failed"""


QUERIES = {"op5_rule_ledger": op5_rule_ledger}
ORACLE_SQL = {"op5_rule_ledger": rules_sql()}
