"""Mixing sources to target weights by iterative proportional fitting (operator 1).

Documents fall in cells of (source, language, topic) classes. Targets name the classes; whatever they don't name is the
class "other", so the number of cells is bounded by the targets and not by the data. Spark sums tokens over the cells;
raking scales the lines of cells in turn until every marginal meets its target. No cell can give more tokens than it has,
so each scale is the one at which its line, with its full cells held, sums to the target. A document is drawn with its
cell's calibrated probability by a hash of its own, so the sample is the same on every run.

A token is a word between white space, unless a column of token counts is named.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, text_or_empty, written

OTHER = "other"
AXES = ("source", "lang", "topic")
#: White space that parts words: \x20 and \x09-\x0D.
_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Targets:
    """Shares of the tokens that each named class should have; they are brought to a sum of 1."""

    source: Mapping[str, float]
    lang: Mapping[str, float]
    topic: Mapping[str, float]


#: A text that has the pattern (RE2) is of the topic; the first that fits counts.
TOPICS = {
    "legal": r"(?i)licen[sc]e|copyright|all rights reserved|warrant",
    "contact": r"[\w.+-]+@[\w-]+\.\w|https?://",
    "tabular": r"\|[^|\n]*\|",
    "numeric": r"\d[\d.,/-]{5,}",
}
#: The topic of all other texts.
PROSE = "prose"


@dataclass(frozen=True)
class Mix:
    targets: Targets
    #: Share of all tokens that the sample should hold.
    keep: float = 0.5
    seed: int = 1
    rounds: int = 1000
    tolerance: float = 1e-10
    topics: Mapping[str, str] = field(default_factory=lambda: dict(TOPICS))


PRODUCTION = Mix(
    Targets(
        source={**{f"src{k}": 1.0 for k in range(20)}, OTHER: 0.5},
        lang={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.12, OTHER: 0.03},
        topic={PROSE: 0.80, "legal": 0.02, "contact": 0.08, "tabular": 0.04, "numeric": 0.06, OTHER: 0.0},
    )
)


def _class(value: Column, named: Mapping[str, float]) -> Column:
    return F.when(value.isin([k for k in named if k != OTHER]), value).otherwise(OTHER)


def words(texts: pa.Array) -> pa.Array:
    """The number of words of each text."""
    bare = pc.ascii_trim(texts, _SPACE)
    return pc.if_else(pc.equal(bare, ""), 0, pc.cast(pc.list_value_length(pc.ascii_split_whitespace(bare)), pa.int64()))


def topics(texts: pa.Array, patterns: Mapping[str, str]) -> pa.Array:
    out = pa.array([PROSE] * len(texts), pa.string())
    for name, pattern in reversed(list(patterns.items())):
        out = pc.if_else(pc.match_substring_regex(texts, pattern), name, out)
    return out


def available(mass: np.ndarray, goal: np.ndarray, budget: float, axis: int) -> np.ndarray:
    """Tokens that each class of an axis should give: its share of the budget, or all it has, the rest spread over the others."""
    have = mass.sum(tuple(k for k in range(mass.ndim) if k != axis)).astype(float)
    out, open_ = np.zeros_like(have), have > 0
    share = np.where(open_, goal, 0.0)
    if share.sum() <= 0:
        share = np.where(open_, 1.0, 0.0)
    for _ in range(len(have)):
        free = open_ & (share > 0)
        if not free.any():
            break
        out[free] = (budget - out[~free].sum()) * share[free] / share[free].sum()
        over = free & (out > have)
        if not over.any():
            break
        out[over] = have[over]
        open_ &= ~over
    return out


def rake(mass: np.ndarray, goals: list[np.ndarray], keep: float, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Tokens to draw from each cell: at most its mass, `keep` of all in sum, and the goals' shares along every axis where
    the cells have them. Where goals can't be met together, the round with the least deviation from any stands."""
    budget = keep * mass.sum()
    if not budget > 0:
        return np.zeros(mass.shape)
    wanted = [available(mass, np.asarray(g, float), budget, k) for k, g in enumerate(goals)]
    factor = [np.ones(len(g)) for g in goals]
    full = mass.astype(float)

    def scaled() -> np.ndarray:
        out = full * keep
        for axis, f in enumerate(factor):
            out = out * f.reshape([-1 if k == axis else 1 for k in range(mass.ndim)])
        return out

    best, least, since = np.minimum(scaled(), full), np.inf, 0
    for _ in range(rounds):
        for axis, want in enumerate(wanted):
            rows = np.moveaxis(scaled(), axis, 0).reshape(len(want), -1)
            most = np.moveaxis(full, axis, 0).reshape(len(want), -1)
            for k in range(len(want)):
                factor[axis][k] *= _scale(rows[k], most[k], want[k])
        now = np.minimum(scaled(), full)
        worst = max(float(np.abs(np.moveaxis(now, axis, 0).reshape(len(want), -1).sum(1) - want).max()) for axis, want in enumerate(wanted)) / budget
        since = 0 if worst < 0.99 * least else since + 1
        if worst < least:
            best, least = now, worst
        if least < tolerance or since > 50:
            break
    return best


def _scale(values: np.ndarray, most: np.ndarray, want: float) -> float:
    """The factor f at which min(f * values, most) sums to `want`."""
    on = values > 0
    values, most = values[on], most[on]
    if not len(values) or want <= 0:
        return 0.0 if want <= 0 else 1.0
    at = most / values
    order = np.argsort(at)
    values, most, at = values[order], most[order], at[order]
    # with the first k cells full, the others sum to f times what is left
    held = np.concatenate([[0.0], np.cumsum(most)[:-1]])
    rest = np.cumsum(values[::-1])[::-1]
    reach = held + at * rest
    k = int(np.searchsorted(reach, want))
    return float(at[-1]) if k == len(reach) else float((want - held[k]) / rest[k])


def mixed(docs: DataFrame, mix: Mix = PRODUCTION, whole_rows: bool = True, tokens: str | None = None) -> DataFrame:
    """All rows and columns of `docs` (doc_id, text, lang, source) under `row`, a struct, with source, lang, topic (the
    classes), n_tokens (words of the text, or the column `tokens`), weight (target over present share of the cell),
    probability and sampled. Without `whole_rows` there is no `row`.

    A null source or language is "other"; a null text has no tokens and the topic prose. A cell without tokens, or
    one whose target is 0, has probability 0, so an empty text is never drawn from a cell without tokens. Targets that the
    cells can't give together are met as nearly as raking comes; `report` says how nearly. Rows with equal doc_ids
    are drawn alike, and null doc_ids too. An empty table gives no rows. Clashing column names stay inside `row`.
    Each text is classed and counted once: the classes (and rows) are kept in the shared folder.
    """
    spark, t, patterns = docs.sparkSession, mix.targets, dict(mix.topics)

    @F.arrow_udf("struct<topic:string,n_tokens:bigint>")
    def read(text: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([topics(text, patterns), words(text)], ["topic", "n_tokens"])

    rows = docs.select(
        F.struct("*").alias("row"), "doc_id", _class(F.col("source"), t.source).alias("source"), _class(F.col("lang"), t.lang).alias("lang"), read(text_or_empty()).alias("_read"),
        (F.col(tokens) if tokens else F.lit(None)).cast("long").alias("_tokens"),
    )
    rows = rows.select("row", "doc_id", "source", "lang", _class(F.col("_read.topic"), t.topic).alias("topic"), (F.coalesce("_tokens", F.lit(0)) if tokens else F.col("_read.n_tokens")).alias("n_tokens"))
    rows = written(rows, "mixture") if whole_rows else checkpointed(rows.drop("row"))
    names = [[*dict.fromkeys([*getattr(t, a), OTHER])] for a in AXES]
    mass = np.zeros([len(n) for n in names])
    # one row a cell, and the targets bound the cells
    for r in rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("n")).collect():
        mass[tuple(n.index(r[a]) for n, a in zip(names, AXES))] = r.n
    goals = [np.array([float(getattr(t, a).get(k, 0.0)) for k in n]) for n, a in zip(names, AXES)]
    drawn = rake(mass, goals, mix.keep, mix.rounds, mix.tolerance)
    p = np.divide(drawn, mass, out=np.zeros_like(drawn), where=mass > 0)
    weight = p / mix.keep if mix.keep else p
    cells = spark.createDataFrame(
        [(names[0][i], names[1][j], names[2][k], float(weight[i, j, k]), float(p[i, j, k])) for i, j, k in np.ndindex(mass.shape)],
        "source string, lang string, topic string, weight double, probability double",
    )
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(mix.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.join(F.broadcast(cells), list(AXES)).select(*["row"] * whole_rows, "doc_id", *AXES, "n_tokens", "weight", "probability", (draw < F.col("probability")).alias("sampled"))


def report(rows: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """axis, class, tokens, share (present), target, expected (share by the probabilities) and sampled (share of the sample)
    of the classes that `mixed` gave `rows`, one row for each class that any row has; null shares where there are no tokens."""
    n = F.col("n_tokens")
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("class")) for a in AXES])).alias("a"), "n_tokens", "probability", "sampled")
    sums = each.groupBy("a.axis", "a.class").agg(F.sum(n).alias("tokens"), F.sum(n * F.col("probability")).alias("e"), F.sum(F.when(F.col("sampled"), n).otherwise(0)).alias("s"))
    goals = [(a, k, float(v) / sum(getattr(mix.targets, a).values())) for a in AXES for k, v in getattr(mix.targets, a).items()]
    target = rows.sparkSession.createDataFrame(goals, "axis string, class string, target double")
    out = sums.join(F.broadcast(target), ["axis", "class"], "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    total = {c: F.sum(c).over(Window.partitionBy("axis")) for c in ("tokens", "e", "s")}
    return out.select("axis", "class", "tokens", *[F.when(total[c] > 0, F.col(c) / total[c]).alias(name) for c, name in (("tokens", "share"), ("e", "expected"), ("s", "sampled"))], "target")


def op1_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), whole_rows=False)


QUERIES = {"op1_raked_mixture": op1_raked_mixture}
ORACLE_SQL: dict[str, str] = {}
