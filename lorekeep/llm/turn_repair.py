r"""Conversation structure repair (operator 13) by a fold of Spark SQL's higher-order functions.

Windows mark each turn's fault and place; the turns of a conversation are collected in order and aggregate() carries, for
each of the four states of the role pattern `(s?(ua)+)?` (nothing yet, after s, after u, after a), the cheapest (cost, audit)
that leads there. An audit is one letter an edit, K(eep), R(erole), D(elete) or I(nsert), so least() over the structs also
settles ties. Costs aside, two audits of equal cost never begin one with the other, so the least of a part stays the least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Costs of the edits, and what a truncated turn adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns that one fold takes. Longer conversations are folded in pieces, from each state, and the pieces then joined: an
#: audit is copied at each step, which would take the square of the turns.
PIECE = 256
WHITE = " \t\n\x0b\x0c\r"
STATES = ("n", "s", "u", "a")
_FAR = 1 << 40


def _add(state: str, cost: str | int, letters: str) -> str:
    return f"named_struct('c', {state}.c + {cost}, 'e', concat({state}.e, {letters}))"


def _start(state: str) -> str:
    """The structs at the start of a fold from the state whose place in STATES is `state`, an expression."""
    return "named_struct(" + ", ".join(f"'{x}', named_struct('c', IF({state} = {k}, 0L, {_FAR}L), 'e', '')" for k, x in enumerate(STATES)) + ")"


def _inserted(acc: str) -> dict[str, str]:
    """The states' structs where turns may be inserted; more than two in a row never pay."""
    one, two = f"'{'I'}'", f"'{'II'}'"
    return {
        "n": f"{acc}.n",
        "s": f"{acc}.s",
        "u": f"least({acc}.u, {', '.join(_add(f'{acc}.{x}', f'{INSERT}L', one) for x in 'nsa')})",
        "a": f"least({acc}.a, {_add(f'{acc}.u', f'{INSERT}L', one)}, {', '.join(_add(f'{acc}.{x}', f'{2 * INSERT}L', two) for x in 'ns')})",
    }


def _step(acc: str, turn: str) -> str:
    """The structs after one more turn, with its initial k, whether it must go (d) and what it adds if it stays (t)."""
    open_ = "named_struct(" + ", ".join(f"'{x}', {y}" for x, y in _inserted(acc).items()) + ")"

    def stays(initial: str, before: str) -> str:
        return _add(before, f"{turn}.t + IF({turn}.k = '{initial}', 0L, {REROLE}L)", f"IF({turn}.k = '{initial}', 'K', 'R')")

    gone = {x: _add(f"q.{x}", f"{DELETE}L", "'D'") for x in STATES}
    after = {
        "n": gone["n"],
        "s": f"IF({turn}.d OR {turn}.k <> 's', {gone['s']}, least({gone['s']}, {_add('q.n', f'{turn}.t', chr(39) + 'K' + chr(39))}))",
        "u": f"IF({turn}.d, {gone['u']}, least({gone['u']}, {stays('u', 'least(q.n, q.s, q.a)')}))",
        "a": f"IF({turn}.d, {gone['a']}, least({gone['a']}, {stays('a', 'q.u')}))",
    }
    body = "named_struct(" + ", ".join(f"'{x}', {y}" for x, y in after.items()) + ")"
    # a transform of one element names a value, so that it is computed once
    return f"get(transform(array({open_}), q -> {body}), 0)"


def _joined(acc: str, piece: str) -> str:
    """The structs after a piece, of which `piece` has those from each state."""
    ways = {y: [f"named_struct('c', {acc}.{x}.c + {piece}[{k}].{y}.c, 'e', concat({acc}.{x}.e, {piece}[{k}].{y}.e))" for k, x in enumerate(STATES)] for y in STATES}
    return "named_struct(" + ", ".join(f"'{y}', least({', '.join(w)})" for y, w in ways.items()) + ")"


def cheapest(turns: str = "_turns", piece: int = PIECE) -> Column:
    """struct<c, e>: the least cost and the ASCII-least audit of that cost, for an array of structs (k, d, t)."""
    pieces = f"IF(size({turns}) = 0, CAST(array() AS array<int>), sequence(0, CAST((size({turns}) - 1) DIV {piece} AS int)))"
    folded = f"aggregate(slice({turns}, p * {piece} + 1, {piece}), {_start('f')}, (acc, x) -> {_step('acc', 'x')})"
    all_ = f"transform({pieces}, p -> transform(IF(p = 0, array(0), array(0, 1, 2, 3)), f -> {folded}))"
    last = f"aggregate(slice(m, 2, greatest(size(m) - 1, 0)), coalesce(get(get(m, 0), 0), {_start('0')}), (acc, x) -> {_joined('acc', 'x')})"
    end = f"least(z.n, {_inserted('z')['a']})"
    return F.expr(f"get(transform(array({all_}), m -> get(transform(array({last}), z -> {end}), 0)), 0)")


def repaired_turns(turns: str = "_turns", audit: str = "audit") -> Column:
    """array<struct<role, text>>: the conversation that an audit makes of its turns (structs with role and text)."""
    made = "named_struct('e', 'I', 'role', '', 'text', '')"
    own = f"named_struct('e', right(c, 1), 'role', {turns}[i].role, 'text', {turns}[i].text)"
    chunks = f"regexp_extract_all({audit}, 'I*[KRD]', 0)"
    items = f"concat(flatten(transform({chunks}, (c, i) -> concat(array_repeat({made}, length(c) - 1), array({own})))), array_repeat({made}, length({audit}) - length(rtrim('I', {audit}))))"
    # roles alternate from a user on, after a system turn that is kept first
    role = "IF(x.e = 'K', x.role, IF(pmod(j - IF(y[0].e = 'K' AND left(y[0].role, 1) = 's', 1, 0), 2) = 0, 'user', 'assistant'))"
    return F.expr(f"get(transform(array(filter({items}, x -> x.e <> 'D')), y -> transform(y, (x, j) -> named_struct('role', {role}, 'text', x.text))), 0)")


def repair(turns: DataFrame, present: Column | None = None, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired: one row for each conv_id of `turns`
    (conv_id, turn, role, text), repaired being an array of (role, text).

    Turns stand in order of turn, nulls first, then role, then text; a null role or text counts as one space. Of a turn's faults
    the first counts: blank (no character but white space), duplicate (role and text of an earlier turn), truncated (the last
    character that is no white space is not one of .!?). gaps: numbers missing between the least and largest turn. illegal:
    neighbours whose roles' initials are not su, ua or au. Where `present` is false a row only names its conversation; one without
    turns has zeros, an empty audit and no repaired turns. Null conv_ids are one conversation. Repeated rows are duplicates; other
    columns are not read; an empty table gives no rows.

    A conversation's turns meet in one row, as its repaired text is one value: so a single one may have 2 GB. Beside that, flags are
    windows that spill, and folding takes time in proportion to the turns but for copying the audit once a piece.
    """
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (F.lit(True) if present is None else present).alias("on"))
    rows = rows.withColumns({"k": F.left("role", F.lit(1)), "core": F.btrim("text", F.lit(WHITE))})
    order = W.partitionBy("conv_id", "on").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"at": F.row_number().over(order), "last_turn": F.lag("turn").over(order), "last_k": F.lag("k").over(order)})
    seen = F.row_number().over(W.partitionBy("conv_id", "on", "role", "text").orderBy("at")) > 1
    fault = F.when(F.col("core") == "", "blank").when(seen, "duplicate").when(~F.right("core", F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.withColumn("fault", F.when(F.col("on"), fault))
    turn = F.struct("at", "k", F.col("fault").isin("blank", "duplicate").alias("d"), F.when(F.col("fault") == "truncated", F.lit(TRUNCATED)).otherwise(0).cast("long").alias("t"), "role", "text")
    on_turn = F.when(F.col("on"), F.col("turn"))
    found = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(on_turn) - F.min(on_turn) + 1 - F.count_if(F.col("on") & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
        F.count_if(F.col("on") & (F.col("at") > 1) & ~F.concat("last_k", "k").isin("su", "ua", "au")).alias("illegal"),
        F.array_sort(F.collect_list(F.when(F.col("on"), turn))).alias("_turns"),
    )
    found = found.withColumn("_narrow", F.transform("_turns", lambda x: F.struct(x.k.alias("k"), x.d.alias("d"), x.t.alias("t"))))
    found = found.withColumn("_best", cheapest("_narrow", piece))
    found = found.withColumns({"cost": F.col("_best.c"), "audit": F.col("_best.e")})
    return found.withColumn("repaired", repaired_turns()).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: `turns` as crc32(`conv_id:turn`) % 20 damages them, nulls counting as one space.

    0: not present; 1: no text; 2: no .!? in it; 3: twice; 4: role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def transcript(turns: str = "repaired") -> Column:
    """`role:text` of each turn, on lines of their own."""
    return F.array_join(F.transform(turns, lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repair(rows, F.col("present")).withColumn("repaired_sha256", F.sha2(transcript().cast("binary"), 256)).drop("repaired")


QUERIES = {"op13_turn_repair": op13_turn_repair}
#: The crc by its definition; then one row for each state and turn, with the cheapest way there.
ORACLE_SQL = {
    "op13_turn_repair": r"""
WITH RECURSIVE slots AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, x)) AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ord(name[i])::BIGINT), lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::BIGINT]), 4294967295), 4294967295) % 20 AS kind
  FROM named, slots),
harmed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, kind, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds),
placed AS (
  SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS spot, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM harmed WHERE kind <> 0),
marked AS (
  SELECT *, left(role, 1) AS k, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY spot) AS k0,
         CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY spot) > 1 THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM placed),
inserts(x, y, cost, letters) AS (VALUES ('n', 'n', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('n', 'u', 3, 'I'), ('s', 'u', 3, 'I'), ('a', 'u', 3, 'I'), ('u', 'a', 3, 'I'), ('n', 'a', 6, 'II'), ('s', 'a', 6, 'II')),
moves(x, y) AS (VALUES ('n', 's'), ('n', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')),
ways AS (
  SELECT conv, spot, x, x AS y, 4 AS cost, 'D' AS letter FROM marked, (SELECT unnest(['n', 's', 'u', 'a']) AS x)
  UNION ALL SELECT conv, spot, x, y, CASE WHEN fault = 't' THEN 3 ELSE 0 END, 'K' FROM marked JOIN moves ON y = k WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv, spot, x, y, 3 + CASE WHEN fault = 't' THEN 3 ELSE 0 END, 'R' FROM marked JOIN moves ON y <> 's' AND y <> k WHERE fault NOT IN ('b', 'd')),
states AS (
  SELECT DISTINCT conv, 0::BIGINT AS spot, 'n' AS state, 0::BIGINT AS cost, '' AS audit FROM harmed
  UNION ALL
  SELECT conv, spot, state, cost, audit FROM (
    SELECT s.conv, w.spot, w.y AS state, s.cost + i.cost + w.cost AS cost, s.audit || i.letters || w.letter AS audit,
           row_number() OVER (PARTITION BY s.conv, w.y ORDER BY s.cost + i.cost + w.cost, s.audit || i.letters || w.letter) AS place
    FROM states s JOIN inserts i ON i.x = s.state JOIN ways w ON w.conv = s.conv AND w.spot = s.spot + 1 AND w.x = i.y) WHERE place = 1),
ends AS (
  SELECT conv, cost, audit FROM (
    SELECT s.conv, s.cost + i.cost AS cost, s.audit || i.letters AS audit, row_number() OVER (PARTITION BY s.conv ORDER BY s.cost + i.cost, s.audit || i.letters) AS place
    FROM states s JOIN inserts i ON i.x = s.state AND i.y IN ('n', 'a') WHERE s.spot = (SELECT coalesce(max(m.spot), 0) FROM marked m WHERE m.conv = s.conv)) WHERE place = 1),
letters AS (
  SELECT conv, audit[p] AS letter, p, CASE WHEN audit[p] <> 'I' THEN length(replace(audit[1:p], 'I', '')) END AS spot FROM ends, unnest(range(1, length(audit) + 1)) AS g(p)),
kept AS (
  SELECT l.conv, l.p, l.letter, m.role, coalesce(CASE WHEN l.letter <> 'I' THEN m.text END, '') AS text, row_number() OVER (PARTITION BY l.conv ORDER BY l.p) AS n,
         first_value(CASE WHEN l.letter = 'K' AND m.k = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv ORDER BY l.p) AS off
  FROM letters l LEFT JOIN marked m ON m.conv = l.conv AND m.spot = l.spot WHERE l.letter <> 'D'),
whole AS (
  SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (n - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS body FROM kept GROUP BY conv),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (k0 IS NOT NULL AND k0 || k NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv)
SELECT h.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, e.cost::BIGINT AS cost, e.audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM harmed) h JOIN ends e ON e.conv = h.conv LEFT JOIN counted c ON c.conv = h.conv LEFT JOIN whole w ON w.conv = h.conv"""
}
