"""Operators 11 to 13 against plain versions, on odd rows and on made ones."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import centroids, jaccard_join, substrings, turn_repair

# --- 11: centroid clustering


def plain_clusters(rows, clusters, rounds, dims):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    now = [v for _, _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(now)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                now[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(i), near(v)[1], min(near(v)[0], 2**63 - 1)) for i, v in kept), now


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, ids long, matrix string")


def test_clusters_equal_the_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(k % 5, 0.4, 6)]) for k in range(150)]
    # repeated rows, ties on a grid, null ids, and vectors that take no part
    rows += rows[:9] + [(200 + k, [float(x) for x in rng.integers(0, 2, 6)]) for k in range(60)] + [(None, [0.5] * 6), (None, [0.25] * 6)]
    rows += [(300, None), (301, [1.0] * 5), (302, [1.0] * 5 + [None]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, [])]
    for clusters, rounds in ((8, 10), (3, 4), (1, 2), (5, 0)):
        found, model = centroids.cluster(vectors(spark, rows).repartition(3), clusters, rounds, 6)
        want, last = plain_clusters(rows, clusters, rounds, 6)
        assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want
        assert model.centroids == last
        assert all(x["scanned"] <= x["looked_at"] or n == 0 for n, x in enumerate(model.rounds))
    assert any(x["looked_at"] < x["vectors"] for x in model.rounds[1:]) or len(model.rounds) == 1


def test_bounds_skip_vectors_of_clusters_far_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(100 * (k % 4), 1, 6)]) for k in range(400)]
    found, model = centroids.cluster(vectors(spark, rows), 4, 10, 6)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == plain_clusters(rows, 4, 10, 6)[0]
    # once nothing moves the rounds end, and few vectors were looked at before
    assert model.rounds[-1]["scanned"] < 400 and len(model.rounds) < 11


def test_clusters_of_huge_components_and_few_vectors(spark):
    rows = [(1, [1e30, -1e30]), (2, [1e30, -1.5e30]), (3, [3e38, 0.0]), (4, [0.5, 0.25]), (5, [1e300, 1e308]), (6, [-7000.0, 9000.5])]
    for clusters in (2, 8):
        found, model = centroids.cluster(vectors(spark, rows), clusters, 10, 2)
        want, last = plain_clusters(rows, clusters, 10, 2)
        assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want and model.centroids == last


def test_clusters_of_nothing(spark):
    found, model = centroids.cluster(vectors(spark, [(1, None)]))
    assert found.count() == 0 and model.centroids == [] and found.columns == ["vec_id", "cluster", "distance"]
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))[0].count() == 0


# --- 12: substring dedup


def plain_dedup(texts, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = {}
    for w in words:
        for k in range(len(w) - n + 1):
            count[tuple(w[k : k + n])] = count.get(tuple(w[k : k + n]), 0) + 1
    out = []
    for w in words:
        gone = {k + j for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for j in range(n)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("n", [1, 3, 7])
def test_substrings_equal_the_plain_rule(spark, n):
    rng = random.Random(n)
    texts = [None, "", " \n\t\x0b\x0c\r ", "one", "a a a a a a a a a a", " lead and trail \n", "naïve café 日本 🙂 \x1c x\x00y  z"]
    passage = " ".join(f"p{k}" for k in range(20))
    for _ in range(120):
        body = " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.choice([0, 2, 6, 7, 30, 90])))
        texts.append(f"{body} {passage} {body[:5]}" if rng.random() < 0.2 else body)
    texts += [texts[20]] * 3 + ["Word " * 5000, " ".join(f"w{k}" for k in range(60_000))]
    rows = [(k if k % 11 else None, t, "x", 1, "y") for k, t in enumerate(texts)] + [(20, texts[20], "x", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, at long, kept string").repartition(3)
    want = plain_dedup([r[1] for r in rows], n)
    for block in (substrings.BLOCK_BYTES, 2_000):
        got = substrings.dedup_substrings(df, n, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted((str(r[0]), *w) for r, w in zip(rows, want))


def test_substrings_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup_substrings(none).count() == 0
    assert spark.catalog.listTables() == []


def test_sketch_loses_no_repeat():
    """With so few columns that most windows share theirs, estimates are too high, never too low."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(60)) for _ in range(8)]
    blocks = [substrings.Windows(pa.array(texts[k : k + 2]), 4) for k in range(0, 8, 2)]
    for width in (3, 40):
        sketches = [substrings.Sketch(w, width) for w in blocks]
        slices = pa.concat_tables([substrings._slices(k, s.columns, s.counts, None, width, 1) for k, s in enumerate(sketches)])
        answers = substrings._merged(slices, 1)
        found = {}
        for k, (w, s) in enumerate(zip(blocks, sketches)):
            own = dict(zip(*[answers.filter(pa.compute.equal(answers["block"], k))[c].to_pylist() for c in ("range", "bits")]))
            asked = set(s.estimated(own, width, 1).tolist())
            names = [tuple(w.names[x] for x in w.at[p : p + 4]) for p in w.starts]
            for place, name in enumerate(names):
                found.setdefault(name, []).append(place in asked)
        assert all(all(x) for x in found.values() if len(x) > 1)
        assert width == 3 or sum(x[0] for x in found.values() if len(x) == 1) == 0


def test_packed_columns():
    rng = np.random.default_rng(2)
    for top in (1, 300, 1 << 40, 1 << 62):
        x = np.unique(rng.integers(0, top, 500).astype(np.uint64))
        first, steps = substrings.packed(x)
        assert (substrings.unpacked(first, len(x), steps) == x).all()


# --- 13: conversation repair


def plain_audit(turns):
    """Every sequence of edits, by growing cost: the least audit of the least cost."""
    best = (10**9, "")

    def legal(roles):
        return not roles or re.fullmatch("s?(ua)+", roles)

    n = len(turns)
    for most in range(3 * n + 3):
        # how many turns are inserted before each turn and at the end
        for where in itertools.combinations_with_replacement(range(n + 1), most):
            if 3 * most > best[0]:
                break
            for edits in itertools.product(*[["D"] if t[1] else ["K", "Ru", "Ra", "D"] for t in turns]):
                cost = 3 * most + sum(4 if e == "D" else (0 if e == "K" else 3) + t[2] for e, t in zip(edits, turns))
                if cost > best[0]:
                    continue
                audit, roles = "", []
                for k in range(n + 1):
                    for _ in range(where.count(k)):
                        audit += "I"
                        roles.append("?")
                    if k < n:
                        audit += edits[k][0]
                        if edits[k] != "D":
                            roles.append(turns[k][0] if edits[k] == "K" else edits[k][1])
                # a made turn may have either role
                head = roles[:1] == ["s"]
                filled = "".join(("su" if head else "u")[p : p + 1] or ("a" if (p - head) % 2 else "u") if r == "?" else r for p, r in enumerate(roles))
                if legal(filled):
                    best = min(best, (cost, audit))
        if best[0] <= 3 * (most + 1):
            break
    return best


@pytest.mark.parametrize("piece", [turn_repair.PIECE, 2])
def test_cheapest_audits_equal_all_edits_tried(spark, piece):
    rng = random.Random(3)
    cases = [[]] + [[(k, d, t)] for k in "suat" for d in (False, True) for t in (0, 3)]
    cases += [[(rng.choice("suat"), rng.random() < 0.2, rng.choice([0, 0, 3])) for _ in range(rng.choice([2, 3, 4, 5]))] for _ in range(60)]
    df = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "n int, turns array<struct<k:string,d:boolean,t:bigint>>")
    got = {r.n: (r.best.c, r.best.e) for r in df.select("n", turn_repair.cheapest("turns", piece).alias("best")).collect()}
    assert got == {n: plain_audit(c) for n, c in enumerate(cases)}


def plain_step(turns):
    """Cost and audit by the plain recurrence over (place, state), for long conversations."""
    far = (10**9, "")
    now = {"n": (0, ""), "s": far, "u": far, "a": far}

    def opened(x):
        add = lambda s, n: (x[s][0] + 3 * n, x[s][1] + "I" * n)
        return {"n": x["n"], "s": x["s"], "u": min(x["u"], add("n", 1), add("s", 1), add("a", 1)), "a": min(x["a"], add("u", 1), add("n", 2), add("s", 2))}

    for k, d, t in turns:
        x = opened(now)
        now = {s: (c + 4, e + "D") for s, (c, e) in x.items()}
        for before, after in () if d else (("n", "s"), ("n", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
            if after == k:
                now[after] = min(now[after], (x[before][0] + t, x[before][1] + "K"))
            elif after != "s":
                now[after] = min(now[after], (x[before][0] + 3 + t, x[before][1] + "R"))
    x = opened(now)
    return min(x["n"], x["a"])


def test_long_conversations_are_folded_in_pieces(spark):
    rng = random.Random(4)
    cases = [[(rng.choice("suuaaat"), rng.random() < 0.2, rng.choice([0, 0, 3])) for _ in range(n)] for n in (255, 256, 257, 700, 3000)]
    df = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "n int, turns array<struct<k:string,d:boolean,t:bigint>>")
    got = {r.n: (r.best.c, r.best.e) for r in df.select("n", turn_repair.cheapest("turns").alias("best")).collect()}
    assert got == {n: plain_step(c) for n, c in enumerate(cases)}


def plain_repair(rows):
    """Columns of one conversation's rows (turn, role, text) by the rules written down."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    seen, faults, turns = set(), [], []
    for _, _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        turns.append((role[:1], fault in ("blank", "duplicate"), 3 if fault == "truncated" else 0))
    cost, audit = plain_step(turns)
    out, at = [], 0
    for e in audit:
        role, text = ("", "") if e == "I" else rows[at][2:]
        at += e != "I"
        if e != "D":
            last = out[-1][0][:1] if out else ""
            out.append((role if e == "K" else "assistant" if last == "u" else "user", text if e != "I" else ""))
    numbers = [t for known, t, _, _ in rows if known]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    k = [r[2][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(k, k[1:]))
    body = "\n".join(f"{r}:{x}" for r, x in out)
    return (gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())


def test_repair_of_odd_conversations(spark):
    rng = random.Random(7)
    texts = [None, "", " \n", "Yes.", "No", "Why?\n", "a: b", "ok! ", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c, rng.choice([None, *range(-2, 12)]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)) for c in [None, *range(40)] for _ in range(rng.randint(1, 9))]
    rows += rows[:30]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, on string, at long")
    got = turn_repair.repair(df.repartition(3)).withColumn("sha", F.sha2(turn_repair.transcript().cast("binary"), 256)).collect()
    want = {c: plain_repair([r[1:] for r in rows if r[0] == c]) for c in [None, *range(40)]}
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha) for r in got} == want and len(got) == 41


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(60) for t in (None, 0, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = turn_repair.damaged(df)
    kinds = {(c, t): zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in rows}
    want = []
    for c, t, role, text in rows:
        k = kinds[c, t]
        want += [(c, str(t), "user" if k == 4 else role, "" if k == 1 else "One Two" if k == 2 else text, k != 0)] * (2 if k == 3 else 1)
    assert sorted((r.conv_id, str(r.turn), r.role, r.text, r.present) for r in made.collect()) == sorted(want)
    alone = turn_repair.repair(df.limit(3), F.lit(False)).collect()
    assert [(r.gaps, r.blank, r.illegal, r.cost, r.audit, r.repaired) for r in alone] == [(0, 0, 0, 0, "", [])]
    assert turn_repair.repair(df.limit(0)).count() == 0


# --- 9: links of sets that differ much in size


@pytest.mark.parametrize("percent", [30, 40, 50, 90])
def test_links_below_half(spark, percent):
    """Pairs at the edge of the threshold whose common words many other texts hold too."""
    common = [f"c{k}" for k in range(1000)]
    texts = []
    for k in range(4):
        n = 1000 * 100 // percent - (5 if k % 2 else -60)
        own = common[:]
        texts += [own[k:], own[k:] + [f"x{k}_{j}" for j in range(max(0, n - 1000))]]
    texts += [common[j * 3 : j * 3 + 300] + [f"y{j}_{i}" for i in range(700)] for j in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    up = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    got = jaccard_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(up))


def test_groups_over_several_doublings():
    rng = np.random.default_rng(8)
    base = np.sort(rng.integers(0, 1 << 58, 6000))
    sets = [np.sort(x) for x in (base[:1000], base[:2400], base, rng.integers(0, 1 << 58, 1000), base[:3000])]
    n, comp = np.array([len(s) for s in sets]), np.arange(5)
    for percent in (15, 30, 40, 75):
        groups = jaccard_join.hopeful_groups([jaccard_join.sketch(s) for s in sets], n, comp, percent)
        together = {frozenset((a, b)) for g in groups for a in g for b in g if a < b}
        for a in range(5):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                assert 100 * both < percent * (n[a] + n[b] - both) or frozenset((a, b)) in together


def test_workers_give_back_what_a_task_has_freed(monkeypatch):
    from types import SimpleNamespace

    from lorekeep.llm import common

    said = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: SimpleNamespace(malloc_trim=said.append))
    assert [*common.released(iter([1, 2]))] == [1, 2] and said == [0]
