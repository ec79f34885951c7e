"""What the operators' methods promise: who decides a placement, what a coder saves, which marginals a sample has, who is left out."""

import math
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lorekeep.llm import common, jaccard_join, licenses, mixing, packing, quality_model, quality_rules, sharding, token_counts, token_files, tokens
from tests.llm.test_operators import LONG, ODD, check_pieces, plain_components, plain_rules

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def uneven(n):
    rng = random.Random(n)
    some = ["a", "b", "the", "ing", "'s", "'S", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "日本", "1", "23", "4.5", "...", "!?", "_", "-", "İ", "ß", " ", "🙂", "don't", "we'll", "\x00", " x"]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_all_white_space_goes_by_the_method(name, texts):
    path = common.tokenizer_path(name)
    enc, lib = tokens.Encoder(path), Tokenizer.from_file(path)
    prose = [t.replace(". ", ".\n\n").replace(" the ", "  the\t") + " \n" for t in texts.values()]
    given = [*uneven(3000), *prose, LONG + "\r\n" * 3, " " * 5000]
    for most in (2_000_000, 100):
        flat, counts = enc.ids(given, most)
        at = 0
        for text, n in zip(given, counts.tolist()):
            assert flat[at : at + n].tolist() == lib.encode(text, add_special_tokens=False).ids
            at += n
    assert enc.left_out == 0 and enc.seen == 2 * len(given)
    # only a key with an added token's string, or with an unproven character, is left to the library
    assert enc.ids(["<|endoftext|> x", "\x1c", "fine"])[1].tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in ("<|endoftext|> x", "\x1c", "fine")]
    assert enc.left_out == 2
    if name.startswith("byte"):
        whole = token_counts.whole_tokens(path)
        assert whole is token_counts.whole_tokens(path)
        assert enc.counts(given, whole).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in given]


SCRIPTS = [
    "你好。今天天气很好，我们去公园吧！", "東京、日本（とうきょう）　全角スペース", "ＡＢＣ，中文 １２３", "🚀 launch 🎉🎉 👍🏽 done", "שלום עולם, מה שלומך?", "مرحبا بالعالم، كيف الحال؟",
    "नमस्ते दुनिया। यह ठीक है", "สวัสดีชาวโลก วันนี้", "Привет, мир — «да»", "Γειά σου ΚΟΣΜΟΣ", "안녕하세요 세계", "a\u2003b\u3000 c\x85d\u2028e",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_scripts_stay_in_the_method_key_by_key(name):
    path = common.tokenizer_path(name)
    enc, lib = tokens.Encoder(path), Tokenizer.from_file(path)
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rng = random.Random(3)
    mixed = ["".join(rng.choice(SCRIPTS)[rng.randint(0, 9) :] + rng.choice([" ", "", "\n", "\u3000", "plain words "]) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    flat, counts = enc.ids([*SCRIPTS, *mixed])
    assert flat.tolist() == [i for t in [*SCRIPTS, *mixed] for i in lib.encode(t, add_special_tokens=False).ids]
    assert enc.left_out == 0
    # of a text with an unproven key, that key alone is left out
    rest = ["zero\u200bwidth " + SCRIPTS[0] + " and the rest", "a\x7fb c", "\x1c \x1f x\x1dy z", "<|endoftext|>", "x<|endoftext|>y z <|EndOfText|>", "\ufeffmark", "\u1e9e \U0002f800 \ua7ce new", "", "\x7f", " \x7f "]
    flat, counts = enc.ids(rest)
    assert counts.tolist() == list(map(size, rest))
    assert flat.tolist() == [i for t in rest for i in lib.encode(t, add_special_tokens=False).ids]
    assert 0 < enc.left_out <= 13
    if name.startswith("byte"):
        assert enc.counts([*SCRIPTS, *mixed, *rest], token_counts.whole_tokens(path)).tolist() == list(map(size, [*SCRIPTS, *mixed, *rest]))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_agreed_character_is_split_as_the_library_splits_it(name):
    path = common.tokenizer_path(name)
    enc, lib = tokens.Encoder(path), Tokenizer.from_file(path)
    agreed = [c for k in range(0x110000) if not 0xD800 <= k < 0xE000 and enc.agreed(c := chr(k))]
    assert len(agreed) > 100_000
    given = [f"a{c}b{c}1{c}!{c} {c}" for c in agreed]
    flat, counts = enc.ids(given)
    want = [e.ids for e in lib.encode_batch(given, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]


def test_very_long_text(spark):
    long = " ".join(f"word{k % 977} and, more." for k in range(150_000))
    df = spark.createDataFrame([(1, long), (2, "x" * 300_000), (3, None)], "doc_id long, text string")
    byte, word = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(byte)
    want = {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, byte).collect()} == want
    check_pieces(packing.pack_documents(df, word).collect(), {1: long, 2: "x" * 300_000, 3: ""}, Tokenizer.from_file(word))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.shingle_components(df).collect()}
    assert got == plain_components({1: long, 2: "x" * 300_000, 3: ""})
    assert {r.doc_id: r.n_words for r in quality_rules.ledger(df).collect()} == {1: len(long.split()), 2: 1, 3: 0}


# ---- packing


class PlainPacker:
    """The rule of placement, written down: levels are counted anew for each run, and every level is tried."""

    def __init__(self, length=4096, levels=64, most_open=256):
        self.length, self.step, self.levels, self.most = length, -(-length // levels), levels, most_open
        self.windows, self.closed = [], []

    def add(self, doc, size):
        start = 0
        while size - start >= self.length:
            self.closed.append([(doc, start, self.length)])
            start += self.length
        while start < size:
            start += self.place(doc, start, size - start)

    def place(self, doc, start, size):
        def squares(counts):
            return sum(n * n for n in counts.values())

        counts = defaultdict(int)
        for w in self.windows:
            counts[w[0] // self.step] += 1
        full, now, options = len(self.windows) >= self.most, squares(counts), []
        if not full:
            after = counts.copy()
            after[size // self.step] += 1
            options.append((squares(after) - now, 1, None))
        for level in sorted(counts):
            window = [w for w in self.windows if w[0] // self.step == level][-1]
            fill = window[0] + size
            if full or fill < self.length + self.step:
                after = counts.copy()
                after[level] -= 1
                if fill < self.length:
                    after[fill // self.step] += 1
                options.append((squares(after) - now, -level, window))
        # the least change; on a tie the fullest window, and a new one last
        window = min(options, key=lambda x: (x[0], x[1]))[2]
        if window is None:
            window = [0, []]
        else:
            self.windows.remove(window)
        n = min(size, self.length - window[0])
        window[0] += n
        window[1].append((doc, start, n))
        if window[0] == self.length:
            self.closed.append(window[1])
        else:
            self.windows.append(window)
        return n


def sizes_of(kind, n):
    rng = np.random.default_rng(1)
    return {"even": rng.integers(50, 1500, n), "same": np.full(n, 2100), "long": np.minimum(rng.pareto(1.2, n) * 300 + 10, 60000).astype(int), "nearly full": np.full(n, 4095)}[kind].tolist()


@pytest.mark.parametrize("kind", ["even", "same", "long", "nearly full"])
def test_placement_is_the_rule(kind):
    fast, plain = packing.Packer(most_open=40), PlainPacker(most_open=40)
    for k, n in enumerate(sizes_of(kind, 1500)):
        fast.add(k, range(n))
        plain.add(k, n)
    assert [[(d, s, len(ids)) for d, s, ids in runs] for _, runs in fast.closed] == plain.closed


@pytest.mark.parametrize("kind", ["even", "same", "long", "nearly full"])
def test_placement_closes_windows_within_memory(kind):
    p, most, held = packing.Packer(), 0, 0
    sizes = sizes_of(kind, 20_000)
    early = 0
    for k, n in enumerate(sizes):
        p.add(k, range(n))
        early += sum(len(ids) for _, runs in p.closed for _, _, ids in runs)
        p.closed = []
        most, held = max(most, p.n_open), max(held, sum(fill for level in p.open for fill, _ in level))
    assert early >= 0.95 * sum(sizes) and most <= packing.MOST_OPEN and held <= packing.MOST_OPEN * packing.LENGTH
    p.finish()
    assert early + sum(len(ids) for _, runs in p.closed for _, _, ids in runs) == sum(sizes)
    short = [n for n in (sum(len(ids) for _, _, ids in runs) for _, runs in p.closed) if n < packing.LENGTH]
    assert all(n & (n - 1) == 0 for n in short) and len(short) < 13


def test_pieces_carry_ids(spark):
    path = common.tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(7, LONG)] * 3, "doc_id long, text string")
    rows = packing.pack_documents(df, path, length=64, levels=8, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    lib = Tokenizer.from_file(path)
    assert sum(r.length for r in rows) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*ODD, LONG, LONG, LONG])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for v in sequences.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))]


# ---- token files


def test_coder_beats_plain_coders(spark):
    path = common.tokenizer_path("byte_bpe_50k.json")
    enc = tokens.encoder(path)
    found = [r.text or "" for r in spark.read.parquet(f"{BIG}/documents.parquet").orderBy("doc_id").select("text").limit(7000).collect()]
    flat, counts = enc.ids(found)
    ids = np.insert(flat, np.cumsum(counts), 0).astype("<u4")[:2_000_000]
    assert len(ids) == 2_000_000
    data = token_files.encode_frame(ids)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    static, other = -(share * np.log2(share)).sum(), 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)
    bits = 8 * len(data) / len(ids)
    assert bits < static and bits < other
    assert (token_files.decode_frame(data) == ids).all()
    # a block is read alone
    size = token_files.decode_frame(data, 0).size
    assert size > 64_000 and (token_files.decode_frame(data, 1) == ids[size : 2 * size]).all()
    for at in (50, len(data) // 2, len(data) - 3):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            token_files.decode_frame(bytes(broken))


# ---- mixing


def plain_topic(text):
    for name, pattern in mixing.TOPICS.items():
        if re.search(pattern, text, re.A):
            return name
    return mixing.PROSE


def test_marginals_of_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixed(docs, whole_rows=False)
    got = rows.collect()
    texts = {r.doc_id: r for r in docs.collect()}
    mass = defaultdict(int)
    for r in got:
        d = texts[r.doc_id]
        assert (r.source, r.lang, r.topic) == (d.source, d.lang, plain_topic(d.text or "")) and r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        mass[r.source, r.lang, r.topic] += r.n_tokens
    total = sum(mass.values())
    p = {(r.source, r.lang, r.topic): r.probability for r in got}
    assert all(0 <= x <= 1 for x in p.values()) and abs(sum(p[c] * n for c, n in mass.items()) - 0.5 * total) < 1e-3 * total
    for axis, name in enumerate(mixing.AXES):
        goal = getattr(mixing.PRODUCTION.targets, name)
        have, want = defaultdict(float), {}
        for c, n in mass.items():
            have[c[axis]] += n
        # shares of the budget, where a class has that much
        free, left = {k for k in have if goal.get(k, 0) > 0}, 0.5 * total
        while True:
            part = {k: left * goal[k] / sum(goal[j] for j in free) for k in free}
            over = {k for k in free if part[k] > have[k]}
            if not over:
                break
            want |= {k: have[k] for k in over}
            left, free = left - sum(have[k] for k in over), free - over
        want |= part
        for k in have:
            assert abs(sum(p[c] * n for c, n in mass.items() if c[axis] == k) - want.get(k, 0)) < 1e-3 * total, (name, k)
    shown = mixing.report(rows).collect()
    for axis in mixing.AXES:
        own = [r for r in shown if r.axis == axis]
        drawn = sum(r.n_tokens for r in got if r.sampled)
        assert abs(sum(r.expected for r in own) - 1) < 1e-9
        for r in own:
            assert math.isclose(r.sampled, sum(x.n_tokens for x in got if x.sampled and x[axis] == r["class"]) / drawn, abs_tol=1e-12)
            # a draw by hash stays near what is expected of it
            assert abs(r.sampled - r.expected) < 0.05


def test_raking_on_empty_classes():
    mass = np.array([[[4.0, 0.0]], [[0.0, 0.0]]])
    assert np.allclose(mixing.rake(mass, [np.array([1.0, 3]), np.array([1.0]), np.array([0.0, 0.0])], 0.5), mass / 2)
    assert not mixing.rake(np.zeros((1, 1, 1)), [np.ones(1)] * 3, 0.5).any()
    assert np.allclose(mixing.rake(mass, [np.zeros(2), np.zeros(1), np.zeros(2)], 1.0), mass)


def test_named_token_counts(spark):
    df = spark.createDataFrame([(1, "a b", "en", "src1", 7), (2, "c", "de", "x", None)], "doc_id long, text string, lang string, source string, n long")
    assert {r.doc_id: r.n_tokens for r in mixing.mixed(df, tokens="n").collect()} == {1: 7, 2: 0}


# ---- sharding


def plain_shard(doc_id, leaves):
    def hashed(*values):
        h = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i" if v[0] == "i" else "<q", v[1])
            h = xxhash.xxh64_intdigest(raw, h)
        return h - (1 << 64) if h >> 63 else h

    at = leaves
    for level in ("region", "rack", "shard"):
        weights = defaultdict(float)
        for leaf in at:
            weights[getattr(leaf, level)] += leaf.weight
        draws = {c: -math.log((hashed(*([("q", doc_id)] if doc_id is not None else []), level, ("i", c)) % (1 << 52) + 0.5) / (1 << 52)) / w for c, w in weights.items() if w > 0}
        won = min(draws, key=lambda c: (draws[c], c)) if len(draws) > 1 else next(iter(draws))
        at = [x for x in at if getattr(x, level) == won]
    return at[0].shard


def test_shards_of_plain_draws(spark, texts):
    rows = entry.queries()["op3_hash_tree_shards"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, sharding.topology(8)), plain_shard(r.doc_id, sharding.topology(9)))
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
    found = sharding.shard_documents(spark.createDataFrame([(None, None, "x"), (None, "a", "y")], "doc_id long, text string, shard string"), sharding.topology(8)).collect()
    assert sorted((r.size, r.text_crc32, r.slot) for r in found) == [(1, 0, 0), (2, zlib.crc32(b"a"), 1)] and {r.shard for r in found} == {plain_shard(None, sharding.topology(8))}


# ---- licences

NOTICES = {
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3": "lgpl",
    "Licensed under the GNU Lesser General Public License, version 3.": "lgpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3": "agpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3": "gpl",
    "Licensed under the GNU General Public License, version 2.": "gpl",
    "Licensed under CC BY-ND 4.0.": "cc-by-nd",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa",
    "Licensed under CC BY 4.0.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Licensed under the Apache License, Version 1.1.": None,
    "Licensed under the Mozilla Public License, version 1.1.": None,
    "Licensed under the BSD 4-Clause License.": None,
    "Licensed under the BSD 2-Clause License.": "bsd-2-clause",
    "Released under the BSD 3-Clause License.": "bsd-3-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice": "isc",
    "Released under the MIT License.": "mit",
    "All rights reserved.": "reserved",
    "The right to rest is reserved for all who work in the garden.": None,
    "He was licensed under the old law to sell wine in the market.": None,
    "Free software is a matter of liberty, and you can modify a copy in general.": None,
}


def test_license_families(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scanner = licenses.train(licenses.sample_paragraphs(docs))
    rng = random.Random(3)
    prose = [p for r in docs.orderBy("doc_id").limit(200).collect() for p in (r.text or "").split("\n") if len(p) > 40 and not re.search(r"(?i)licen|rights|copyright", p)]
    rows, want = [], {}
    for k, (notice, family) in enumerate(NOTICES.items()):
        for j, text in enumerate((notice, "\n".join([rng.choice(prose), notice, rng.choice(prose)]), notice.upper())):
            rows.append((10 * k + j, text))
            want[10 * k + j] = [family] if family else []
    for k, p in enumerate(prose):
        rows.append((100_000 + k, p))
        want[100_000 + k] = []
    got = {r.doc_id: r.families for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    none = {r.doc_id: (r.n_paragraphs, r.n_predicted, r.n_confirmed, r.families) for r in licenses.scan(spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (1, None)], "doc_id long, text string"), scanner).collect()}
    assert none == {k: (0, 0, 0, []) for k in (1, 2, 3)}


# ---- quality model


def test_quality_model_is_a_plain_fit(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality_model.fit(docs, labels)
    known = {r.doc_id: float(r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = [(k, np.array(quality_model.statistics(texts[k])), y) for k, y in sorted(known.items()) if k in texts]
    tuning = [xxhash.xxh64_intdigest(b"tuning", xxhash.xxh64_intdigest(struct.pack("<q", k), 42)) % (1 << 64) for k, _, _ in rows]
    tuning = np.array([(h - (1 << 64) if h >> 63 else h) % 5 == 0 for h in tuning])
    stats, y = np.array([x for _, x, _ in rows]), np.array([y for _, _, y in rows])
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-9)
    x = quality_model.features(stats, mean, scale)
    # ridge regression as least squares on the rows and one row for each weight
    a = np.vstack([x[~tuning], np.sqrt(quality_model.RIDGE) * np.eye(x.shape[1])])
    weights = np.linalg.lstsq(a, np.concatenate([y[~tuning], np.zeros(x.shape[1])]), rcond=None)[0]
    assert np.allclose(model.weights, weights, atol=1e-6)
    # isotonic regression by its max-min formula
    order = np.argsort(x[tuning] @ weights, kind="stable")
    z = y[tuning][order]
    n = len(z)
    means = np.array([[z[i : j + 1].mean() if j >= i else np.inf for j in range(n)] for i in range(n)])
    want = np.array([max(min(means[i][k:]) for i in range(k + 1)) for k in range(n)])
    at = (x[tuning] @ weights)[order]
    # a step for each run of one level, at the mean of its predictions
    starts = np.flatnonzero(np.concatenate([[True], np.abs(np.diff(want)) > 1e-12]))
    ends = np.append(starts[1:], n)
    assert np.allclose(model.steps[0], [at[i:j].mean() for i, j in zip(starts, ends)], atol=1e-6)
    assert np.allclose(model.steps[1], want[starts], atol=1e-9)


@pytest.mark.parametrize("labels, want", [([(0, 1), (1, 1)], 1.0), ([(0, None), (1, None)], 0.5), ([], 0.5), ([(900, 1)], 0.5)])
def test_labels_of_one_kind(spark, labels, want):
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(6)] + [(0, "word 0")] * 2, "doc_id long, text string")
    model = quality_model.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = quality_model.score_documents(docs, model).collect()
    assert len(rows) == 8 and {r.score for r in rows} == {want}


# ---- registered queries


def test_registered_queries(spark, docs, texts):
    run = {k: v for k, v in entry.queries().items() if k.startswith("op")}
    byte, word = (Tokenizer.from_file(common.tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = {k: np.array([*byte.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    for r in run["op4_whole_token_counts"](spark, SF).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), len(ids[r.doc_id]) - 1, len(ids[r.doc_id]) - 1 > 1024)
    at = 0
    for r in sorted(run["op7_context_mixing_files"](spark, SF).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    assert at == sum(map(len, ids.values()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run["op9_prefix_tree_join"](spark, SF).collect()} == plain_components(texts)
    check_pieces(run["op10_sum_of_squares_packing"](spark, SF).collect(), texts, word)
    for r in run["op5_rule_ledger"](spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(texts[r.doc_id])
    for r in run["op8_fourier_quality"](spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    for name in ("op1_raked_mixture", "op6_paragraph_licenses"):
        assert {r.doc_id for r in run[name](spark, SF).select("doc_id").collect()} == set(texts)


def test_one_of_each_keeps_columns(spark):
    df = spark.createDataFrame([(2, "same text here", "mine", 1), (1, "same text here", "yours", 2), (None, "other", None, 3)], "doc_id long, text string, _key string, row int")
    assert sorted(map(tuple, jaccard_join.one_of_each(df).collect()), key=str) == [(1, "same text here", "yours", 2), (None, "other", None, 3)]


# ---- pipeline


def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key string"
    odd = spark.createDataFrame([(k if k != 3 else None, t, None, "src0", 1, "r", "k") for k, t in enumerate(ODD)] + [(7, LONG, "en", "src0", 1, "r", "k")] * 2, schema)
    for name, rows in (("odd", odd), ("empty", odd.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / name / "labels.parquet"))
        for stage, function in pipeline.STAGES:
            out = function(spark, rows, str(tmp_path / name))
            assert stage == "packing" or out.columns == rows.columns
            assert out.count() <= (rows.count() if stage != "packing" else 10_000)
        assert pipeline.run(spark, str(tmp_path / name)).columns[0] == "doc_id"


def test_stages_are_plain_versions(spark):
    import corpus_pipeline as pipeline
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(pipeline.STAGES)
    scores = {r.doc_id: r.score for r in quality_model.score_documents(d, quality_model.fit(d, labels)).collect()}
    kept = stages["quality"](spark, d, sf)
    assert {r.doc_id for r in kept.collect()} == {k for k, x in scores.items() if x >= 0.3}
    kept = common.written(kept, "t")
    texts, lim = {r.doc_id: r.text for r in kept.collect()}, quality_rules.Limits()

    def passes(text):
        n, chars, symbols, dup, repeat = plain_rules(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        return n >= lim.min_words and 100 * repeat <= lim.max_repeat_percent * n and 100 * symbols <= lim.max_symbol_percent * n and 100 * dup <= lim.max_dup_line_percent * lines and lim.min_mean_word * n <= chars <= lim.max_mean_word * n

    kept = common.written(stages["rules"](spark, kept, sf), "t")
    texts = {k: t for k, t in texts.items() if passes(t)}
    assert {r.doc_id for r in kept.collect()} == set(texts)
    least = {k for k, (_, c) in plain_components(texts).items() if k == c}
    kept = common.written(stages["near_duplicates"](spark, kept, sf), "t")
    assert {r.doc_id for r in kept.collect()} == least
    rows = mixing.mixed(kept).collect()
    drawn = {r.doc_id for r in rows if (xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)) % (1 << 52) + 0.5) / (1 << 52) < r.probability}
    assert {r.doc_id for r in stages["mixture"](spark, kept, sf).collect()} == drawn
