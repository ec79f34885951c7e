"""The training-data operators against plain versions, on odd rows and on test tables."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorekeep.llm import common, exact_topk, jaccard_join, licenses, mixing, packing, quality_model, quality_rules, sharding, token_counts, token_files

SF = "/root/testdata/sf0.001"
LONG = "the Quick brown fox jumps over a lazy dog, again and again. " * 400
ODD = [None, "", " \n\t ", "one", "one two\n\nthree  four", "<|endoftext|> x", "naïve café 日本 🙂 \x1c \x00", LONG, LONG, "# $ % ### | a", "Licensed under CC BY-NC 4.0.", "a a a a a a a a a a"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, shard string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t, "en" if k % 2 else None, "src0", 1, "x", "y") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[7]], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    path = common.tokenizer_path("byte_bpe_50k.json")
    assert mixing.mixed(none).count() == 0
    assert exact_topk.top_k(v := spark.createDataFrame([], "vec_id long, embedding array<float>"), v).count() == 0
    assert sharding.shard_documents(none, sharding.topology(2)).count() == 0
    assert token_counts.token_counts(none, path).count() == 0
    assert quality_rules.ledger(none).count() == 0
    assert licenses.scan(none, licenses.train([])).count() == 0
    token_files.write_token_files(none, path, str(tmp_path / "t"))
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0
    assert quality_model.score_documents(none, quality_model.fit(none, labels)).count() == 0
    assert jaccard_join.shingle_components(none).count() == 0
    assert packing.pack_documents(none, path).count() == 0


def test_raking():
    mass = np.array([[[5.0, 1], [2, 8]], [[1, 0], [9, 4]]])
    got = mixing.rake(mass, [np.array([1.0, 3]), np.array([1.0, 1]), np.array([2.0, 1])], 0.1)
    share = got / got.sum()
    assert np.allclose(share.sum((1, 2)), [0.25, 0.75]) and np.allclose(share.sum((0, 1)), [2 / 3, 1 / 3])
    assert (got <= mass).all() and abs(got.sum() - 0.1 * mass.sum()) < 1e-9


def test_mixture(odd, docs):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == len(ODD) + 1 and all(r.lang == "other" for r in rows if r.row.lang is None)
    rows = mixing.mixed(docs).collect()
    total, drawn = sum(r.n_tokens for r in rows), sum(r.n_tokens * r.probability for r in rows)
    assert abs(drawn - 0.5 * total) < 0.01 * total
    assert {r.doc_id for r in rows if r.sampled} == {r.doc_id for r in mixing.mixed(docs.repartition(7)).collect() if r.sampled}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = [(k, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for k in range(90)] + [(900, None), (901, [float("nan")] * 6), (902, [1.0, None] * 3), (903, [])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_topk.top_k(df, df.where("vec_id % 9 = 0"), shard_rows=7, tile_rows=3).collect()}
    good = [(k, [int(np.floor(256 * x)) for x in e]) for k, e in v[:90]]
    want = {}
    for q, a in good:
        if q % 9 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), k) for k, b in good if k != q)[:5]
            want |= {(q, n + 1): (k, -s) for n, (s, k) in enumerate(best)}
    assert got == want


def test_shards(odd, docs):
    rows = sharding.shard_documents(docs, sharding.topology(8), sharding.topology(9)).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    found = sharding.shard_documents(odd, sharding.topology(8)).collect()
    assert len(found) == len(ODD) + 1 and all(r.size == len((ODD[r.doc_id] or "").encode()) + 1 for r in found if r.doc_id is not None)


def test_token_counts(odd, docs):
    path = common.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for df in (odd, docs):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for k, r in by_id(token_counts.token_counts(df, path)).items():
            assert r.n_tokens == len(lib.encode(texts[k], add_special_tokens=False).ids) and r.n_bytes == len(texts[k].encode())
    whole = token_counts.whole_tokens(path)
    assert len(whole) > 45_000 and all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in list(whole)[:500])


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = defaultdict(int)
    for w in windows:
        count[w] += 1
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(odd, docs):
    for df in (odd, docs):
        texts = {r.doc_id: r.text for r in df.collect()}
        for k, r in by_id(quality_rules.apply_policy(quality_rules.ledger(df))).items():
            want = plain_rules(texts[k])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    led = quality_rules.apply_policy(quality_rules.ledger(docs))
    kept = led.where("kept").count()
    assert all(r.kept_without == kept + r.failed_alone for r in quality_rules.ablations(led).collect())
    assert quality_rules.passing(docs).count() == kept and quality_rules.passing(odd).columns == odd.columns


def test_rules_sql(spark, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(quality_rules.rules_sql() + " ORDER BY doc_id").fetchall()
    got = quality_rules.op5_rule_ledger(spark, SF).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_licenses(odd, docs):
    scanner = licenses.train(licenses.sample_paragraphs(docs))
    lines = {"Released under the MIT License.": "mit", "All rights reserved.": "reserved", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, r in by_id(licenses.scan(docs, scanner)).items():
        assert {f for line, f in lines.items() if line in texts[k]} <= set(r.families)
    assert by_id(licenses.scan(odd, scanner))[10].families == ["cc-by-nc"]
    words = licenses.words_of("permission to read this public text is free")
    assert scanner.probabilities([scanner.features(words)])[0].argmax() == len(licenses.TEMPLATES)


WRAPPED = {
    "mit": """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "bsd": """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
    "gpl": """ * A tool.
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or""",
    "cc-by-nc": "A text.\n\nThis work is licensed under a Creative Commons Attribution\nNonCommercial 4.0 International License.",
}
FIRST = {"mit": 4, "bsd": 2, "gpl": 2, "cc-by-nc": 2}


def test_wrapped_licenses(spark, docs):
    prose = [f"Once upon a time in the town of {w} the people\nwalked to the market under the trees of the\nold square and talked about the terms" for w in ("a", "b", "c")]
    scanner = licenses.train(licenses.sample_paragraphs(docs))
    rows, want = [], {}

    def add(text, families, first=None):
        rows.append((len(rows), text))
        want[len(rows) - 1] = (families, first)

    for family, text in WRAPPED.items():
        add(text, [family], FIRST[family])
        add("\n".join([*prose, text, *prose]), [family], FIRST[family] + 9)  # no blank line around the notice
        add(text.replace("\n", "\r\n"), [family], FIRST[family])
        add(re.sub(r"(?<=\w) (?=\w)", "\n", text), [family])  # a word a line
    add("\n\n".join(WRAPPED.values()), sorted(WRAPPED))
    add("\n".join(WRAPPED.values()), sorted(WRAPPED))
    # a blank line parts paragraphs, and words of notices in plain prose are none
    add("Permission is hereby granted, free of charge, to any person obtaining\n\na copy of this software and associated documentation\n\nfiles, to deal in the Software", [])
    add("\n".join(prose * 5), [])
    for k, r in by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner)).items():
        families, first = want[k]
        assert r.families == families and r.n_confirmed == len(families), rows[k]
        assert first is None or [x.paragraph for x in r.found if x.confirmed] == [first]


def test_frames():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 50257, 5000), np.tile(rng.integers(0, 50257, 9), 300), np.zeros(700, int), rng.integers(0, 65535, 1)):
        data = token_files.encode_frame(ids.astype("<u4"))
        assert (token_files.decode_frame(data) == ids).all()
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_frame(bytes(broken))
    with pytest.raises(ValueError):
        token_files.decode_frame(b"nothing")


def test_token_files(spark, odd, docs, tmp_path):
    path = common.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for name, df in (("odd", odd.where("doc_id IS NOT NULL")), ("docs", docs)):
        token_files.write_token_files(df, path, str(tmp_path / name), frame_ids=3000)
        got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, str(tmp_path / name)).collect())
        want, at = [], 0
        for r in df.orderBy("doc_id").collect():
            ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == sorted(want)


def test_quality(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.fit(docs, labels)
    rows = quality_model.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert quality_model.score_documents(odd, model).count() == len(ODD) + 1
    x, y = quality_model.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def plain_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {k: (len(sets[k]), top(k)) for k in sets}


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard(spark, docs, block):
    rng = np.random.default_rng(9)
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    base = [f"w{k}" for k in rng.integers(0, 500, 60)]
    for k in range(40):  # a chain of near copies that its ends don't share
        base[rng.integers(0, 60)] = f"n{k}"
        texts[1000 + k] = " ".join(base)
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(20):
        texts[2000 + k] = passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 900, 15 + 3 * k))
    texts |= {3000 + k: t for k, t in enumerate(t for t in ODD if t is not None)}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.shingle_components(df, block=block).collect()}
    assert got == plain_components(texts)


def test_one_of_each(odd):
    kept = jaccard_join.one_of_each(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 4, 5, 6, 7, 9, 10, 11] and len(kept) == 11


def check_pieces(rows, texts, lib, length=4096):
    ids = {k: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, v in ids.items():
        at = 0
        for start, n in sorted(docs[k]):
            assert start == at and n > 0
            at += n
        assert at == len(v)
    for v in sequences.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)


def test_packing(odd, docs):
    path = common.tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for df in (odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), docs):
        check_pieces(packing.pack_documents(df, path).collect(), {r.doc_id: r.text for r in df.collect()}, lib)
    p = packing.Packer(8, 8)
    for k, size in enumerate([5, 3, 5, 3, 9, 1, 2]):
        p.add(k, range(size))
    p.finish()
    assert sum(len(ids) for _, runs in p.closed for _, _, ids in runs) == 28


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    rows = corpus_pipeline.run(spark, sf).collect()
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d.count()
        d = common.written(stage(spark, d, sf), f"test-{name}")
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < d.count() < before
    check_pieces(rows, {r.doc_id: r.text for r in d.collect()}, Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json")))
