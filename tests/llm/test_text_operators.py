"""Quality, BPE, language ID, licences, LM scoring: against brute force, on edge cases."""

import random
import zlib
from collections import Counter
from hashlib import sha256
from math import log10

import numpy as np
import public_tokenizers
import pytest
from corpusloom.llm import bpe, langid, license_scan, lm, quality
from tokenizers import Tokenizer

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (5, "x " * 60000), (6, "The cat sat. " * 30), (6, "The cat sat. " * 30), (7, "ü" * 3000), (8, "one\n\none\ntwo | three | four\n### $$$ %%%")]
WORDS = "the of and cat dog runs over lazy quick brown fox jumps tree house river stone green blue".split()


def frame(spark, rows, schema="doc_id long, text string"):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], schema + ", id string, fp int")


def docs(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 90))) + ".") for i in range(n)]


def test_quality_measures_match_brute_force(spark):
    rows = EDGES + docs(60)
    got = sorted(map(tuple, quality.quality_rules(frame(spark, rows)).select("doc_id", "n_words", "n_repeat_words", "n_dup_lines", "n_symbols", "word_chars", "base_failed").collect()))
    want = []
    for i, t in rows:
        t = t or ""
        w = t.encode().split()
        wins = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if wins[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want.append((i, len(w), len(hit), len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in t), sum(len(x.decode()) for x in w), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert got == sorted(want)


@pytest.mark.parametrize(("line", "rule"), [
    ("Home | News | About", "navigation"), ("Buy&&& now&&&", "symbols"), ("ALL CAPS HERE!", "shouting"), ("Click here to go on.", "boilerplate"), ("no stop at the end", "punctuation"), ("A fine line.", None),
])
def test_line_rules(line, rule):
    assert quality.line_fails(line.encode(), len(line.split())) == rule


def test_clean_takes_lines_out_and_keeps_other_columns(spark):
    good = "This is a clean line of text with many words in it, and it ends well. " * 5
    parts = [" ".join(f"word{i}x{j}" for j in range(9)) + "." for i in range(12)]
    rows = [(1, "\n".join([*parts, "Home | News | About"])), (2, "A | B | C\n" * 40), (3, None), (4, good)]
    out = {r["doc_id"]: r for r in quality.clean(frame(spark, rows)).collect()}
    assert set(out) == {1}
    assert out[1]["text"] == "\n".join(parts)
    assert out[1]["fp"] == 1


def test_empty_tables(spark):
    e = frame(spark, []).withColumnRenamed("fp", "lang")
    assert quality.quality_rules(e).count() == 0
    assert bpe.bpe_encoding(e).count() == 0
    assert license_scan.license_scan(e).count() == 0
    assert langid.language_id(e.selectExpr("doc_id", "text", "cast(lang as string) lang")).count() == 0
    assert lm.lm_scoring(e).count() == 0


def test_bpe_equals_the_library(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    odd = ["a", "É", "½", " ", "  ", "\n", "\r\n", "\x1c", "\x85", "\xa0", "'s", "<|endoftext|>", ".", "!!", "😀", "́", "中文", "the"]
    rows = [*EDGES, *((100 + i, "".join(r.choice(odd) for _ in range(r.randint(0, 30)))) for i in range(300))]
    got = Counter(map(tuple, bpe.bpe_encoding(frame(spark, rows)).collect()))
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    back = {r["id"]: r["text"] for r in bpe.decoded(bpe.encoded(frame(spark, rows[-50:]), public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert back == dict(rows[-50:])


def test_language_id_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.language_id(df).join(df, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_id_edge_cases(spark):
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(["the house of the king and the sea", "la maison de la mer et les rois"] * 20)]
    rows = [(i, t, "fr" if t.startswith("la") else "en") for i, t, _ in rows] + [(900, None, None), (901, "123 !!", None), (901, "123 !!", "en"), (None, "the king", "en")]
    out = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (out[900]["lang_pred"], out[900]["score"]) == ("und", 0.0)
    assert out[901]["lang_pred"] == "und"
    assert out[None]["held_out"] is False
    assert out[1]["lang_pred"] == "fr"


def test_licences_found_and_confirmed(spark):
    prose = "\n".join(["Nothing to see on this line.", "He lost his driving license in the river."])
    rows = [(1, f"{prose}\nReleased under the MIT License."), (2, prose), (3, None), (4, ""), (5, "Licensed under the Apache License, Version 2.0.\r\nmore"), (6, "mit den Kindern und dem Hund")]
    out = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert (out[1]["licence"], out[1]["confirmed"]) == ("mit", True)
    assert out[5]["licence"] == "apache-2.0"
    assert [out[i]["licence"] for i in (2, 3, 4, 6)] == [None] * 4
    assert "Python" not in license_scan.license_scan(frame(spark, rows))._jdf.queryExecution().toString()


MIT = """Copyright (c) 2019 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
NOTICES = [
    (MIT, "mit", True), ("A title\n" + MIT.replace("\n", "\r\n"), "mit", True), ("Some heading\nReleased under the MIT License.\nText goes on here", "mit", True),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "agpl", True),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published\nby the Free Software Foundation, either version 2 of the License, or\n(at your option) any later version.", "gpl", True),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at the address below.", "epl", True),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.", "zlib", True),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "boost", True),
    ("You may use this file under the terms of the Artistic License 2.0.", "artistic", None),
]
NONE = [
    "You may not copy, modify or distribute this catalogue without written permission.", "No copies of these plans may be made or distributed without permission in writing.",
    "Her license was renewed in March.", "The warranty covers parts and labour for one year.", "All copyright in the paintings stays with the museum.", "They distribute food to those in need.",
    "The origin of the fire is not known.", "He spoke of a boost to trade and of an eclipse of the sun.",
]


def test_wrapped_notices_and_what_is_none(spark):
    rows = [(i, f"Before it there is a line.\n\n{t}\n\nAnd one after it.") for i, (t, _, _) in enumerate(NOTICES)] + [(100 + i, t) for i, t in enumerate(NONE)]
    out = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, rows)).collect()}
    for i, (t, family, confirmed) in enumerate(NOTICES):
        assert out[i]["licence"] == family, (t, out[i])
        assert confirmed is None or out[i]["confirmed"] == confirmed, (t, out[i])
    named = [(t, out[100 + i]["licence"], out[100 + i]["probability"], out[100 + i]["confirmed"]) for i, t in enumerate(NONE) if out[100 + i]["licence"]]
    assert not [x for x in named if x[3]] and len(named) <= 1, named


def test_licence_classifier_on_unseen_copies():
    m = license_scan.model()
    right = total = 0
    for family, words in license_scan._samples(99, license_scan.UNKNOWN):
        g = [x for x in license_scan.grams(words) if x in m["weights"]]
        z = np.array(m["bias"]) + sum((np.array(m["weights"][x]) for x in g), np.zeros(len(m["families"]))) / np.sqrt(max(len(g), 1))
        p = np.exp((z - z.max()) / m["temperature"])
        p /= p.sum()
        best = int(p[:-1].argmax())
        found = m["families"][best] if p[best] >= m["threshold"] else "unknown"
        right, total = right + (found == family), total + 1
    assert right / total > 0.9


def lm_brute(rows):
    train = [(t or "").encode().lower().split() + [lm.END] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        x = (t or "").encode().lower().split() + [lm.END]
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(x), sum(w in c for w in x), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in x), 6)))
    return out, c, n, v


def test_lm_base_matches_brute_force(spark):
    rows = [*EDGES, *docs(80), (None, "the cat")]
    out = lm.lm_scoring(frame(spark, rows)).collect()
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == Counter(lm_brute(rows)[0])
    assert all(r["score"] <= 0 for r in out)


def lm_scores(rows):
    """The model by its formula: counts of whole n-grams, no automaton."""
    words = lambda t: (t or "").encode().lower().split() + [lm.END]
    train = [words(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    n = [Counter(tuple(x[i : i + k]) for x in train for i in range(len(x) - k + 1)) for k in (0, 1, 2, 3)]
    total, distinct = sum(n[1].values()), len(n[1])

    def p(h, c):
        if not h:
            return (n[1][(c,)] + lm.FLOOR) / (total + lm.FLOOR * (distinct + 1)) if total else 1.0
        m = lm.STRENGTH[len(h)]
        return (n[len(h) + 1][(*h, c)] + m * p(h[1:], c)) / (n[len(h)][h] + m)

    return [(i, round(sum(log10(p(tuple(x[max(0, j - 2) : j]), x[j])) for j in range(len(x))), 6)) for i, t in rows for x in [words(t)]], p, n[1]


@pytest.mark.parametrize(("unit", "packed"), [(1_500_000, 10), (50, 10), (50, 2), (1_500_000, -1)])
def test_lm_scores_match_the_formula(spark, monkeypatch, unit, packed):
    """Every n-gram counts; units send their counts to each other, in packs or as rows, and a text goes on from one unit into the next."""
    monkeypatch.setattr(lm, "UNIT", unit)
    monkeypatch.setattr(lm, "PACKED_BITS", packed)
    monkeypatch.setattr(lm, "PART", 4_000_000 if unit > 50 else 500)
    monkeypatch.setattr(lm, "HELD", 400_000 if unit > 50 else 20)
    rows = [*EDGES, *docs(60), *docs(60)[:9], (None, "the cat"), (77_001, None), (77_001, "a b a b a b")]
    out = lm.lm_scoring(frame(spark, rows).repartition(3)).collect()
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in out) == Counter(lm_scores(rows)[0])


def test_lm_numbers_are_packed_whole():
    r = np.random.default_rng(0)
    for words in (1, 2, 256, 257, 65_536, 65_537, 20_000_000):
        tokens = r.integers(0, words, 1000)
        assert (lm.unpacked_tokens(lm.packed_tokens(tokens, words)) == tokens).all()
    assert len(lm.unpacked_tokens(lm.packed_tokens(np.zeros(0, dtype=np.uint32), 1))) == 0


def test_lm_states_are_distributions():
    _, p, words = lm_scores(docs(40, 3))
    every = [w for (w,) in words]
    for h in [(), (every[0],), (every[0], every[1]), (every[1], b"never seen")]:
        assert sum(p(h, w) for w in every) + p(h, b"unknown word") == pytest.approx(1, abs=1e-9)


def test_lm_of_a_text_in_many_sections(spark, monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 13}" for i in range(400_000))
    rows = [(1, text), (2, text), (4, "w1x1")]
    monkeypatch.setattr(lm, "UNIT", 50_000)
    monkeypatch.setattr(lm, "HELD", 10_000)
    got = {r["doc_id"]: r for r in lm.lm_scoring(frame(spark, rows)).collect()}
    assert got[1]["score"] == pytest.approx(got[2]["score"]) and got[1]["n_tokens"] == 400_001
    assert got[1]["score"] == pytest.approx(dict(lm_scores(rows)[0])[1], rel=1e-9)


def test_lm_beats_its_base_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = [r for r in lm.lm_scoring(df).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_without_training_rows(spark):
    rows = [(i, "some words") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm.lm_scoring(frame(spark, rows)).collect()
    assert {(r["n_known"], r["train_tokens"], r["score"]) for r in got} == {(0, 0, 0.0)}


def test_units_are_not_moved_to_be_scored(spark):
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 30))) for i in range(60)]
    out = lm.lm_scoring(frame(spark, rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(unit") == 1  # of the answers alone
    assert len(out.collect()) == 60 and not spark.catalog.tableExists("units") and not [t for t in spark.catalog.listTables() if t.name.startswith("loom_")]
