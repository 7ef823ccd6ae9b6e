"""Fingerprint links, components, near-duplicates and line dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash
from corpusloom.llm import hamming, line_dedup, simhash
from corpusloom.llm._common import bit_counts
from corpusloom.llm.components import components
from pyspark.sql import functions as F


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def clustered(seed, n_base=30, near=40):
    r = np.random.default_rng(seed)
    out = set()
    for b in r.integers(0, 2**63, n_base):
        out.add(int(b))
        for _ in range(int(r.integers(0, near))):
            x = int(b)
            for bit in r.choice(63, int(r.integers(1, 7)), replace=False):
                x ^= 1 << int(bit)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("cap", [2048, 40])
def test_links_connect_what_brute_force_connects(spark, cap):
    fps = clustered(cap)
    want = classes(((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3), fps)
    df = spark.createDataFrame([(x, x) for x in fps], "id long, fp long")
    got = {r["node"]: r["component"] for r in components(hamming.links(df, 3, hamming.subset_masks(len(fps), 3), cap=cap)).collect()}
    assert {x: got.get(x, x) for x in fps} == want


def test_planned_masks_cover_all_pairs():
    r = np.random.default_rng(0)
    fps = r.integers(0, 2**64, 3000, dtype=np.uint64) & np.uint64(0xFFFFFFFFFF0F0FFF)  # some bits never set
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    for n in (3000, 3_000_000_000):  # the plan changes with the size, the links do not
        masks = hamming.plan(n, bits.T @ bits * (n / 3000), 3)
        for _ in range(300):
            diff = sum(1 << int(b) for b in r.choice(64, 3, replace=False))
            assert any(not diff & m for m in masks)
    for n in (10, 10**7, 10**10):
        for _ in range(200):
            diff = sum(1 << int(b) for b in r.choice(64, 3, replace=False))
            assert any(not diff & m for m in hamming.subset_masks(n, 3))


def test_components_of_a_long_chain_and_no_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(5, 5), (0, 1)], "a long, b long")
    assert {r["component"] for r in components(chain).collect()} == {0}
    assert components(chain.filter("a < 0")).count() == 0


def test_bit_counts_over_long_groups():
    r = np.random.default_rng(1)
    h, n = r.integers(0, 2**64, 3000, dtype=np.uint64), np.array([0, 1, 254, 255, 256, 0, 2234])
    want = [[int((h[s : s + k] >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] for s, k in zip(np.cumsum(n) - n, n, strict=True)]
    assert bit_counts(h, n).tolist() == want


def brute_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "null id text here"), (1, None), (2, ""), (3, "One Two"), (4, "one two"), (5, " \n"), (5, " \n")]
    for i in range(10, 40):
        t = [r.choice(words) for _ in range(r.randint(60, 300))]
        for k in range(r.randint(1, 4)):
            u = list(t)
            if k:
                u[r.randrange(len(u))] = "changed"
            rows.append((100 * i + k, " ".join(u)))
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_texts()
    prints = [brute_print(t) for _, t in rows]
    at = range(len(rows))
    root = classes(((i, j) for i in at for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3), at)
    least = {}
    for i in at:
        if rows[i][0] is not None:
            least[root[i]] = min(least.get(root[i], 10**9), rows[i][0])
    want = sorted(((rows[i][0], f"{prints[i]:016x}", least.get(root[i])) for i in at), key=str)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    assert sorted(map(tuple, simhash.simhash_near_dedup(df).collect()), key=str) == want
    kept = simhash.keep_one(df)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({w[2] for w in want}, key=str)
    assert simhash.simhash_near_dedup(df.limit(0)).count() == 0


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_similarity_matches_brute_force():
    r = random.Random(2)
    for _ in range(1500):
        a, b = ("".join(r.choice("abcü") for _ in range(r.randint(0, 14))) for _ in "xy")
        assert line_dedup.distance(a, b) == lev(a, b)
        assert line_dedup.similar(a, b) == (lev(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9)
    pairs = [tuple("".join(r.choice("abcü") for _ in range(r.randint(0, 70))) for _ in "xy") for _ in range(200)]
    for a, b in pairs:  # judgements short of the distance are right
        v, w = a.replace("a", " "), b.replace("a", " ")
        assert line_dedup._aligned(v.split(" "), w.split(" "), 100) >= lev(v, w) and line_dedup._runs_apart(a, b) <= 6 * lev(a, b)
    assert line_dedup.distances(pairs) == [lev(a, b) for a, b in pairs]


def line_brute(rows):
    """Near-equal pairs and the component of each line occurrence (key, number), every pair of lines compared."""
    lines = []
    for key, text in sorted(rows, key=lambda x: x[0]):
        for j, words in enumerate(line_dedup.normal_lines(None if text is None else text.encode())):
            if words:
                lines.append((key, j, b" ".join(words).decode()))
    at = range(len(lines))
    counts = np.zeros((len(lines), 512), dtype=np.int32)  # each character that differs costs an edit at least
    for i, (_, _, text) in enumerate(lines):
        np.add.at(counts[i], [ord(c) % 512 for c in text], 1)
    sizes = np.array([len(x[2]) for x in lines])
    pairs = []
    for i in at:
        more = np.maximum(counts[:i] - counts[i], 0).sum(axis=1)
        fewer = np.maximum(counts[i] - counts[:i], 0).sum(axis=1)
        for j in np.flatnonzero(np.maximum(more, fewer) <= 0.2 * np.maximum(sizes[:i], sizes[i]) + 1e-9).tolist():
            if lines[i][2] == lines[j][2] or line_dedup.similar(lines[i][2], lines[j][2]):
                pairs.append((i, j))
    return lines, pairs, classes(pairs, at)


def line_rows():
    r = random.Random(8)
    words = [f"word{i}" for i in range(200)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(3, 60))) for _ in range(40)]
    out = [(900, None), (901, ""), (902, "\n\n")]
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 8)):
            x = r.choice(base).split()
            if r.random() < 0.5:
                k = r.randrange(len(x))
                x[k] = x[k] + "s"
            lines.append(" ".join(x).upper() if r.random() < 0.2 else " ".join(x) + "." * r.randint(0, 1))
        out.append((i, "\n".join(lines)))
    return out


def links_of(spark, rows):
    df = spark.createDataFrame(rows, "row long, text string")
    lines = df.mapInArrow(line_dedup._lines, "row long, line int, key binary, sketch binary, size long")
    groups = lines.groupBy("key").agg(F.min(F.struct("row", "line")).alias("first"), F.count("*").alias("n"), F.max("sketch").alias("sketch"), F.max("size").alias("size"))
    found = {bytes(r["node"]): bytes(r["component"]) for r in components(line_dedup.near_links(groups, df)).collect()}
    return lambda text: found.get(k := line_dedup.lines_of([text.encode()])[2].astype("<u8").tobytes(), k)


@pytest.mark.parametrize("source", ["edited", "sf0.001"])
def test_line_links_against_all_pairs(spark, source):
    """Nothing is linked that brute force does not connect, and of its pairs at least 0.9 are."""
    if source == "edited":
        rows = [(k, t) for k, t in line_rows()]
    else:
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    lines, pairs, root = line_brute(rows)
    of = links_of(spark, rows)
    unequal = [(i, j) for i, j in pairs if lines[i][2] != lines[j][2]]
    caught = sum(of(lines[i][2]) == of(lines[j][2]) for i, j in unequal)
    assert len(unequal) > 20 and caught >= 0.9 * len(unequal)
    seen = {}
    for i, (_, _, text) in enumerate(lines):
        assert root[seen.setdefault(of(text), i)] == root[i]


def test_line_dedup_keeps_one_of_each_group(spark):
    rows = line_rows()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, __row string, __gone int")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df).collect()}
    lines, _, root = line_brute(rows)
    of = links_of(spark, rows)
    first = {}
    for key, j, text in lines:
        first.setdefault(of(text), (key, j))
    gone = {(key, j) for key, j, text in lines if first[of(text)] != (key, j)}
    assert got == {key: None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if (key, j) not in gone) for key, text in rows}
    out = line_dedup.dedup_lines(df, drop_emptied=True)
    assert out.columns == df.columns
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_very_long_lines_are_compared_whole(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(500)]
    long = " ".join(r.choices(words, k=20_000))
    rows = [(1, long), (2, long.replace(words[7], "other")), (3, " ".join(reversed(long.split())))]
    got = {x["doc_id"]: x["text"] for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: long, 2: "", 3: rows[2][1]}


def test_tables_grow_with_the_lines_and_miss_alike():
    for n in (0, 1, 10**3, 10**6, 10**9, 10**12):
        drawn = line_dedup.blocks.tables(n)
        width = len(drawn[0])
        assert all(len(set(t)) == width for t in drawn) and (1 - 0.85**width) ** len(drawn) <= line_dedup.blocks.MISS


def test_lines_and_their_keys():
    texts = [b"One two\n\n TWO\tone.\n---\nlast", None, b"", b"\n\none TWO", "é\u2003x 12,3".encode()]
    owner, number, keys, words, size, *_ = line_dedup.lines_of(texts)
    want = [(i, j, b" ".join(w)) for i, t in enumerate(texts) for j, w in enumerate(line_dedup.normal_lines(t)) if w]
    assert [(i, j, len(x), x.count(b" ") + 1) for i, j, x in want] == list(zip(owner.tolist(), number.tolist(), size.tolist(), words.tolist(), strict=True))
    named = [x.tobytes() for x in keys]
    for i, x in enumerate(want):
        for j, y in enumerate(want):
            assert (x[2] == y[2]) == (named[i] == named[j])
    assert len(line_dedup.lines_of([None, b""])[0]) == 0


def test_matches_find_every_close_pair_of_a_bucket():
    r = np.random.default_rng(1)
    blocks = line_dedup.blocks
    base = r.integers(0, 2**64, 40, dtype=np.uint64)
    records = np.zeros(300, dtype=blocks.RECORD)
    for i in range(300):
        x = int(base[i % 40])
        for bit in r.choice(64, int(r.integers(0, 15)), replace=False):
            x ^= 1 << int(bit)
        records[i] = (i % 3, x, 0, 0, 50 + int(r.integers(0, 9)))
    groups, places, ordered = blocks.matches(records, [])
    at = range(300)

    def close(i, j):
        p, q = ordered[i], ordered[j]
        bits = (int(p["a"]) ^ int(q["a"])).bit_count()
        return p["key"] == q["key"] and abs(int(p["m"]) - int(q["m"])) <= blocks.LENGTHS and bits <= blocks.MAX_BITS and (bits > 0 or p["m"] != q["m"])

    root = classes(((i, j) for i in at for j in range(i) if close(i, j)), at)
    want = {i: c for i, c in root.items() if list(root.values()).count(c) > 1}
    assert dict(zip(places.tolist(), groups.tolist(), strict=True)) == want


def test_line_dedup_with_repeated_and_null_ids(spark):
    line = "this very line comes again and again here"
    rows = [(1, line), (1, line), (None, f"{line}\nshort one")]
    got = sorted(r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # exactly one row keeps the line (null ids come first in order)
    assert sum(line in t for t in got) == 1 and sum("short one" in t for t in got) == 1 and len(got) == 3


def test_many_lines_with_one_print(spark, monkeypatch):
    """Lines of the same words in other orders share a sketch; the group is compared in pairs of chunks, and none is lost."""
    r = random.Random(3)
    words = [f"v{i}" for i in range(12)]
    texts = []
    for _ in range(60):
        i, j = r.sample(range(12), 2)
        words[i], words[j] = words[j], words[i]
        texts.append(" ".join(words))
    rows = list(enumerate(dict.fromkeys(texts)))
    lines, _, root = line_brute(rows)
    for cap in (1024, 10):
        monkeypatch.setattr(line_dedup, "CAP", cap)
        of = links_of(spark, rows)
        named = {}
        for i, (_, _, text) in enumerate(lines):
            named.setdefault(of(text), set()).add(i)
        want = {}
        for i in range(len(lines)):
            want.setdefault(root[i], set()).add(i)
        assert sorted(map(sorted, named.values())) == sorted(map(sorted, want.values()))


def test_lines_are_cut_and_read_once_without_python(spark):
    """The cut of whole texts runs no Python, and a text is split once however many of its lines are looked up."""
    many = "\n".join(f"line {i} " + "abcdefghij"[i % 10] * (i % 89 + 5) for i in range(20_000))
    rows = [(1, "one line of the kind\n\nother words here\n"), (2, "one line of the kind\n\n\tkept as it is"), (3, None), (4, ""), (5, "one line of the kind"), (6, "\n \n"), (7, many)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a`b.c", F.lit(1))
    out = line_dedup.dedup_lines(df, counts=("n", "gone"))
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: (r["text"], r["n"], r["gone"]) for r in out.filter("doc_id < 7").collect()}
    assert got == {1: (rows[0][1], 4, 0), 2: ("\n\tkept as it is", 3, 1), 3: (None, 0, 0), 4: ("", 1, 0), 5: ("", 1, 1), 6: ("\n \n", 3, 0)}
    kept = {r["doc_id"] for r in line_dedup.dedup_lines(df, drop_emptied=True).collect()}
    assert kept == {1, 2, 3, 4, 6, 7}
