"""Licence scans with DataFrame functions only: a trained paragraph classifier, confirmed against templates.

Training (on the driver, over the fixed templates, their crops and thinned copies, and texts that are no licence of a known family;
no corpus row is read): multinomial logistic regression with an L1 penalty on sparse word 1- to 3-grams, where every feature holds
an anchor word. A third of the texts of the unknown class is kept out of training whole; a temperature, and the least probability
below which a paragraph is ``unknown``, are set on these and on other copies of the templates.

Scoring: a paragraph ends at a blank line or where a line ends with a sentence, so a wrapped licence is one paragraph; where a
paragraph has several lines, each line is looked at on its own as well, as it may stand below a title or a heading. What holds no
anchor word has no feature and is skipped; for others the n-grams' weights are looked up in a map literal, added up and turned
into probabilities. A found family is confirmed if enough of the paragraph's word pairs lie in one of its templates and no other
family's template holds more of them. All of it is expressions over one row: no shuffle, no join, no Python.

Defined cases: null and empty texts have no finding; ties go to the alphabetically first family; repeated rows get equal
results; whole texts and very long lines are read (time grows with a paragraph's length); an empty table gives an empty result.
Only id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import ANCHORS, TEMPLATES, UNKNOWN

ORDERS = (1, 2, 3)
COPIES, RATE, L1, STEPS = 24, 2.0, 2e-4, 400
MIN_SIMILARITY = 0.6
#: Every such text of the unknown class is kept out of training.
HELD = 3
#: Where paragraphs end: at a blank line, and where a line ends with a sentence.
PARAGRAPH_END = r"\n[ \t\r]*(?=\n)|(?<=[.:;!?])[ \t\r]*\n"


def words_of(line: str) -> list[str]:
    return re.sub(r"[^a-z0-9.]+", " ", line.lower()).replace(". ", " ").rstrip(".").split()


def grams(words: list[str]) -> list[str]:
    """Distinct n-grams that hold an anchor word."""
    found = (" ".join(words[i : i + n]) for n in ORDERS for i in range(len(words) - n + 1))
    return sorted({g for g in found if not set(g.split()).isdisjoint(ANCHORS)})


def _samples(seed: int, unknown: tuple[str, ...]) -> Iterator[tuple[str, list[str]]]:
    """Templates and texts of the unknown class, whole, cropped and thinned."""
    r = np.random.default_rng(seed)
    for family, texts in [*TEMPLATES.items(), ("unknown", unknown)]:
        for text in texts:
            words = words_of(text)
            yield family, words
            for _ in range(COPIES):
                keep = r.random(len(words)) > r.choice([0.0, 0.05, 0.1])
                some = [w for w, k in zip(words, keep, strict=True) if k]
                if len(some) > 24:
                    at = int(r.integers(0, len(some) - 16))
                    some = some[at : at + int(r.integers(16, len(some)))]
                yield family, [*(["copyright", "c", "2021"] if family != "unknown" and r.random() < 0.1 else []), *some]
    vocabulary = sorted({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)})
    for _ in range(20 * COPIES):  # words of licences in no order
        yield "unknown", list(r.choice(vocabulary, int(r.integers(4, 30))))


@lru_cache(maxsize=1)
def model() -> dict:
    """families, weights {n-gram: [weight per family]}, bias, temperature, threshold."""
    families = (*sorted(TEMPLATES), "unknown")
    train, held = list(_samples(1, tuple(t for i, t in enumerate(UNKNOWN) if i % HELD))), list(_samples(2, UNKNOWN[::HELD]))
    index = {g: i for i, g in enumerate(sorted({g for _, w in train for g in grams(w)}))}

    def matrix(rows):
        x = np.zeros((len(rows), len(index)), dtype=np.float32)
        for i, (_, w) in enumerate(rows):
            at = [index[g] for g in grams(w) if g in index]
            x[i, at] = 1 / np.sqrt(max(len(at), 1))
        return x, np.array([families.index(f) for f, _ in rows])

    x, y = matrix(train)
    w, b = np.zeros((x.shape[1], len(families)), dtype=np.float32), np.zeros(len(families), dtype=np.float32)
    one = np.eye(len(families), dtype=np.float32)[y]
    share = 1 / np.maximum(one.sum(axis=0), 1)  # every family weighs the same
    row = (share[y] / len(families))[:, None]
    for _ in range(STEPS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - one) * row
        w -= 8 * RATE * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - L1 * RATE, 0)
        b -= RATE * g.sum(axis=0)
    hx, hy = matrix(held)
    z = hx @ w + b

    def probabilities(t):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    t = min(np.exp(np.linspace(-3, 1, 41)), key=lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(hy)), hy], 1e-12)).mean())
    p, last = probabilities(t), len(families) - 1
    best = p[:, :last].max(axis=1)
    none = np.sort(best[hy == last])
    # at most 1 in 100 of held-out prose passes
    threshold = float(np.clip(none[int(0.99 * (len(none) - 1))], 0.5, 0.9))
    kept = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    names = sorted(index, key=index.get)
    return {
        "families": families, "weights": {names[i]: [round(float(v), 5) for v in w[i]] for i in kept},
        "bias": [round(float(v), 5) for v in b], "temperature": float(t), "threshold": threshold,
    }


def _line_words(line: Column) -> Column:
    clean = F.rtrim(F.regexp_replace(F.lower(line), r"[^a-z0-9.]+", " "))
    clean = F.regexp_replace(F.regexp_replace(clean, r"\. ", " "), r"\.+$", "")
    return F.filter(F.split(clean, " +"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - n)
    made = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licence (null: nothing with an anchor word or all unknown), probability, similarity, confirmed, findings.

    ``findings`` has a row per paragraph, and per line of longer ones, with an anchor word: part (its number, paragraphs before
    lines), family (or ``unknown``), probability of the family, similarity to its templates, confirmed. The document's licence is
    the finding with the highest probability, confirmed ones first.
    """
    m = model()
    families, k = m["families"], len(m["families"]) - 1
    weights = F.from_json(F.lit(json.dumps(m["weights"])), "map<string,array<double>>")
    pairs = [[f, sorted({" ".join(w[i : i + 2]) for i in range(len(w) - 1)})] for f, texts in sorted(TEMPLATES.items()) for w in map(words_of, texts)]
    templates = F.from_json(F.lit(json.dumps([{"family": f, "pairs": p} for f, p in pairs])), "array<struct<family:string,pairs:array<string>>>")
    names = F.from_json(F.lit(json.dumps(families)), "array<string>")
    bias = F.from_json(F.lit(json.dumps(m["bias"])), "array<double>")
    anchored = r"(?i)(?<![a-z0-9])(?:" + "|".join(ANCHORS) + r")(?![a-z0-9])"

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    paragraphs = F.filter(F.split("t", PARAGRAPH_END, -1), lambda p: p.rlike(anchored))
    lines = F.filter(F.flatten(F.transform(F.filter(paragraphs, lambda p: F.contains(F.trim(p), F.lit("\n"))), lambda p: F.split(p, "\n", -1))), lambda x: x.rlike(anchored))
    parts = F.when(F.col("t").rlike(anchored), F.concat(paragraphs, lines))
    hits = F.transform(parts, lambda s, i: F.struct(i.alias("part"), _line_words(s).alias("w")))

    def summed(words: Column) -> Column:
        every = F.array_distinct(F.concat(*(_grams(words, n) for n in ORDERS)))
        found = F.filter(F.transform(every, lambda g: F.try_element_at(weights, g)), lambda w: w.isNotNull())
        zero = F.transform(bias, lambda x: x * 0.0)
        total = F.aggregate(found, F.struct(zero.alias("z"), F.lit(0).alias("n")), lambda a, w: F.struct(F.zip_with(a["z"], w, lambda p, q: p + q).alias("z"), (a["n"] + 1).alias("n")))
        return F.transform(F.array(total), lambda a: F.zip_with(F.transform(a["z"], lambda v: v / F.sqrt(F.greatest(a["n"], F.lit(1)))), bias, lambda p, q: (p + q) / m["temperature"]))[0]

    scored = F.transform(hits, lambda x: F.struct(x["part"].alias("part"), x["w"].alias("w"), summed(x["w"]).alias("z")))

    def softmax(z: Column) -> Column:
        top = F.array_max(z)
        e = F.transform(z, lambda v: F.exp(v - top))
        return F.transform(F.array(F.aggregate(e, F.lit(0.0), lambda a, v: a + v)), lambda s: F.transform(e, lambda v: v / s))[0]

    likely = F.transform(scored, lambda x: F.struct(x["part"].alias("part"), x["w"].alias("w"), softmax(x["z"]).alias("p")))

    def named(x: Column) -> Column:
        best = F.array_max(F.slice(x["p"], 1, k))
        family = F.when(best >= m["threshold"], F.element_at(names, F.array_position(F.slice(x["p"], 1, k), best).cast("int"))).otherwise("unknown")
        return F.struct(x["part"].alias("part"), x["w"].alias("w"), family.alias("family"), best.alias("probability"))

    def compared(x: Column) -> Column:
        own = F.array_distinct(_grams(x["w"], 2))
        close = F.transform(templates, lambda t: F.struct((t["family"] == x["family"]).alias("own"), (F.size(F.array_intersect(own, t["pairs"])) / F.greatest(F.size(own), F.lit(1))).alias("part")))
        most = lambda mine: F.coalesce(F.array_max(F.transform(F.filter(close, lambda c: c["own"] == F.lit(mine)), lambda c: c["part"])), F.lit(0.0))
        return F.struct(x["part"].alias("part"), x["family"].alias("family"), x["probability"].alias("probability"), most(True).alias("similarity"), most(False).alias("rival"))

    judged = F.transform(F.transform(likely, named), compared)
    final = F.transform(
        judged, lambda x: F.struct(*(x[c].alias(c) for c in ("part", "family", "probability", "similarity")), ((x["similarity"] >= MIN_SIMILARITY) & (x["similarity"] >= x["rival"])).alias("confirmed"))
    )
    out = rows.select("id", F.coalesce(final, F.expr("cast(array() as array<struct<part:int,family:string,probability:double,similarity:double,confirmed:boolean>>)")).alias("findings"))
    known = F.filter("findings", lambda x: x["family"] != "unknown")
    ranked = F.array_max(F.transform(known, lambda x: F.struct(x["confirmed"].alias("c"), x["probability"].alias("p"), x["similarity"].alias("s"), (-x["part"]).alias("l"), x["family"].alias("f"))))
    out = out.withColumn("top", ranked)
    return out.select("id", F.col("top.f").alias("licence"), F.col("top.p").alias("probability"), F.col("top.s").alias("similarity"), F.coalesce("top.c", F.lit(False)).alias("confirmed"), "findings")


def license_scan(docs: DataFrame) -> DataFrame:
    """The licence found in every row of ``documents``."""
    return scan(docs).withColumnRenamed("id", "doc_id")
