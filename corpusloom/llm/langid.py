"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE_PER_LANGUAGE`` rows a language at most, those of the
smallest hash of id and text; equal ones once) by follow-the-regularised-leader with elastic-net penalties, which leaves most weights at zero; a
temperature is then fitted on a fifth of the sample that the weights have not seen. Inputs of a prediction are whole texts only.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; without a labelled row nothing is learned
and every text is ``und``; ties go to the alphabetically first language; repeated rows get equal results; very long texts are
counted in blocks; an empty table gives an empty result. Only id, text and label are read, whatever else the table has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, pieces_of

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 600
#: Follow-the-regularised-leader: learning rate and its offset, elastic net (L1, L2), passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.002, 0.001, 3
#: Characters of a text that are counted at once.
BLOCK = 1 << 20
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of hashed character 1- to 3-grams of the whole text, letters in lower case; buckets without any are left out."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for at in range(0, len(points), BLOCK):
        for n in ORDERS:
            part = points[at : at + BLOCK + n - 1]
            if len(part) < n:
                continue
            code = np.full(len(part) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                code = (code ^ part[k : len(part) - n + 1 + k]) * _PRIMES[k]
                code ^= code >> np.uint32(15)
            counts += np.bincount(code & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(counts).astype(np.int32)
    return at, counts[at].astype(np.int32)


def has_letter(text: str | None) -> bool:
    return text is not None and (text.isalpha() or any(map(str.isalpha, text)))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  #: (BUCKETS, languages), sparse in content
    bias: np.ndarray
    temperature: float

    def features(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts
        x = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt(x @ x)
        return at, x / norm if norm else x

    def scores(self, counts: tuple[np.ndarray, np.ndarray], temperature: float | None = None) -> np.ndarray:
        at, x = self.features(counts)
        z = (x @ self.weights[at] + self.bias) / (temperature or self.temperature)
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        p = self.scores(ngram_counts(text))
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def fit(rows: list[tuple[str, str]]) -> Model:
    """``rows``: (text, language)."""
    rows = [(t, y) for t, y in rows if t and y is not None]
    languages = tuple(sorted({y for _, y in rows}))
    k = len(languages)
    idf, weights, bias = np.zeros(BUCKETS), np.zeros((BUCKETS, k)), np.zeros(k)
    if not k:
        return Model(languages, idf, weights, bias, 1.0)
    counted = [ngram_counts(t) for t, _ in rows]
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for at, _ in counted:
        seen[at] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    model = Model(languages, idf, weights, bias, 1.0)
    index = {y: i for i, y in enumerate(languages)}
    data = [(*model.features(c), index[y]) for c, (_, y) in zip(counted, rows, strict=True)]
    train = [d for i, d in enumerate(data) if i % 5 or len(data) < 10]
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    order = np.random.default_rng(0)
    for _ in range(PASSES):
        for i in order.permutation(len(train)):
            at, x, y = train[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    model = Model(languages, idf, w[:BUCKETS], w[BUCKETS], 1.0)
    held = [(c, index[y]) for i, (c, (_, y)) in enumerate(zip(counted, rows, strict=True)) if not i % 5] or [(counted[0], data[0][2])]

    def loss(t: float) -> float:
        return -float(np.mean([np.log(max(model.scores(c, t)[y], 1e-300)) for c, y in held]))

    losses = {float(t): loss(float(t)) for t in np.exp(np.linspace(np.log(0.02), np.log(5), 40))}
    return Model(languages, idf, model.weights, model.bias, min(losses, key=lambda t: (losses[t], -t)))  # the least loss, the softest of equals


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """Per language, the labelled rows of the smallest hashes outside the held-out fold; at most ``per_language`` each."""
    # the model has a column of weights per language, so a table of them is small enough to broadcast
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, 3) != 1))
    u = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40))  # rows of one id are told apart by their texts
    counts = labelled.groupBy(F.col(label_col).alias("y")).agg(F.count("*").alias("n"))
    limits = counts.select("y", (F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))).cast("long").alias("limit"))
    drawn = labelled.select(F.col(label_col).alias("y"), u.alias("u"), F.col(text_col).alias("t")).join(F.broadcast(limits), "y").filter("u < limit").select("y", "u", "t").dropDuplicates(["y", "u"])  # repeated rows are learned once
    found: dict[str, list] = {}
    for r in drawn.orderBy("u").toLocalIterator():
        own = found.setdefault(r["y"], [])
        if len(own) < per_language:
            own.append((r["t"], r["y"]))
    return [x for y in sorted(found) for x in found[y]]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                found = [model.predict(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x for x, _ in found], type=pa.string()), pa.array([s for _, s in found], type=pa.float64())], names=["id", "lang_pred", "score"]
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose language is found with a score of ``least`` or more; all columns stay. Nothing learned: all with a letter."""
    at = docs.columns.index(text_col)

    def keep(text: str | None) -> bool:
        return model.predict(text)[1] >= least if model.languages else has_letter(text)

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, at):
                yield batch.filter(pa.array([keep(t) for t in batch.column(at).to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``documents``."""
    model = fit(training_sample(docs, "doc_id", "text", "lang"))
    out = identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
