"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents are tokenised and cut into pieces; a histogram of piece lengths (in units of ``GRAIN`` tokens, so of fixed size
whatever the input) is the demand of a linear program over patterns, a pattern being what fits one sequence. A knapsack by
dynamic programming prices new patterns, the solution is rounded down, what is left is placed first-fit by size, and the
pieces, ranked inside their length class, take the slots of the rounded patterns.

Cuts: every ``capacity`` tokens; and the tail of every second document (by a hash of its tokens) is cut once more at a hashed
place, so that short pieces exist to fill up sequences even where a large group of documents has one length.

Defined cases: a null text is empty, an empty text is the end id alone; repeated rows are packed as often as they occur (a
row is one document even where ids repeat or are null); very long texts become many full sequences; an empty table gives an
empty result; ties in rank are broken by row, so which of two equal pieces takes a slot has no meaning. Only the id and text
columns are read, so other columns can have any name.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_bytes, pieces_of, segments, stored
from .bpe import byte_letters

CAPACITY, END_ID, GRAIN = 2048, 1, 16
#: Pricing stops this close to the bound; so many columns are priced at most (any basis is a valid packing).
GAP, MAX_COLUMNS = 5e-4, 4000
#: Distinct words a worker remembers the ids of.
CACHE_WORDS = 600_000
#: How byte-level models write a byte.
LETTERS = {b: c for b, c in byte_letters().items() if chr(b) != c}


class WordEncoder:
    """ids by the tokenizers library, a word at a time with a cache; for tokenizers that drop white space and never join over it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> None:
        """Words of letters that the normaliser would leave alone go to the model at once, others through the whole library."""
        others, tokenize, cache = [], self.model.tokenize, self.cache
        for w in words:
            if w.isalpha() and w.islower():
                cache[w] = array("I", [t.id for t in tokenize(w.decode("ascii"))]).tobytes()
                continue
            text = w.decode("utf-8", "replace")
            if text.isalpha() and text == text.lower() and is_normalized("NFC", text):
                cache[w] = array("I", [t.id for t in tokenize(w.decode("latin-1").translate(LETTERS))]).tobytes()
            else:
                others.append(w)
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in others], add_special_tokens=False)
        for w, e in zip(others, found, strict=True):
            cache[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        # special tokens are looked for in the text as it stands
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new: set[bytes] = set()
        for words in split:
            new.update(set(words).difference(cache))
        if new:
            # a stop after a letter or digit is a token of its own, so "word," needs no entry of its own in the tokenizer
            ends = [w for w in new if w[-1:] in (b".", b",") and w[-2:-1].isalnum()]
            cores = {w[:-1] for w in ends} | {w[-1:] for w in ends} | new.difference(ends)
            self._encode([w for w in cores if w not in cache])
            for w in ends:
                cache[w] = cache[w[:-1]] + cache[w[-1:]]
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut(n: int, seed: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of a document of n tokens start, and n at the end."""
    at = list(range(0, n, capacity)) + [n]
    tail = n - at[-2]
    if seed & 1 and GRAIN * 4 <= tail < capacity:
        at.insert(-1, at[-2] + GRAIN * (1 + (seed >> 1) % (tail // GRAIN - 1)))
    return at


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, its length class, its partition and rank there; with its ids on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        rank = np.zeros(capacity // GRAIN + 1, dtype=np.int64)
        for whole in batches:
            for batch in pieces_of(whole):
                texts = [t or b"" for t in as_bytes(batch.column(1))]
                short = iter(enc.encode([t for t in texts if len(t) < 8 << 20]))
                owner, cols, ids_out = [], [[] for _ in range(6)], []
                for i, t in enumerate(texts):
                    ids = next(short) if len(t) < 8 << 20 else b"".join(enc.encode([s])[0] for s in segments(t))
                    ids += END_ID.to_bytes(4, "little")
                    n, view = len(ids) // 4, memoryview(ids)
                    at = cut(n, zlib.crc32(ids), capacity)
                    for a, b in zip(at, at[1:]):  # noqa: B905
                        cls = -(-(b - a) // GRAIN)
                        owner.append(i)
                        for col, x in zip(cols, (a, b - a, zlib.crc32(view[4 * a : 4 * b]), n, cls, int(rank[cls])), strict=True):
                            col.append(x)
                        rank[cls] += 1
                        if with_ids:
                            ids_out.append(np.frombuffer(view[4 * a : 4 * b], dtype="<u4").astype(np.int32))
                arrays = [batch.column(0).take(pa.array(owner, type=pa.int64())), *(pa.array(c, type=pa.int64()) for c in cols), pa.array([part] * len(owner), type=pa.int64())]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank", "part"]
                if with_ids:
                    arrays.append(pa.array(ids_out, type=pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = dict(docs.dtypes)[id_col]
    layout = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, cls long, rank long, part long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, layout)


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest total value: how often each size is taken (unbounded)."""
    order = np.argsort(sizes, kind="stable")
    w, v = sizes[order], values[order]
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    upto = np.searchsorted(w, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            total = best[c - w[:k]] + v[:k]
            j = int(total.argmax())
            if total[j] > best[c] + 1e-12:
                best[c], pick[c] = total[j], j
    taken, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            taken[order[pick[c]]] += 1
            c -= int(w[pick[c]])
    return float(best[capacity]), taken


@dataclass(frozen=True)
class Plan:
    """Patterns (rows; columns are length classes 1..units) and how many sequences use each."""

    patterns: np.ndarray
    times: np.ndarray
    bound: float  #: from the linear program: no packing of these classes needs fewer sequences


def cutting_stock(demand: np.ndarray) -> Plan:
    """``demand[c - 1]`` pieces of class c (c units long) into sequences of ``len(demand)`` units."""
    units = len(demand)
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return Plan(np.zeros((0, units), dtype=np.int64), np.zeros(0, dtype=np.int64), 0.0)
    need = demand[sizes - 1].astype(float)
    per = units // sizes
    basis = np.diag(per.astype(float))
    inverse = np.diag(1.0 / per)
    need += 1e-4 * np.random.default_rng(0).random(m)  # keeps ties from stalling the simplex
    x = need / per
    bound = float(sizes @ need) / units
    for step in range(MAX_COLUMNS):
        if x.sum() - bound <= max(0.5, GAP * bound):
            break
        duals = np.maximum(inverse.sum(axis=0), 0)
        value, column = knapsack(duals, sizes, units)
        # duals over the best pattern's value are feasible, so they bound every packing from below
        bound = max(bound, float(duals @ need) / max(value, 1.0))
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.maximum(direction, 1e-9), np.inf)
        out = int(ratio.argmin())
        step_size = ratio[out]
        x = np.maximum(x - step_size * direction, 0)
        x[out] = step_size
        basis[:, out] = column
        inverse[out] /= direction[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(direction[others], inverse[out])
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ need, 0)
    whole = np.floor(x + 1e-9).astype(np.int64)
    rows = [basis[:, p].astype(np.int64) for p in np.flatnonzero(whole)]
    times = [int(whole[p]) for p in np.flatnonzero(whole)]
    rest = np.maximum(demand[sizes - 1] - (np.array(rows).T @ np.array(times) if rows else 0), 0).astype(np.int64)
    bins: list[list] = []  # [units left, counts]; the rest is less than m patterns
    for k in range(m - 1, -1, -1):
        for _ in range(int(rest[k])):
            spot = next((b for b in bins if b[0] >= sizes[k]), None)
            if spot is None:
                bins.append(spot := [units, np.zeros(m, dtype=np.int64)])
            spot[0] -= int(sizes[k])
            spot[1][k] += 1
    rows += [b[1] for b in bins]
    times += [1] * len(bins)
    wide = np.zeros((len(rows), units), dtype=np.int64)
    wide[:, sizes - 1] = np.array(rows)
    return Plan(wide, np.array(times, dtype=np.int64), bound)


def _seats(plan: Plan):
    """For a class and ranks inside it: the sequence and the seat there."""
    base = np.cumsum(plan.times) - plan.times
    tables = {}
    for c in range(plan.patterns.shape[1]):
        used = np.flatnonzero(plan.patterns[:, c])
        room = plan.patterns[used, c] * plan.times[used]
        tables[c + 1] = used, np.cumsum(room) - room
    return base, tables


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, on demand)."""
    pieces = stored(token_pieces(docs, tokenizer_path, id_col, text_col, with_ids, capacity), "pieces")
    counts = pieces.groupBy("part", "cls").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "cls", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    demand = np.zeros(capacity // GRAIN, dtype=np.int64)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # as many rows as classes at most
        demand[r["cls"] - 1] = r["n"]
    plan = cutting_stock(demand)
    base, tables = _seats(plan)
    patterns = plan.patterns

    def seat(batches):
        for batch in batches:
            cls = batch.column(0).to_numpy(zero_copy_only=False)
            rank = batch.column(1).to_numpy(zero_copy_only=False)
            seq, at = np.zeros(len(cls), dtype=np.int64), np.zeros(len(cls), dtype=np.int64)
            for c in np.unique(cls):
                rows = np.flatnonzero(cls == c)
                used, start = tables[int(c)]
                k = np.searchsorted(start, rank[rows], side="right") - 1
                p = used[k]
                inner = rank[rows] - start[k]
                seq[rows] = base[p] + inner // patterns[p, c - 1]
                at[rows] = (patterns.shape[1] - c) * 4096 + inner % patterns[p, c - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(seq), pa.array(at)], names=[*batch.schema.names[2:], "sequence_id", "seat"])

    keep = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    ranked = pieces.join(offsets, ["part", "cls"]).select("cls", (F.col("rank") + F.col("ahead")).alias("rank"), *keep)
    layout = ", ".join(f"{c} {t}" for c, t in ranked.dtypes[2:]) + ", sequence_id long, seat long"
    ahead = Window.partitionBy("sequence_id").orderBy("seat").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.mapInArrow(seat, layout).withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("seat")


def packing(docs: DataFrame) -> DataFrame:
    """The pieces of every row of ``documents``, tokenised by the public word BPE."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
