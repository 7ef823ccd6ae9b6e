"""Importance resampling towards a target: hashed word n-grams, log ratios of their counts, and a seeded Gumbel draw.

The bucket of an n-gram is the CRC of its bytes, and CRCs are linear over GF(2): appending m bytes to a string multiplies its
CRC by the m-th power of one 32 x 32 matrix, and the CRC of what was appended is added. So each word's CRC is computed once, an
n-gram's follows from those of its words and their lengths, and no n-gram is ever put together as a string. Powers are kept as
tables of four bytes for short words, and as squarings for long ones.

Counts are arrays of fixed size (``BUCKETS``), summed by Spark; so are the gains, which every task holds. Ranks come from
ranges of the scores and their counts (``mix.numbered``), so no task orders them all.

Defined cases: a null or empty text has no features, weight 0 and no rank; so has any text of fewer than ``LEAST_WORDS`` words
no rank. A null id takes part as an empty string and ranks behind the other ids of its score; rows of one id and score are
ranked as they were read. Repeated rows count as often as they occur. Texts over 8 MiB are read in parts, with the last words of
one part before the next. An empty table gives an empty result, an empty target a T of 0. Only the id and text columns are
read; other columns can be carried in one struct, so they can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.operators.mix import numbered

from ._common import as_bytes, pieces_of, segments, stored

BUCKETS, LONGEST, LEAST_WORDS, PER_CENT, SEED = 10_000, 2, 20, 25, 7
#: The CRC's polynomial, lowest power in the highest bit; shifts up to so many bytes have tables of their own.
POLYNOMIAL, TABLED = 0xEDB88320, 64
SPACE = np.uint32(crc32(b" "))
#: A-Z in lower case; what is no letter, digit or part of a character beyond ASCII becomes a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The matrix (32 columns, as integers) times each vector."""
    out = np.zeros_like(vectors)
    for i in range(32):
        out ^= np.where(vectors >> np.uint32(i) & np.uint32(1), matrix[i], np.uint32(0))
    return out


def _byte_shift() -> np.ndarray:
    """What one zero byte does to each bit of a CRC."""
    column = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        column = np.where(column & np.uint32(1), column >> np.uint32(1) ^ np.uint32(POLYNOMIAL), column >> np.uint32(1))
    return column


def _table(matrix: np.ndarray) -> np.ndarray:
    """(4, 256): the matrix times each value of each byte."""
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_times(matrix, values << np.uint32(8 * k)) for k in range(4)])


@cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for shifts by 0 to ``TABLED`` - 1 bytes, and for those by 1, 2, 4, ... bytes, up to 2^40."""
    one = _byte_shift()
    power, short = np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(TABLED):
        short.append(_table(power))
        power = _times(one, power)
    squares, power = [], one
    for _ in range(41):
        squares.append(_table(power))
        power = _times(power, power)
    return np.stack(short), squares


def _applied(tables: np.ndarray, which: np.ndarray | int, crcs: np.ndarray) -> np.ndarray:
    octets = [(crcs >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]
    return tables[which, 0, octets[0]] ^ tables[which, 1, octets[1]] ^ tables[which, 2, octets[2]] ^ tables[which, 3, octets[3]]


def shifted(crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs after so many zero bytes each."""
    short, squares = _shifts()
    small = sizes < TABLED
    if small.all():
        return _applied(short, sizes, crcs)
    out = crcs.copy()
    out[small] = _applied(short, sizes[small], crcs[small])
    for k, table in enumerate(squares):
        at = np.flatnonzero(~small & (sizes >> k & 1 == 1))
        out[at] = _applied(table[None], 0, out[at])
    return out


def gram_crcs(crcs: np.ndarray, sizes: np.ndarray, runs: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ...: the CRCs of all runs of n words, and the place of their last words. ``runs`` tells texts apart."""
    last, now = np.arange(len(crcs)), crcs
    yield now, last
    for n in range(2, longest + 1):
        inside = runs[last[1:]] == runs[last[1:] - n + 1] if len(last) else np.zeros(0, dtype=bool)
        last, before = last[1:][inside], now[:-1][inside]
        if not len(last):
            return
        spaced = _applied(_shifts()[0], 1, before) ^ SPACE
        now = shifted(spaced, sizes[last]) ^ crcs[last]
        yield now, last


def _words(data: bytes) -> list[bytes]:
    return data.translate(LOWER).split()


def _features(texts: list[bytes | None], buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, bucket) of all features, some texts at a time."""
    def of(words: list[bytes], owner: np.ndarray, ahead: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        crcs = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for crc, last in gram_crcs(crcs, sizes, owner, longest):
            new = last >= ahead
            yield owner[last[new]], crc[new] % np.uint32(buckets)

    short = [_words(t) if t and len(t) <= 8 << 20 else [] for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in short])
    yield from of([w for words in short for w in words], owner)
    for i, t in enumerate(texts):
        if t and len(t) > 8 << 20:
            tail: list[bytes] = []
            for part in segments(t):
                words = tail + _words(part)
                yield from of(words, np.full(len(words), i), len(tail))
                tail = words[len(words) - longest + 1 :] if longest > 1 else []


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: how many features of all texts lie there."""

    def run(batches):
        counts = np.zeros(buckets, dtype=np.int64)
        for whole in batches:
            for batch in pieces_of(whole, 0):
                for _, found in _features(as_bytes(batch.column(0)), buckets, longest):
                    counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["bucket", "n"])

    parts = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """A gain per bucket, in thousandths of a natural logarithm, rounded down."""
    sides = {"s": bucket_counts(docs, text_col, buckets, longest), "t": bucket_counts(target, target_col, buckets, longest)}
    counts = {}
    for name, side in sides.items():
        counts[name] = np.zeros(buckets, dtype=np.float64)
        for r in side.collect():  # as many rows as buckets
            counts[name][r["bucket"]] = r["n"]
    s, t = counts["s"], counts["t"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, carry: Sequence[str] = ()) -> DataFrame:
    """id, n_features, weight of every row, and ``row`` with the columns to carry."""

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                n = batch.num_rows
                features, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                for owner, found in _features(as_bytes(batch.column(1)), len(gain), longest):
                    features += np.bincount(owner, minlength=n)
                    value = gain[found]
                    sums = np.concatenate([[0], np.cumsum(value)])
                    edges = np.searchsorted(owner, np.arange(n + 1))
                    total += sums[edges[1:]] - sums[edges[:-1]]
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features), pa.array(weight), *batch.columns[2:]], names=["id", "n_features", "weight", *batch.schema.names[2:]])

    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *rest)
    layout = StructType([rows.schema["id"], StructField("n_features", LongType()), StructField("weight", LongType()), *rows.schema.fields[2:]])
    return rows.mapInArrow(run, layout)


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    per_cent: int = PER_CENT, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, carry: Sequence[str] = (),
) -> DataFrame:
    """id, n_features, weight, score and rank of every row (and ``row``); rows without a rank are not drawn."""
    gain = gains(docs, target, text_col, target_col, buckets, longest)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighted(docs, gain, id_col, text_col, longest, carry).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = stored(scored.withColumn("place", F.monotonically_increasing_id()), "scored")
    least = sum(max(0, least_words - n + 1) for n in range(1, longest + 1))  # features of a text of so many words
    fit = F.col("n_features") >= least
    n = scored.filter(fit).count()
    ranked = numbered(scored.filter(fit), -F.col("score"), F.col("id").isNull(), "id", "place", out="rank")
    drawn = F.when(F.col("rank") < per_cent * n // 100, F.col("rank") + 1)
    columns = ["id", "n_features", "weight", "score", *(["row"] if carry else [])]
    return ranked.select(*columns, drawn.alias("rank")).unionByName(scored.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows that are drawn, as they were, with their rank beside them: row, rank."""
    return resampled(docs, target, carry=docs.columns, **options).filter("rank is not null").select("row", "rank")


def importance_resampling(docs: DataFrame, target: DataFrame) -> DataFrame:
    """A quarter of ``documents``, drawn towards the texts of ``benchmark``."""
    return resampled(docs, target).withColumnRenamed("id", "doc_id").select("doc_id", "n_features", "weight", "score", "rank")
