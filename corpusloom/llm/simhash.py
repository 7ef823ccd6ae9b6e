"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ.

Method: a generalised pigeonhole (see ``hamming``): correlated bits form parts, dynamic programming over estimated candidate
counts gives each part its own threshold, the parts are probed and every candidate is verified on all 64 bits.

Defined cases: a null text has no words; a text without words has the fingerprint zero, which links like any other; a text of
fewer words than a shingle is hashed whole. Repeated rows and exact copies share a fingerprint and so a component, and are
never expanded into pairs. Rows with a null id get the component of their fingerprint (null if nothing in it has an id).
Ties: a bit that exactly half of the hashes set is 0; the smallest id names a component. An empty table gives an empty result. Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hamming
from ._common import as_bytes, bit_counts, majority, pieces_of, stored
from .components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Shingles hashed at once, for very long texts.
BLOCK = 1 << 18


def shingle_hashes(text: bytes | None, width: int = SHINGLE, seed: int = SEED):
    """Blocks of XXH64 values of the shingles of a text, A-Z in lower case."""
    words = (text or b"").lower().split()
    if not words:
        return
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(line, seed)], dtype=np.uint64)
        return
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    for at in range(0, len(words) - width + 1, BLOCK):
        stop = min(at + BLOCK, len(words) - width + 1)
        pairs = zip(starts[at:stop], ends[at + width - 1 : stop + width - 1], strict=True)
        yield np.array([digest(line[s:e], seed) for s, e in pairs], dtype=np.uint64)


def fingerprint_batches(batches):
    for whole in batches:
        for batch in pieces_of(whole):
            hashes, owners, n = [], [], 0
            for text in as_bytes(batch.column(1)):
                found = list(shingle_hashes(text))
                hashes += found
                owners.append(sum(map(len, found)))
                n += 1
            counts = np.array(owners, dtype=np.int64)
            bits = bit_counts(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority(bits, counts).view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint as a signed long, a row per row of ``docs``."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(fingerprint_batches, f"id {kind}, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component): the component is the smallest id reachable over links of at most ``max_bits`` differing bits."""
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    n, both = hamming.bit_statistics(classes)
    masks = hamming.plan(n, both, max_bits)
    nodes = classes.select(F.col("fp").alias("id"), "fp")
    members = components(hamming.links(nodes, max_bits, masks)).withColumnRenamed("node", "fp")
    grouped = members.join(classes, "fp")
    least = grouped.groupBy("component").agg(F.min("least").alias("reach"))
    reach = members.join(least, "component").select("fp", "reach")
    named = classes.join(reach, "fp", "left").select("fp", F.coalesce("reach", "least").alias("component"))
    return prints.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Of each component the row of the smallest id; rows without an id come last. All columns stay."""
    from .resemblance import kept_rows, keyed_rows

    keyed, key = keyed_rows(docs, id_col)
    found = near_duplicates(keyed, key, text_col, max_bits).filter("id <=> component")
    return kept_rows(docs, keyed, key, found.select(F.col("id").alias("row")))


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``documents``."""
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
