"""Alignment of the tokens of two tokenizers over the same bytes, and corpus-wide counts of linked ids.

A text goes in with one space in front. The cumulative ends of both token lists are merged as two pointers would: every stretch
between two neighbouring ends, of either side, lies in one token of each side, so it is one link; where both sides end, a group
ends. Words between single spaces are aligned once and remembered, as neither tokenizer joins tokens over such a space (checked:
a word whose end is no token end is aligned on its own).

How often a pair of ids is linked is counted by Spark. A unit of texts lists its distinct pairs once, with the texts that hold
each; ``groupBy`` sums them, the largest count of each id of either side is joined to the pairs, and both are joined back to the
units, where texts refer to their unit's pairs by place. A pair is one row per unit, so no key is large.

Defined cases: a null or empty text, and one whose tokens do not spell it (it holds U+2581), has no tokens: zeros and an empty
digest. Strings of special tokens are plain text. Repeated rows count as texts of their own, even where ids repeat or are null;
ties for the largest count are all largest. Long texts are taken whole; a unit holds ``UNIT_BYTES`` of text, or one longer text.
An empty table gives an empty result. Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces_of, stored
from .bpe import SPLIT, coder

#: Bytes of text in a unit; words that a worker remembers from one unit to the next.
UNIT_BYTES, CACHE_WORDS = 8 << 20, 400_000


class ByteTokens:
    """Side A: a byte-level model; its entries' ids are the ranks by which tiktoken merges.

    Merging by rank of the joined entry gives the listed merges where every entry is reached by merging its own bytes; a test
    holds that, and the ids against the tokenizers library.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding

        own = coder(path)
        special = set(own.special.values())
        self.strings = [own.strings.get(i, b"") for i in range(max(own.strings) + 1)]
        ranks = {s: i for i, s in enumerate(self.strings) if s and i not in special}
        self.encode = Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        return self.encode(" " + text)


class PieceTokens:
    """Side B: a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.strings = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.strings.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


@dataclass
class Aligned:
    """Words side by side: counts of each, their links one after another, and their groups as text."""

    counts: np.ndarray  #: (words, 4): tokens of A, of B, groups, links
    links: np.ndarray  #: a * (size of B) + b
    groups: list[bytes]  #: each group ends with a semicolon


class Aligner:
    """Aligns texts by their words, which it remembers."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        self.wide = len(b.strings)
        self.lengths = [np.array([len(s) for s in x.strings], dtype=np.int64) for x in (a, b)]
        #: What a token writes if its group goes on, if its side of the group ends with it.
        self.spelled = [[b"%d%c" % (i, c) for c in (44, end) for i in range(len(x.strings))] for x, end in ((a, 124), (b, 59))]
        #: Where a text may be cut: a space between two characters that are no white space.
        self.cut = regex.compile(r"(?<=[^\s\p{White_Space}]) (?=[^\s\p{White_Space}])").split
        self.odd_space = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.parts: list[np.ndarray] = []
        self.kept: list[np.ndarray] = []
        self.counts, self.links = np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int64)

    def words(self, text: str) -> list[str]:
        """The text's words; a space in front of each is understood."""
        loose = text[0] in " \n" or text[-1] == " " or "  " in text or "\n " in text or " \n" in text or self.odd_space(text)
        if not loose:
            return text.split(" ")
        first, *rest = self.cut(" " + text)
        return [first[1:], *rest]

    def merge(self, words: list[str]) -> Aligned | None:
        """The words, aligned as one text; None if they do not spell it or a word's end is no end of a group."""
        text = " ".join(words)
        raw = (" " + text).encode()
        ids = [np.array(x.ids(text), dtype=np.int64) for x in (self.a, self.b)]
        if any(b"".join(map(x.strings.__getitem__, i.tolist())) != raw for x, i in zip((self.a, self.b), ids, strict=True)):
            return None
        ends = [np.cumsum(n[i]) for n, i in zip(self.lengths, ids, strict=True)]
        # both lists of ends on one line of bytes: a link ends at every mark, a group at the marks of both
        mark = np.zeros(len(raw) + 1, dtype=np.uint8)
        for side, e in enumerate(ends):
            mark[e] |= side + 1
        every, both = np.flatnonzero(mark), np.flatnonzero(mark == 3)
        begins = np.concatenate([[0], every[:-1]])
        of_a, of_b = (np.searchsorted(e, begins, side="right") for e in ends)
        word_ends = np.cumsum([len(w.encode()) + 1 for w in words])
        if (mark[word_ends] != 3).any():
            return None
        at = np.stack([np.searchsorted(e, word_ends, side="right") for e in (*ends, both, every)], axis=1)
        # in writing, a token of A follows the tokens of B of earlier groups, one of B also those of A of its own
        seen_a, seen_b = (np.concatenate([[0], np.searchsorted(e, both, side="right")]) for e in ends)
        group_a, group_b = (np.searchsorted(both, e) for e in ends)
        said = np.zeros(len(ids[0]) + len(ids[1]), dtype=object)
        for side, place, e in ((0, np.arange(len(ids[0])) + seen_b[group_a], ends[0]), (1, np.arange(len(ids[1])) + seen_a[group_b + 1], ends[1])):
            wide = len(self.spelled[side]) // 2
            said[place] = list(map(self.spelled[side].__getitem__, (ids[side] + wide * (mark[e] == 3)).tolist()))
        said, cuts = said.tolist(), [0, *(at[:, 0] + at[:, 1]).tolist()]
        groups = [b"".join(said[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return Aligned(np.diff(at, axis=0, prepend=0), ids[0][of_a] * self.wide + ids[1][of_b], groups)

    def _learn(self, words: list[str]) -> None:
        """Adds new words to the table; those that cannot be aligned get minus one token."""
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace() and "▁" not in w]
        taken = set(plain)
        found = []
        for i in range(0, len(plain), 2048):
            part = plain[i : i + 2048]
            whole = self.merge(part)
            found += [(part, whole)] if whole else [([w], self.merge([w])) for w in part]
        found += [([w], self.merge([w])) for w in words if w not in taken]
        for part, got in found:
            self.places.update(zip(part, range(len(self.places), len(self.places) + len(part)), strict=True))
            self.parts.append(got.counts if got else np.array([[-1, 0, 0, 0]], dtype=np.int64))
            self.kept.append(got.links if got else np.zeros(0, dtype=np.int64))
            self.groups += got.groups if got else [b""]

    def settle(self) -> None:
        """What was learnt, as arrays: counts, where a word's links begin, and links as places in the list of distinct ones."""
        if self.parts:
            self.counts = np.concatenate([self.counts, *self.parts])
            self.links = np.concatenate([self.links, *self.kept])
            self.parts, self.kept = [], []
        self.starts = np.cumsum(self.counts[:, 3]) - self.counts[:, 3]
        self.pairs, self.link = np.unique(self.links, return_inverse=True)

    def places_of(self, texts: list[str | None]) -> list[list[int]]:
        """For each text the places of its words in the table."""
        split = [self.words(t) if t else [] for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        new.difference_update(self.places)
        if new:
            self._learn(sorted(new))
        get = self.places.__getitem__
        return [list(map(get, words)) for words in split]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(ByteTokens(path_a), PieceTokens(path_b))
    return _ALIGNERS[path_a, path_b]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many as its size."""
    ahead = np.cumsum(sizes) - sizes
    return np.repeat(starts - ahead, sizes) + np.arange(int(sizes.sum()))


class Unit:
    """Texts whose distinct pairs are listed together."""

    def __init__(self, table: Aligner):
        self.table = table
        self.ids: list[pa.Array] = []
        self.places: list[list[int]] = []
        self.bytes = 0

    def add(self, ids: pa.Array, texts: list[str | None], size: int) -> None:
        self.ids.append(ids)
        self.places += self.table.places_of(texts)
        self.bytes += size

    def rows(self, unit: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row per text, and one with the unit's pairs."""
        t = self.table
        t.settle()
        n = len(self.places)
        per_text = np.array([len(p) for p in self.places], dtype=np.int64)
        words = np.fromiter(chain.from_iterable(self.places), dtype=np.int64, count=int(per_text.sum()))
        owner = np.repeat(np.arange(n), per_text)
        bad = np.zeros(n, dtype=bool)
        bad[owner[t.counts[words, 0] < 0]] = True
        keep = ~bad[owner]
        words, owner = words[keep], owner[keep]
        sums = [np.bincount(owner, weights=t.counts[words, k], minlength=n).astype(np.int64) for k in range(4)]
        written = ([] if bad[k] else p for k, p in enumerate(self.places))
        digests = [sha256(b"".join(map(t.groups.__getitem__, p))[:-1]).hexdigest() if p else "" for p in written]
        # a text's words once each, then its pairs once each
        wide = max(len(t.groups), 1)
        word_key, word_times = np.unique(owner * wide + words, return_counts=True)
        owner, words = np.divmod(word_key, wide)
        sizes = t.counts[words, 3]
        at = t.link[_ranges(t.starts[words], sizes)]
        wide = max(len(t.pairs), 1)
        key = np.repeat(owner, sizes) * wide + at
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(np.repeat(word_times, sizes)[order], first).astype("<u4") if len(first) else np.zeros(0, dtype="<u4")
        owner, at = np.divmod(key[first], wide)
        held = np.bincount(at, minlength=wide)
        used = np.flatnonzero(held)
        at = (np.cumsum(held > 0) - 1)[at].astype("<u4")
        edges = np.searchsorted(owner, np.arange(n + 1)).tolist()
        spans = list(zip(edges, edges[1:], strict=False))
        ids = pa.concat_arrays(self.ids)
        for lo in range(0, n, 1000):
            part = spans[lo : lo + 1000]
            m = len(part)
            columns = [
                pa.array([unit] * m, type=pa.int64()), ids.slice(lo, m), *(pa.array(s[lo : lo + m]) for s in sums), pa.array(digests[lo : lo + m]),
                pa.array([at[a:b].tobytes() for a, b in part], type=pa.binary()), pa.array([times[a:b].tobytes() for a, b in part], type=pa.binary()),
                pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if len(used):
            columns = [pa.array([unit], type=pa.int64()), *(pa.nulls(1, schema.field(i).type) for i in range(1, 9))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t.pairs[used]], type=pa.list_(pa.int64())), pa.array([held[used]], type=pa.list_(pa.int32()))], schema=schema)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds, by ``pairs is null``: a text (unit, id, counts, digest; ``at`` and ``times``: its pairs by place in the
    unit's list and how often each is linked, packed as unsigned 32-bit), and a unit's list (unit, pairs, held: texts that hold each)."""
    kind = dict(docs.dtypes)[id_col]
    layout = f"unit long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, pairs array<long>, held array<int>"

    def run(batches):
        table, part, n, unit, schema = aligner(path_a, path_b), TaskContext.get().partitionId(), 0, None, None
        for whole in batches:
            for batch in pieces_of(whole):
                if schema is None:
                    kinds = [pa.int64(), batch.schema.field(0).type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                    schema = pa.schema(list(zip((x.split()[0] for x in layout.split(", ")), kinds, strict=True)))
                if unit is None:
                    if len(table.places) > CACHE_WORDS:
                        table.forget()
                    unit = Unit(table)
                unit.add(batch.column(0), batch.column(1).to_pylist(), batch.column(1).nbytes)
                if unit.bytes >= UNIT_BYTES:
                    yield from unit.rows(part << 32 | n, schema)
                    n, unit = n + 1, None
        if unit is not None:
            yield from unit.rows(part << 32 | n, schema)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, layout)


def pair_counts(units: DataFrame, wide: int) -> DataFrame:
    """pair, a, b, n (texts that hold the pair), best_a and best_b: whether no pair of that id of A, or of B, is held by more.

    ``units`` has a row per unit and pair: pair, held. The maxima have a row per id of a vocabulary, so their size is bounded.
    """
    counts = units.groupBy("pair").agg(F.sum("held").alias("n")).withColumns({"a": F.expr(f"pair div {wide}"), "b": F.expr(f"pair % {wide}")})
    tops = [counts.groupBy(side).agg(F.max("n").alias(f"top_{side}")) for side in "ab"]
    both = counts.join(F.broadcast(tops[0]), "a").join(F.broadcast(tops[1]), "b")
    return both.select("pair", "a", "b", "n", (F.col("n") == F.col("top_a")).alias("best_a"), (F.col("n") == F.col("top_b")).alias("best_b"))


def cross_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    wide = len(PieceTokens(path_b).strings)
    found = stored(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    texts = found.filter("pairs is null").drop("pairs", "held")
    # one exchange by pair serves the counts and the join
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = found.filter("pairs is not null").select("unit", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select("unit", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    listed = listed.repartition(parts, "pair")
    counts = stored(pair_counts(listed, wide).select("pair", "n", "best_a", "best_b"), "pair-counts")
    packed = F.col("n") * 4 + F.col("best_a").cast("long") * 2 + F.col("best_b").cast("long")
    answers = listed.join(counts.withColumn("x", packed), "pair").select(F.col("unit").alias("of"), "place", "x")

    def finish(rows: pa.Table, back: pa.Table) -> pa.Table:
        value = np.zeros(back.num_rows, dtype=np.int64)
        value[back["place"].to_numpy()] = back["x"].to_numpy()
        n, on_a, on_b = value >> 2, value >> 1 & 1, value & 1
        sums = [[], [], []]
        for at, times in zip(rows["at"].to_pylist(), rows["times"].to_pylist(), strict=True):
            at, times = np.frombuffer(at, dtype="<u4"), np.frombuffer(times, dtype="<u4").astype(np.int64)
            for out, x in zip(sums, (on_a, on_b, n), strict=True):
                out.append(int((x[at] * times).sum()))
        kept = rows.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        for name, x in zip(("n_best", "n_best_b", "count_sum"), sums, strict=True):
            kept = kept.append_column(name, pa.array(x, type=pa.int64()))
        return kept

    kind = dict(docs.dtypes)[id_col]
    layout = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, n_best_b long, count_sum long"
    return texts.groupBy("unit").cogroup(answers.groupBy("of")).applyInArrow(finish, layout)


def cross_tokenizer_alignment(docs: DataFrame) -> DataFrame:
    """The alignment of the public byte-level BPE (A) with the public piece BPE (B) over every row of ``documents``."""
    import public_tokenizers

    found = cross_alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum", "groups_sha256")
