"""Language-model scoring by a weighted backoff automaton.

Model: a trigram over words with Dirichlet smoothing. With n(.) the counts of the training texts, h a history and h' the history
without its first word, P(c | h) = (n(hc) + M * P(c | h')) / (n(h) + M), where M is ``STRENGTH`` of the history's length. The empty
history gives (n(c) + a) / (N + a * (V + 1)) with a = ``FLOOR``: the event space is the V training words and one unknown word, as in the base.
As an automaton: a state is a history seen in training (the empty one, one word, two words); an arc of a state is a seen
n-gram and carries log10 P(c | h); where a state has no arc for the word, its failure arc leads to the next shorter history at the
price of log10(M / (n(h) + M)), the weight that the formula leaves for unseen words, so each state's probabilities add up
to 1. The end of a text is a word like any other. One traversal from left to right carries the state and adds up.

Size: every n-gram of the training texts counts, none is cut. The texts are dealt into units of about ``UNIT`` tokens. Each unit names its
distinct n-grams by hashes with its own counts of them; they are sent, packed, to parts of the hash space (or as rows, where the parts
are many) and added up there, and what the other units count of them is sent back, in the order asked and without the hashes. So a task that scores a unit holds exactly the arcs that its texts can
touch, and what is moved grows with the input, a few bytes an n-gram. Words are told by 64 bits. Pairs and triples are told by 40
bits besides those of the part; as the parts' number grows with the n-grams, about 4 in a million share a hash with another and
add their counts, at any size.

Defined cases: a null text is empty and scores its end alone; repeated rows count as often as they occur and are scored alike;
ties do not matter, as nothing is ranked; a row with a null id is in neither fold (held_out false, not learned from); very long
texts are traversed in several units, each starting in the state that the one before ends in; without a training row,
N = V = 0 and every word has probability 1; an empty table gives an empty result. Only id and text are read, so other columns can have any name.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import as_bytes, bucketed, crc_mod, mixed, pieces_of, segments

#: The end of a text; no word holds white space, so none equals it.
END = b"\n"
FLOOR, STRENGTH = 0.5, (0.0, 200.0, 20.0)
#: Tokens of a unit, tokens whose arcs are laid out at once while it is scored, and n-grams that a part of the hash space takes.
UNIT, HELD, PART = 1_200_000, 150_000, 6_000_000
#: Bits of the hash of a pair or triple besides those that number the part; bits of the parts' number up to which units send packs.
KEY, PACKED_BITS = 40, 10


def _fold(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = crc_mod(id_col, 7) == 2
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(~held, F.lit(False)).alias("train"))


def _unit_layout(kind: str) -> str:
    return f"unit long, row array<long>, id array<{kind}>, held array<boolean>, train array<boolean>, n array<long>, ahead array<int>, words binary, tokens binary, learned long"


def _units(id_type: pa.DataType):
    """Texts to units: pieces of rows, the hash of each distinct word, and the words as numbers. A piece has up to two words ahead, of its own text."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, number = TaskContext.get().partitionId() << 40, 0, 0
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        pieces: list[tuple] = []
        tokens: list[np.ndarray] = []
        size = learned = 0

        def out() -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary))
            row, ids, held, train, n, ahead = (list(x) for x in zip(*pieces, strict=True))
            cells = [
                pa.array([part | serial]), pa.array([row], pa.list_(pa.int64())), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([train], pa.list_(pa.bool_())), pa.array([n], pa.list_(pa.int64())), pa.array([ahead], pa.list_(pa.int32())),
                pa.array([words.tobytes()], pa.binary()), pa.array([packed_tokens(np.concatenate(tokens), len(vocabulary))], pa.binary()), pa.array([learned], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(cells, names=["unit", "row", "id", "held", "train", "n", "ahead", "words", "tokens", "learned"])

        for whole in batches:
            for batch in pieces_of(whole):
                ids, held, train = (batch.column(i).to_pylist() for i in (0, 2, 3))
                for i, text in enumerate(as_bytes(batch.column(1))):
                    before: list[bytes] = []
                    sections = [s.split() for s in segments((text or b"").lower(), 2 << 20)]
                    sections[-1].append(END)
                    for words in sections:
                        own = before + words
                        tokens.append(np.fromiter(map(vocabulary.__getitem__, own), dtype=np.uint32, count=len(own)))
                        pieces.append((part | number, ids[i], held[i], train[i], len(words), len(before)))
                        size += len(own)
                        learned += len(words) if train[i] else 0
                        before = own[-2:]
                        if size >= UNIT:
                            yield out()
                            vocabulary.clear()
                            pieces.clear()
                            tokens.clear()
                            serial += 1
                            size = learned = 0
                    number += 1
        if pieces:
            yield out()

    return deal


class Grams:
    """The n-grams of one unit: for each order the distinct hashes, the unit's own training counts, and the number of each position's n-gram (-1: none)."""

    def __init__(self, words: bytes, tokens: bytes, train: list[bool], n: list[int], ahead: list[int]):
        self.tokens = unpacked_tokens(tokens)
        sizes = np.array(n, dtype=np.int64) + np.array(ahead, dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(self.tokens)) - np.repeat(starts, sizes)
        scored = place >= np.repeat(np.array(ahead, dtype=np.int64), sizes)
        self.starts = starts
        counted = (scored & np.repeat(np.array(train, dtype=bool), sizes)).astype(np.float64)
        hashes = np.frombuffer(words, dtype=np.uint64)
        keys = [mixed(hashes)]
        numbers, counts = [self.tokens], [np.bincount(self.tokens, counted, len(hashes)).astype(np.int64)]
        chained = keys[0][self.tokens]
        word = chained
        for order in (2, 3):
            chained = mixed(chained[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[order - 1 :] + np.uint64(order)) if len(chained) else chained
            at = np.full(len(self.tokens), -1, dtype=np.int64)
            valid = np.flatnonzero(place >= order - 1)
            found, own = np.unique(chained[valid - (order - 1)], return_inverse=True)
            at[valid] = own
            keys.append(found)
            numbers.append(at)
            counts.append(np.bincount(own, counted[valid], len(found)).astype(np.int64))
        self.keys, self.numbers, self.counts = keys, numbers, counts

    def spaces(self, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hashes, order) of the words, and of the pairs and triples, shortened: in order they are what the unit asks for."""
        keys = (self.keys[0], np.concatenate(self.keys[1:]) >> np.uint64(64 - KEY - bits))
        return [(k, np.argsort(k, kind="stable")) for k in keys]

    def learn(self, more: list[np.ndarray], bits: int) -> None:
        """Adds what other units count, given in the order of ``spaces``."""
        at = len(self.keys[1])
        for (_, order), extra, space in zip(self.spaces(bits), more, (0, 1), strict=True):
            own = np.zeros(len(order), dtype=np.int64)
            own[order] = extra
            if space:
                self.counts[1] += own[:at]
                self.counts[2] += own[at:]
            else:
                self.counts[0] += own


def packed_tokens(tokens: np.ndarray, words: int) -> bytes:
    """Numbers of words, byte by byte of their places, as many as the largest needs; compressed."""
    wide = max(1, ((words - 1).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].T)
    return bytes([wide]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked_tokens(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return sum((plane.astype(np.int64) << 8 * k for k, plane in enumerate(planes)), np.zeros(planes.shape[1], dtype=np.int64))


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts, mostly one byte each; compressed."""
    large = counts >= 255
    parts = [np.array([len(counts)], "<i8").tobytes(), np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked_counts(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    counts = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<i8", offset=8 + n)
    return counts


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as gaps, byte by byte of their places; compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.T).tobytes())


def unpacked_keys(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


_UNIT_GRAMS = ("words", "tokens", "train", "n", "ahead")


def _rows(batch: pa.RecordBatch | pa.Table, names) -> Iterator[tuple]:
    for i in range(batch.num_rows):  # a unit at a time: one may be large
        yield tuple(batch.column(batch.schema.get_field_index(c))[i].as_py() for c in names)


def _asker(bits: int):
    """Units to (part, unit, words, counts, grams, gram_counts): packed hashes and the unit's own counts, by part."""
    parts = 1 << bits

    def ask(batches):
        for batch in batches:
            for unit, *own in _rows(batch, ("unit", *_UNIT_GRAMS)):
                grams = Grams(*own)
                cells = []
                for (keys, order), counts, width in zip(grams.spaces(bits), (grams.counts[0], np.concatenate(grams.counts[1:])), (64, KEY + bits), strict=True):
                    keys, counts = keys[order], counts[order]
                    edges = [*np.searchsorted(keys, np.arange(parts, dtype=np.uint64) << np.uint64(width - bits)).tolist(), len(keys)] if bits else [0, len(keys)]
                    spans = list(zip(edges[:-1], edges[1:], strict=True))
                    cells += [pa.array([packed_keys(keys[s:e]) for s, e in spans], pa.binary()), pa.array([packed_counts(counts[s:e]) for s, e in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([unit] * parts, pa.int64()), *cells], names=["part", "unit", *_ASKED])

    return ask


_ASKED = ("words", "counts", "grams", "gram_counts")


def _summed(keys: list[bytes], counts: list[bytes]) -> tuple[list[bytes], int]:
    """For each unit's keys, in its order, packed sums of what the others count; and how many distinct keys are counted at all."""
    found, own = [unpacked_keys(x) for x in keys], np.concatenate([unpacked_counts(x) for x in counts])
    ends = np.cumsum([len(k) for k in found])
    key = np.concatenate(found)
    distinct = 0
    if len(key):
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sums = np.add.reduceat(own[order], starts)
        distinct = int((sums > 0).sum())
        total = np.empty(len(key), dtype=np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(starts, len(key))))
        own = total - own
    return [packed_counts(x) for x in np.split(own, ends[:-1])], distinct


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part after the other to (unit, part, words, grams, distinct): what other units count of what the unit asked for, and the part's training words."""

    def work(part: int, asked: list[tuple]) -> pa.RecordBatch:
        units, words, counts, grams, gram_counts = zip(*asked, strict=True)
        (told, distinct), (told_grams, _) = _summed(words, counts), _summed(grams, gram_counts)
        cells = [pa.array(units, pa.int64()), pa.array([part] * len(units), pa.int32()), pa.array(told, pa.binary()), pa.array(told_grams, pa.binary()), pa.array([distinct] * len(units), pa.int64())]
        return pa.RecordBatch.from_arrays(cells, names=["unit", "part", "words", "grams", "distinct"])

    part, asked = None, []
    for batch in batches:
        for p, *row in _rows(batch, ("part", "unit", *_ASKED)):
            if p != part:
                if asked:
                    yield work(part, asked)
                part, asked = p, []
            asked.append(tuple(row))
    if asked:
        yield work(part, asked)


def _row_asker(bits: int):
    """Units to rows of their n-grams: (space, key, unit, place, n), the place being that in the unit's order."""

    def ask(batches):
        for batch in batches:
            for unit, *own in _rows(batch, ("unit", *_UNIT_GRAMS)):
                grams = Grams(*own)
                for space, ((keys, order), counts) in enumerate(zip(grams.spaces(bits), (grams.counts[0], np.concatenate(grams.counts[1:])), strict=True)):
                    keys, counts = keys[order].view(np.int64), counts[order]
                    for at in range(0, len(keys), 100_000):
                        part = keys[at : at + 100_000]
                        cells = [pa.array(np.full(len(part), space, dtype=np.int32)), pa.array(part), pa.array(np.full(len(part), unit)), pa.array(np.arange(at, at + len(part))), pa.array(counts[at : at + 100_000])]
                        yield pa.RecordBatch.from_arrays(cells, names=["space", "key", "unit", "place", "n"])

    return ask


def _row_answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, space, place, n), in that order, to one answer a unit."""

    def work(unit: int, told: list[list[np.ndarray]]) -> pa.RecordBatch:
        cells = [pa.array([packed_counts(np.concatenate([np.zeros(0, dtype=np.int64), *x]))], pa.binary()) for x in told]
        return pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([0], pa.int32()), *cells], names=["unit", "part", "words", "grams"])

    unit, told = None, [[], []]
    for batch in batches:
        units, spaces, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        edges = [0, *(np.flatnonzero((np.diff(units) != 0) | (np.diff(spaces) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if units[a] != unit:
                if unit is not None:
                    yield work(unit, told)
                unit, told = int(units[a]), [[], []]
            told[spaces[a]].append(n[a:b])
    if unit is not None:
        yield work(unit, told)


def _exchanged(units: DataFrame, bits: int, n_units: int) -> DataFrame:
    """unit, part, words, grams: what all other units count of what a unit asks for; distinct: sums to the distinct training words over a unit's rows.

    While the parts are few, a unit sends each a pack. Packs are as many as units times parts, so from ``PACKED_BITS`` on the
    n-grams go as rows, as many as there are, are summed by ``groupBy`` and joined back; both ways give the same.
    """
    grams = units.select("unit", *_UNIT_GRAMS)
    if bits <= PACKED_BITS:
        asked = grams.mapInArrow(_asker(bits), "part int, unit long, words binary, counts binary, grams binary, gram_counts binary")
        return asked.repartition(1 << bits, "part").sortWithinPartitions("part", "unit").mapInArrow(_answer, "unit long, part int, words binary, grams binary, distinct long")
    rows = grams.mapInArrow(_row_asker(bits), "space int, key long, unit long, place long, n long")
    sums = rows.groupBy("space", "key").agg(F.sum("n").alias("all"))
    others = rows.join(sums, ["space", "key"]).select("unit", "space", "place", (F.col("all") - F.col("n")).alias("n"))
    return others.repartition(max(1, n_units), "unit").sortWithinPartitions("unit", "space", "place").mapInArrow(_row_answer, "unit long, part int, words binary, grams binary").withColumn("distinct", F.lit(_distinct_words(units)))


class Automaton:
    """The states and arcs that a unit's texts can touch. State 0 is the empty history, 1 + w a word's, beyond those a pair's.

    Arcs are told by the n-gram's number at a position, so that no table of arcs has to be built and searched: where a word's state
    stands before position i, its arc, if there is one, is the pair that ends there, and a pair's is the triple.
    """

    #: What stands for an arc that is not there; log-probabilities are 0 at most.
    NONE = 1.0

    def __init__(self, grams: Grams, total: int, distinct: int):
        self.grams = grams
        one, two, _ = grams.counts
        words, space = len(one), total + FLOOR * (distinct + 1)
        self.single = ((one + FLOOR) / space if total else np.ones(words)).astype(float)
        at2 = np.zeros(len(two), dtype=np.int64)  # a position of each pair tells its words
        valid = np.flatnonzero(grams.numbers[1] >= 0)
        at2[grams.numbers[1][valid]] = valid
        last2, before2 = grams.tokens[at2], grams.tokens[at2 - 1]
        m1, m2 = STRENGTH[1], STRENGTH[2]
        self.p2 = (two + m1 * self.single[last2]) / (one[before2] + m1)
        self.empty = list(zip(np.log10(self.single).tolist(), np.where(one > 0, 1 + np.arange(words), 0).tolist(), strict=True))
        # arrays of machine numbers: a unit has nearly as many states as tokens
        self.fail = array("d", np.concatenate([[0.0], np.log10(m1 / (one + m1)), np.log10(m2 / (two + m2))]).tobytes())
        self.shorter = array("q", np.concatenate([np.zeros(1 + words, dtype=np.int64), 1 + last2]).tobytes())
        self.pairs = 1 + words  #: the first state of a pair

    def arcs(self, start: int, end: int) -> tuple[list[float], list[float], list[int]]:
        """For each position: the weight of a word's arc and of a pair's arc there (``NONE``: no arc), and the pair's state that both lead to."""
        grams = self.grams
        _, two, three = grams.counts
        pair, triple = grams.numbers[1][start:end], grams.numbers[2][start:end]
        word_arc, pair_arc = np.full(end - start, self.NONE), np.full(end - start, self.NONE)
        seen = np.flatnonzero((pair >= 0) & (two[pair] > 0)) if len(two) else np.zeros(0, dtype=np.int64)
        word_arc[seen] = np.log10(self.p2[pair[seen]])
        seen = np.flatnonzero((triple >= 0) & (three[triple] > 0)) if len(three) else np.zeros(0, dtype=np.int64)
        history = grams.numbers[1][start + seen - 1]
        m2 = STRENGTH[2]
        pair_arc[seen] = np.log10((three[triple[seen]] + m2 * self.p2[pair[seen]]) / (two[history] + m2))
        return word_arc.tolist(), pair_arc.tolist(), (self.pairs + pair).tolist()

    def traverse(self, start: int, end: int, state: int = 0) -> tuple[float, int]:
        """Log-probability of the words from position ``start`` to ``end`` - 1, read from a state, and the state reached."""
        total, pairs, fail, shorter, empty = 0.0, self.pairs, self.fail, self.shorter, self.empty
        for w, word_arc, pair_arc, target in zip(self.grams.tokens[start:end].tolist(), *self.arcs(start, end), strict=True):
            if state >= pairs:
                if pair_arc <= 0:
                    total += pair_arc
                    state = target
                    continue
                total += fail[state]
                state = shorter[state]
            if state:
                if word_arc <= 0:
                    total += word_arc
                    state = target
                    continue
                total += fail[state]
            p, state = empty[w]
            total += p
        return total, state


def _scorer(total: int, bits: int, kind: pa.DataType):
    """A unit and its answers to (row, id, held_out, n_tokens, n_known, base, score) of its pieces."""

    def work(unit: pa.Table, answers: pa.Table) -> pa.Table:
        (row, ids, held, *own), = _rows(unit, ("row", "id", "held", *_UNIT_GRAMS))
        _, _, _, n, ahead = own
        grams = Grams(*own)
        answers = answers.sort_by("part")  # the parts number the first bits of the hashes
        grams.learn([np.concatenate([unpacked_counts(x) for x in answers[column].to_pylist()]) for column in ("told", "grams")], bits)
        distinct = sum(answers["distinct"].to_pylist())
        automaton = Automaton(grams, total, distinct)
        log = np.log10(grams.counts[0] + 1.0) - log10(total + distinct + 1)
        known, base, score = [], [], []
        ends = [*grams.starts.tolist()[1:], len(grams.tokens)]
        for start, end, before in zip(grams.starts.tolist(), ends, ahead, strict=True):
            own, total_score = start + before, 0.0
            state = automaton.traverse(start, own)[1]
            words = grams.tokens[own:end]
            known.append(int((grams.counts[0][words] > 0).sum()))
            base.append(float(log[words].sum()))
            for at in range(own, end, HELD):
                more, state = automaton.traverse(at, min(end, at + HELD), state)
                total_score += more
            score.append(total_score)
        cells = [pa.array(row, pa.int64()), pa.array(ids, kind), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
        return pa.Table.from_arrays(cells, names=["row", "id", "held_out", "n_tokens", "n_known", "base", "score"])

    return work


def _distinct_words(units: DataFrame) -> int:
    """How many distinct words the training texts have."""

    def learned(batches):
        for batch in batches:
            for own in _rows(batch, _UNIT_GRAMS):
                grams = Grams(*own)
                yield pa.RecordBatch.from_arrays([pa.array(grams.keys[0][grams.counts[0] > 0].view(np.int64))], names=["word"])

    return units.filter("learned > 0").mapInArrow(learned, "word long").distinct().count()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    texts = _fold(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    arrow = to_arrow_type(texts.schema["id"].dataType)
    # in buckets by unit, so that the units stay where they are when their answers come to them
    units = bucketed(texts.mapInArrow(_units(arrow), _unit_layout(kind)), "units", "unit")
    sums = units.agg(F.count("*").alias("units"), F.coalesce(F.sum("learned"), F.lit(0)).alias("learned"), F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("n")).first()
    total = sums["learned"]
    bits = min(64 - KEY, max(0, ceil(log2(max(1, 2 * sums["n"] / PART)))))  # at most the whole hash
    told = _exchanged(units, bits, sums["units"]).withColumnRenamed("words", "told")
    scored = units.drop("learned").groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(
        _scorer(total, bits, arrow), f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    )
    rows = scored.groupBy("row").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return rows.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def lm_scoring(docs: DataFrame) -> DataFrame:
    """The scores of every row of ``documents``."""
    return score(docs).withColumnRenamed("id", "doc_id")
