"""Unigram tokenizer: the likeliest segmentation of each word under a vocabulary of scored pieces.

The pieces form a trie; the pieces that match at each place of a word span a lattice, and one Viterbi pass from left to right
keeps, for each place, the best way to reach it. A word that holds a character no piece covers takes an unknown symbol there, or
the character's bytes where the vocabulary has them. Words are what stands between spaces, and a worker remembers their ids, so
a text costs a look-up per word.

Texts become ids in Arrow batches, a few rows at a time, and the ids of a batch are packed numbers; a null text is a null. Ties go to the piece that begins first, as in the public library.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.tokens import register_tokenizer

#: How a space is written inside pieces, how far an unknown character lies below the worst piece, words remembered, their length, and rows at a time.
SPACE, UNKNOWN_PENALTY, CACHE_WORDS, CACHE_LENGTH, ROWS = "▁", 10.0, 200_000, 48, 64

Pieces = Sequence[tuple[str, float]]


class Unigram:
    """Ids by Viterbi, and back."""

    def __init__(self, pieces: Pieces, unknown: int = 0, byte_fallback: bool = False):
        self.pieces = [p for p, _ in pieces]
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.unknown = unknown
        self.floor = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.trie: dict = {}
        for piece, score in pieces:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            if piece:
                node[None] = score
        named = [f"<0x{b:02X}>" for b in range(256)]
        self.bytes = [self.ids.get(n) for n in named] if byte_fallback else None
        self.of_byte = {self.ids[n]: b for b, n in enumerate(named) if n in self.ids} if byte_fallback else {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def segments(self, word: str) -> list[str]:
        """The likeliest pieces; neighbouring unknown characters are one."""
        n = len(word)
        best, begin, known = [0.0] + [None] * n, [0] * (n + 1), [True] * (n + 1)
        for i in range(n):
            here, node, single = best[i], self.trie, False
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                score = node.get(None)
                if score is not None:
                    reached = score + here
                    if best[j + 1] is None or reached > best[j + 1]:
                        best[j + 1], begin[j + 1], known[j + 1] = reached, i, True
                    single = single or j == i
            if not single:
                reached = self.floor + here
                if best[i + 1] is None or reached > best[i + 1]:
                    best[i + 1], begin[i + 1], known[i + 1] = reached, i, False
        out, end, strange = [], n, -1
        while end > 0:
            start = begin[end]
            if known[end]:
                out.append(word[start:end])
                strange = -1
            elif strange == end:  # it goes on to the left of an unknown piece
                out[-1] = word[start:end] + out[-1]
                strange = start
            else:
                out.append(word[start:end])
                strange = start
            end = start
        return out[::-1]

    def _word(self, word: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.segments(word):
            own = self.ids.get(piece)
            if own is not None:
                out.append(own)
                continue
            spelled = [self.bytes[b] for b in piece.encode()] if self.bytes else [None]
            out += spelled if None not in spelled else [self.unknown]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        head, *rest = text.split(SPACE)
        words = ([SPACE + head] if head else []) + [SPACE + w for w in rest]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        out: list[int] = []
        for w in words:
            ids = self.cache.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) <= CACHE_LENGTH:
                    self.cache[w] = ids
            out += ids
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids: bytes read as UTF-8 (each that is none as U+FFFD), the first space taken off."""
        out: list[str] = []
        run = bytearray()

        def spelled() -> None:
            if run:
                try:
                    out.append(run.decode())
                except UnicodeDecodeError:
                    out.append("�" * len(run))
                run.clear()

        for k, i in enumerate(ids):
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            spelled()
            piece = self.pieces[i]
            out.append((piece.removeprefix(SPACE) if k == 0 else piece).replace(SPACE, " "))
        spelled()
        return "".join(out)


def _rows(column: pa.Array) -> Iterator[list]:
    return (column.slice(i, ROWS).to_pylist() for i in range(0, len(column), ROWS))


def ids_of(texts: pa.Array, encode: Callable[[str], list[int]]) -> pa.Array:
    """The ids of each text: what is held of a batch are its numbers, four bytes each."""
    values, ends = array("i"), array("i", [0])
    for rows in _rows(texts):
        for text in rows:
            if text is not None:
                values.extend(encode(text))
            ends.append(len(values))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(values, dtype=np.int32)), mask=texts.is_null())


def texts_of(ids: pa.Array, decode: Callable[[list[int]], str]) -> pa.Array:
    """The text of each list of ids."""
    parts = [pa.array([None if row is None else decode(row) for row in rows], type=pa.string()) for rows in _rows(ids)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=pa.string())


_MODELS: dict[int, Unigram] = {}


class UnigramTokenizer:
    """A tokenizer of columns; the vocabulary travels with the work, so executors need no file."""

    def __init__(self, pieces: Pieces, unknown: int = 0, byte_fallback: bool = False):
        pieces = tuple((str(p), float(s)) for p, s in pieces)
        if not 0 <= unknown < len(pieces):
            raise ValueError("the unknown piece is not in the vocabulary")
        key = hash((pieces, unknown, byte_fallback))

        def model() -> Unigram:
            if key not in _MODELS:
                _MODELS[key] = Unigram(pieces, unknown, byte_fallback)
            return _MODELS[key]

        @F.arrow_udf("array<int>")
        def one(texts: pa.Array) -> pa.Array:
            return ids_of(texts, model().encode)

        @F.arrow_udf("array<array<int>>")
        def many(texts: pa.Array) -> pa.Array:
            sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            return pa.ListArray.from_arrays(ends, ids_of(texts.flatten(), model().encode), mask=texts.is_null())

        @F.arrow_udf("string")
        def back(ids: pa.Array) -> pa.Array:
            return texts_of(ids, model().decode)

        self._one, self._many, self._back = one, many, back

    def __call__(self, text: Column) -> Column:
        return self._one(text)

    def many(self, texts: Column) -> Column:
        """For an array of texts, their ids each."""
        return self._many(texts)

    def decode(self, ids: Column) -> Column:
        return self._back(ids)


def of_json(text: str) -> UnigramTokenizer:
    """The tokenizer of a tokenizer.json whose model is a Unigram one."""
    model = json.loads(text)["model"]
    if model.get("type") != "Unigram":
        raise ValueError(f"a Unigram model is needed, not {model.get('type')}")
    return UnigramTokenizer([tuple(v) for v in model["vocab"]], model.get("unk_id") or 0, model.get("byte_fallback", False))


def of_pieces(path: str) -> UnigramTokenizer:
    """The tokenizer of a sentencepiece file's pieces and scores."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    return UnigramTokenizer([(m.id_to_piece(i), m.get_score(i)) for i in range(n)], m.unk_id(), any(m.is_byte(i) for i in range(n)))


def register_unigram(name: str, model: UnigramTokenizer) -> UnigramTokenizer:
    """Makes the tokenizer one that encodings can name."""
    register_tokenizer(name, model)
    return model
