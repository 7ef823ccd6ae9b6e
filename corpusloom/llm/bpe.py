"""Byte-level BPE encoding and decoding.

Method: the symbols of a word form a doubly linked list; a priority queue holds merge ranks; entries whose symbols have
changed meanwhile are stale and skipped. Decoding concatenates the vocabulary's strings and reads the bytes as UTF-8.

Defined cases: a null text is empty and has no ids; the added token's string in a text becomes its id, as in the library;
very long words cost n log n; of pairs of one rank the leftmost merges first, as in the library; repeated rows get equal results; an empty table gives an empty one. Only the id and text columns
are read, so other columns can have any name.
"""

from __future__ import annotations

import heapq
import json
from array import array
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, pieces_of

#: Fixed value: how this vocabulary splits a text into words; white space is Unicode's White_Space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words and runs between spaces that a worker remembers.
CACHE_WORDS, CACHE_RUNS, RUN_CHARS = 400_000, 300_000, 48


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else one from 256 on, in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(printable))
    return letters


class BytePairCoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.byte_ids = [vocab.get(letters[b]) for b in range(256)]
        self.strings: dict[int, bytes] = {}
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = bytes(map(back.__getitem__, token)) if all(c in back for c in token) else token.encode()
        #: pair -> rank, and what a rank joins
        self.ranks: dict[int, int] = {}
        self.joins: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.joins.append((vocab[left], vocab[right], vocab[left + right]))
        self.find = regex.compile(SPLIT).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.unsafe = regex.compile(r"\p{White_Space} | \p{White_Space}").search
        self.safe_split = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})").split
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: merges in order of rank, leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        n, rank_of, joins, push, pop = len(ids), self.ranks.get, self.joins, heapq.heappush, heapq.heappop
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # an entry is rank and place in one integer; the rank tells which two symbols it was made for
        queue = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank_of(a << 32 | b)) is not None]  # noqa: B905
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            left, right, joined = joins[entry >> 32]
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two has been merged meanwhile
            ids[i], ids[j] = joined, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(joined << 32 | ids[k])) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] << 32 | joined)) is not None:
                push(queue, r << 32 | h)
        return [i for i in ids if i >= 0]

    def _run(self, run: str) -> bytes:
        """Ids, packed, of a stretch that begins and ends where words do."""
        out, words = [], self.words
        core = run[1:] if run[:1] == " " else run
        if core.isalpha():
            found = (run,)
        elif core[:-1].isalpha() and core[-1] in ".,":
            found = (run[:-1], run[-1])
        else:
            found = self.find(run)
        for word in found:
            ids = words.get(word)
            if ids is None:
                ids = array("I", self.merge(word.encode())).tobytes()
                if len(word) <= RUN_CHARS:
                    if len(words) >= CACHE_WORDS:
                        words.clear()
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> list[bytes]:
        parts = self.safe_split(text) if self.unsafe(text) else text.split(" ")
        runs = self.runs  # by the run without the space before it
        if len(runs) >= CACHE_RUNS:
            runs.clear()
        out = list(map(runs.get, parts))
        out[0] = self._run(parts[0])
        for k in [k for k, ids in enumerate(out) if ids is None]:
            out[k] = ids = self._run(" " + parts[k])
            if len(parts[k]) <= RUN_CHARS:
                runs[parts[k]] = ids
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return b"".join(self._plain(text))
        out: list[bytes] = []
        for part in self.specials.split(text):
            out += [self.special[part].to_bytes(4, "little")] if part in self.special else self._plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of packed ids, in UTF-8; bytes that are none become U+FFFD."""
        raw = b"".join(map(self.strings.__getitem__, array("I", ids)))
        return raw.decode("utf-8", "replace").encode()


_CODERS: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    if path not in _CODERS:
        _CODERS[path] = BytePairCoder(path)
    return _CODERS[path]


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (packed binary, little-endian unsigned 32-bit) of every row."""

    def run(batches):
        c = coder(tokenizer_path)
        for whole in batches:
            for batch in pieces_of(whole):
                ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.binary())], names=["id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def decoded(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """id, text of rows (id, ids) as ``encoded`` returns them; null ids give an empty text."""

    def run(batches):
        c = coder(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or b"") for x in as_bytes(batch.column(1))], type=pa.binary()).cast(pa.string())], names=["id", "text"])

    return rows.select("id", "ids").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass."""

    def run(batches):
        c = coder(tokenizer_path)
        for whole in batches:
            for batch in pieces_of(whole):
                ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(x) // 4 for x in ids], type=pa.int64()),
                        pa.array([sha256(x).hexdigest() for x in ids]), pa.array([sha256(c.decode(x)).hexdigest() for x in ids]),
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(docs.dtypes)[id_col]
    layout = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, layout)


def bpe_encoding(docs: DataFrame) -> DataFrame:
    """The digest of ids and decoded text of every row of ``documents``, with the public byte-level BPE."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
