"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

Defined cases: a null text has no words (rejected by the base rule); lines without a word are kept and never judged; white
space is ASCII (space and 9 to 13), lines end at ``\\n`` only. Ties and repeated rows get equal results, an empty table an
empty one. Whole texts are read; of very long ones the word windows are counted with integer arrays. Other columns of the
input pass through ``clean`` untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, pieces_of

WS = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules (in words of the line) and of the documents."""

    bars_per_word: float = 0.25  #: navigation: so many ``|`` a word, and at least two
    symbols_per_word: float = 0.5  #: so many of ``#*$%&<>`` a word
    boilerplate_words: int = 20  #: a line with a boilerplate phrase fails if it has no more words than this
    min_shout: int = 2  #: a line of at least so many words fails if it has more capitals A-Z than small letters a-z
    max_lost: int = 40  #: per cent of the words' characters that may go


#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in to", "lorem ipsum",
    "privacy policy", "read more", "share this", "sign up", "skip to content", "subscribe to", "terms of use",
)
#: What a line of running text ends with: stops, closing marks, and the stops of Chinese, Japanese, Hindi, Urdu, Arabic, Armenian and Amharic.
TERMINAL = tuple(x.encode() for x in ".!?:;…\"')]”’»。！？：；」』）｡।॥۔؟؛։።")
_PHRASES = re.compile("|".join(BOILERPLATE).encode())
_NOT = {name: bytes(set(range(256)) - set(keep)) for name, keep in {"sym": b"#*$%&<>", "up": bytes(range(65, 91)), "low": bytes(range(97, 123))}.items()}
_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_LONG = 50_000


def line_fails(line: bytes, n_words: int, rules: Rules = Rules()) -> str | None:
    """The rule that a line (with a word in it) breaks, or None."""
    bars = line.count(b"|")
    if bars >= 2 and bars >= rules.bars_per_word * n_words:
        return "navigation"
    if len(line.translate(None, _NOT["sym"])) >= rules.symbols_per_word * n_words:
        return "symbols"
    if n_words >= rules.min_shout and len(line.translate(None, _NOT["up"])) > len(line.translate(None, _NOT["low"])):
        return "shouting"
    if n_words <= rules.boilerplate_words and _PHRASES.search(line.lower()):
        return "boilerplate"
    if not line.rstrip(WS).endswith(TERMINAL):
        return "punctuation"
    return None


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    if n > _LONG:
        code: dict[bytes, int] = {}
        ids = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=n)
        pair = np.unique(ids[:-1] * len(code) + ids[1:], return_inverse=True)[1]
        _, inverse, counts = np.unique(pair[:-1] * len(code) + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
    else:
        windows = list(zip(words, words[1:], words[2:]))  # noqa: B905  the shortest ends it
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        twice = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _points(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def judge(text: bytes | None, rules: Rules = Rules()) -> tuple[dict, bytes]:
    """The measures of a text, and the text without its failing lines."""
    text = text or b""
    words = text.split()
    lost = dup = failed = 0
    seen: set[bytes] = set()
    kept = []
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            if line_fails(line, len(own), rules):
                failed += 1
                lost += _points(b"".join(own))
                continue
        kept.append(line)
    chars = _points(b"".join(words))
    n, again = len(words), repeat_words(words)
    base = n < 50 or 100 * again > 50 * n
    m = {
        "n_words": n, "word_chars": chars, "n_symbols": len(text.translate(None, _SYMBOLS)), "n_dup_lines": dup, "n_repeat_words": again,
        "base_failed": base, "kept": not base and 100 * lost <= rules.max_lost * chars, "n_failed_lines": failed, "lost_chars": lost,
    }
    return m, b"\n".join(kept)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, lost_chars long"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_()}
_FIELDS = [(x.split()[0], _TYPES[x.split()[1]]) for x in MEASURES.split(", ")]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """id and the measures of every row, with the verdict in ``kept``."""

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                rows = [judge(t, rules)[0] for t in as_bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f] for r in rows], type=t) for f, t in _FIELDS)], names=["id", *(f for f, _ in _FIELDS)])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {MEASURES}")


def clean(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows that are kept, with failing lines taken out of their text; every other column as it was."""
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, at):
                found = [judge(t, rules) for t in as_bytes(batch.column(at))]
                keep = pa.array([m["kept"] for m, _ in found], type=pa.bool_())
                text = pa.array([t for _, t in found], type=pa.binary()).cast(batch.column(at).type)
                columns = [text if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures and the verdict of every row of ``documents``."""
    return measured(docs).withColumnRenamed("id", "doc_id")
