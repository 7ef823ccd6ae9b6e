"""Word segmentation of text without spaces: the likeliest path through the graph of dictionary words.

The dictionary is a prefix tree. From each place of a sentence its words lead on, which makes a graph without cycles; dynamic
programming from the right gives each place the best way to the end. A character that begins no word stands alone, with the
weight of a word seen once. Of equal paths the one with the longer first word is taken. Letters and digits that stand alone side
by side are one word; white space and other characters are words of their own.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from math import log

from pyspark.sql import SparkSession

#: Fixed value: what may take part in dictionary words.
BLOCK = re.compile(r"([一-鿕a-zA-Z0-9+#&._%\-]+)")
_PLAIN = re.compile(r"[a-zA-Z0-9]")


class Segmenter:
    """Callable: a text as its words, joined by spaces. The tree is built where it is used; only the dictionary travels."""

    def __init__(self, words: Mapping[str, float]):
        if any(not w or n <= 0 for w, n in words.items()):
            raise ValueError("words need a letter and a positive frequency")
        self.words = dict(words)
        self._tree: dict | None = None

    def __getstate__(self) -> dict:
        return {"words": self.words, "_tree": None}

    @property
    def tree(self) -> dict:
        if self._tree is None:
            total = sum(self.words.values()) or 1.0
            self.alone = -log(total)
            self._tree = {}
            for word, n in self.words.items():
                node = self._tree
                for c in word:
                    node = node.setdefault(c, {})
                node[None] = log(n) - log(total)
        return self._tree

    def path(self, block: str) -> list[str]:
        """The likeliest words of a block."""
        tree, n = self.tree, len(block)
        best, end = [0.0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i], end[i] = self.alone + best[i + 1], i + 1
            node = tree
            for j in range(i, n):
                node = node.get(block[j])
                if node is None:
                    break
                weight = node.get(None)
                # the first character's own weight replaces that of an unknown one
                if weight is not None and (weight + best[j + 1] >= best[i] or j == i):
                    best[i], end[i] = weight + best[j + 1], j + 1
        out, i = [], 0
        while i < n:
            word = block[i : end[i]]
            if out and len(word) == 1 and _PLAIN.match(word) and merged:
                out[-1] += word
            else:
                out.append(word)
            merged = len(word) == 1 and bool(_PLAIN.match(word))
            i = end[i]
        return out

    def cut(self, text: str) -> list[str]:
        """All words of a text; together they are the text."""
        out: list[str] = []
        for k, part in enumerate(BLOCK.split(text)):
            out += self.path(part) if k % 2 else list(part)
        return out

    def __call__(self, text: str) -> str:
        return " ".join(self.cut(text))


def dictionary(spark: SparkSession, path: str) -> Segmenter:
    """The segmenter of a dictionary file: a word, its frequency and perhaps a tag on each line. A dictionary is of bounded size."""
    lines = spark.read.text(path).selectExpr("split(trim(value), ' ') as p").filter("size(p) > 1").selectExpr("p[0] as word", "cast(p[1] as double) as n")
    return Segmenter({r["word"]: r["n"] for r in lines.collect()})
