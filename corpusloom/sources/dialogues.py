"""Dialogue texts taken apart from the right: the last mark first.

A dialogue is one text in which a mark stands before each question and another before each answer. Well-formed or not, it is read
from its end: what lies behind the last question mark and before the last answer mark is a question; the text before that question
mark is what is left. A mark that is not there counts as standing one place before the text's start, and a cut that ends there
leaves off the last character, as slices with -1 do; published datasets were read that way, so malformed rows come out alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    """What stands before a question and before an answer; whether what is left is stripped at each step."""

    question: str
    answer: str
    strip: bool


#: The marks of two published datasets.
BELLE = Marks("Human:", "Assistant:", True)
HH = Marks("\n\nHuman: ", "\n\nAssistant: ", False)


class Scanner:
    """A text whose end moves to the left."""

    def __init__(self, text: str, marks: Marks):
        self.text, self.marks = text.strip() if marks.strip else text, marks
        self.asked, self.answered = self._places()

    def _places(self) -> tuple[int, int]:
        return self.text.rfind(self.marks.question), self.text.rfind(self.marks.answer)

    def question(self) -> str:
        return self.text[self.asked + len(self.marks.question) : self.answered].strip()

    def answer(self) -> str:
        return self.text[self.answered + len(self.marks.answer) :].strip()

    def back(self) -> None:
        """To the text before the last question."""
        left = self.text[: self.asked]
        self.text = left.strip() if self.marks.strip else left
        self.asked, self.answered = self._places()

    def earlier(self) -> Iterator[tuple[str, str]]:
        """(question, answer) of the rounds before the last question, last first; ends where either mark is missing."""
        self.back()
        while self.answered >= 0 and self.asked >= 0:
            yield self.question(), self.answer()
            self.back()


def rounds(text: str, marks: Marks) -> tuple[str, str, list[list[str]]]:
    """(the last question, the last answer, the rounds before it in order)."""
    scan = Scanner(text, marks)
    question, answer = scan.question(), scan.answer()
    return question, answer, list(scan.earlier())[::-1]


def parsed(text: Column, marks: Marks) -> Column:
    """struct<question, answer, history>: the dialogue of each text; of a null text a null."""

    @F.pandas_udf("question string, answer string, history array<array<string>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [rounds(t or "", marks) for t in texts]
        return pd.DataFrame({"question": [q for q, _, _ in rows], "answer": [a for _, a, _ in rows], "history": [[list(r) for r in h] for _, _, h in rows]})

    return F.when(text.isNotNull(), scan(text))
