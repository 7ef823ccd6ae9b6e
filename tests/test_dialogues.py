"""Dialogue texts, well-formed and not; the malformed ones worked by hand."""

import json

import pytest
from corpusloom.sources import catalog
from corpusloom.sources.dialogues import BELLE, HH, rounds

WORKED = [
    ("Human: q1\nAssistant: a1\nHuman: q2\nAssistant:", BELLE, ("q2", "", [("q1", "a1")])),
    # no mark at all: the question begins at place 5 and ends before the last character, the answer at 9
    ("What is the answer", BELLE, ("is the answe", "he answer", [])),
    # no answer mark behind the last question: the last answer mark is the one before it, so the question is empty
    ("Human: one\nAssistant: two\nHuman: three", BELLE, ("", "two\nHuman: three", [("one", "two")])),
    # no question mark: the question is cut from the sixth character to the answer mark
    ("so it was asked Assistant: yes", BELLE, ("was asked", "yes", [])),
    # two answers to a question: the last one counts, the first stays in the question
    ("Human: a\nAssistant: b\nAssistant: c\nHuman: d\nAssistant: ", BELLE, ("d", "", [("a\nAssistant: b", "c")])),
    # an answer before any question ends the history
    ("Assistant: hello\nHuman: x\nAssistant: y\nHuman: z\nAssistant:", BELLE, ("z", "", [("x", "y")])),
    ("", BELLE, ("", "", [])),
    ("Human:Assistant:", BELLE, ("", "", [])),
    ("\n\nHuman: q1\n\nAssistant: a1\n\nHuman: q2\n\nAssistant: last", HH, ("q2", "last", [("q1", "a1")])),
    # the space of the last mark is missing, so the mark before counts
    ("\n\nHuman: q1\n\nAssistant: a1\n\nHuman: q2\n\nAssistant:", HH, ("", "a1\n\nHuman: q2\n\nAssistant:", [("q1", "a1")])),
    ("no marks, 14 in", HH, (", 14 i", "in", [])),
    ("\n\nAssistant: only an answer", HH, ("", "only an answer", [])),
]


@pytest.mark.parametrize(("text", "marks", "want"), WORKED)
def test_worked_dialogues(text, marks, want):
    question, answer, history = rounds(text, marks)
    assert (question, answer, [tuple(h) for h in history]) == want


def test_builders_read_malformed_rows(spark, tmp_path):
    texts = [t for t, m, _ in WORKED if m is BELLE]
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"instruction": t, "output": " out　"}) for t in texts))
    got = [[t["value"] for t in r[0]] for r in catalog.belle_multiturn(spark, str(tmp_path / "b.jsonl")).collect()]
    want = [[x for h in w[2] for x in h] + [w[0], "out"] for _, m, w in WORKED if m is BELLE]
    assert sorted(got) == sorted(want)
    pairs = [t for t, m, _ in WORKED if m is HH]
    (tmp_path / "h.jsonl").write_text("\n".join(json.dumps({"chosen": t, "rejected": t[::-1] + "\n\nAssistant: bad "}) for t in pairs))
    rows = catalog.hh_rlhf(spark, str(tmp_path / "h.jsonl")).collect()
    assert sorted((r["instruction"], r["chosen"], [tuple(h) for h in r["history"]]) for r in rows) == sorted(w for _, m, w in WORKED if m is HH)
    assert {r["rejected"] for r in rows} == {"bad"}
