"""BLEU and ROUGE over whole texts against brute force."""

import random

from corpusloom.operators import evaluate
from corpusloom.plans.evaluation import bleu_rouge


def common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
    return rows[-1][-1]


def test_longest_common_matches_brute_force():
    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 90))] for _ in "xy")
        assert evaluate.longest_common(a, b) == common(a, b)


def f_score(hits, a, b):
    p, r = (hits / a if a else 0.0), (hits / b if b else 0.0)
    return round(100 * 2 * p * r / (p + r + 1e-8), 4)


def test_bleu_rouge_scores_whole_texts(spark, tmp_path):
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    texts = {i: "\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(r.randint(1, 12))) for i in range(12)}
    labels = {i: " ".join(r.choice(words) for _ in range(40)) for i in range(10)}
    labels[3] = texts[3]
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["item_id"]: x for x in bleu_rouge(spark, str(tmp_path)).collect()}
    assert got.keys() == labels.keys()
    for i, label in labels.items():
        hyp, ref = texts[i].split(), label.split()
        grams = [[{tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for x in (hyp, ref)] for n in (1, 2)]
        want = [f_score(len(a & b), len(a), len(b)) for a, b in grams]
        assert [got[i]["rouge_1"], got[i]["rouge_2"], got[i]["rouge_l"]] == [*want, f_score(common(hyp, ref), len(hyp), len(ref))]
        assert got[i]["bleu_4"] == evaluate.bleu4(texts[i], label)
    assert got[3]["bleu_4"] == 100.0 and got[3]["rouge_l"] == 100.0
