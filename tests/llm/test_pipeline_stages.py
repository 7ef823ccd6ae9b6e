"""The pipeline's stages on null, empty, tied and repeated rows, very long texts, clashing columns and an empty table."""

import random

import corpus_pipeline
import pytest
from corpusloom.llm import quality

PROSE = "The river was low that summer, and the men who worked on it talked of little else but rain. "
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, `__row` string, `__kept` string, `__w` int, row int, id int"


def rows():
    def own(k):
        r = random.Random(k)
        words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(96)]
        return f"Word{k}x0 {' '.join(words)}."

    found = [(i, own(i), "en") for i in range(30)] + [(100 + i, PROSE * 20 + own(300 + i), "en") for i in range(3)]
    found += [(None, own(500), "en"), (None, None, None), (7, own(7), "en"), (7, own(600), None), (200, None, "en"), (201, "", "en"), (202, "   \n\n ", "en"), (203, "short", "en"), (204, own(3), "en")]
    found += [(300, "\n".join(own(1000 + k) for k in range(1500)), "en")]
    return [(i, t, lang, "s", 1, "r", "k", 5, 6, 7) for i, t, lang in found]


def test_stages_keep_columns_and_defined_cases(spark):
    docs = spark.createDataFrame(rows(), COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert {tuple(r)[5:] for r in kept} == {("r", "k", 5, 6, 7)}, name
        assert 300 in {r["doc_id"] for r in kept} and set(range(10, 30)) <= {r["doc_id"] for r in kept}, name
        assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), "").count() == 0
    near = corpus_pipeline.simhash_stage(spark, docs, "").collect()
    assert sorted(" ".join(r["text"].split()[:1]) for r in near if r["doc_id"] == 7) == ["Word600x0", "Word7x0"]
    assert 204 not in {r["doc_id"] for r in near} and 3 in {r["doc_id"] for r in near}


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame(rows(), COLUMNS).limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stop", ["。", "！", "।", "۔", "؟", "։", "።", "."])
def test_lines_end_with_the_stops_of_many_scripts(stop):
    assert quality.line_fails(f"कुछ शब्द यहाँ हैं 我们 在 这里{stop}".encode(), 7) is None
    assert quality.line_fails("कुछ शब्द यहाँ हैं 我们 在 这里".encode(), 7) == "punctuation"
