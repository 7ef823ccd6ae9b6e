"""The unigram tokenizer against the public library, and inside encodings."""

import itertools
import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from corpusloom.config import DataArgs, DatasetSpec, RunSpec
from corpusloom.functions import unigram
from corpusloom.functions.tokens import of_each, tokenizer
from corpusloom.operators import encode, prepare
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "a  b", "▁x", "line\nline\n\n", "我们 \U0001f600\U0001f601", "<s> <unk> </s> <0x41>", "éé", "tab\there", "nul\0", "x" * 5000, " 　"]


def vocabulary():
    m = SentencePieceProcessor(model_file=PATH)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size())]


def library(pieces, byte_fallback):
    t = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    t.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Metaspace()] if byte_fallback else [decoders.Metaspace()])
    return t


def test_ids_and_texts_equal_the_library(spark):
    t, tok = library(vocabulary(), True), unigram.of_pieces(PATH)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + ODD
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(-1, None)], "i long, text string").withColumn("ids", tok(F.col("text")))
    got = {r["i"]: (r["ids"], r["back"]) for r in df.withColumn("back", tok.decode(F.col("ids"))).collect()}
    assert got.pop(-1) == (None, None)
    for i, e in enumerate(t.encode_batch_fast(texts, add_special_tokens=False)):
        assert got[i] == (e.ids, t.decode(e.ids, skip_special_tokens=False)), texts[i][:80]


def test_unknown_characters_and_ties():
    r = random.Random(3)
    letters = "abcd▁"
    pool = ["".join(p) for n in (1, 2, 3) for p in itertools.product(letters, repeat=n)]
    for _ in range(60):
        pieces = [("<unk>", 0.0)] + [(p, float(-r.randint(1, 4))) for p in r.sample(pool, 25)]
        own, t = unigram.Unigram(pieces), library(pieces, False)
        for _ in range(40):
            text = "".join(r.choice("abcd zq") for _ in range(r.randint(0, 14)))
            assert own.encode(text) == t.encode(text).ids, (pieces, text)


def best_by_trial(word, pieces):
    """The highest sum over all ways to cut a word into known pieces."""
    score = dict(pieces)
    cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(word)), n) for n in range(len(word)))
    sums = []
    for c in cuts:
        parts = [word[a:b] for a, b in zip((0, *c), (*c, len(word)), strict=True)]
        if all(p in score for p in parts):
            sums.append(sum(score[p] for p in parts))
    return max(sums)


def test_segments_are_the_likeliest():
    r = random.Random(5)
    for _ in range(50):
        pieces = [(c, -5.0 - r.random()) for c in "abc"] + [("".join(r.choice("abc") for _ in range(r.randint(2, 4))), -9 * r.random()) for _ in range(12)]
        pieces = list(dict(pieces).items())
        word = "".join(r.choice("abc") for _ in range(9))
        parts = unigram.Unigram(pieces).segments(word)
        assert "".join(parts) == word and sum(dict(pieces)[p] for p in parts) == pytest.approx(best_by_trial(word, pieces))


def test_encodings_take_it_by_name(spark):
    pieces = [("<unk>", 0.0), *((c, -8.0) for c in "abcdefghijklmnopqrstuvwxyz▁:"), ("▁so", -3.0), ("Human", -2.0), ("Assistant", -2.0)]
    model = unigram.register_unigram("letters", unigram.of_json(json.dumps({"model": {"type": "Unigram", "unk_id": 0, "vocab": pieces}})))
    assert tokenizer("letters") is model
    with pytest.raises(ValueError, match="Unigram"):
        unigram.of_json('{"model": {"type": "BPE"}}')
    rows = spark.createDataFrame([(0, "ask this", "so it is"), (1, "and that", "so")], "row_idx long, instruction string, output string")
    spec = DatasetSpec("t", columns={"prompt": "instruction", "response": "output"})
    own = unigram.Unigram(pieces)
    for extras in (encode.Extras(tools=False), encode.Extras()):
        out = prepare.prepare(spark, RunSpec(tokenizer="letters", eos=""), DataArgs(datasets=("t",)), tables={"t": (spec, rows)}, extras=extras).train.orderBy("row_idx").collect()
        assert [r["input_ids"] for r in out] == [own.encode("Human: ask this\nAssistant:") + own.encode("so it is\n"), own.encode("Human: and that\nAssistant:") + own.encode("so\n")]
    rm = rows.select("row_idx", "instruction", F.col("output").alias("good"), F.lit("no").alias("bad"))
    ranked = DatasetSpec("r", ranking=True, columns={"prompt": "instruction", "chosen": "good", "rejected": "bad"})
    pair = prepare.prepare(spark, RunSpec("rm", tokenizer="letters", eos=""), DataArgs(datasets=("r",)), tables={"r": (ranked, rm)}).train.orderBy("row_idx").first()
    assert pair["rejected_input_ids"] == own.encode("Human: ask this\nAssistant:") + own.encode("no\n")
    arrays = spark.createDataFrame([(["so", None],), (None,)], "t array<string>")
    assert [r[0] for r in arrays.select(of_each(model, F.col("t"))).collect()] == [[own.encode("so"), None], None]


def test_batches_are_packed_and_long_words_are_not_remembered():
    own = unigram.Unigram([("<unk>", 0.0), ("a", -1.0), ("ab", -1.5), ("▁", -2.0)])
    texts = ["a ab", None, "", "ab" * 5000, *["ab a"] * 200]
    ids = unigram.ids_of(pa.array(texts), own.encode)
    assert ids.type == pa.list_(pa.int32()) and ids.to_pylist() == [None if t is None else own.encode(t) for t in texts]
    assert unigram.texts_of(ids, own.decode).to_pylist() == texts
    assert unigram.ids_of(pa.array([], type=pa.string()), own.encode).to_pylist() == [] and len(unigram.texts_of(ids[:0], own.decode)) == 0
    assert own.cache and max(map(len, own.cache)) <= unigram.CACHE_LENGTH
