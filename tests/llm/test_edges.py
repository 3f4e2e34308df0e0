"""Letters that change class when lower-cased, long runs of one kind of character, columns named like a stage's own."""

import random
import re
import time

import corpus_pipeline
from leafspan.llm import packing, personal
from leafspan.llm.tokens import WordBpe


def test_words_whose_lower_case_is_no_letter():
    from tokenizers import Tokenizer

    path = packing.public_vocabulary()
    whole, coder, draw = Tokenizer.from_file(path), WordBpe(path), random.Random(6)
    texts = ["ALİ. İ, İ. .İ ALİ,x İSTANBUL. Ali", "İ", "İ.İ."] + ["".join(draw.choice("İIıiAß. ,Éé̇") for _ in range(draw.randint(1, 12))) for _ in range(3_000)]
    for text, ids in zip(texts, coder.encode([t.encode() for t in texts])):
        assert ids == WordBpe._pack(whole.encode(text, add_special_tokens=False).ids), text


def test_base_spans_are_those_of_the_plain_patterns():
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choice("ab1.2@-%_+ 3(é") for _ in range(draw.randint(0, 30)))
        got = personal.base_spans(text)
        assert got["email"] == [m.span() for m in personal.EMAIL.finditer(text)]
        assert got["ip"] == [m.span() for m in personal.IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]


def test_long_runs_take_linear_time():
    began = time.time()
    for unit in ("1", "a", "@", "1.", "1 ", "+1", "a@b.c_", "a@a-"):
        text = unit * (1_000_000 // len(unit))
        for run in (text, text + "@", text + "@b.cd"):
            found = personal.base_spans(run)
        if unit == "a":
            assert found["email"] == [(0, len(run))]
    assert time.time() - began < 60


def test_language_stage_keeps_clashing_columns(spark):
    words = {"en": "the cat sat on the mat and then it ran", "de": "der hund lief über die straße und dann heim"}
    rows = [(i, words[lang] + f" {i}", lang, i * 2.0, None, "x", True) for i in range(60) for lang in ("en", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, rejected boolean, lang_pred string, column_0 boolean")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() > 100
    r = kept.first()
    assert r["score"] == 2.0 * r["doc_id"] and r["rejected"] is None and r["lang_pred"] == "x" and re.search(r"cat|hund", r["text"])
