import math
import random
import re
from collections import Counter

from leafspan.functions import text as T
from leafspan.operators import lexical
from pyspark.sql import functions as F


def test_search_in_blocks_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 7)
    monkeypatch.setattr(lexical, "BLOCK_QUESTIONS", 3)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(40)]
    docs += [(40 + i, docs[i][1]) for i in range(10)] + [(50, None)]
    asked = [(f"q{i}", " ".join(rng.choices(vocabulary + ["unseen"], k=rng.randint(0, 5)))) for i in range(8)]
    found = lexical.search(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(asked, "q string, t string"), "d", "t", "q", "t", 6)

    held = {d: Counter((t or "").split()) for d, t in docs}
    average = sum(sum(c.values()) for c in held.values() if c is not None) / (len(docs) - 1)
    df = Counter(w for c in held.values() for w in c)
    expected = set()
    for q, t in asked:
        scores = []
        for d, c in held.items():
            parts = [
                n * math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / average))
                for w, n in Counter(t.split()).items() if c[w]
            ]
            scores.append((-round(sum(parts), 9), d))
        expected |= {(q, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:6], 1)}
    got = {(r.q, r.rank, r.d, round(r.score, 8)) for r in found.collect()}
    assert got == {(q, rank, d, round(s, 8) + 0.0) for q, rank, d, s in expected}


def test_words_split_on_the_same_characters_as_the_sql(spark):
    characters = [chr(c) for c in [*range(0x3100), 0xFEFF, 0x1F600]]
    df = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(characters)], "i int, t string")
    rows = df.select("i", T.words(F.col("t")).alias("words"), F.split("t", T.WHITESPACE + "+").alias("plain"), T.strip(F.concat(F.substring("t", 2, 1), F.lit("x"))).alias("strip")).collect()
    for row in rows:
        assert row.words == row.plain == f"a{characters[row.i]}b".split()
        assert row.strip == (characters[row.i] + "x").strip()
    assert re.fullmatch(re.escape(T.WHITESPACE), T.BLANK.split("&&")[1][:-1])
