"""Unit vectors for text, table and scoring functions."""

import re

import pytest
from leafspan.functions import scoring, tables
from leafspan.functions import text as T
from leafspan.functions.chunks import chunk_text
from leafspan.functions.lists import best_alignment, list_exact, list_f1, normalise_item
from leafspan.operators import blocks, outline, tree
from pyspark.sql import functions as F


def values(spark, column, rows, schema="a string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_incomplete(spark):
    rows = [
        ("The quick brown fox jumps over the lazy dog and",), ('He said, "This method is the best of them all."',),
        ("We collected many sam-",), ("We collected a great many different sam-",),
        ("The quick brown fox jumps over the lazy dog and.",), ("",), ("It lists the following three items here:",),
    ]
    assert values(spark, T.looks_incomplete(F.col("a")), rows) == [True, False, False, True, True, False, True]


def test_garbage_cut(spark):
    rows = [("The result holds and " + " ".join("t" * 15),), ("All good " * 12,), ("a b c",)]
    assert values(spark, T.cut_garbage_tail(F.col("a")), rows) == ["The result holds", "All good " * 12, "a b c"]


def test_acronym(spark):
    rows = [("LLM is",), ("This is",), ("A test",), ("G20 met",), ("12 x",)]
    assert values(spark, T.first_word_is_acronym(F.col("a")), rows) == [True, False, False, True, False]


def test_scores(spark):
    rows = [
        ("5", "5.0", "Int"), ("5", "6", "Int"), ("x", "5", "Int"), ("12.5", "12.4", "Float"), ("0.5", "50%", "Float"),
        ("12.5", "13", "Float"), ("kitten", "sitten", "Str"), ("2021-03", "2021-04", "Str"), ("abc", "xyz", "Str"),
        ("['a', 'b']", "['b', 'a']", "List"), ("['1', '2']", "['1', '3']", "List"), ("['a']", "['a', 'b']", "List"),
    ]
    got = values(spark, scoring.typed_score(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string")
    assert got == pytest.approx([1, 0, 0, 1, 1, 0, 1 - 1 / 6, 0, 0, 1, 0, 0])


def test_token_f1_counts_repeats(spark):
    rows = [("the cat sat cat", "a cat cat dog"), ("x", "y")]
    got = values(spark, scoring.token_f1(F.col("a"), F.col("b")), rows, "a string, b string")
    assert got == pytest.approx([2 / 3, 0])


def test_judgement_last_key_counts(spark):
    text = "noise\nExtracted results: 12\n score : 1\nscore: 0.5"
    got = values(spark, F.to_json(scoring.parse_judgement(F.col("a"))), [(text,)])
    assert got == ['{"extracted_results":"12","format":"Failed to extract","score":"0.5"}']


def test_lists(spark):
    assert normalise_item("The Twenty-five, Apples") == "20.0 5.0 apples"
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for shape in ((3, 4), (4, 2), (1, 1), (5, 5)):
        m = rng.random(shape)
        wide = m if shape[0] <= shape[1] else m.T
        best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert best_alignment(m) == pytest.approx(best)
    df = spark.createDataFrame([(["red car", "3"], ["three", "a red bus"])], "a array<string>, b array<string>")
    assert df.select(list_f1("a", "b").alias("x")).first().x == 0.75
    rows = [(["a"], []), ([], ["a"]), ([], []), (None, ["a"]), (["a"], None)]
    odd = spark.createDataFrame(rows, "a array<string>, b array<string>").select(list_f1("a", "b").alias("x"), list_exact("a", "b").alias("y"))
    assert [str(r.x) for r in odd.collect()] == ["0.0", "0.0", "0.0", "None", "None"]


def test_chunks_rejoin_and_respect_limit():
    import random

    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["ab ", "c. ", "d! ", "longword ", "e? "]) for _ in range(rng.randint(0, 60)))
        for limit in (1, 3, 7):
            found = chunk_text(text, limit)
            assert " ".join(found).split() == text.split()
            assert all(len(c.split()) <= limit for c in found)
    assert chunk_text("A b. C d e. F.", 3) == ["A b.", "C d e.", "F."]
    assert chunk_text("a b c d e. f.", 2) == ["a b", "c d", "e.", "f."]
    assert chunk_text("abcdef", 2, len) == ["ab", "cd", "ef"]


HTML = (
    '<table><tr><th colspan="2">Site</th><th>n</th></tr><tr><td rowspan="2">A</td><td>x</td><td>1</td></tr>'
    "<tr><td>y</td><td>(2%)</td></tr></table>"
)


def test_table(spark):
    df = spark.createDataFrame([(HTML,)], "h string").withColumn("g", tables.grid("h"))
    row = df.select(
        "g", tables.header_rows(F.col("g")).alias("n"), tables.headers(F.col("g"), F.lit(1)).alias("heads"),
        tables.column_count(F.col("h")).alias("c"), tables.is_numeric_cell(F.lit("(1,200)%")).alias("num"),
        tables.linearised(F.lit("Cap"), F.col("g"), F.lit("")).alias("line"),
    ).first()
    assert row.g == [["Site", "Site", "n"], ["A", "x", "1"], ["A", "y", "(2%)"]]
    assert (row.n, row.heads, row.c, row.num) == (1, ["Site", "n"], 3, True)
    assert row.line.startswith("Table Caption: Cap\nType: Text-heavy table") and "Row 1: 'Site' is 'A'; 'Site' is 'x'; 'n' is '1';" in row.line


@pytest.mark.parametrize("rows", [None, 2])
def test_mini_document(spark, rows):
    long_ = "We collected a great many different sam-"
    lines = [
        ("text", "Dropped preface before any title.", None, 0), ("text", "Tiny Report", 0, 0), ("text", "Methods", 1, 0),
        ("text", long_, None, 0), ("text", "ples from three different sites in the north.", None, 1), ("equation", "a = b + c", None, 1),
        ("table", None, None, 1), ("table", None, None, 2), ("text", "Results", 1, 2), ("text", "The result holds.", None, 2), ("image", None, None, 3),
    ]
    data = [
        ("d", i, t, x, lv, pg, ["Figure 1"] if t == "image" else (["Table 1"] if i == 7 else []), [], 2 if t == "table" else None, "p.png", "<table></table>", False)
        for i, (t, x, lv, pg) in enumerate(lines, 1)
    ]
    df = spark.createDataFrame(
        data,
        "doc_id string, pos int, type string, text string, text_level int, page_idx int, caption array<string>, footnote array<string>, "
        "n_columns int, img_path string, table_body string, invalid boolean",
    )
    made = blocks.renumber(blocks.repair_text(df), rows)
    pairs = blocks.continuation_candidates(made, rows=rows)
    assert sorted((r.pdf_id, r.candidate_id) for r in pairs.collect()) == [(4, 5), (4, 6)]
    assert [(r.pdf_id, r.previous_id) for r in blocks.previous_table(made, rows=rows).collect()] == [(8, 7)]
    stitched = blocks.stitch(made, pairs)
    text = {r.pdf_id: (r.text, r.invalid) for r in stitched.collect()}
    assert text[4] == ("We collected a great many different samples from three different sites in the north. a = b + c", False)
    assert text[5][1] and not text[6][1]
    final = blocks.renumber(stitched, rows)
    entries = outline.repair(outline.parents_by_level(outline.titles(final), rows)).select("doc_id", "pdf_id", "text_level", "parent_id")
    nodes = tree.build(outline.assign_blocks(final, entries, rows), entries, rows).cache()
    got = {r.content: (r.depth, r.parent_id) for r in nodes.collect()}
    assert "Dropped preface before any title." not in got
    assert got["Tiny Report"] == (1, 0) and got["Methods"] == (2, 1) and got["a = b + c"] == (3, 2) and got["Figure 1"][0] == 3
    pages = tree.structural_filter(nodes, [tree.StructuralFilter("page", "2-3")])
    assert {r.page_idx for r in pages.collect()} == {1, 2}
    under = tree.structural_filter(nodes, [tree.StructuralFilter("section", "METHODS")])
    assert {r.content for r in under.collect()} >= {"Methods", "a = b + c"} and "Results" not in {r.content for r in under.collect()}
    assert tree.structural_filter(nodes, [tree.StructuralFilter("page", "x"), tree.StructuralFilter("section")]).count() == nodes.count()


def test_root_paths_with_cycle_and_orphan(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (5, None), (6, 7), (7, 6), (8, 99)], "id long, parent long")
    got = {r.id: (r.path, r.orphan) for r in tree.root_paths(df, [], "id", "parent").collect()}
    assert got[4] == ([1, 2, 3, 4], False) and got[5] == ([5], True) and got[6] == ([7, 6], True) and got[8][1]


def test_chat_memory(spark):
    from leafspan.functions import records

    told = "array(named_struct('role','u','content','hi'), named_struct('role','a','content','the answer'))"
    df = spark.sql(f"SELECT {told} AS m, named_struct('role','u','content','hi') AS old, named_struct('role','u','content','new') AS fresh")
    row = df.select(
        F.size(records.remember(F.col("m"), F.col("old"))).alias("same"), F.size(records.remember(F.col("m"), F.col("fresh"))).alias("more"),
        records.recall(F.col("m"), F.lit("the")).alias("hits"), records.recent(F.col("m"), 1).alias("last"),
        F.size(records.unseen(F.col("m"), F.array("old", "fresh"))).alias("news"),
        F.size(records.unseen(F.col("m"), F.array("old", "fresh"), 1)).alias("news_of_last"),
    ).first()
    assert (row.same, row.more, row.news, row.news_of_last) == (2, 3, 1, 2)
    assert [m.content for m in row.hits] == ["the answer"] == [m.content for m in row["last"]]


def test_records(spark):
    from leafspan.functions import records

    reply = '("entity"<|>Spark &amp; Co<|>Org<|>An engine)##junk##("relationship"<|>a<|>b<|>uses<|>7)##("relationship"<|>a<|>c<|>uses<|>much)##("entity"<|>!!<|>T<|>d)<|COMPLETE|>'
    rows = records.parse_records(spark.createDataFrame([(1, reply)], "n int, r string"), "r").cache()
    assert [(r.entity_name, r.entity_type, r.description) for r in records.record_entities(rows).collect()] == [("spark   co", "org", "an engine")]
    assert [(r.src_entity_name, r.tgt_entity_name, r.weight) for r in records.record_relations(rows).orderBy("seq").collect()] == [("a", "b", 7.0), ("a", "c", 1.0)]


def test_part_queries_read_a_single_row_group_in_parallel(spark, tmp_path):
    from leafspan import catalog

    rows = "id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, 3 AS p_size, 2.5D AS p_retailprice"
    spark.range(0, 400, 1, 1).selectExpr(*rows.split(", ")).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("table_headers", "table_text", "table_grid", "list_answers"):
        made = catalog.queries()[name](spark, str(tmp_path))
        assert len(made.select(F.spark_partition_id()).distinct().collect()) > 1, name


def test_cut_off_texts_are_found_as_by_the_plain_patterns(spark):
    def plain(text):
        strip = lambda c: F.regexp_replace(c, f"^{T.BLANK}+|{T.BLANK}+$", "")
        body = strip(text)
        unquoted = F.regexp_replace(body, "['\"]+$", "")
        last = F.lower(F.regexp_extract(unquoted, r"(\w+)\W*$", 1))
        told = F.when(body.isNull() | (T.word_count(body) < 5) | (F.length(body) < 25), False).when(body.endswith("-"), True)
        told = told.when(unquoted.rlike("[,:;]$"), True).when(~unquoted.rlike("[.!?]$"), True).when(last.isin(T.CONNECTORS), True)
        return strip(text), told.otherwise(False)

    lead = "one two three four five six seven"
    ends = [" and", " and.", " end.", " end", ":", ";'\"", ".'\"", ",\r\"", ".\r\n'", ".\u2028\"", ".\n\n'", " -", "-", " of \u3000", " and!!! ...", " \u00e9t\u00e9.", "\u3000.", " the).", "_and."]
    texts = [None, "", " ", "\u2003\u3000", "a b c d e", "\u00a0x\u0085", *[pad + lead + end + pad for end in ends for pad in ("", "\t", "\u2028 ")]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    stripped, told = plain(F.col("x"))
    rows = df.select("x", T.strip(F.col("x")).alias("a"), stripped.alias("b"), T.looks_incomplete(F.col("x")).alias("c"), told.alias("d")).collect()
    assert [(r.a, r.c) for r in rows] == [(r.b, r.d) for r in rows] and len({r.c for r in rows}) == 2
    # A long text is passed once: its last word is looked for at the beginnings of words only.
    assert "(?<!" in str(T.looks_incomplete(F.col("x")))


def test_candidates_are_found_once_for_tails_and_merged_blocks(spark):
    found = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(block):
        found.add(1)
        return block

    made = spark.createDataFrame(
        [(1, 1, "text", "the start-", False), (1, 2, "text", "goes on", False), (1, 3, "equation", "a = b", False), (1, 4, "text", "Alone", False)],
        "doc_id int, pdf_id int, type string, text string, invalid boolean",
    )
    accepted = spark.createDataFrame([(1, 1, 2), (1, 1, 3)], "doc_id int, pdf_id int, candidate_id int")
    rows = blocks.stitch(made, accepted.withColumn("pdf_id", counted("pdf_id"))).orderBy("pdf_id").collect()
    assert [(r.text, r.invalid) for r in rows] == [("the startgoes on a = b", False), ("goes on", True), ("a = b", False), ("Alone", False)]
    assert found.value == 2
