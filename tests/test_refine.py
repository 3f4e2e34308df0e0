"""Merging of chains of texts and tables, judgements in batches, and entity merges that collide with a third entity."""

import pytest
from leafspan.models.base import PairJudge
from leafspan.operators import blocks, merging, refine
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id string, pdf_id int, pos int, type string, text string, text_level int, page_idx int, caption array<string>, "
    "footnote array<string>, table_body string, n_columns int, invalid boolean"
)


def block(n, kind, text=None, page=0, html=None, columns=None, caption=()):
    return ("d", n, n, kind, text, None, page, list(caption), [], html, columns, False)


def table_of(*cells):
    return "<table>" + "".join(f"<tr><td>{c}</td></tr>" for c in cells) + "</table>"


LONG = "this paragraph of several words does not come to its end and"


def test_a_chain_of_three_tables_becomes_one(spark):
    made = spark.createDataFrame([
        block(1, "table", page=0, html=table_of("a", "b"), columns=1, caption=["T"]), block(2, "text", "between.", page=0),
        block(3, "table", page=1, html=table_of("c"), columns=1), block(4, "table", page=2, html=table_of("d"), columns=1),
        block(5, "table", page=3, html=table_of("x" * 500), columns=1), block(6, "table", page=4, html="<table><tr><td>p</td><td>q</td></tr></table>", columns=2),
    ], SCHEMA)
    accepted = refine.accepted_tables(made, PairJudge(), rows=2)
    assert sorted(map(tuple, accepted.collect())) == [("d", 3, 1), ("d", 4, 3)]
    got = {r.pdf_id: r for r in refine.merge_table_chains(made, accepted, rows=2).collect()}
    assert got[1].table_body == table_of("a", "b", "c", "d") and [n for n in got if got[n].invalid] in ([3, 4], [4, 3])
    assert got[5].table_body == table_of("x" * 500)


def test_tables_without_an_element_are_joined_as_text(spark):
    bodies = spark.createDataFrame([(["a", "b"],), (["a", table_of("b"), table_of("c")],), ([table_of("a")],)], "b array<string>")
    got = [r[0] for r in bodies.select(refine.appended(F.col("b"))).collect()]
    assert got == ["ab", "a" + table_of("b", "c"), table_of("a")]


def test_a_paragraph_brings_along_what_it_has_taken(spark):
    made = spark.createDataFrame([
        block(1, "text", LONG + " cut-"), block(2, "image"), block(3, "text", " " + LONG, page=1), block(4, "equation", "e = m", page=1),
        block(5, "text", "ends here.", page=1), block(6, "text", "Alone.", page=1),
    ], SCHEMA)
    accepted = spark.createDataFrame([("d", 1, 3), ("d", 3, 4), ("d", 3, 5)], "doc_id string, pdf_id int, candidate_id int")
    for rows in (None, 2):
        got = {r.pdf_id: r for r in refine.stitch_chains(made, accepted, rows).collect()}
        assert got[1].text == f"{LONG} cut{LONG} e = m ends here."
        assert {n for n in got if got[n].invalid} == {3, 5} and got[6].text == "Alone."


def test_batches_with_a_wrong_number_of_judgements_are_left_out(spark):
    pairs = spark.createDataFrame([("d", n, '{"pdf_id_1":%d,"table_1_html":"aa","table_2_html":"%s"}' % (n, "odd" if n == 5 else "b")) for n in range(1, 9)], "doc_id string, pdf_id int, payload string")
    batches = {r.group: [p.pdf_id for p in r.batch] for r in refine.pair_batches(pairs, rows=2).collect()}
    assert batches == {0: [1, 2, 3], 1: [4, 5, 6], 2: [7, 8]}
    assert sorted(len(r.batch) for r in refine.pair_batches(pairs, budget=3, rows=None).collect()) == [2, 2, 2, 2]

    class Forgetful(PairJudge):
        def complete(self, prompt):
            right = super().complete(prompt)
            return F.when(prompt.contains("odd"), '{"judgments":[]}').otherwise(F.concat(F.lit("Sure: "), right))

    told = {r.pdf_id: r.judgment.merged_id for r in refine.judged(pairs, refine.TABLE_TASK, Forgetful(), rows=None).collect()}
    assert told == {n: n for n in (1, 2, 3, 7, 8)}


def test_refined_blocks_are_numbered_again(spark):
    made = spark.createDataFrame([
        block(1, "text", LONG), block(2, "text", "goes on- wards.", page=0), block(3, "table", page=0, html=table_of("a"), columns=1),
        block(4, "table", page=1, html=table_of("b"), columns=1), block(5, "text", "The end.", page=1),
    ], SCHEMA)
    got = [(r.pdf_id, r.text, r.table_body) for r in refine.refined(made, PairJudge(), rows=None).orderBy("pdf_id").collect()]
    assert got == [(1, LONG + " goes on-wards.", None), (2, None, table_of("a", "b")), (3, "The end.", None)]


DECIDED = "doc_id string, seq int, old_name string, old_type string, new_name string, new_type string, merged_name string, merged_type string"


@pytest.fixture(scope="module")
def merged(spark):
    mentions = spark.createDataFrame(
        [("d", n, s, name, "T", f"{name}{n}") for n, s, name in ((1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (3, 1, "a"), (4, 0, "e"))] + [("z", 1, 0, "a", "T", "other")],
        "doc_id string, node_id int, seq int, entity_name string, entity_type string, description string",
    )
    key = lambda n: f"Name: {n}\nType: T"
    edges = spark.createDataFrame([("d", i, key(s), key(t), float(i)) for i, (s, t) in enumerate((("a", "b"), ("a", "d"), ("c", "d"), ("d", "e")))], "doc_id string, seq int, src string, tgt string, weight double")
    # a and b become c, which exists: three in one. Its result is then merged with d under a new name; e is named thrice alone.
    decisions = spark.createDataFrame([("d", 1, "a", "T", "b", "T", "c", "T"), ("d", 2, "c", "T", "d", "T", "f", "U"), ("d", 3, "e", "T", "e", "T", "e", "T")], DECIDED)
    return merging.merge(mentions, edges, decisions, rows=2)


def test_merges_that_meet_a_third_entity(merged):
    rows = {(r.doc_id, r.entity_name, r.entity_type): r.description for r in merged.descriptions.collect()}
    assert rows == {("d", "f", "U"): "a1<SEP>b1<SEP>c2<SEP>d3<SEP>a3", ("d", "e", "T"): "e4", ("z", "a", "T"): "other"}
    assert sorted(r.index_id for r in merged.bridge.filter("node_name LIKE '%f%U'").collect()) == [1, 2, 3]


def test_edges_follow_their_entities(merged):
    got = [(r.src, r.tgt, r.weight) for r in merged.edges.collect()]
    assert got == [("Name: e\nType: T", "Name: f\nType: U", 3.0)]


def test_payloads_of_pairs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def payload(text):
        made.add(1)
        return text

    pairs = spark.createDataFrame([("d", i, "one two") for i in range(1, 8)], "doc_id string, pdf_id int, text string")
    batches = refine.pair_batches(pairs.select("doc_id", "pdf_id", payload("text").alias("payload")), budget=7)
    assert sorted(tuple(p.pdf_id for p in r.batch) for r in batches.collect()) == [(1, 2, 3), (4, 5, 6), (7,)]
    assert made.value == 7
