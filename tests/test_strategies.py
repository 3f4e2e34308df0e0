"""Retrieval strategies, answers and summaries on a small tree with known outcomes."""

import hashlib
import random

import numpy as np
import pytest
from leafspan.models.base import ExtractiveGenerator, HashEmbedder, OverlapReranker, once_per_value
from leafspan.operators import graph, summaries
from leafspan.plans import answers, routing, strategies
from pyspark.sql import functions as F

NODES = [
    # id, parent, type, depth, page, content, path
    (1, 0, "title", 1, 0, "Report", [1]), (2, 1, "title", 2, 0, "Methods Alpha", [1, 2]), (3, 2, "text", 3, 0, "alpha beta measured", [1, 2, 3]),
    (4, 2, "image", 3, 1, "alpha picture", [1, 2, 4]), (5, 1, "title", 2, 2, "Results Gamma", [1, 5]), (6, 5, "text", 3, 2, "gamma delta observed", [1, 5, 6]),
    (7, 5, "table", 3, 2, "delta table", [1, 5, 7]),
]
NAMES = ["alpha", "beta", "gamma", "delta"]


@pytest.fixture(scope="module")
def index(spark):
    nodes = spark.createDataFrame(
        [("d", i, p, t, dep, pg, c, path, "x.png" if t == "image" else "", "") for i, p, t, dep, pg, c, path in NODES],
        "doc_id string, index_id int, parent_id int, type string, depth int, page_idx int, content string, path array<int>, img_path string, table_body string",
    )
    bridge = spark.createDataFrame(
        [("d", i, n) for i, *_, c, _ in NODES for n in NAMES if n in c.lower()], "doc_id string, index_id int, node_name string"
    )
    entities = spark.createDataFrame([("d", n) for n in NAMES], "doc_id string, node_name string").withColumn(
        "embedding", HashEmbedder().embed(F.col("node_name"))
    )
    edges = spark.createDataFrame([("d", "alpha", "beta", 1.0), ("d", "gamma", "delta", 2.0)], "doc_id string, src string, tgt string, weight double")
    return strategies.Index(nodes.cache(), entities.cache(), edges.cache(), bridge.cache())


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q1", "d", "What was Alpha measured with?"), ("q2", "d", "Did Delta change?")], "qid string, doc_id string, question string")


def ids(found, qid):
    return {r.index_id for r in found.filter(F.col("qid") == qid).collect()}


def test_linking_is_exact_first_and_keeps_one_start(index, asked):
    found = strategies.link_entities(asked, index, strategies.Models(), strategies.TreeGraphSettings()).collect()
    by_question = {(r.qid, r.node_name): r.similarity for r in found}
    assert by_question["q1", "alpha"] == 1.0 and by_question["q2", "delta"] == 1.0


def no_index(*args, **kwargs):
    raise AssertionError("a question meets the items of its own document only")


def test_linking_meets_the_entities_of_the_document_only(index, asked, monkeypatch):
    monkeypatch.setattr(strategies.vectors, "nearest", no_index)
    found = strategies.link_entities(asked, index, strategies.Models(), strategies.TreeGraphSettings(max_distance=2.1))
    assert {(r.qid, r.node_name) for r in found.collect()} >= {("q1", "alpha"), ("q2", "delta")}


def test_by_vector_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(strategies.vectors, "nearest", no_index)
    rng = random.Random(3)
    words = ["ab", "cd", "ef", "gh", "ij"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 4)))
    nodes = [(d, i, text()) for d in ("d", "e") for i in range(25)]
    questions = [("q1", "d", "ab cd"), ("q2", "d", "ef"), ("q3", "e", "gh ij ij"), ("q4", "none", "ab")]
    items = spark.createDataFrame(nodes, "doc_id string, index_id int, content string")
    found = strategies.by_vector(
        spark.createDataFrame(questions, "qid string, doc_id string, question string"),
        items.select("doc_id", "index_id", HashEmbedder().embed(F.col("content")).alias("embedding")), topk=4,
    )

    def vector(value):
        made = np.zeros(64)
        for word in value.split():
            made[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
        return made / (np.linalg.norm(made) or 1)

    expected = []
    for q, doc, question in questions:
        scored = sorted((-round(float(vector(question) @ vector(c)), 9), f"{i}}}", i) for d, i, c in nodes if d == doc)
        expected += [(q, doc, i, rank, -s) for rank, (s, _, i) in enumerate(scored[:4], 1)]
    got = sorted((r.qid, r.doc_id, r.index_id, r.rank, r.similarity) for r in found.collect())
    assert [g[:4] for g in got] == sorted(e[:4] for e in expected)
    assert [g[4] for g in got] == pytest.approx([e[4] for e in sorted(expected)], abs=1e-8)


def test_few_candidates_are_all_returned(index, asked):
    found = strategies.tree_graph(asked, index)
    assert ids(found, "q1") == {2, 3, 4} and ids(found, "q2") == {5, 6, 7}


def test_text_only_variant_ranks_by_overlap(index, asked):
    settings = strategies.TreeGraphSettings(variant="wo_graph", topk=1)
    assert ids(strategies.tree_graph(asked, index, settings=settings), "q1") == {3}


def test_graph_only_variant_matches_rank_sums(index, asked):
    settings = strategies.TreeGraphSettings(variant="wo_text", topk=1)
    # alpha starts with the whole weight; nodes 2 and 4 mention it once, node 3 also mentions its neighbour.
    assert ids(strategies.tree_graph(asked, index, settings=settings), "q1") == {3}
    assert ids(strategies.global_graph(asked, index, topk=1), "q1") == {3}


def test_skyline_with_fallback_covers_large_pools(index, asked):
    settings = strategies.TreeGraphSettings(variant="wo_selector", topk=4)
    found = strategies.tree_graph(asked, index, settings=settings)
    assert 3 in ids(found, "q1") and len(ids(found, "q1")) >= 4


def test_descent(index, asked):
    steps = {r.step: r.index_id for r in strategies.tree_descent(asked, index.nodes).filter("qid = 'q2'").collect()}
    assert steps == {0: 0, 1: 1, 2: 2, 3: 3}  # no title mentions Delta, so the first child is taken
    capped = strategies.tree_descent(asked, index.nodes, max_depth=1)
    assert ids(capped, "q1") == {0, 1}


def test_modalities(index, asked):
    texts, images = strategies.by_modality(asked.select("qid", "doc_id").join(index.nodes.select("doc_id", "index_id"), "doc_id"), index.nodes)
    assert {r.index_id for r in images.collect()} == {4} and 4 not in {r.index_id for r in texts.collect()}


def test_global_answers(index, spark):
    rows = [("g1", "d", "How many images are on pages 1 to 2?"), ("g2", "d", "List all tables on pages 1 to 9."), ("g3", "d", "List all tables on pages 70 to 90.")]
    planned = routing.route(spark.createDataFrame(rows, "qid string, doc_id string, question string"))
    nodes = index.nodes.withColumn("title_path", F.lit(""))
    chosen = routing.apply_filters(planned, nodes, "qid")
    told = {r.qid: r.answer for r in answers.answer_global(planned, chosen, index.nodes, ExtractiveGenerator()).collect()}
    assert told["g1"] == answers.COUNT_ANSWER % (1, rows[0][2]) and "delta table" in told["g2"]
    assert told["g3"] == answers.NO_ITEMS_ANSWER


def test_reduction_yields_one_answer_each(spark, asked):
    parts = spark.createDataFrame([("q1", f"{i:03d}", f"part{i}") for i in range(50)] + [("q2", "0", "only")], "qid string, chunk string, answer string")
    told = {r.qid: r.answer for r in answers.synthesise(asked, parts, ExtractiveGenerator(), fan_in=4).collect()}
    assert set(told) == {"q1", "q2"} and told["q2"] == "only"


@pytest.mark.parametrize("rows", [None, 2])
def test_evidence_respects_budget(index, asked, rows):
    retrieved = asked.select("qid", "doc_id").join(index.nodes.select("doc_id", "index_id"), "doc_id")
    packed = answers.pack_evidence(retrieved, index.nodes, limit=4, rows=rows).filter("qid = 'q1'").orderBy("chunk").collect()
    text = answers.SEPARATOR.join(r.evidence for r in packed)
    assert [p.split("Content: ")[1].strip() for p in text.split(answers.SEPARATOR)] == [n[5] for n in NODES]


def test_unanswered_questions_are_asked_without_evidence(index, asked):
    told = answers.answer(asked, asked.select("qid", "doc_id", F.lit(3).alias("index_id")).filter("qid = 'q1'"), index.nodes, ExtractiveGenerator())
    assert {r.qid for r in told.collect()} == {"q1", "q2"}


def test_tree_summaries_reach_the_top(index):
    told = {r.index_id: r.summary for r in summaries.tree_summaries(index.nodes, ExtractiveGenerator(words=100)).collect()}
    assert "gamma delta observed" in told[5] and "alpha beta measured" in told[1]


def test_summary_levels_shrink(spark):
    texts = spark.createDataFrame([(i, f"topic{i % 3} word{i % 3} item{i}") for i in range(30)], "chunk_id long, text string")
    levels = summaries.summary_levels(texts, HashEmbedder(8), ExtractiveGenerator(20), cluster_counts=[3])
    sizes = [r["count"] for r in levels.groupBy("depth").count().orderBy("depth").collect()]
    assert sizes[0] == 30 and sizes[-1] <= 5 and levels.select("chunk_id").distinct().count() == sum(sizes)


def test_model_is_called_once_per_value(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    scored = once_per_value(df, ["t"], "s", lambda t: OverlapReranker().score(t, F.lit("a")))
    assert sorted(map(tuple, scored.collect())) == [("a", 1.0), ("a", 1.0), ("b", 0.0)]


def test_semantic_edges_respect_cap_and_threshold(spark):
    vectors = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.99, 0.1], "d": [0.98, 0.2], "e": [0.1, 0.99]}
    nodes = spark.createDataFrame([("d", n, v) for n, v in vectors.items()], "doc_id string, node_name string, embedding array<double>")
    edges = spark.createDataFrame([("d", "a", "b", 1.0)], "doc_id string, src string, tgt string, weight double")
    found = {(r.src, r.tgt) for r in graph.semantic_edges(nodes, edges).collect()}
    assert found == {("a", "c"), ("c", "d"), ("b", "e")}


def test_section_prompts_of_short_documents_are_packed_in_one_step(index, asked, monkeypatch):
    def refuse(*_):
        raise AssertionError("packed in segments")

    monkeypatch.setattr("leafspan.operators.packing._following", refuse)
    mapped = strategies.link_entities(asked, index, strategies.Models(), strategies.TreeGraphSettings())
    found = strategies.select_sections(asked, mapped, index, strategies.Models(), 2).filter("linked").collect()
    assert {(r.qid, r.section_id) for r in found} == {("q1", 2), ("q2", 5)}


def test_titles_wait_until_their_prompts_are_known(index, asked, monkeypatch):
    packed = strategies.greedy_groups

    def narrow(items, *rest, **more):
        assert "title" not in items.columns
        return packed(items, *rest, **more)

    monkeypatch.setattr(strategies, "greedy_groups", narrow)
    mapped = strategies.link_entities(asked, index, strategies.Models(), strategies.TreeGraphSettings())
    found = strategies.select_sections(asked, mapped, index, strategies.Models(), 2).collect()
    assert {(r.qid, r.section_id) for r in found if r.linked} == {("q1", 2), ("q2", 5)}


def test_chooser_reads_its_prompt_once(spark):
    chooser = strategies.SectionChooser()
    assert str(chooser.complete(F.col("p"))).count("from_json") == 1
    rows = [('Input:\n{"question": "Alpha b", "remaining": [{"section_id": 7, "title": "b c"}, {"section_id": 8, "title": "d"}, {"section_id": 9}]}',), ("none",)]
    told = [r[0] for r in spark.createDataFrame(rows, "p string").select(chooser.complete(F.col("p"))).collect()]
    assert told == ['{"supplementary_ids":[7]}', "{}"]
