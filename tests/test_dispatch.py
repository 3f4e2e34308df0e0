"""Section selection, the variants, and every strategy from a configuration file."""

import pytest
from leafspan.config import load_config
from leafspan.models.base import SectionChooser
from leafspan.plans import dispatch, strategies
from pyspark.sql import functions as F

from test_strategies import asked, ids, index  # noqa: F401


def sections(asked, index, **more):
    models = strategies.Models(**more)
    mapped = strategies.link_entities(asked, index, models, strategies.TreeGraphSettings())
    return {(r.qid, r.section_id, r.linked) for r in strategies.select_sections(asked, mapped, index, models, 2).collect()}


def test_linked_sections_and_chosen_ones(spark, index, asked):  # noqa: F811
    assert sections(asked, index) == {("q1", 2, True), ("q2", 5, True)}
    more = spark.createDataFrame([("q3", "d", "Which Methods changed Delta?")], "qid string, doc_id string, question string")
    assert sections(more, index) == {("q3", 5, True), ("q3", 2, False)}
    assert ids(strategies.tree_graph(more, index), "q3") == {2, 3, 4, 5, 6, 7}


def test_only_offered_ids_count(index, asked):  # noqa: F811
    class Liar(SectionChooser):
        def complete(self, prompt):
            return F.concat(F.lit('I choose {"supplementary_ids":[5,2,77],"explanation":"all"} '), F.lit("."))

    class Silent(SectionChooser):
        def complete(self, prompt):
            return F.lit("Error: no answer")

    assert sections(asked, index, chooser=Liar()) == {("q1", 2, True), ("q1", 5, False), ("q2", 5, True), ("q2", 2, False)}
    assert sections(asked, index, chooser=Silent()) == {("q1", 2, True), ("q2", 5, True)}


@pytest.mark.parametrize("strategy", ["tree_graph", "graph", "vector", "lexical", "multimodal", "traverse"])
def test_strategies_run_from_a_file(tmp_path, index, asked, strategy):  # noqa: F811
    path = tmp_path / "run.yaml"
    path.write_text(f"rag:\n  strategy: {strategy}\n  topk: 2\n")
    config = load_config(str(path))
    found = dispatch.retrieve(config, asked, index)
    assert found.columns == ["qid", "doc_id", "index_id"] and found.count() > 0
    if strategy == "lexical":
        assert ids(found, "q1") == {2, 3} or 3 in ids(found, "q1")


@pytest.mark.parametrize("variant", ["standard", "wo_plan"])
def test_planning_and_its_absence(tmp_path, spark, index, variant):  # noqa: F811
    path = tmp_path / "run.yaml"
    path.write_text(f"rag:\n  strategy: tree_graph\n  variant: {variant}\n")
    questions = spark.createDataFrame(
        [("s", "d", "What was Alpha measured with?"), ("c", "d", "What is Alpha? What is Delta?"), ("g", "d", "How many images are on pages 1 to 2?")],
        "qid string, doc_id string, question string",
    )
    told = {r.qid: r.answer for r in dispatch.ask(load_config(str(path)), questions, index).collect()}
    assert set(told) == {"s", "c", "g"} and "alpha" in told["s"].lower()
    assert ("I found 1 items" in told["g"]) == (variant == "standard")
