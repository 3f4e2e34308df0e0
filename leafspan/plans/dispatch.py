"""From a run configuration to retrieved nodes and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.config import RunConfig
from leafspan.operators import lexical, tree
from leafspan.plans import answers, routing, strategies
from leafspan.session import cut_lineage


def retrieve(config: RunConfig, questions: DataFrame, index: strategies.Index, models: strategies.Models | None = None) -> DataFrame:
    """``(qid, doc_id, index_id)`` by the strategy that the configuration names."""
    models, settings = models or strategies.Models(), config.settings
    if config.strategy == "tree_graph":
        found = strategies.tree_graph(questions, index, models, settings)
    elif config.strategy == "graph":
        found = strategies.global_graph(questions, index, models, settings.topk)
    elif config.strategy == "vector":
        items = index.nodes.select("doc_id", "index_id", models.embedder.embed(F.col("content")).alias("embedding"))
        found = strategies.by_vector(questions, cut_lineage(items), models, settings.topk)
    elif config.strategy == "lexical":
        items = index.nodes.select("doc_id", "index_id", F.coalesce("content", F.lit("")).alias("text"))
        hits = lexical.search_in_scope(items, questions, settings.topk)
        found = hits.join(questions.select("qid", "doc_id"), "qid")
    elif config.strategy == "multimodal":
        texts, images = strategies.multimodal(questions, index.nodes, models, settings.topk)
        found = texts.select("qid", "doc_id", "index_id").unionByName(images.select("qid", "doc_id", "index_id"))
    elif config.strategy == "traverse":
        found = strategies.tree_descent(questions, index.nodes, models, settings.max_depth).filter("index_id > 0")
    else:
        raise ValueError(f"unknown strategy {config.strategy}")
    return found.select("qid", "doc_id", "index_id")


def ask(config: RunConfig, questions: DataFrame, index: strategies.Index, models: strategies.Models | None = None, limit: int = 2_000) -> DataFrame:
    """``(qid, answer)`` for every question.

    The tree and graph strategy plans first, unless its variant is ``wo_plan``: complex questions are answered from their
    steps, global ones from the nodes that their filters keep. All other strategies answer every question as it stands.
    """
    models = models or strategies.Models()
    planning = config.strategy == "tree_graph" and config.settings.variant != "wo_plan"
    if not planning:
        found = cut_lineage(retrieve(config, questions, index, models))
        return answers.answer(questions, found, index.nodes, models.generator, limit)
    planned = cut_lineage(routing.route(questions))
    steps = routing.retrieval_steps(planned, "qid")
    steps = cut_lineage(steps.select(F.to_json(F.struct("qid", "step")).alias("qid"), F.col("qid").alias("plan"), "step", "doc_id", "question"))
    asked = steps.drop("plan", "step")
    told = answers.answer(asked, cut_lineage(retrieve(config, asked, index, models)), index.nodes, models.generator, limit)
    told = cut_lineage(told.join(steps.select("qid", "plan", "step"), "qid").select(F.col("plan").alias("qid"), "step", "answer"))
    simple = told.join(planned.filter("query_type = 'simple'").select("qid"), "qid", "left_semi").select("qid", "answer")
    combined = answers.answer_complex(planned, told, models.generator)
    chosen = cut_lineage(routing.apply_filters(planned, tree.title_paths(index.nodes), "qid"))
    overall = answers.answer_global(planned, chosen, index.nodes, models.generator)
    return simple.unionByName(combined.select("qid", "answer")).unionByName(overall.select("qid", "answer"))
