"""Readers, stores, routing, configuration and incremental runs."""

import json
import uuid

import pytest
from leafspan.config import load_config
from leafspan.plans import routing
from leafspan.sources import files, stores
from leafspan.streaming.ingest import answer_incrementally
from pyspark.sql import functions as F


def test_name_based_uuid(spark):
    names = ["report_1.pdf", "é"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", files.name_based_uuid(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in got} == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}


def test_block_lists_keep_order(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps([{"type": "text", "text": c} for c in "abc"]))
    got = files.read_block_lists(spark, str(tmp_path), "struct<type:string,text:string>").orderBy("pos").collect()
    assert [(r.doc_id, r.pos, r.text) for r in got] == [("doc", 1, "a"), ("doc", 2, "b"), ("doc", 3, "c")]


def test_pending_files(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    done = spark.createDataFrame([("a",)], "doc_id string")
    assert [r.doc_id for r in files.pending_files(spark, str(tmp_path), done).collect()] == ["b"]


def test_store(spark, tmp_path):
    store = stores.TableStore(spark, str(tmp_path), "vectors")
    store.delete(spark.range(3), ["id"])
    store.reset()
    assert not store.exists() and store.read().isEmpty()
    store.append(spark.range(3))
    store.append(spark.range(3, 5))
    store.delete(spark.createDataFrame([(1,), (77,)], "id long"), ["id"])
    assert sorted(r.id for r in store.read().collect()) == [0, 2, 3, 4]
    store.delete(spark.createDataFrame([(77,)], "id long"), ["id"])
    assert len(store._versions()) == 2
    store.reset()
    assert store.read().count() == 0


def test_incremental_answers(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    results = stores.TableStore(spark, str(tmp_path / "out"), "results")
    answer = lambda q: q.withColumn("output", F.upper("question"))

    def run(name, rows, checkpoint):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema("qid string, question string").json(str(source))
        query = answer_incrementally(stream, results, answer, ["qid"], str(tmp_path / checkpoint))
        query.awaitTermination()

    run("1.json", [{"qid": "a", "question": "x"}], "c1")
    run("2.json", [{"qid": "b", "question": "y"}, {"qid": "a", "question": "x"}], "c1")
    run("3.json", [{"qid": "c", "question": "z"}], "c2")  # a lost checkpoint replays everything
    assert sorted(r.output for r in results.read().collect()) == ["X", "Y", "Z"]


def test_routing(spark):
    rows = [
        ("Count pictures shown on pages 3 to 10.",), ("For later reading, summarise the 'Methodology' section.",),
        ("How many chapters are in this report?",), ("What is a? What is b?",), ("What is a?",),
    ]
    got = routing.route(spark.createDataFrame(rows, "question string")).withColumn("ok", routing.is_valid()).collect()
    assert [r.query_type for r in got] == ["global", "global", "global", "complex", "simple"] and all(r.ok for r in got)
    assert [tuple(f) for f in got[0].filters] == [("image", None), ("page", "3-10")]
    assert [tuple(f) for f in got[1].filters] == [("section", "Methodology")] and got[2].filters[0].filter_value is None


def test_config(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "run.yaml"
    path.write_text("save_path: out\nrag:\n  strategy: tree_graph\n  topk: 7\n  variant: wo_text\n")
    config = load_config(str(path))
    assert config.settings.topk == 7 and config.settings.variant == "wo_text" and config.save_path == "out"
    path.write_text("rag:\n  strategy: nothing\n")
    with pytest.raises(ValueError):
        load_config(str(path))
