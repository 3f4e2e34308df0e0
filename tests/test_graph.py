"""Rank iteration, clustering, alias resolution and endpoint repair against plain Python."""

import random

import numpy as np
import pytest
from leafspan.operators import entities, graph, merging


def rank_model(names, edges, weights, alpha=0.5):
    index = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, w in edges:
        m[index[a], index[b]] = m[index[b], index[a]] = w
    start = np.array([weights.get(n, 0.0) for n in names])
    start = start / start.sum()
    out = m.sum(1)
    x = np.full(len(names), 1 / len(names))
    while True:
        flow = (x[out > 0] / out[out > 0]) @ m[out > 0] + x[out == 0].sum() * start
        following = alpha * flow + (1 - alpha) * start
        if np.abs(following - x).sum() < len(names) * 1e-6:
            return dict(zip(names, following))
        x = following


def test_rank_of_several_graphs(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_PER_SALT", 3)
    rng = random.Random(1)
    expected, nodes, edges = {}, [], []
    for doc in ("a", "b"):
        names = [f"{doc}{i}" for i in range(12)]
        pairs = {(names[0], n) for n in names[1:9]} | {tuple(sorted(rng.sample(names[:10], 2))) for _ in range(10)}
        own = [(s, t, float(rng.randint(1, 9))) for s, t in sorted(pairs)]
        weights = {names[2]: 1.0, names[5]: 3.0}
        expected.update(rank_model(names, own, weights))
        nodes += [(doc, n, weights.get(n, 0.0)) for n in names]
        edges += [(doc, *e) for e in own]
    nodes.append(("c", "alone", 0.0))
    ranks = graph.pagerank(
        spark.createDataFrame(nodes, "doc_id string, node_name string, weight double"),
        spark.createDataFrame(edges, "doc_id string, src string, tgt string, weight double"),
    ).collect()
    assert {r.node_name: pytest.approx(r.rank, abs=1e-9) for r in ranks} == expected
    assert sum(r.rank for r in ranks if r.doc_id == "a") == pytest.approx(1)


def test_rank_moves_only_documents_that_are_not_done(spark, monkeypatch):
    step, given = graph._rank_step, []

    def recorded(state, *rest):
        given.append({r.doc_id for r in state.select("doc_id").distinct().collect()})
        return step(state, *rest)

    monkeypatch.setattr(graph, "_rank_step", recorded)
    nodes = [("early", "x", 1.0), ("late", "a", 1.0), ("late", "b", 0.0), ("late", "c", 0.0)]
    edges = [("late", "a", "b", 1.0), ("late", "b", "c", 3.0)]
    ranks = graph.pagerank(
        spark.createDataFrame(nodes, "doc_id string, node_name string, weight double"),
        spark.createDataFrame(edges, "doc_id string, src string, tgt string, weight double"),
    ).collect()
    found = {r.node_name: r.rank for r in ranks}
    assert given[0] == {"early", "late"} and given[-1] == {"late"} and len(ranks) == 4
    assert found.pop("x") == pytest.approx(1)
    assert found == pytest.approx(rank_model("abc", [e[1:] for e in edges], {"a": 1.0}), abs=1e-9)


def test_clusters(spark):
    pairs = [("d", f"n{i}", f"n{i + 1}") for i in range(9)] + [("d", "x", f"y{i}") for i in range(20)] + [("e", "n0", "n5")]
    found = {(r.doc_id, r.name): r.root for r in entities.clusters(spark.createDataFrame(pairs, "doc_id string, left string, right string")).collect()}
    assert {found["d", f"n{i}"] for i in range(10)} == {"n0"}
    assert {found["d", f"y{i}"] for i in range(20)} == {"x"} == {found["d", "x"]}
    assert found["e", "n5"] == "n0"


def test_aliases(spark):
    rows = [("d", f"a{i}", f"a{i + 1}") for i in range(11)] + [("d", "s", "s")]
    found = {r.old_name: r.latest_name for r in entities.resolve_aliases(spark.createDataFrame(rows, "doc_id string, old_name string, new_name string")).collect()}
    assert all(found[f"a{i}"] == "a11" for i in range(11)) and found["s"] == "s"


def test_aliases_on_cycles(spark):
    rows = [("d", "a", "b"), ("d", "b", "a"), ("d", "x", "y"), ("d", "y", "z"), ("d", "z", "x"), ("d", "w", "y"), ("d", "p", "q"), ("e", "a", "c")]
    got = entities.resolve_aliases(spark.createDataFrame(rows, "doc_id string, old_name string, new_name string")).collect()
    found = {(r.doc_id, r.old_name): r.latest_name for r in got}
    assert len(got) == len(rows) and found == {
        ("d", "a"): "a", ("d", "b"): "a", ("d", "w"): "w", ("d", "x"): "w", ("d", "y"): "w", ("d", "z"): "w", ("d", "p"): "q", ("e", "a"): "c"
    }


def test_endpoint_repair(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            following = [i]
            for j, y in enumerate(b):
                following.append(min(row[j] + (x != y), row[j + 1] + 1, following[-1] + 1))
            row = following
        return row[-1]

    rng = random.Random(9)
    known = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 40))) for _ in range(40)]
    asked = set()
    for name in known:
        text = list(name)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            if rng.random() < 0.5:
                text[at] = rng.choice("abc")
            else:
                text.insert(at, rng.choice("abc"))
        asked.add("".join(text))
    expected = {}
    for name in asked:
        best = min(known, key=lambda k: (distance(k, name), k))
        similar = 1 - distance(best, name) / max(len(best), len(name)) >= 0.9
        expected[name] = best if similar else name
    ends = spark.createDataFrame([("d", 1, n) for n in sorted(asked)], "doc_id string, node_id int, name string")
    have = spark.createDataFrame([("d", 1, n) for n in known], "doc_id string, node_id int, entity_name string")
    assert {r.name: r.repaired_name for r in entities.repair_endpoints(ends, have).collect()} == expected


def test_long_descriptions_stay_in_parts(spark):
    rows = [("d", i, 0, "e", "T", f"x{i}") for i in range(1, 12)]
    df = spark.createDataFrame(rows, "doc_id string, node_id int, seq int, entity_name string, entity_type string, description string")
    parts = sorted((r.part, r.description) for r in entities.entity_descriptions(df, rows=3, per_part=4).collect())
    assert [p for p, _ in parts] == [0, 1, 2]
    assert "<SEP>".join(d for _, d in parts) == "<SEP>".join(f"x{i}" for i in range(1, 12))


def test_rank_steps_leave_the_edges_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shares = graph.placed_edges(spark.range(100).selectExpr("id % 3 as doc_id", "cast(id % 10 as string) as u", "cast(id as string) as v", "0.1D as share", "cast(id % 2 as int) as salt")).persist()
        shares.count()
        state = spark.range(30).selectExpr(
            "id % 3 as doc_id", "cast(id as string) as node_name", "0.1D as start", "10L as n", "2 as salts", "0.1D as rank", "cast(null as double) as before", "false as done"
        )
        step = graph._rank_step(state, shares, 0.5, 1e-6)
        step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        lines = plan.splitlines()
        at = next(i for i, line in enumerate(lines) if "InMemoryTableScan" in line or "TableCacheQueryStage" in line)
        join = max(i for i in range(at) if "Join" in lines[i])
        assert not any("Exchange" in line or "ShuffleQueryStage" in line for line in lines[join + 1 : at])
        assert "InMemoryTableScan" in plan
        shares.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_any_of_the_nearest_entities_makes_an_endpoint_known(spark):
    have = [("d", 1, "abcdefgha"), ("d", 1, "abcdefghij"), ("d", 2, "abcdefgha")]
    ends = [("d", 1, "abcdefghi"), ("d", 2, "abcdefghi"), ("d", 2, "abcdefgha"), ("e", 1, "abcdefghi")]
    have = spark.createDataFrame(have, "doc_id string, node_id int, entity_name string")
    ends = spark.createDataFrame(ends, "doc_id string, node_id int, name string")
    found = sorted(tuple(r) for r in entities.unknown_endpoints(ends, have).collect())
    assert found == [("d", 2, "abcdefghi"), ("e", 1, "abcdefghi")]


def test_decisions_that_name_one_entity_three_times_keep_its_name(spark):
    rows = [("d", 8, "x", "T", "x", "T", "x", "T"), ("d", 15, "a", "T", "b", "T", "c", "T"), ("d", 22, "a", "T", "a", "T", "a", "T")]
    columns = "doc_id string, seq int, old_name string, old_type string, new_name string, new_type string, merged_name string, merged_type string"
    key = lambda n: f"Name: {n}\nType: T"
    names = merging.final_names(spark.createDataFrame(rows, columns)).select("old_key", "new_key").collect()
    assert sorted(map(tuple, names)) == [(key("a"), key("a")), (key("b"), key("a")), (key("c"), key("a")), (key("x"), key("x"))]


def test_small_graphs_are_ranked_in_tasks_as_joins_rank_them(spark):
    rng = random.Random(5)
    nodes, edges = [("zero", "a", 0.0), ("zero", "b", 0.0), ("lone", "a", 2.0)], [("zero", "a", "b", 1.0)]
    for doc, n in (("d1", 6), ("d2", 15), ("d3", 40)):
        nodes += [(doc, f"n{i}", float(rng.choice([0, 0, 1, 3])) + (i == 0)) for i in range(n)]
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)}
        edges += [(doc, f"n{a}", f"n{b}", float(rng.randint(0, 4))) for a, b in sorted(pairs) if b != n - 1]
    edges += [("d1", "n0", "elsewhere", 2.0), ("d1", "n1", "n1", 1.0)]
    nodes = spark.createDataFrame(nodes, "doc_id string, node_name string, weight double")
    edges = spark.createDataFrame(edges, "doc_id string, src string, tgt string, weight double")
    found = [{(r.doc_id, r.node_name): r["rank"] for r in graph.pagerank(nodes, edges, whole=whole).collect()} for whole in (0, 60, 1_000)]
    assert found[0].keys() == found[1].keys() == found[2].keys() and len(found[0]) == 62
    for key, rank in found[0].items():
        assert found[1][key] == pytest.approx(rank, abs=1e-12) and found[2][key] == pytest.approx(rank, abs=1e-12)


def test_small_graphs_need_no_round_of_jobs_each_iteration(spark):
    nodes = spark.createDataFrame([("d", f"n{i}", float(i == 0)) for i in range(30)], "doc_id string, node_name string, weight double")
    edges = spark.createDataFrame([("d", f"n{i}", f"n{i + 1}", 1.0) for i in range(29)], "doc_id string, src string, tgt string, weight double")
    context = spark.sparkContext
    context.setJobGroup("ranks", "")
    try:
        graph.pagerank(nodes, edges, whole=100).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("ranks")) < 15


def test_small_graphs_that_do_not_settle_are_refused(spark):
    nodes = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 0.0)], "doc_id string, node_name string, weight double")
    edges = spark.createDataFrame([("d", "a", "b", 1.0)], "doc_id string, src string, tgt string, weight double")
    with pytest.raises(Exception, match="did not converge"):
        graph.pagerank(nodes, edges, tolerance=0.0, max_iterations=2, whole=100).collect()


def test_graphs_without_start_weights_fill_no_bundle(spark):
    nodes = spark.createDataFrame([("d", "a", 0.0), ("d", "b", 0.0)], "doc_id string, node_name string, weight double")
    edges = spark.createDataFrame([("d", "a", "b", 1.0), ("e", "a", "b", 1.0)], "doc_id string, src string, tgt string, weight double")
    assert graph.pagerank(nodes, edges, whole=100).isEmpty()
