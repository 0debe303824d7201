"""The query language over a small project, its refusals, and the graph and report operators on small inputs."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import scalars
from quern.operators import graph, joins, patterns, reports, steps
from quern.plans import query as language
from quern.plans.registry import Flow, Protocol
from quern.schema import DOMAINS, PlanError, kinds_below
from quern.sources.facts import html_nodes, page_rows, python_facts, read_facts, sarif_results, write_facts, write_sarif

FILES = {
    "src/app.py": "from src.service import audit, Base\n\nclass App(Base):\n    def handle(self, value):\n        return audit(value, level=2)\n\ndef main():\n    main()\n    App().handle(1)\n",
    "src/service.py": "class Base:\n    pass\n\ndef audit(value, level):\n    return value\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    return python_facts(spark, FILES)


def ids(q, facts, column="id"):
    return [r[column] for r in language.run(q, facts)[0].collect()]


def test_golden_call(facts):
    rows, cut = language.run('(language python (call :callee (name "audit")))', facts)
    (r,) = rows.collect()
    assert (r.path, r.kind, r.language, r.start_line, r.end_line, r.text) == ("src/app.py", "call", "python", 5, 5, "audit(value, level=2)") and not cut.head()[0]
    assert ids('(query (call :callee (name "audit")) (step enclosing_decl))', facts) == ["src.app.App.handle"]


@pytest.mark.parametrize(
    "query, want",
    [
        ({"declarations": {"name": "audit"}, "steps": [{"op": "callers", "transitive": True}]}, {"src.app.App.handle", "src.app.main"}),
        ({"declarations": {"name": "main"}, "steps": [{"op": "callees"}]}, {"src.app.main", "src.app.App", "src.app.App.handle"}),
        ({"declarations": {"name": "App"}, "steps": [{"op": "supertypes"}]}, {"src.service.Base"}),
        ({"declarations": {"name": "Base"}, "steps": [{"op": "subtypes", "transitive": True}]}, {"src.app.App"}),
        ({"declarations": {"name": "App"}, "steps": [{"op": "members"}]}, {"src.app.App.handle"}),
        ({"declarations": {"name": "handle"}, "steps": [{"op": "owner"}]}, {"src.app.App"}),
        ({"declarations": {"name": "audit"}, "steps": [{"op": "used_by"}]}, {"src.app.App.handle"}),
        ({"declarations": {"name": "handle"}, "steps": [{"op": "uses"}]}, {"src.service.audit"}),
        ({"declarations": {"name": "audit"}, "steps": [{"op": "file_of"}, {"op": "importers_of"}]}, {"src/app.py"}),
        ({"files": {}, "where": ["src/app*"], "steps": [{"op": "imports_of"}]}, {"src/service.py"}),
        ({"union": [{"declarations": {"name": "audit"}}, {"declarations": {"kind": "class"}}]}, {"src.service.audit", "src.app.App", "src.service.Base"}),
        ({"intersect": [{"declarations": {"kind": "class"}}, {"declarations": {"name": "App"}}]}, {"src.app.App"}),
        ({"except": [{"declarations": {"kind": "class"}}, {"declarations": {"name": "App"}}]}, {"src.service.Base"}),
    ],
)
def test_steps(facts, query, want):
    assert set(ids(query, facts)) == want


def test_patterns(facts):
    assert ids({"match": {"kind": "call", "args": [{"name": "value"}], "kwargs": {"level": {"kind": "literal"}}, "inside_decl": {"kind": "method"}}}, facts, "name") == ["audit"]
    assert ids({"match": {"kind": "callable", "not_has": {"kind": "call"}}}, facts, "name") == ["audit"]
    assert ids({"match": {"kind": "call", "arity": {"min": 1, "max": 1}, "not_inside": {"kind": "class"}}}, facts, "name") == ["handle"]
    bound = language.run({"match": {"kind": "call", "name": "audit"}, "steps": [{"op": "call_shape"}, {"op": "call_bindings"}]}, facts)[0]
    assert {(r.argument_index, r.formal_name) for r in bound.collect()} == {(0, "value"), (1, "level")}
    args = language.run({"match": {"kind": "call", "name": "audit"}, "steps": [{"op": "call_shape"}, {"op": "call_argument_groups"}, {"op": "call_arguments"}]}, facts)[0]
    assert [r.text for r in args.collect()] == ["value", "2"]


def test_limit_probes_one_row_more(facts):
    rows, cut = language.run({"declarations": {}, "limit": 2}, facts)
    assert rows.count() == 2 and cut.head()[0]


@pytest.mark.parametrize(
    "query, path",
    [
        ({"match": {"kind": "call"}, "x": 1}, ""), ({"match": {"has": {"kind": "call"}}}, "match"), ({"match": {"kind": "call"}, "steps": [{"op": "members"}]}, "steps[0]"),
        ({"union": [{"declarations": {}}, {"files": {}}]}, "union"), ({"union": [{"declarations": {}}, {"match": {"kind": "call"}, "steps": [{"op": "members"}]}]}, "union[1].steps[0]"),
        ({"declarations": {}, "limit": 0}, "limit"), ({"occurrences": {"role": "nonsense"}}, "occurrences"), ({"schema_version": 2, "files": {}}, "schema_version"),
        ({"declarations": {}, "steps": [{"op": "callers", "colour": 1}]}, "steps[0]"), ({"declarations": {}, "steps": [{"op": "nothing"}]}, "steps[0]"), ({"files": {}, "declarations": {}}, ""),
    ],
)
def test_refusals(query, path):
    with pytest.raises(PlanError) as e:
        language.check(query)
    assert e.value.path == path


def test_registry():
    assert len(steps.STEPS) == 74 and all(s.gives in DOMAINS and s.takes <= set(DOMAINS) for s in steps.STEPS.values())
    assert kinds_below("callable") == ["callable", "constructor", "function", "lambda", "method"]


def test_scalars(spark):
    assert scalars.alternation("^(a|b c)$") == ["a", "b c"] and scalars.alternation("^(a|b.)$") is None and scalars.anchors("foobar.bazz") == ["foobar", "bazz"]
    rows = spark.createDataFrame([("Foo.java",), ("src/test/java/FooTest.java",), ("pkg/foo_test.go",), ("src/foo.test.ts",)], "p string")
    assert {r[0] for r in rows.select(scalars.stem(rows.p)).collect()} == {"foo"}
    assert scalars.glob_regex("src/**/*.py") == r"^src/(?:.*/)?[^/]*\.py$"
    got = spark.sql("select 'a b c a b c a' as t").select(scalars.word_shingles(F.col("t"), 3).alias("s")).head().s
    assert got == ["a b c", "b c a", "c a b"]


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.depth) for r in graph.closure(seeds, e).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert {(r.id, r.depth) for r in graph.closure(seeds, e, None, True).collect()} == {(2, 1), (3, 2), (4, 3), (1, 3)}
    assert {r.id for r in graph.closure(seeds, e, 1).collect()} == {2}
    blocked = spark.createDataFrame([("t", 3)], "label string, id long")
    assert {r.id for r in graph.reachable(spark.createDataFrame([("t", 1)], "label string, id long"), e, blocked).collect()} == {1, 2}
    assert graph.dominators(0, [(0, 1), (0, 2), (1, 3), (2, 3)])[3] == {0, 3}
    assert graph.strong_components([(1, 2), (2, 1), (2, 3)]) == {1: 1, 2: 1, 3: 3}
    assert graph.reaching(0, [(0, 1), (0, 2), (1, 3), (2, 3)], [(1, "establish", "x"), (2, "establish", "x"), (3, "read", "x")]) == [("x", 1, 3), ("x", 2, 3)]
    points = spark.createDataFrame([("p", 0, "entry")], "procedure string, point long, boundary string")
    edges = spark.createDataFrame([("p", 0, 1), ("p", 1, 2)], "procedure string, src long, dst long")
    events = spark.createDataFrame([("p", 1, "establish", "x"), ("p", 2, "read", "x")], "procedure string, point long, event string, subject string")
    assert {(r.relation, r.certainty) for r in graph.flow_relations(points, edges, events).collect()} == {("reaching", "exact"), ("dominates", "exact")}


def test_tabulation_keeps_what_nothing_is_above(spark):
    # At 5 the row without either quality comes a step before the one with one; at 6 the two that are not comparable come after it.
    flows = [(1, 5, False, False), (1, 2, True, False), (2, 5, True, True), (1, 6, False, False), (2, 6, True, True), (1, 3, False, True), (3, 6, True, True), (1, 7, False, False)]
    flows = spark.createDataFrame([(a, "x", b, "x", p, c) for a, b, p, c in flows], "src long, fact_in string, dst long, fact_out string, proven boolean, complete boolean")
    got = graph.tabulate(spark.createDataFrame([(1, "x"), (None, "x")], "node long, fact string"), flows).collect()
    assert sorted((r.node or 0, r.proven, r.complete) for r in got) == [
        (0, True, True), (1, True, True), (2, True, False), (3, False, True), (5, True, False), (6, False, True), (6, True, False), (7, False, False)]


def test_reports(spark):
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.3), ("c", "y", 0.2)], "l string, r string, score double")
    assert {(r.l, r.r) for r in reports.greedy_pairs(scored, 0.25).collect()} == {("a", "x"), ("b", "y")}
    handlers = spark.createDataFrame([("h", "Throwable", 0, False, False), ("k", "Exception", 6, False, False)], "id string, caught string, statements int, comment_only boolean, log_only boolean")
    assert [(r.id, r.score) for r in reports.exception_smells(handlers).collect()] == [("h", 10)]
    found = spark.createDataFrame([("r", "m", "p.py", 1, 2)], "rule string, message string, path string, start_line int, end_line int")
    assert '"ruleId":"r"' in sarif_results(found).head().value


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<div><p>x<br><a href='/q'>y</a></p><li>z</div>"), (2, "u", None)], "page_id long, url string, html string")
    rows = {r.kind: r for r in html_nodes(pages).collect()}
    assert set(rows) == {"div", "p", "br", "a", "li"} and rows["a"].parent == rows["p"].node_id and rows["a"].text == "/q" and rows["div"].subtree_end == 5


def test_refresh(spark, tmp_path):
    from quern.streaming.typestate import current, refresh

    at = str(tmp_path / "facts")
    refresh(spark, spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int"), at)
    refresh(spark, spark.createDataFrame([("b", 2)], "path string, v int"), at)
    assert {tuple(r) for r in current(spark, at).collect()} == {("a", 1), ("b", 2)}


def test_sarif_document(spark, tmp_path):
    import json

    rows = [("r", "m", p, i, i + 1) for p in ("b", "a") for i in range(3)]
    found = spark.createDataFrame(rows, "rule string, message string, path string, start_line int, end_line int").repartition(3)
    for name, df in (("some", found), ("none", found.limit(0))):
        write_sarif(df, "t", str(tmp_path / name))
        text = "\n".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        results = json.loads(text)["runs"][0]["results"]
        assert [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in results] == (sorted((p, i) for _, _, p, i, _ in rows) if name == "some" else [])


def test_facts_on_disk(spark, tmp_path):
    facts = python_facts(spark, {"a.py": "def f():\n    return g()\n\ndef g():\n    return 1\n"})
    write_facts({k: facts[k] for k in ("declarations", "calls")}, str(tmp_path / "facts"))
    back = read_facts(spark, str(tmp_path / "facts"))
    assert set(back) == {"declarations", "calls"} and {r.id for r in back["declarations"].collect()} == {r.id for r in facts["declarations"].collect()}


def test_late_events_take_their_place(spark, tmp_path):
    from quern.streaming.typestate import protocol_stream

    table = {("new", "open"): "open", ("open", "read"): "read", ("new", "read"): "error", ("error", "open"): "open"}
    files = [[(1, 1, 10, "open"), (2, 2, 10, "read")], [(1, 3, 30, "read"), (2, 4, 5, "open")], [(1, 5, 20, "read"), (3, 6, 50, "open")]]
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "who long, tie long, s long, what string").selectExpr("who", "tie", "timestamp_seconds(s) as at", "what")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    import os
    import shutil
    import time

    os.makedirs(tmp_path / "all")
    for k in range(3):
        for f in (tmp_path / "in" / f"{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "all" / f"{k}-{f.name}")
            os.utime(tmp_path / "all" / f"{k}-{f.name}", (time.time() + k, time.time() + k))
    seen = {}
    stream = spark.readStream.schema("who long, tie long, at timestamp, what string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    out = protocol_stream(stream, "who", "at", "tie", "what", table, "new", {"error"}, "1 minute", keep_ms=3_600_000)
    q = out.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.update({r.who: (r.state, r.violations) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == {1: ("read", 0), 2: ("read", 0), 3: ("open", 0)}


def test_saved_queries_and_models(spark, tmp_path):
    from quern.plans import query as language
    from quern.sources.facts import load_models, load_queries

    (tmp_path / "calls.rql").write_text('(query (call (name "f")) (limit 3))')
    (tmp_path / "decls.json").write_text('{"declarations": {"kind": "class"}, "limit": 5}')
    saved = {r.name: r.query for r in load_queries(spark, str(tmp_path)).collect()}
    assert language.check(language.parse(saved["calls"])) == "match" and language.check(language.parse(saved["decls"])) == "declaration"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "models.json").write_text('{"package": "p", "type": "T", "name": "read", "kind": "source"}\n')
    assert [(r.package, r.name, r.subtypes) for r in load_models(spark, str(tmp_path / "m")).collect()] == [("p", "read", None)]


def test_policies_are_checked():
    from quern.plans.policy import Endpoints, Policy, check
    from quern.schema import PlanError

    seed = {"declarations": {"kind": "class"}}
    for bad in ([Policy("a", "lint", seed)], [Policy("a", "match", seed), Policy("a", "match", seed)], [Policy("a", "taint", seed)], [Policy("a", "assertion", seed)], [Policy("a", "match", {"nothing": {}})]):
        with pytest.raises(PlanError):
            check(bad)
    with pytest.raises(PlanError):
        Endpoints({"a": seed, "b": {"files": {}}}).rows({}, ["a"], ["b"])


def test_control_flow_of_branches_and_loops():
    from quern.operators import graph

    edges = [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5)]
    assert graph.postdominators([5], edges)[1] == {1, 4, 5}
    assert graph.control_dependence([5], edges) == {(2, 1), (3, 1), (1, 4), (4, 4)}
    assert graph.loop_regions(0, edges) == {1: {1, 2, 3, 4}} and graph.depth_first(0, edges) == [0, 1, 2, 4, 5, 3]
    assert graph.postdominators([], []) == {} and graph.loop_regions(0, []) == {}


@pytest.fixture
def written(monkeypatch):
    """The plans of what loops write, as they are before they run."""
    seen, write = [], graph.cut_lineage

    def spy(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(graph, "cut_lineage", spy)
    return seen


def counted_rows(spark, rows, schema):
    """The rows, and how often one of them was read."""
    read = spark.sparkContext.accumulator(0)

    def count(row):
        read.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count), schema), read


def test_closure_reads_its_edges_once_and_sends_none_to_the_driver(spark, written):
    chain = [(i, i + 1) for i in range(8)] + [(100 + i, 0) for i in range(50)]
    edges, read = counted_rows(spark, chain, "src long, dst long")
    got = {(r.root, r.id, r.depth) for r in graph.closure(spark.createDataFrame([(0,), (5,)], "id long"), edges).collect()}
    assert got == {(0, i, i) for i in range(1, 9)} | {(5, i, i - 5) for i in range(6, 9)}
    assert read.value <= 2 * len(chain) and not any("Broadcast" in p for p in written[2:])


def test_shortest_paths_read_their_edges_once(spark, written):
    chain = [(i, i + 1) for i in range(6)] + [(0, 2)]
    edges, read = counted_rows(spark, chain, "src long, dst long")
    got = {r.id: r.path for r in graph.shortest_paths(spark.createDataFrame([(0,)], "id long"), edges, 9).collect()}
    assert got == {0: [0]} | {1: [0, 1]} | {i: [0, *range(2, i + 1)] for i in range(2, 7)}
    assert read.value <= 2 * len(chain) and not any("Broadcast" in p for p in written[2:])


def test_tabulation_reads_its_flows_once_and_sends_none_to_the_driver(spark, written):
    rows = [(i, "x", i + 1, "x", i != 3, True) for i in range(6)]
    flows, read = counted_rows(spark, rows, "src long, fact_in string, dst long, fact_out string, proven boolean, complete boolean")
    reached = graph.tabulate(spark.createDataFrame([(0, "x"), (None, "x")], "node long, fact string"), flows)
    assert {(r.node, r.proven, r.complete) for r in reached.collect()} == {(None, True, True)} | {(i, i < 4, True) for i in range(7)}
    assert read.value == len(rows) and not any("Broadcast" in p for p in written)
    assert {len(r.path) for r in graph.witnesses(reached, reached.where("node = 6").select("node", "fact")).collect()} == {7}


def procedures(spark):
    """Two procedures of one shape under other numbers, one of them with a kill on the way; the events, and how often one was read."""
    points = spark.createDataFrame([(10 * p + k, p, b) for p in (1, 2) for k, b in enumerate(("entry", "body", "normal_exit"))], "id long, procedure_id long, boundary string")
    edges = spark.createDataFrame([(10 * p + k, 10 * p + k + 1) for p in (1, 2) for k in (0, 1)], "src long, dst long")
    rows = [(100 * p + k, p, f"f{p}", 10 * p + at, event, "q") for p in (1, 2) for k, at, event in ((0, 0, "establish"), (1, 2, "read"), (2, 1, "kill")) if (p, k) != (1, 2)]
    events, read = counted_rows(spark, rows, "id long, procedure_id long, path string, point long, event string, subject string")
    given = spark.createDataFrame([(p, f"f{p}", [p]) for p in (1, 2, 3)], "id long, path string, ord array<long>")
    return given, {"points": points, "control_edges": edges, "state_events": events}, read, len(rows)


def test_flow_relations_read_the_events_once(spark):
    given, facts, read, n = procedures(spark)
    got = steps.run_step("flow_relations_of", "procedure", given, facts)[1].collect()
    assert {(r.id, r.path, r.procedure_id, r.certainty) for r in got} == {("reaching#100#101", "f1", 1, "exact"), ("dominates#100#101", "f1", 1, "exact"), ("dominates#200#201", "f2", 2, "exact")}
    assert read.value == n
    reads = facts["state_events"].where("event = 'read'").withColumn("ord", F.array(F.lit(0).cast("long")))
    got = steps.run_step("flow_relations_of", "state_event", reads, facts, {"relation": "reaching"})[1].collect()
    assert [(r.source_id, r.target_id) for r in got] == [(100, 101)]


def test_registered_flows_read_the_events_once(spark, monkeypatch):
    monkeypatch.setitem(steps.REGISTRY.flows, "here", Flow("event = 'establish'", "event = 'read'", "event = 'kill'"))
    given, facts, read, n = procedures(spark)
    (r,) = steps.run_step("value_flow", "procedure", given, facts, {"plan": "here"})[1].collect()
    assert (r.id, r.path, r.procedure_id, r.distance, [tuple(w) for w in r.witness]) == ("100#101", "f1", 1, 2, [(10, 100), (12, 101)])
    assert read.value == n


def test_typestate_reads_the_events_once(spark, monkeypatch):
    monkeypatch.setitem(steps.REGISTRY.protocols, "here", Protocol({("new", "establish"): "live", ("live", "read"): "used"}, "new", ("used",), ()))
    given, facts, read, n = procedures(spark)
    facts["state_events"] = facts["state_events"].where("id <> 101")
    (r,) = steps.run_step("typestate", "procedure", given, facts, {"protocol": "here"})[1].collect()
    assert (r.procedure_id, r.state, r.ended_badly, [tuple(w) for w in r.witness]) == (1, "live", True, [(10, 100, "establish")]) and read.value == n


def test_narrowest_spans_are_sent_once(spark):
    rows = spark.createDataFrame([(1, "a", 10, 20, [1])], "id long, path string, start_byte long, end_byte long, ord array<long>")
    table = spark.createDataFrame([(5, "a", 0, 90, "x"), (6, "a", 9, 25, "y"), (7, "a", 8, 24, "z")], "id long, path string, start_byte int, end_byte int, name string")
    chosen = steps.within("scopes", narrow=True)(rows, {"scopes": table}, {})
    assert [tuple(r) for r in chosen.collect()] == [(6, "a", 9, 25, "y", [1])] and chosen.dtypes == [*table.dtypes, ("ord", "array<bigint>")]
    assert steps.within("scopes", narrow=True, unique=True)(rows, {"scopes": table}, {}).count() == 0
    plan = joins.first_seen(chosen, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan


def test_captures_look_at_their_nodes_once(spark):
    nodes = spark.createDataFrame([("a", 0, "call", "f", "f(x, x)", 4), ("a", 1, "identifier", "x", "x", 2), ("a", 2, "identifier", "x", "x", 3), ("a", 3, "identifier", "y", "y", 4)], "path string, node_id long, kind string, name string, text string, subtree_end long")
    roles = spark.createDataFrame([("a", 0, "receiver", 0, None, 1, "x"), ("a", 0, "args", 0, None, 2, "x"), ("a", 0, "args", 1, None, 3, "y")], "path string, node_id long, role string, ordinal int, keyword string, target_node long, name string")
    found = patterns.matching({"kind": "call", "receiver": {"capture": "v"}, "args": [{"capture": "v"}]}, nodes, roles)
    assert [r.capture_v for r in found.collect()] == ["x"]
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert leaves.size() == 7  # the calls; for each capture its role edges with a node, their nodes, and those without one


def test_pages_are_handed_on_in_parts():
    pages = pd.DataFrame([(f"u{i}", "<p><b>x</b></p>") for i in range(5000)], columns=["path", "html"])
    parts = list(page_rows(iter([pages])))
    assert [len(p) for p in parts] == [4096, 4096, 1808] and list(pd.concat(parts)["parent"].head(2).isna()) == [True, False]


def test_similar_bags_make_no_pairs_on_the_way(spark, monkeypatch):
    monkeypatch.setattr(reports, "BLOCK", 3)
    bag = lambda k, n: {f"t{(k * 7 + i * 5) % 11}": i % 3 + 1 for i in range(n)}
    bags = {side: {f"{side}{k}": bag(k + at, 2 + k % 4) for k in range(8)} for at, side in enumerate("ab")}
    frames = [spark.createDataFrame([(i, x, n) for i, b in bags[side].items() for x, n in b.items()], "id string, token string, n long") for side in "ab"]
    every = [b for side in "ab" for b in bags[side].values()]
    w = {x: math.log((len(every) + 1) / (sum(x in b for b in every) + 0.5)) for b in every for x in b}
    low = lambda a, b: sum(w[x] * min(a[x], b[x]) for x in a.keys() & b.keys())
    want = {(i, j): low(a, b) / (low(a, a) + low(b, b) - low(a, b)) for i, a in bags["a"].items() for j, b in bags["b"].items() if low(a, b)}
    found = reports.bag_similarity(*frames)
    assert {(r.l, r.r): round(r.score, 9) for r in found.collect()} == {k: round(v, 9) for k, v in want.items()}
    some = reports.bag_similarity(*frames, least=0.3)
    assert {(r.l, r.r) for r in some.collect()} == {k for k, v in want.items() if v >= 0.3}
    assert "hashpartitioning(l" not in found._jdf.queryExecution().executedPlan().toString()
    rare = reports.bag_similarity(*frames, most_df=6)
    assert 0 < rare.count() < len(want)
    # The same as taking pairs from the top one by one.
    left, right, taken = set(), set(), set()
    for v, i, j in sorted((-round(v, 12), i, j) for (i, j), v in want.items() if v >= 0.1):
        if i not in left and j not in right:
            taken.add((i, j))
            left.add(i)
            right.add(j)
    scored = spark.createDataFrame([(i, j, round(v, 12)) for (i, j), v in want.items()], "l string, r string, score double")
    assert {(r.l, r.r) for r in reports.greedy_pairs(scored, 0.1).collect()} == taken
