"""Loading, look-ups by qualified names, substring joins, stored vectors and streams on small fixtures."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from codestrata.functions import names
from codestrata.functions.names import texts_holding
from codestrata.operators import diff, load, lookup, vectors
from codestrata.operators import questions as Q
from codestrata.plans import catalog
from codestrata.session import Stage, release
from codestrata.streaming import changes
from tests.conftest import T0, rows

CALLERS = [("A.run", "run"), ("BA.run", "run"), ("B.run", "run"), ("A.run.inner", "inner"), ("run", "run"), ("a.RUN", "RUN"), ("A.runner", "runner"), ("x.A.run", "run"),
           ("A.run.z.run", "run"), ("rerun", "rerun"), ("XA.run", "A.run")]


def made_by(caller, name, target):
    simple = target.split(".")[-1]
    near = name == target or caller.lower().endswith(target.lower()) or caller.lower().startswith(target.lower())
    return near and (name == target or caller == target or caller.endswith("." + target) or (simple != target and caller.endswith("." + simple)))


@pytest.mark.parametrize("target", ["A.run", "run", "B.run", "inner", "nothing"])
def test_callees_of_a_qualified_name(spark, target):
    sites = spark.createDataFrame([(i, c, n, f"callee{i}", "f", i, "p") for i, (c, n) in enumerate(CALLERS)],
                                  "edge_id long, caller string, caller_name string, callee_name string, file string, line int, project string")
    want = sorted(((f"callee{i}", i) for i, (c, n) in enumerate(CALLERS) if made_by(c, n, target)), key=repr)
    assert rows(lookup.callees_of(sites, target), "callee", "line") == want
    if "." in target:
        named = spark.createDataFrame([(target,), (target,), (None,)], "target string")
        want = sorted(((f"callee{i}", i) for i, (c, n) in enumerate(CALLERS) if made_by(c, "", target)), key=repr)
        assert rows(lookup.callees_of_each(sites, named), "callee", "line") == want


def test_texts_holding_words_of_any_length(spark):
    texts = ["src/main/app.py", "a", "", None, "aaaaaaaaaaaaaaaa", "main/app", "ünïcode/päth.py"]
    words = ["app.py", "main/app", "a", "aa", "aaaaaaaaa", "päth", "", None, "zzz", "src/main/app.py", "%", "ünïcode/p"]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    want = sorted(((a, b) for a in texts for b in words if a is not None and b and b in a), key=repr)
    assert rows(texts_holding(t, "text", w, "word"), "text", "word") == want


def broadcast_runs(df):
    """Whether the plan that ran broadcasts the runs of a text, not what is joined or summed up from them."""
    df.collect()
    inside = False
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        if inside and "explode(array_distinct(flatten(" in line:
            return True
        inside = "BroadcastExchange" in line or (inside and not re.search("Join|Aggregate|Scan|Range", line))
    return False


def test_runs_of_few_texts_are_not_broadcast(spark):
    def numbered(n, column):
        return spark.range(n).select(F.concat(F.lit("src/main/app_"), F.col("id").cast("string")).alias(column))

    words = numbered(40, "word")
    for asked in (words, F.broadcast(words)):
        held = texts_holding(numbered(4, "text"), "text", asked, "word")
        assert rows(held, "text") == [(f"src/main/app_{i}",) for i in range(4)]
        assert not broadcast_runs(held)


@pytest.mark.parametrize("most", [0, 8 << 20])
def test_citation_gate_broadcasts_no_runs(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(names, "MAX_BROADCAST_WORDS", most, raising=False)
    spark.createDataFrame([(1, "q", "ok [a.py:3]\nbad [zz.py]\nno citation\n推测 [zz.py]"), (2, "q", ""), (3, "q", "[p/a] [a.py]"), (4, "q", None)],
                          "item_id long, question string, answer string").write.parquet(f"{tmp_path}/answers")
    spark.createDataFrame([("p/a.py",), ("p/b.py",)], "path string").write.parquet(f"{tmp_path}/paths")
    gate = Q.citation_gate(spark.read.parquet(f"{tmp_path}/answers"), spark.read.parquet(f"{tmp_path}/paths"))
    assert rows(gate, "item_id", "verified", "caught", "confidence", "passed") == [
        (1, 1, 1, 0.5, True), (2, 0, 0, 1.0, True), (3, 1, 0, 1.0, True), (4, 0, 0, 1.0, True)]
    assert not broadcast_runs(gate)


def test_callers_bind_exactly_then_by_suffix(spark):
    functions = spark.createDataFrame([
        (1, "f", "A.go", "A", 1), (2, "f", "B.go", "B", 9), (3, "f", "go", None, 20), (4, "f", "A.run", "A", 5), (5, "f", "A.run", "A", 7), (6, "g", "C.stop", "C", 1), (7, None, "x", None, 1)],
        "func_id long, path string, qualified_name string, class_name string, start_line int")
    calls = spark.createDataFrame([(1, "f", "go"), (2, "f", "A.run"), (3, "f", "run"), (4, "g", "stop"), (5, "g", "go"), (6, "f", None), (7, "f", "o")], "edge_id long, path string, caller_name string")
    got = rows(load.bind_callers(calls, load.load_order(functions)), "edge_id", "caller_func_id")
    assert got == [(1, 3), (2, 5), (3, 5), (4, 6)]


def test_file_ids_keep_the_known_ones(spark):
    known = spark.createDataFrame([("b.py", 7), ("gone.py", 9), (None, 1)], "path string, file_id long")
    paths = spark.createDataFrame([("z\\y.py",), ("a.py",), ("b.py",), ("a.py",), (None,), ("",)], "path string")
    assert rows(load.file_ids(known, paths), "path", "file_id") == [("a.py", 10), ("b.py", 7), ("z/y.py", 11)]


def test_search_limit_is_clamped(spark, make):
    functions = make("functions", [{"func_id": i, "name": "f", "qualified_name": "f", "start_line": i} for i in range(40)], "path string")
    assert [lookup.search_functions(functions, "f", n).count() for n in (-5, 0, 3, 30, 700)] == [1, 1, 3, 30, 30]


def test_citations_are_any_part_of_a_path(spark):
    answers = spark.createDataFrame([(1, "x [app.py:3]\ny [no/such.py:1]"), (2, "[main/app]"), (3, "[zzz]"), (4, "plain"), (5, None), (6, "[src] and [nope]")], "item_id long, answer string")
    paths = Q.valid_paths(spark.createDataFrame([("p/src/main/app.py",), ("word",), (None,)], "a string"))
    got = rows(Q.citation_gate(answers, paths), "item_id", "verified", "caught", "confidence", "passed")
    assert got == [(1, 1, 1, 0.5, True), (2, 1, 0, 1.0, True), (3, 0, 1, 0.0, False), (4, 0, 0, 1.0, True), (5, 0, 0, 1.0, True), (6, 0, 1, 0.0, False)]
    read = spark.createDataFrame([(1, "p/src/main/app.py"), (6, "p/src/x.py")], "item_id long, path string")
    got = rows(Q.baseline_confidence(answers, read), "item_id", "verified", "bad", "confidence")
    assert got == [(1, 1, 1, 0.5), (2, 0, 1, 0.0), (3, 0, 1, 0.0), (4, 0, 0, 1.0), (5, 0, 0, 1.0), (6, 1, 0, 1.0)]


def test_failed_steps_come_first(spark):
    answers = spark.createDataFrame([(1, "q", "未找到", True), (2, "q", "未找到", False), (3, "q", "ok", None)], "item_id long, question string, answer string, tool_error boolean")
    assert rows(Q.reflect_verdict(answers), "item_id", "verdict") == [(1, "tool_error"), (2, "unresolved"), (3, "none")]


def test_mentioned_words_and_json_parts(spark):
    answers = spark.createDataFrame([(1, "foo() calls bar (x) and foo( "), (2, None)], "item_id long, answer string")
    words = spark.createDataFrame([(1, "foo"), (1, "foo"), (2, "bar")], "item_id long, word string")
    assert rows(Q.mentioned(answers, words), "item_id", "result_count") == [(1, 1), (2, 0)]
    texts = spark.createDataFrame([(1, 'say {"a": [1, 2]} now'), (2, "[1] x [2]"), (3, None), (4, "")], "k long, t string")
    assert rows(Q.json_parts(texts, "k", "t"), "k", "object", "array") == [(1, '{"a": [1, 2]}', "[1, 2]"), (2, None, None), (3, None, None), (4, None, None)]


def test_kept_items_and_summary(spark):
    r = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 1)], "g string, n int")
    kept = Q.kept_items(r, "g", ["n"])
    assert sorted(x.n for x in kept.where("g = 'a'").collect()) == list(range(20)) and {x.omitted for x in kept.where("g = 'a'").collect()} == {5}
    got = rows(Q.result_summary(kept, "g", kept.n.cast("string"), 20), "g", "summary", "chars")
    assert got[1] == ("b", '{"g":"b","items":["1', len('{"g":"b","items":["1"],"omitted":0}')) and len(got[0][1]) == 20


def test_review_lists_are_rows(spark):
    changed = spark.createDataFrame([("f", "modified"), ("g", "removed"), ("h", "added")], "name string, status string")
    reached = spark.createDataFrame([("f", "c1", 1, "x.py", 1), ("f", "c2", 2, "y.py", 1), ("g", "c1", 1, None, None)], "source string, caller string, depth int, file string, line int")
    assert rows(diff.review_lists(changed, reached), "source", "status", "item_kind", "item") == sorted([
        ("f", "modified", "direct_caller", "c1"), ("f", "modified", "affected_file", "x.py"), ("f", "modified", "affected_file", "y.py"), ("g", "removed", "direct_caller", "c1")], key=repr)


def test_vector_store_replaces_and_deletes_by_project(spark):
    stage = Stage(spark, "store")
    shop = vectors.VectorStore(spark, f"{stage.root}/store")
    items = spark.createDataFrame([(1, "a:b c"), (2, "a:b c"), (3, "q")], "func_id long, project string")
    shop.add(items)
    shop.replace_projects(items.where("func_id = 2"))
    assert rows(shop.read(items.schema), "func_id", "project") == [(2, "a:b c"), (3, "q")]
    shop.delete_project("a:b c")
    assert rows(shop.read(items.schema), "func_id", "project") == [(3, "q")]


def test_stream_of_hashes_over_several_batches(spark, make, tmp_path):
    day = dt.timedelta(days=1)
    batches = [[("./a.py", "AA", 1, T0), ("b.py", "b1", 1, T0)], [("a.py", "a2", 2, T0), ("b.py", "b0", 1, T0 - day)], [("b.py", "B2", 1, T0 + day), (None, "x", 1, T0)]]
    for i, batch in enumerate(batches):
        make("file_hashes", [dict(zip(("path", "sha1", "snapshot_no", "loaded_at"), r)) for r in batch]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    schema = spark.read.parquet(f"{tmp_path}/in/0.parquet").schema
    got = changes.stream_hashes(spark, f"{tmp_path}/in/*", schema)
    assert rows(got, "path", "sha1") == [("a.py", "a2"), ("b.py", "b2")]


def test_release_deletes_the_tables_of_runs(spark):
    stage = Stage(spark, "gone")
    stage.keep(spark.range(3))
    assert os.path.isdir(stage.root)
    release(spark)
    assert not os.path.isdir(stage.root)


def test_answers_carry_no_docstrings(spark, folder):
    at = dict(snapshot_no=1, name="go", file_id=1, start_line=3, end_line=4)
    d = folder(
        files=[{"file_id": 1, "path": "p/a.py", "name": "a.py", "project": "p"}],
        functions=[at | {"func_id": 1, "qualified_name": "go", "docstring": x, "class_name": x} for x in ("x", "y", None)] + [at | {"func_id": 2, "qualified_name": "A.go", "start_line": 2}],
        eval_items=[{"item_id": 1, "question": "q", "expected_target": "go", "passage": "so"}, {"item_id": 2, "question": "q", "expected_target": "gone"}])
    answers = catalog.Bound(spark, d).answers()
    assert rows(answers, "item_id", "answer") == [(1, "so\n见 [p/a.py:2]"), (2, "")]
    assert "docstring" not in answers._jdf.queryExecution().executedPlan().toString()
