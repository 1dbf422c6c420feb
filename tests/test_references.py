import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.functions.names import refers, spaced
from codestrata.operators import lookup as L
from codestrata.operators import references as R
from codestrata.plans import problems
from tests.conftest import rows


def reference(callee: str, name: str) -> bool:
    """The rule as written down, with look-arounds."""
    c, f = callee.replace("::", "."), name.replace("::", ".")
    simple = f.split(".")[-1]
    inside = (c == f or c.endswith("." + f) or c.startswith(f + ".") or re.search(rf"(?<!\w){re.escape(f)}(?!\w)", c)
              or (simple != f and "::" not in callee and re.search(rf"(?<!\w){re.escape(simple)}(?!\w)", c)))
    low = callee.lower()
    edge = any(low.startswith(p.lower()) or low.endswith(p.lower()) for p in (name, simple))
    return bool(inside) and edge


WORDS = st.sampled_from(["run", "A.run", "BA.run", "a.run.b", "rerun", "A::run", "self.run", "f(run)", "run2", "x.A.run", "A.run()", "Run", "b.RUN"])


def test_refers_against_the_rule(spark):
    pairs = [(c, n) for c in WORDS.elements for n in ("run", "A.run", "x.A.run", "Run")]
    df = spark.createDataFrame(pairs, "c string, n string").withColumn("got", refers(F.col("c"), spaced(F.col("c")), F.col("n")))
    assert [(r.c, r.n, r.got) for r in df.collect()] == [(c, n, reference(c, n)) for c, n in pairs]


def test_reference_edges_equal_the_pairwise_rule(spark):
    callees = [*WORDS.elements, "", "other"]
    sites = spark.createDataFrame([(i, "m", c, "f", i, "p") for i, c in enumerate(callees)], "edge_id long, caller string, callee_name string, file string, line int, project string")
    names = spark.createDataFrame([("run",), ("A.run",), ("A.run",), (None,)], "target string")
    got = {(r.callee_name, r.target) for r in L.reference_edges(sites, names).collect()}
    assert got == {(c, n) for c in callees for n in ("run", "A.run") if reference(c, n)}


def test_name_probes(spark):
    df = spark.createDataFrame([("a.b::c", None), ("self.x", "A"), ("this::x.y", "N.A"), ("self.x", None), (None, "A"), ("f", "A")], "c string, o string")
    got = [sorted(r[0]) for r in df.select(R.name_probes(F.col("c"), F.col("o"))).collect()]
    assert got == [["a.b.c", "b.c", "c"], ["A.x"], ["N.A.x.y"], [], [], ["f"]]


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    bits = R.filter_size(5000)
    may = R.passes_filter(spark, R.key_filter(keys, bits), bits)
    seen = spark.range(20000).select("id", may(F.xxhash64("id")).alias("m")).collect()
    assert all(r.m for r in seen if r.id < 5000)
    assert np.mean([r.m for r in seen if r.id >= 5000]) < 0.02
    assert not spark.range(1).select(may(F.lit(None).cast("long"))).first()[0]


def test_filter_of_nothing(spark):
    empty = spark.range(0).select(F.col("id").alias("key"))
    may = R.passes_filter(spark, R.key_filter(empty, 1 << 13), 1 << 13)
    assert not any(r[0] for r in spark.range(100).select(may("id")).collect())


@pytest.fixture()
def orphan_folder(folder):
    fn = lambda i, q, file=1, snap=2: {"snapshot_no": snap, "func_id": i, "file_id": file, "name": q.split(".")[-1], "qualified_name": q, "start_line": i, "end_line": i}
    e = lambda i, caller, callee: {"edge_id": i, "caller_func_id": caller, "callee_name": callee}
    return folder(
        files=[{"file_id": 1, "path": "my-app/a.py", "name": "a.py", "project": "my-app"}, {"file_id": 2, "path": "my-app/b.py", "name": "b.py", "project": "my-app"}],
        functions=[fn(1, "A.run"), fn(2, "go"), fn(3, "old", snap=1), fn(4, "main")],
        classes=[{"snapshot_no": 2, "class_id": 1, "file_id": 1, "name": "A", "qualified_name": "A"}],
        imports=[{"import_id": 1, "source": "my_app.util", "names": ["helper", "go"], "is_from": True, "file_id": 1},
                 {"import_id": 2, "source": "os", "names": ["path"], "is_from": True, "file_id": 1}],
        call_edges=[e(1, 1, "print"), e(2, 3, "go"), e(3, 99, "go"), e(4, None, "gone"), e(5, 1, "self.missing"), e(6, 1, "self.run"), e(7, 1, "self.graph.x"),
                    e(8, 1, "helper"), e(9, 1, "go"), e(10, 1, "my_app.util.lost"), e(11, 1, "my_app.go"), e(12, 1, "A"), e(13, 1, "A.lost"), e(14, 1, "path.join"),
                    e(15, 2, "self.missing"), e(8, 1, "helper"), e(16, 1, "my_app::main"), e(17, 1, None), e(None, 1, "helper"), e(18, 2, "this::A.run")],
    )


def test_p5_found(spark, orphan_folder):
    got = rows(problems.p5_found(spark, orphan_folder), "edge_id", "ref_field")
    assert got == sorted([(2, "caller_func_id"), (3, "caller_func_id"), *[(i, "callee_name") for i in (5, 8, 10, 13, 15, 16)]], key=repr)


def test_p5_report(spark, orphan_folder):
    got = rows(problems.p5_report(spark, orphan_folder), "table_name", "ref_field", "period", "orphans")
    assert got == [("call_edges", "callee_name", "2025-03-03", 6), ("call_edges", "caller_func_id", "2025-03-03", 2)]


@given(st.lists(st.sampled_from(["a", "b", "self", "this", "c.d", "e::f"]), min_size=1, max_size=4))
@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
def test_positions_lie_within_the_filter(parts):
    at = R._positions(np.array([hash(tuple(parts))], dtype=np.int64), 1 << 13)
    assert at.shape == (R.FILTER_PROBES, 1) and ((0 <= at) & (at < 1 << 13)).all()


def test_sharded_filter_proves_most_and_loses_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    from codestrata.session import Stage

    monkeypatch.setattr(R, "MAX_FILTER_BITS", 1 << 13)
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    refs = spark.range(6000).withColumn("h", F.xxhash64("id"))
    got = {r.id: r._maybe for r in R.maybe_known(refs, "h", keys, Stage(spark, "shards")).collect()}
    assert len(got) == 6000 and all(got[i] for i in range(3000)) and sum(got[i] for i in range(3000, 6000)) < 150
