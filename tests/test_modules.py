from codestrata.operators import modules
from codestrata.session import Stage
from tests.conftest import rows


def test_rings_of_any_length_are_found(spark):
    ring = [("p", f"m{i}", f"m{(i + 1) % 6}", 1) for i in range(6)]
    pairs = [("p", "m0", "x", 1), ("p", "x", "y", 1), ("p", "y", "x", 1), ("p", "y", "z", 1), ("q", "m0", "m1", 1), ("q", "m1", "m2", 1)]
    deps = spark.createDataFrame(ring + pairs, "project string, from_module string, to_module string, details long")
    found = modules.rings(deps, Stage(spark, "rings"))
    assert rows(found, "project", "ring", "module", "modules") == sorted([("p", "m0", f"m{i}", 6) for i in range(6)] + [("p", "x", m, 2) for m in "xy"], key=repr)
    named = spark.createDataFrame([("p", "m0"), ("q", "m0")], "project string, module string")
    assert rows(modules.ring_stats(named, found), "project", "rings", "on_rings", "largest") == [("p", 2, 8, 6), ("q", 0, 0, 0)]


def test_cycle_of_six_modules_and_all_shorter_ones(spark):
    arcs = [("p", f"m{i}", f"m{(i + 1) % 6}", 1) for i in range(6)] + [("p", "m3", "m1", 1), ("p", "m5", "x", 1), ("p", "x", "y", 1), ("q", "a", "b", 1), ("q", "b", "a", 1)]
    deps = spark.createDataFrame(arcs, "project string, from_module string, to_module string, details long")
    found = modules.cycles(deps, Stage(spark, "cycles"))
    assert rows(found, "project", "cycle", "length") == sorted(
        [("p", "m0->m1->m2->m3->m4->m5->m0", 6), ("p", "m1->m2->m3->m1", 3), ("q", "a->b->a", 2)], key=repr)


def test_no_dependencies_no_cycles(spark):
    deps = spark.createDataFrame([], "project string, from_module string, to_module string, details long")
    assert modules.cycles(deps, Stage(spark, "cycles")).collect() == []


def test_imports_resolve_exactly_then_by_segment_then_by_part(spark, make):
    paths = ["p/core/a.py", "p/io/b.py", "p/storage/c.py", "p/core_x/d.py", "q/core/e.py", "p/lone/f.py", "/g.py"]
    files = make("files", [{"file_id": i, "path": p, "name": p, "project": p[0] if p[0] != "/" else "p"} for i, p in enumerate(paths)])
    sources = ["io", "core.deep.io", "x.storage.y", "stor", "nothing", "cor", None, "core", "io"]
    imports = make("imports", [{"import_id": i, "file_id": 5, "source": s} for i, s in enumerate(sources)] + [{"import_id": 50, "file_id": 4, "source": "io"}])
    want = {}
    modules_of_p = sorted({"core", "io", "storage", "core_x", "lone", ""})
    for s in {s for s in sources if s is not None}:
        near = [m for m in modules_of_p if m in s or s in m]
        target = s if s in modules_of_p else s.split(".")[0] if s.split(".")[0] in modules_of_p else near[0] if near else None
        if target is not None and target != "lone":
            want[target] = want.get(target, 0) + 1
    got = rows(modules.dependencies(files, imports), "project", "from_module", "to_module", "details")
    assert got == sorted((("p", "lone", t, n) for t, n in want.items()), key=repr)
