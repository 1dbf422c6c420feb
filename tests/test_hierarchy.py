from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codestrata.operators import hierarchy as H
from codestrata.plans import problems
from tests.conftest import rows


def brute(pairs):
    up = {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)
    out = set()
    for n in up:
        seen, queue = {}, deque([(n, 0)])
        while queue:
            x, d = queue.popleft()
            for y in up.get(x, ()):
                if y not in seen:
                    seen[y] = d + 1
                    queue.append((y, d + 1))
        out |= {(n, a, d) for a, d in seen.items()}
    return out


GRAPHS = {
    "tree": [(2, 1), (3, 1), (4, 2), (5, 4), (5, 4)],
    "diamond": [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (5, 1)],
    "loop": [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)],
    "two parts": [(2, 1), (12, 11), (13, 12), (11, 13)],
    "nulls": [(2, 1), (None, 1), (3, None)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("most", [H.MAX_COMPONENT_LINKS, 2])
def test_ancestors_against_brute_force(spark, name, most):
    pairs = GRAPHS[name]
    links = spark.createDataFrame(pairs, "child long, parent long")
    found, back = H.ancestors(links, max_component=most)
    clean = [(c, p) for c, p in pairs if c is not None and p is not None]
    assert {tuple(r) for r in found.collect()} == brute(clean)
    closing = {tuple(r) for r in back.select("child", "parent").collect()}
    assert closing <= set(clean)
    loops = {n for n, a, _ in brute(clean) if n == a}
    assert bool(closing) == bool(loops)


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 9)), max_size=25))
@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
def test_component_walk_against_brute_force(pairs):
    parents = {}
    for c, p in set(pairs):
        parents.setdefault(c, []).append(p)
    found, _ = H._component_rows(parents)
    assert set(found) == brute(pairs) and len(found) == len(set(found))


def test_deep_chain_needs_no_recursion():
    parents = {i: [i - 1] for i in range(1, 3000)}
    found, back = H._component_rows(parents)
    assert not back and len(found) == 2999 * 3000 // 2


def _longest_frame(pairs, slices=1):
    """Rows, sum of distances and the longest frame of a walk over one component."""
    import pandas as pd

    links = pd.DataFrame(pairs, columns=["child", "parent"]).assign(component=0, slices=slices)
    total = far = longest = 0
    for part in range(slices):
        batches = (links.iloc[at:at + 10_000].assign(slice=part) for at in range(0, len(links), 10_000))
        for frame in H._walk(batches):
            total, far, longest = total + len(frame), far + int(frame["distance"].sum()), max(longest, len(frame))
    return total, far, longest


def test_chain_of_20000_comes_in_bounded_frames():
    n = 20_000
    total, far, longest = _longest_frame([(i, i - 1) for i in range(1, n + 1)])
    assert total == n * (n + 1) // 2 and far == n * (n + 1) * (n + 2) // 6
    assert longest < H.ROWS_PER_BATCH + n


def test_loop_of_5000_comes_in_bounded_frames():
    n = 5_000
    total, far, longest = _longest_frame([(i, (i + 1) % n) for i in range(n)], slices=3)
    assert total == n * n and far == n * n * (n + 1) // 2
    assert longest < H.ROWS_PER_BATCH + n


@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 12)), max_size=30), st.integers(0, 6))
@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
def test_walk_that_remembers_little_against_brute_force(pairs, remember):
    parents = {}
    for c, p in set(pairs):
        parents.setdefault(c, []).append(p)
    got = [(node, up, far) for node, own in H._reached(parents, remember) for up, far in own.items()]
    assert set(got) == brute(pairs) and len(got) == len(set(got))


@pytest.mark.parametrize("name", GRAPHS)
def test_sliced_components_against_brute_force(spark, monkeypatch, name):
    monkeypatch.setattr(H, "LINKS_PER_SLICE", 2)
    clean = [(c, p) for c, p in GRAPHS[name] if c is not None and p is not None]
    found, loops = H.ancestors(spark.createDataFrame(GRAPHS[name], "child long, parent long"))
    want = brute(clean)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    pairs = {(n, a) for n, a, _ in want}
    assert sorted(map(tuple, loops.collect())) == sorted({(c, p) for c, p in clean if (p, c) in pairs})


def test_hierarchy_and_paths(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 4)], "child long, parent long")
    closure, _ = H.ancestors(links)
    got = {r.node: (r.depth, r.root, r.descendants, r.is_cyclic) for r in H.hierarchy(closure, links).collect()}
    assert got == {1: (0, 1, 2, False), 2: (1, 1, 1, False), 3: (2, 1, 0, False), 4: (1, None, 1, True)}
    paths = {(r.node, r.ancestor): r.next for r in H.shortest_paths(closure, links).collect()}
    assert paths == {(2, 1): 1, (3, 2): 2, (3, 1): 2, (4, 4): 4}


def test_p2_found_over_tables(spark, folder):
    f = [{"file_id": 1, "path": "my-app/a.py", "name": "a.py", "project": "my-app"}, {"file_id": 2, "path": "other/b.py", "name": "b.py", "project": "other"}]
    fn = lambda i, q, file=1, snap=2: {"snapshot_no": snap, "func_id": i, "file_id": file, "name": q.split(".")[-1].split("::")[-1], "qualified_name": q, "start_line": i, "end_line": i}
    cl = lambda i, n, bases, file=1, snap=2: {"snapshot_no": snap, "class_id": i, "file_id": file, "name": n, "qualified_name": n, "base_classes": bases}
    e = lambda i, caller, callee: {"edge_id": i, "caller_func_id": caller, "callee_name": callee}
    d = folder(
        files=f,
        functions=[fn(1, "A.run"), fn(2, "A::go"), fn(3, "helper"), fn(4, "main"), fn(5, "helper", 2), fn(9, "old", snap=1)],
        classes=[cl(1, "A", ["lib.Base[T]", "Unknown"]), cl(2, "Base", ["Base"]), cl(3, "Base", [], 2), cl(4, "C", None)],
        call_edges=[e(1, 1, "self.go"), e(2, 2, "my_app.util.helper"), e(2, 2, "my_app.util.helper"), e(3, 3, "main"), e(4, None, "helper"), e(5, 3, "xhelper"),
                    e(6, 9, "helper"), e(7, 3, "self.go"), e(8, 2, None), e(9, 4, "A::run")],
    )
    got = rows(problems.p2_found(spark, d), "rec_kind", "node_id", "ancestor_id", "distance")
    assert got == sorted([
        ("call", 2, 1, 1), ("call", 3, 2, 1), ("call", 3, 1, 2), ("call", 1, 4, 1), ("call", 2, 4, 2), ("call", 3, 4, 3),
        ("class", 1, 2, 1), ("class", 2, 2, 1),
    ], key=repr)


@pytest.mark.parametrize("most", [H.MAX_COMPONENT_LINKS, 2])
def test_cycles_have_one_definition_at_every_size(spark, most):
    from codestrata.session import Stage

    pairs = [(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7), (8, 9)]
    _, loops = H.ancestors(spark.createDataFrame(pairs, "child long, parent long"), max_component=most)
    got = rows(H.cycles(loops, Stage(spark, "cycles")), "cycle", "child", "parent")
    assert got == [(1, 1, 2), (1, 1, 3), (1, 2, 3), (1, 3, 1), (4, 4, 5), (4, 5, 4), (7, 7, 7)]


def test_p2_hierarchy_has_every_record_and_root(spark, folder):
    fn = lambda i, q: {"snapshot_no": 1, "func_id": i, "file_id": 1, "name": q, "qualified_name": q, "start_line": i, "end_line": i}
    d = folder(
        files=[{"file_id": 1, "path": "p/a.py", "name": "a.py", "project": "p"}],
        functions=[fn(1, "one"), fn(2, "two"), fn(3, "both"), fn(4, "alone"), fn(5, "again")],
        classes=[{"snapshot_no": 1, "class_id": 1, "file_id": 1, "name": "Lone", "qualified_name": "Lone"}],
        call_edges=[{"edge_id": i, "caller_func_id": a, "callee_name": b} for i, (a, b) in enumerate([(1, "both"), (2, "both"), (5, "again")])],
    )
    got = rows(problems.p2_hierarchy(spark, d), "rec_kind", "node_id", "depth", "root_id", "descendants", "is_cyclic")
    assert got == sorted([
        ("call", 1, 0, 1, 1, False), ("call", 2, 0, 2, 1, False), ("call", 3, 1, 1, 0, False), ("call", 3, 1, 2, 0, False),
        ("call", 4, 0, 4, 0, False), ("call", 5, 1, None, 1, True), ("class", 1, 0, 1, 0, False),
    ], key=repr)
    assert rows(problems.p2_cycles(spark, d), "rec_kind", "cycle_id", "node_id", "parent_id") == [("call", 5, 5, 5)]


@pytest.mark.parametrize("most", [H.MAX_COMPONENT_LINKS, 2])
def test_root_paths_of_trees_and_closed_cycles(spark, most):
    from codestrata.session import Stage

    pairs = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (6, 7), (7, 8), (8, 7), (9, 6), (8, 10), (11, 12), (12, 13), (13, 12)]
    links = spark.createDataFrame(pairs, "child long, parent long")
    closure, _ = H.ancestors(links, max_component=most)
    got = rows(H.root_paths(H.shortest_paths(closure, links), H.path_ends(closure), Stage(spark, "paths")), "node", "root", "distance", "path")
    want = {2: [2, 1], 3: [3, 1], 4: [4, 2, 1], 5: [5, 4, 2, 1], 6: [6, 7, 8, 10], 7: [7, 8, 10], 8: [8, 10], 9: [9, 6, 7, 8, 10], 11: [11, 12], 13: [13, 12]}
    assert got == sorted(((n, p[-1], len(p) - 1, p) for n, p in want.items()), key=repr)


def test_long_chain_and_loop_by_joins(spark):
    n = 300
    pairs = [(i, i - 1) for i in range(1, n)] + [(1000 + i, 1000 + (i + 1) % 40) for i in range(40)]
    got = H.ancestors(spark.createDataFrame(pairs, "child long, parent long"), max_component=2)[0]
    assert {tuple(r) for r in got.collect()} == brute(pairs) and got.count() == len(brute(pairs))


def test_components_against_brute_force(spark, monkeypatch):
    import random

    from codestrata.session import Stage

    monkeypatch.setattr(H, "LINKS_PER_CHUNK", 7)
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(500 + i, 501 + i) for i in range(90)] + [(7, 700 + i) for i in range(60)] + [(900, 900)]
    label = {n: n for p in pairs for n in p}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    links = spark.createDataFrame(pairs, "child long, parent long").repartition(5)
    assert rows(H.components(links, Stage(spark, "components")), "node", "component") == sorted(label.items(), key=repr)
