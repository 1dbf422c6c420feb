import datetime as dt
import random

import pytest

from codestrata.operators import snapshots as S
from codestrata.plans import problems
from tests.conftest import T0, rows


def brute(records, delivered):
    by = {}
    for scope, kind, no, path, name, value in records:
        by.setdefault((scope, no), {})[(kind, path, name)] = value
    out = set()
    for scope in {s for s, _ in delivered}:
        numbers = sorted(n for s, n in delivered if s == scope)
        for old, new in zip(numbers, numbers[1:]):
            a, b = by.get((scope, old), {}), by.get((scope, new), {})
            for key in set(a) | set(b):
                kind = "added" if key not in a else "removed" if key not in b else "changed" if a[key] != b[key] else None
                if kind:
                    out.add((scope, key[0], key[1], key[2], new, kind))
    return out


@pytest.mark.parametrize("buckets", [1, 3])
@pytest.mark.parametrize("chunk_rows", [1, 4, 1000])
def test_changes_against_brute_force(spark, buckets, chunk_rows):
    rng = random.Random(5)
    records, delivered = [], []
    for scope in ("hot", "cold"):
        state = {("file", f"{scope}/{i}.py", ""): str(rng.random()) for i in range(80 if scope == "hot" else 5)}
        for no in (1, 3, 4):
            delivered.append((scope, no))
            records += [(scope, *key[:1], no, *key[1:], v) for key, v in state.items()]
            for key in rng.sample(sorted(state), len(state) // 5):
                state[key] = rng.choice([str(rng.random()), None])
            for key in rng.sample(sorted(state), len(state) // 6):
                del state[key]
            state[("function", f"{scope}/{no}.py", f"f{no}")] = "1-2"
    df = spark.createDataFrame(records, "scope string, kind string, snapshot_no int, path string, name string, value string")
    got = S.snapshot_changes(df, spark.createDataFrame(delivered, "scope string, snapshot_no int"), chunk_rows, buckets)
    found = [tuple(r) for r in got.select("scope", "kind", "path", "name", "snapshot_no", "change_kind").collect()]
    assert len(found) == len(set(found)) and set(found) == brute(records, delivered)


def test_snapshot_delivered_empty(spark):
    df = spark.createDataFrame([("p", "file", 1, "p/a", "", "x")], "scope string, kind string, snapshot_no int, path string, name string, value string")
    delivered = spark.createDataFrame([("p", 1), ("p", 2)], "scope string, snapshot_no int")
    assert [r.change_kind for r in S.snapshot_changes(df, delivered).collect()] == ["removed"]


def test_p7_found(spark, folder):
    later = T0 + dt.timedelta(hours=1)
    fn = lambda no, i, q, a, b, file=1, at=T0: {"snapshot_no": no, "func_id": i, "file_id": file, "name": q, "qualified_name": q, "start_line": a, "end_line": b, "loaded_at": at}
    h = lambda no, p, s, at=T0: {"snapshot_no": no, "path": p, "sha1": s, "loaded_at": at}
    d = folder(
        files=[{"file_id": 1, "path": "p/a.py", "name": "a.py", "project": "p"}, {"file_id": 2, "path": "p/b.py", "name": "b.py", "project": "p"}],
        functions=[fn(1, 1, "f", 1, 2), fn(1, 1, "f", 9, 9, at=later), fn(3, 2, "f", 1, 2), fn(1, 3, "g", 1, 1), fn(3, 3, "g", 1, 1), fn(3, 4, "A::m", 3, 4)],
        file_hashes=[h(1, "p/a.py", "AB"), h(3, "./p\\a.py", "ab"), h(1, "p/b.py", "1"), h(1, "p/b.py", "2", later), h(3, "p/b.py", "3"), h(3, "p/c.py", "4"), h(3, None, "4")],
    )
    got = rows(problems.p7_found(spark, d), "rec_kind", "path", "rec_name", "snapshot_no", "change_kind")
    assert got == [("file", "p/b.py", "", 3, "changed"), ("file", "p/c.py", "", 3, "added"), ("function", "p/a.py", "A.m", 3, "added"), ("function", "p/a.py", "f", 3, "changed")]


def test_empty_tables(spark, empty_folder):
    for query in problems.queries().values():
        assert query(spark, empty_folder).count() == 0
