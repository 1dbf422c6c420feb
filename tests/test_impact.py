"""Change impact against the rule pair by pair, and how much is found once for all namesakes."""

import random
import re

import numpy as np
import pyarrow as pa

from codestrata.operators import impact
from codestrata.operators.impact import Impact, key_depth
from codestrata.session import Stage

SITES = "callee_name string, caller string, file string, line int"


def spaced(name):
    return " " + re.sub(r"(\W)", r" \1 ", name.replace("::", ".")) + " "


def refers(callee, name):
    simple = name.replace("::", ".").split(".")[-1]
    inside = spaced(name) in spaced(callee) or (simple != name and "::" not in callee and spaced(simple) in spaced(callee))
    low = callee.lower()
    return inside and any(low.startswith(n.lower()) or low.endswith(n.lower()) for n in (name, simple))


def walked(sites, source, levels=4):
    first = lambda site: ((site[2] is not None, site[2] or ""), (site[3] is not None, site[3] or 0))
    depth, out, names = {source: 0}, [], {source}
    for level in range(1, levels + 1):
        hit = {}
        for site in sites:
            if site[1] is not None and site[1] not in depth and any(refers(site[0], n) for n in names):
                hit[site[1]] = min(hit.get(site[1], site), site, key=first)
        out += [(source, caller, level, site[2], site[3]) for caller, site in hit.items()]
        names = set(hit)
        depth |= dict.fromkeys(hit, level)
    return out


def test_impact_equals_the_pairwise_walk(spark):
    draw = random.Random(3)
    methods = [f"{c}{sep}{m}" for c in ("Tide", "Loom", "a.Gate") for m in ("put", "peek", "Commit") for sep in (".",)]
    names = [*methods, "fold", "split_map", "commit", "put", "rank", "Solo", "x.Tide"]
    spelled = [*names, "Tide::put", "a::Gate::peek", "self.put", "Loom.put(x).peek", "tide.put.rank", "this.Commit", "q.split_map", "TIDE.put", "loom.peek.more"]
    for _ in range(4):
        sites = [(draw.choice(spelled), draw.choice([*names, None]), draw.choice(["a.py", "b.py", None]), draw.choice([1, 2, 30, None])) for _ in range(14)]
        asked = [*draw.sample(names, 6), "absent", "No.peek", None]
        got = Impact(spark.createDataFrame(sites, SITES), spark.createDataFrame([(n,) for n in asked], "source string"), Stage(spark, "impact")).places()
        want = [row for n in asked if n is not None for row in walked(sites, n)]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_namesakes_are_walked_once(spark):
    owners = [f"C{i}" for i in range(30)]
    sites = [(f"c{i % 7}.put" if i % 2 else f"c{i}.peek", f"{o}.{'peek' if i % 3 else 'put'}", "a.py", i) for i, o in enumerate(owners)]
    asked = spark.createDataFrame([(f"{o}.{m}",) for o in owners for m in ("put", "peek")], "source string")
    impact = Impact(spark.createDataFrame(sites, SITES), asked, Stage(spark, "impact"))
    rows, steps, members = impact.parts
    # 60 sources, but what is reached is held for the two segments alone
    assert members.count() == 60 and members.select("group_id").distinct().count() == 2
    assert rows.count() <= 2 * len(sites) and steps.count() == 2
    assert impact.rows.select(key_depth("key").alias("depth")).where("depth not between 1 and 4").count() == 0
    assert impact.rows.count() == sum(len(walked(sites, f"{o}.{m}")) for o in owners for m in ("put", "peek"))


def test_reached_rows_are_not_shuffled(spark):
    sites = spark.createDataFrame([("a.put", "B.put", "a.py", 1), ("fold", "a.put", "b.py", 2)], SITES)
    asked = spark.createDataFrame([("fold",), ("C.put",)], "source string")
    depths = Impact(sites, asked, Stage(spark, "impact")).depths()
    # what is brought together lies by caller, and neither grouping nor the join with the sources moves it again
    assert depths._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, depths.collect())) == [("C.put", "B.put", 1), ("fold", "B.put", 2), ("fold", "a.put", 1)]


#: Two sources of one segment that come back to themselves, alone in their files or not, and a file that is not known.
LOOPED = [("x.put", "A.put", "a.py", 1), ("x.put", "B.put", "b.py", 2), ("A.put", "C.peek", "b.py", 3), ("y.put", "fold", None, 4), ("fold", "D.rank", "d.py", 5)]
CHANGED = ["A.put", "B.put", "fold", "Z.put", "D.rank"]


def test_review_lists_leave_out_the_source_itself(spark):
    impact = Impact(spark.createDataFrame(LOOPED, SITES), spark.createDataFrame([(n,) for n in CHANGED], "source string"), Stage(spark, "impact"))
    every = [row for n in CHANGED for row in walked(LOOPED, n)]
    assert sorted(map(tuple, impact.direct_callers().collect())) == sorted({r[:2] for r in every if r[2] == 1})
    assert sorted(map(tuple, impact.reached_files().collect())) == sorted({(r[0], r[3]) for r in every if r[3]})


def test_review_counts_leave_out_the_source_itself(spark):
    impact = Impact(spark.createDataFrame(LOOPED, SITES), spark.createDataFrame([(n,) for n in CHANGED], "source string"), Stage(spark, "impact"))
    want = []
    for n in CHANGED:
        if reached := walked(LOOPED, n):
            want.append((n, sum(r[2] == 1 for r in reached), len(reached), len({r[3] for r in reached if r[3]})))
    assert sorted(map(tuple, impact.counts().collect())) == sorted(want)


def test_call_sites_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    sites = spark.createDataFrame(LOOPED, SITES).mapInPandas(counted, SITES)
    impact = Impact(sites, spark.createDataFrame([("A.put",)], "source string"), Stage(spark, "impact"))
    assert impact.calls.count() == len(LOOPED) and read.value == len(LOOPED)


def test_groups_meet_callers_as_numbers(spark):
    impact = Impact(spark.createDataFrame(LOOPED, SITES), spark.createDataFrame([(n,) for n in CHANGED], "source string"), Stage(spark, "impact"))
    depths = impact.depths()
    plan = depths._jdf.queryExecution().executedPlan().toString()
    # the one aggregate of groups and callers is gone: no pair is a row before it is a row of the result's group
    assert "MapInArrow" in plan and "HashAggregate" not in plan
    assert sorted(map(tuple, depths.collect())) == sorted(row[:3] for n in CHANGED for row in walked(LOOPED, n))


def test_file_bits_of_tasks_and_blocks_add_up(monkeypatch):
    draw = random.Random(5)
    steps = np.array([(g, n, draw.randint(0, 3)) for g in (1, 4, 9, 12) for n in draw.sample([1, 4, 7, 9, 12], 3)])
    rows = [(n, f"c{c}", (draw.randint(1, 4) << impact.DEPTH_SHIFT) + (draw.randint(0, 3) << impact.LINE_BITS) + c) for n in (1, 4, 7, 12) for c in range(20) if draw.random() < 0.6]
    want = {}
    for g, n, late in steps.tolist():
        for node, caller, key in rows:
            if node == n and (key >> impact.DEPTH_SHIFT) + late <= 4:
                want[g, caller] = min(want.get((g, caller), 1 << 70), key + (late << impact.DEPTH_SHIFT))
    monkeypatch.setattr(impact, "BLOCK", len(steps) * 3)
    parts = []
    for task in range(3):
        own = [r for r in rows if int(r[1][1:]) % 3 == task]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*own)], names=["node", "caller", "key"])
        parts += [b for b in impact.file_bits([batch.slice(0, 5), batch.slice(5)], steps, 4, 16)]
    files, bits = {}, lambda x: set(np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")).tolist())
    for (g, _), key in want.items():
        files.setdefault((key >> impact.LINE_BITS) & 3, []).append(g)
    merged = [b.to_pylist()[0] for b in impact.merged_bits(sorted(parts, key=lambda b: b["file_no"][0].as_py()))]
    assert [r["file_no"] for r in merged] == [-1, *sorted(f for f in files if f)]
    for r in merged[1:]:
        of = files[r["file_no"]]
        assert bits(r["reached"]) == set(of) and bits(r["shared"]) == {g for g in of if of.count(g) > 1}
    assert merged[0]["callers"] == [sum(g == k for g, _ in want) for k in range(16)]
    assert merged[0]["direct"] == [sum(g == k and key >> impact.DEPTH_SHIFT == 1 for (g, _), key in want.items()) for k in range(16)]


def test_files_of_groups_are_listed_without_pairs_moved(spark):
    reached = Impact(spark.createDataFrame(LOOPED, SITES), spark.createDataFrame([(n,) for n in CHANGED], "source string"), Stage(spark, "impact"))
    files = reached.reached_files()
    plan = files._jdf.queryExecution().executedPlan().toString()
    # lists of groups are taken apart last, and what comes from them meets the sources where it lies
    assert "Generate explode" in plan and "Exchange" not in plan[:plan.index("Generate explode")].replace("BroadcastExchange", "")
    every = [row for n in CHANGED for row in walked(LOOPED, n)]
    assert sorted(map(tuple, files.collect())) == sorted({(r[0], r[3]) for r in every if r[3]})
