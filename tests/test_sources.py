from pyspark.sql import functions as F

from codestrata.operators import questions as Q
from codestrata.operators import vectors as V
from codestrata.sources.source_tree import source_tree, vue_script


def test_source_tree_and_vue(spark, tmp_path):
    for path in ("src/a.py", "node_modules/b.js", "src/c.txt", "d.vue"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("<template/><script lang='ts'>\nlet a\n</script>")
    got = source_tree(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.py", "d.vue"]
    assert got.select(vue_script(F.col("content"))).first()[0].strip() == "let a"


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    m[5] = m[4]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>")
    found = V.nearest(rows.where("vec_id % 20 = 0"), rows, 5)
    got = {(r.query_id, r["rank"]): r.vec_id for r in found.collect()}
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {}
    for q in (0, 20, 40):
        d = 1 - u @ u[q]
        for k, i in enumerate(np.lexsort((np.arange(60), d))[:5]):
            want[(q, k + 1)] = i
    assert got == want


def test_intents_and_keywords(spark):
    asked = ["谁调用了 A.run", "总共有多少函数", "调用关系有多少条", "hello", None]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    got = [tuple(r) for r in df.select(Q.intent(F.col("q")), Q.keywords(F.col("q"))).collect()]
    assert [g[0] for g in got] == ["callers", "stats", "stats", "unknown", None]
    assert got[0][1] == ["A.run"] and got[3][1] == ["hello"]


def test_citation_gate(spark):
    answers = spark.createDataFrame([(1, "q", "ok [a.py:3]\nbad [zz.py]\nno citation\n推测 [zz.py]"), (2, "q", "")], "item_id long, question string, answer string")
    paths = spark.createDataFrame([("p/a.py",)], "path string")
    got = {r.item_id: (r.verified, r.caught, r.confidence, r.passed) for r in Q.citation_gate(answers, paths).collect()}
    assert got == {1: (1, 1, 0.5, True), 2: (0, 0, 1.0, True)}
