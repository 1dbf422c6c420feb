from codestrata.plans import catalog
from tests.conftest import rows

QUERIES = catalog.queries()


def test_retrieval_has_three_tiers(spark, folder):
    def read(name, *columns):
        return rows(QUERIES[name](spark, d), *columns)

    texts = {1: "x", 2: "fooBar FOOBAR foobar" + " " * 39_980, 3: "foobar", 4: "z", 5: " ", 6: None}
    names = {1: "foo_bar.py", 2: "a.py", 3: "b.py", 4: "c.py", 5: "d.py", 6: "foo_bar_gone.py"}
    asked = {1: 'who calls "fooBar"?', 2: 'who calls "foo_bar"?', 3: "nothing there", 4: "?", 5: None}
    d = folder(
        files=[{"file_id": i, "path": f"p/{n}", "name": n, "project": "p"} for i, n in names.items()],
        file_contents=[{"file_id": i, "content": t} for i, t in texts.items()],
        eval_items=[{"item_id": i, "question": q} for i, q in asked.items()],
    )
    smallest = [(1, 0), (4, 0), (5, 0), (3, 0), (2, 0)]
    want = {1: (2, [(2, 3), (3, 1)]), 2: (1, [(1, 0)]), 3: (3, smallest), 4: (3, smallest), 5: (3, smallest)}
    assert read("question_retrieval", "item_id", "rank", "file_id", "tier", "hits") == sorted(
        ((i, at, f, tier, hits) for i, (tier, files) in want.items() for at, (f, hits) in enumerate(files, 1)), key=repr)
    taken = {(i, f): t for i, f, t in read("question_budget", "item_id", "file_id", "taken")}
    head = len("===== FILE: p/a.py =====\n")
    assert taken[1, 2] == 40_000 and (1, 3) not in taken
    assert taken[2, 1] == len("===== FILE: p/foo_bar.py =====\n") + 1
    assert (3, 5) not in taken and taken[3, 2] == 40_000 - (taken[3, 1] + taken[3, 4] + taken[3, 3]) and taken[3, 3] == head + 6
