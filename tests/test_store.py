"""Lines, hashes, overview and removal on small graphs with nulls, copies and extra columns."""

import hashlib

from codestrata.operators import callgraph, store
from tests.conftest import rows

FILES = [{"file_id": 1, "path": "p/src/a.py", "name": "a.py", "project": "p"}, {"file_id": 2, "path": "p/b.js", "name": "b.js"},
         {"file_id": None, "path": None}, {"file_id": 3, "path": "p/src/c/d.py", "name": "d.py", "project": "p"}]


def test_lines_and_hashes(make):
    contents = make("file_contents", [{"file_id": 1, "content": "x\r\ny\rz\n"}, {"file_id": 2, "content": ""}, {"file_id": 3}, {"content": "q"}], "line string")
    newest = store.newest_contents(contents)
    assert rows(store.numbered_lines(newest, 3), "file_id", "line_no", "line") == [(1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (2, 1, "")]
    assert rows(store.content_hashes(contents), "file_id", "sha1") == [(1, hashlib.sha1(b"x\r\ny\rz\n").hexdigest()), (2, hashlib.sha1(b"").hexdigest())]


def test_overview_counts_records_once(make):
    functions = make("functions", [{"func_id": i, "file_id": f} for i, f in enumerate((1, 1, 3, None))], "project string")
    classes = make("classes", [{"class_id": 1, "file_id": 1}])
    got = rows(store.overview(make("files", FILES, "functions long"), functions, classes), "project", "directory", "files", "python_files", "functions", "classes")
    assert got == [("p", "", 1, 0, 0, 0), ("p", "src", 2, 2, 3, 1)]


def test_removal_cascades_and_keeps_nulls(make):
    files = make("files", FILES, "func_id long")
    functions = make("functions", [{"func_id": 1, "file_id": 1}, {"func_id": 2, "file_id": 1}, {"func_id": 2, "file_id": 3}, {"func_id": None, "file_id": None}])
    edges = make("call_edges", [{"edge_id": i, "caller_func_id": c} for i, c in enumerate((1, 2, None, 9))], "func_id long")
    hashes = make("file_hashes", [{"path": "./p/src/a.py"}, {"path": "p\\src\\a.py"}, {"path": "p/b.js"}, {"path": None}], "file_id long")
    kept = store.remove_files(files.where("file_id = 1").select("file_id", "path"), files, functions, make("classes", [{"class_id": 1, "file_id": 1}]),
                              make("imports", [{"import_id": 1, "file_id": 1}, {"import_id": 2}]), edges, hashes)
    assert rows(kept["files"], "file_id") == sorted([(2,), (3,), (None,)], key=repr)
    assert rows(kept["functions"], "func_id", "file_id") == sorted([(2, 3), (None, None)], key=repr)
    assert rows(kept["call_edges"], "edge_id") == [(1,), (2,), (3,)]
    assert rows(kept["file_hashes"], "path") == sorted([("p/b.js",), (None,)], key=repr)
    assert (kept["classes"].count(), rows(kept["imports"], "import_id")) == (0, [(2,)])


def test_adjacency(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "b"), ("b", "a")], "source string, target string")
    assert rows(callgraph.adjacency(links), "node_id", "callers", "callees") == [("a", "b", "b"), ("b", "a,c", "a"), ("c", "", "b")]
    assert callgraph.adjacency(links.limit(0)).count() == 0
