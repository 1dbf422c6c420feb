"""A small local session and builders of graph tables."""

from __future__ import annotations

import datetime as dt

import pytest

from codestrata.session import local_session, ship

T0 = dt.datetime(2025, 3, 3, 12)

SCHEMAS = {
    "files": "file_id long, path string, name string, project string",
    "file_contents": "file_id long, content string, loaded_at timestamp_ntz",
    "functions": "snapshot_no int, func_id long, name string, file_id long, qualified_name string, start_line int, end_line int, "
                 "docstring string, is_method boolean, class_name string, loaded_at timestamp_ntz",
    "classes": "snapshot_no int, class_id long, name string, file_id long, qualified_name string, start_line int, end_line int, "
               "docstring string, base_classes array<string>, loaded_at timestamp_ntz",
    "call_edges": "edge_id long, caller_func_id long, callee_name string, caller_line int, loaded_at timestamp_ntz",
    "imports": "import_id long, source string, names array<string>, is_from boolean, file_id long",
    "file_hashes": "snapshot_no int, path string, sha1 string, loaded_at timestamp_ntz",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, channel string, collected_at timestamp_ntz",
    "doc_labels": "doc_id long, label string, annotator string, labelled_at timestamp_ntz",
    "eval_items": "item_id long, suite string, category string, question string, expected_type string, expected_target string, "
                  "min_count int, keywords array<string>, passage string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """make(table, rows): rows are dicts; missing columns are null, loaded_at is T0."""

    def build(name: str, rows: list[dict], extra: str = ""):
        schema = SCHEMAS[name] + (", " + extra if extra else "")
        columns = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(c, T0 if c == "loaded_at" else None) for c in columns) for r in rows], schema)

    return build


@pytest.fixture()
def folder(spark, make, tmp_path):
    """folder(**tables): a graph folder with the given rows; tables not named are empty."""

    def build(**tables):
        for name in SCHEMAS:
            make(name, tables.get(name, [])).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return build


@pytest.fixture(scope="session")
def empty_folder(make, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in SCHEMAS:
        make(name, []).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
