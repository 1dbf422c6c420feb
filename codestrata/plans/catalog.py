"""Queries of the code graph's own operators, each bound to the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.names import simple_name
from codestrata.operators import callgraph, diff, impact, load, lookup, modules, questions, store, vectors
from codestrata.operators.snapshots import graph_records, ranged_records
from codestrata.session import Stage
from codestrata.sources.source_tree import EXTENSIONS, SKIPPED_DIRECTORIES, vue_script
from codestrata.sources.tables import Graph, function_records, newest_rows, plain_path, project_files, table
from codestrata.streaming import changes, trace

#: The name that the point queries ask for; every test table has functions of it.
NAME, WORD = "commit", "mosaic"


class Bound:
    """The views that the queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.graph = Graph(spark, folder)

    @cached_property
    def functions(self) -> DataFrame:
        return self.graph.latest_functions(extra=("class_name", "docstring"))

    @cached_property
    def classes(self) -> DataFrame:
        return self.graph.latest_classes()

    @cached_property
    def sites(self) -> DataFrame:
        return lookup.call_sites(self.graph.call_edges, self.functions)

    @cached_property
    def pairs(self) -> DataFrame:
        return diff.latest_pairs(self.graph.delivered())

    @cached_property
    def records(self) -> DataFrame:
        g = self.graph
        return graph_records(g.files, g.functions, g.classes, g.file_hashes).withColumnRenamed("scope", "project")

    def changed_functions(self, statuses: tuple[str, ...] = ("added", "modified")) -> DataFrame:
        """name and status of functions that differ between the last two snapshots."""
        functions, pairs = self.recent
        # both groupings after this lie as these rows do
        together = functions.drop("head_no", "base_no").repartition("project", "path", "qualified_name")
        rows = ranged_records(together, "function").withColumnRenamed("scope", "project")
        return diff.record_changes(rows, pairs, ["project", "path", "name"]).where(F.col("status").isin(*statuses)).select("name", "status").distinct()

    @cached_property
    def recent(self) -> tuple[DataFrame, DataFrame]:
        """The functions, without their texts, of the last two snapshots of each project, and ``pairs``; made once, and earlier snapshots go no further."""
        stage = Stage(self.spark, "recent")
        pairs = stage.keep(self.pairs)
        functions = function_records(self.graph.functions, self.graph.files).join(pairs, "project").where("snapshot_no = head_no or snapshot_no = base_no")
        return stage.keep(functions), pairs

    def paths(self) -> DataFrame:
        """Every string of the tables that may be cited as a path."""
        g = self.graph
        return questions.valid_paths(g.files.select("path"), g.files.select("name"), g.file_hashes.select("path"), g.imports.select("source"))

    def keys(self, name: str, key: str) -> DataFrame:
        """The latest records of a table by their key alone, for counting."""
        rows = newest_rows(getattr(self.graph, name).where(F.col(key).isNotNull()), ["snapshot_no", key], ["file_id"])
        owner = project_files(self.graph.files).select("file_id", "project")
        return rows.join(owner, "file_id").join(self.graph.latest(), ["project", "snapshot_no"], "left_semi")

    def hashes(self) -> tuple[DataFrame, DataFrame]:
        rows = self.records.where("kind = 'file'").select("project", "path", "snapshot_no", F.col("value").alias("sha1"))
        return diff.versions(rows, self.pairs)

    def dependencies(self) -> DataFrame:
        return modules.dependencies(self.graph.files, self.graph.imports)

    def impact_of(self, sources: DataFrame) -> DataFrame:
        return self.reach(sources).places()

    def reach(self, sources: DataFrame) -> impact.Impact:
        # neither the texts of self.functions nor distinct edges: only the least place of a call counts
        sites = lookup.call_sites(self.graph.call_edges, self.recent[0].where("snapshot_no = head_no"), every=True)
        return impact.Impact(sites, sources, Stage(self.spark, "impact"))

    def answers(self) -> DataFrame:
        """item_id, question and an answer that cites the place of the expected function."""
        items = table(self.spark, self.folder, "eval_items")
        # without the texts of self.functions, which settle no tie of what is taken here
        at = self.graph.latest_functions().groupBy("name").agg(F.min(F.struct("path", "start_line", "func_id")).alias("at"))
        cited = F.concat(F.lit("\n见 ["), F.col("at.path"), F.lit(":"), F.col("at.start_line").cast("string"), F.lit("]"))
        return items.join(at, items.expected_target == at.name, "left").select(
            "item_id", "question", F.concat(F.coalesce("passage", F.lit("")), F.coalesce(cited, F.lit(""))).alias("answer"))


def _q(function):
    return lambda spark, folder: function(Bound(spark, folder))


def _named(b: Bound, name: str = NAME) -> DataFrame:
    return b.spark.range(1).select(F.lit(name).alias("source"))


def _top_node(b: Bound) -> DataFrame:
    return callgraph.nodes(callgraph.degrees(b.graph.call_edges, b.functions), 1)


def _shown(b: Bound) -> DataFrame:
    return Stage(b.spark, "nodes").keep(callgraph.nodes(callgraph.degrees(b.graph.call_edges, b.functions)))


def _ego(b: Bound) -> DataFrame:
    shown = _shown(b)
    centre = shown.orderBy(F.desc(F.col("calls") + F.col("called_by")), "node_id").limit(1)
    return callgraph.ego_network(callgraph.links(b.sites, shown), centre)


def _layers(b: Bound) -> DataFrame:
    return modules.layers(modules.fan(b.dependencies()))


def _module_stats(b: Bound) -> DataFrame:
    deps = Stage(b.spark, "modules").keep(b.dependencies())
    return modules.module_stats(modules.modules(b.graph.files), deps, modules.cycles(deps, Stage(b.spark, "cycles")))


def _diff(kind: str):
    def run(b: Bound) -> DataFrame:
        rows = b.records.where(F.col("kind") == kind)
        return diff.record_changes(rows, b.pairs, ["project", "path", "name"]).where("status <> 'same'").select("path", "name", "status")

    return run


def _diff_stats(b: Bound) -> DataFrame:
    changed = diff.record_changes(b.records, b.pairs, ["kind", "project", "path", "name"])
    return changed.groupBy("kind", "project", "status").agg(F.count(F.lit(1)).alias("n"))


def _diff_callees(b: Bound) -> DataFrame:
    """What late deliveries add: call sites of each project's first day against all of them."""
    late = b.graph.call_edges.select("edge_id", "loaded_at")
    sites = b.sites.join(late.groupBy("edge_id").agg(F.min("loaded_at").alias("loaded_at")), "edge_id")
    start = sites.groupBy("project").agg(F.min("loaded_at").alias("start"))
    early = sites.join(start, "project").where("loaded_at < start + interval 1 day")
    return diff.callee_changes(early, sites)


def _sync_plan(b: Bound) -> DataFrame:
    base, head = b.hashes()
    return diff.sync_plan(base, head)


def _sync_apply(b: Bound) -> DataFrame:
    """All tables of the graph after the sync; imports and calls belong to the files that each version lists."""
    stage = Stage(b.spark, "sync")
    base, head = (stage.keep(h.select("project", "path")) for h in b.hashes())
    plan = stage.keep(_sync_plan(b))
    columns = ["kind", "project", "path", "name", "value"]
    sides = diff.versions(b.records.where("kind <> 'file'"), b.pairs)
    owner = b.graph.files.select("file_id", "path")
    imports = b.graph.imports.where("source is not null").select("import_id", "file_id", "source").distinct().join(owner, "file_id").select(
        F.lit("import").alias("kind"), "path", F.col("source").alias("name"), F.lit("").alias("value"))
    calls = b.sites.select(F.lit("call").alias("kind"), F.col("file").alias("path"), F.concat_ws(">", "caller", "callee_name").alias("name"),
                           F.coalesce(F.col("line").cast("string"), F.lit("?")).alias("value"))
    hanging = stage.keep(imports.unionByName(calls))
    indexed, parsed = (rows.select(columns).unionByName(hanging.join(listed, "path").select(columns)) for rows, listed in zip(sides, (base, head)))
    return diff.sync_apply(indexed, parsed, plan).select("kind", "path", "name", F.col("value").alias("lines"))


def _hash_record(b: Bound) -> DataFrame:
    """Hashes of the latest files that gave any function or class."""
    _, head = b.hashes()
    parsed = b.functions.select("path").unionByName(b.classes.select("path"))
    return diff.recorded_hashes(head, parsed)


def _review_lists(b: Bound) -> DataFrame:
    changed = Stage(b.spark, "review").keep(b.changed_functions(("added", "modified", "removed")))
    reached = b.reach(changed.select(F.col("name").alias("source")))
    return diff.listed_items(changed, reached.direct_callers(), reached.reached_files())


def _review_recall(b: Bound) -> DataFrame:
    """Of the functions that each suite asks for, those that changed, and those whose keywords the passage holds."""
    expected = _items(b).select("suite", F.col("expected_target").alias("target"), F.col("passage").alias("summary"), F.col("keywords").alias("hints"))
    changed = b.changed_functions(("added", "modified", "removed")).select(simple_name(F.col("name")).alias("name"))
    return diff.review_recall(expected, changed)


def _called_methods(b: Bound) -> DataFrame:
    names = b.functions.where((F.col("name") == NAME) & F.contains("qualified_name", F.lit("."))).select(F.col("qualified_name").alias("target"))
    return lookup.callees_of_each(b.sites, names)


def _file_ids(b: Bound) -> DataFrame:
    """Ids of every path that a file hash names: those of files, and new ones."""
    return load.file_ids(b.graph.files, b.graph.file_hashes.select(plain_path(F.col("path")).alias("path")))


def _bound_edges(b: Bound) -> DataFrame:
    """The calls of the latest snapshots, their callers given by qualified and by simple name, bound to functions of their files."""
    called = b.graph.call_edges.where("callee_name is not null").select("edge_id", "caller_func_id", "callee_name", "caller_line").distinct()
    facts = called.join(b.functions.select(F.col("func_id").alias("caller_func_id"), "path", "name", "qualified_name"), "caller_func_id")
    spelled = facts.select("edge_id", "path", F.explode(F.array(
        F.struct(F.lit("qualified").alias("spelled"), F.col("qualified_name").alias("caller_name")),
        F.struct(F.lit("simple").alias("spelled"), F.col("name").alias("caller_name")))).alias("x")).select("edge_id", "path", "x.spelled", "x.caller_name")
    return load.bind_callers(spelled, load.load_order(b.functions)).select("edge_id", "spelled", "caller_func_id")


def _loaded(b: Bound) -> DataFrame:
    """Rows of each table once the parse results of the latest snapshots are loaded."""
    ids = load.file_ids(b.graph.files.limit(0), b.functions.select("path").union(b.classes.select("path")))
    imports = b.graph.imports.where("source is not null").select("import_id", "file_id", "source").distinct().join(
        b.graph.files.select("file_id", "path"), "file_id").join(ids.select("path"), "path", "left_semi")
    return lookup.graph_stats(files=ids, functions=b.functions, classes=b.classes, imports=imports, call_edges=_bound_edges(b).where("spelled = 'qualified'"))


def _semantic(b: Bound) -> DataFrame:
    """Each vector against the least-numbered one of its label."""
    rows = table(b.spark, b.folder, "embeddings").where("vec_id is not null and embedding is not null")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    return vectors.semantic_hits(rows.join(first, "label").select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("a"), "b"))


def _fallback(b: Bound) -> DataFrame:
    """An item's vector is the one of its number; all vectors are the store."""
    rows = table(b.spark, b.folder, "embeddings").select("vec_id", "embedding")
    return questions.fallback_results(_items(b), rows.withColumnRenamed("vec_id", "item_id"), rows)


def _vector_store(b: Bound) -> DataFrame:
    """Items stored per project, after the least project is deleted and the next one indexed twice."""
    stage = Stage(b.spark, "vectors")
    items = stage.keep(vectors.index_items(b.functions).where("project is not null"))
    shop = vectors.VectorStore(b.spark, f"{stage.root}/store")
    shop.add(items)
    names = [r.project for r in items.select("project").distinct().orderBy("project").limit(2).collect()]
    if names:
        shop.delete_project(names[0])
        shop.replace_projects(items.where(F.col("project") == names[-1]))
        shop.delete_project(names[0])
    schema = "func_id long, item_id string, document string, project string"
    return shop.read(schema).groupBy("project").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("document")).alias("chars")) if names else (
        items.groupBy("project").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("document")).alias("chars")))


def _baseline(b: Bound) -> DataFrame:
    """item_id, words of the answer known to the files read, and confidence in its citations."""
    stage = Stage(b.spark, "baseline")
    answers = stage.keep(b.answers().select("item_id", "answer"))
    read = stage.keep(_retrieval(b).select("item_id", "file_id", "path"))
    words = store.newest_contents(b.graph.file_contents).join(read, "file_id").select(
        "item_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(questions.CALL_WORD), 1))).alias("word"))
    return questions.mentioned(answers, words).join(questions.baseline_confidence(answers, read), "item_id")


def _empty(b: Bound) -> DataFrame:
    found = b.functions.groupBy(F.col("name").alias("expected_target")).agg(F.count(F.lit(1)).alias("n"), F.min("docstring").alias("detail"))
    return _items(b).join(found, "expected_target", "left").select("item_id", questions.is_empty(F.col("n"), F.col("detail")).alias("empty"))


def _text_intents(b: Bound) -> DataFrame:
    """Intent and keyword of every document, read as a question."""
    text = F.col("text")
    return table(b.spark, b.folder, "documents").select("doc_id", questions.intent(text).alias("detected"), questions.raw_keyword(text).alias("word"))


def _review(b: Bound) -> DataFrame:
    changed = Stage(b.spark, "review").keep(b.changed_functions())
    return diff.counted(changed, b.reach(changed.select(F.col("name").alias("source"))).counts())


def _vectors(b: Bound) -> DataFrame:
    rows = table(b.spark, b.folder, "embeddings")
    found = vectors.nearest(rows.where("vec_id % 100 = 0"), rows)
    return found.select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


def _items(b: Bound) -> DataFrame:
    return table(b.spark, b.folder, "eval_items")


def _counts(b: Bound) -> DataFrame:
    named = b.functions.groupBy(F.col("name").alias("expected_target")).agg(F.count(F.lit(1)).alias("result_count"))
    return _items(b).select("item_id", "expected_target").join(named, "expected_target").select("item_id", "result_count")


def _scores(b: Bound) -> DataFrame:
    answers = Stage(b.spark, "scores").keep(b.answers())
    gate = questions.citation_gate(answers, b.paths())
    return questions.scores(_items(b), answers.select("item_id", "answer"), gate.select("item_id", "confidence"), _counts(b))


def _budget(b: Bound) -> DataFrame:
    return questions.context_budget(questions.naive_retrieval(b.graph.file_contents, WORD))


def _retrieval(b: Bound) -> DataFrame:
    return questions.question_retrieval(_items(b), b.graph.files, b.graph.file_contents, Stage(b.spark, "retrieval"))


def _scripts(b: Bound) -> DataFrame:
    """First script element of every content with markup; 0 characters where it has none."""
    body = vue_script(F.col("content"))
    marked = F.lower("content").rlike("<(html|script|template)")
    return b.graph.file_contents.where(marked).select("file_id", F.length(body).alias("script_chars"))


def _trace_stream(b: Bound) -> DataFrame:
    # the pattern lets the stream read a table of one file as well as a folder of files
    return trace.stream_summary(b.spark, f"{b.folder}/events.parque[t]", table(b.spark, b.folder, "events").schema)


def _read_file(b: Bound) -> DataFrame:
    """The first lines of the first file by path that matches the word and has content."""
    contents = store.newest_contents(b.graph.file_contents)
    hit = lookup.search_files(b.graph.files.join(contents.select("file_id"), "file_id", "left_semi"), WORD, 1)
    return store.numbered_lines(contents.join(hit.select("file_id"), "file_id", "left_semi")).select("line_no", "line")


def _removed(b: Bound) -> DataFrame:
    """What each table holds once the files whose path contains the word are removed."""
    g = b.graph
    gone = g.files.where(F.contains("path", F.lit(WORD))).select("file_id", "path")
    return lookup.graph_stats(**store.remove_files(gone, g.files, g.functions, g.classes, g.imports, g.call_edges, g.file_hashes))


def _related(b: Bound) -> DataFrame:
    """Impact of every function whose name contains the word: callers and the levels they are reached at."""
    sources = b.functions.where(F.contains("name", F.lit(WORD))).select(F.col("qualified_name").alias("source"))
    return b.reach(sources).depths().select("caller", "depth").distinct()


def queries() -> dict:
    bound = {
        "callers_of": lambda b: lookup.callers_of(b.sites, NAME),
        "callees_of_methods": _called_methods,
        "callees_of": lambda b: lookup.callees_of(b.sites, NAME),
        "search_functions": lambda b: lookup.search_functions(b.functions, WORD),
        "search_files": lambda b: lookup.search_files(b.graph.files, WORD),
        "function_detail": lambda b: lookup.function_detail(b.functions, NAME),
        "file_structure": lambda b: lookup.file_structure(lookup.search_files(b.graph.files, WORD, 1), b.functions, b.classes),
        "structure_by_file": lambda b: lookup.structure_by_file(b.graph.files, b.functions, WORD),
        "graph_stats": lambda b: lookup.graph_stats(files=b.graph.files, functions=b.keys("functions", "func_id"), classes=b.keys("classes", "class_id"),
                                                    call_edges=b.graph.call_edges.select("edge_id").distinct(), imports=b.graph.imports.select("import_id").distinct()),
        "change_impact": lambda b: b.impact_of(_named(b)).select("caller", "depth", "file", "line"),
        "impact_batch": lambda b: b.reach(b.changed_functions().select(F.col("name").alias("source"))).depths(),
        "affected_files": lambda b: impact.affected_files(b.impact_of(_named(b))),
        "related_impact": _related,
        "read_file": _read_file,
        "content_hashes": lambda b: store.content_hashes(b.graph.file_contents),
        "project_overview": lambda b: store.overview(b.graph.files, b.functions, b.classes),
        "graph_remove": _removed,
        "module_dependencies": lambda b: b.dependencies(),
        "module_fan": lambda b: modules.fan(b.dependencies()),
        "core_modules": lambda b: modules.core_modules(modules.fan(b.dependencies())),
        "module_cycles": lambda b: modules.cycles(Stage(b.spark, "cycles").keep(b.dependencies()), Stage(b.spark, "cycles")),
        "module_files": lambda b: modules.module_files(b.graph.files, b.graph.imports),
        "module_rings": lambda b: modules.rings(b.dependencies(), Stage(b.spark, "rings")),
        "module_ring_stats": lambda b: modules.ring_stats(modules.modules(b.graph.files), modules.rings(b.dependencies(), Stage(b.spark, "rings"))),
        "module_layers": _layers,
        "module_stats": _module_stats,
        "module_orphans": lambda b: modules.orphans(modules.modules(b.graph.files), b.dependencies()),
        "call_degrees": lambda b: callgraph.degrees(b.graph.call_edges, b.functions).select("func_id", "calls", "called_by"),
        "callgraph_nodes": lambda b: callgraph.nodes(callgraph.degrees(b.graph.call_edges, b.functions)),
        "callgraph_links": lambda b: callgraph.links(b.sites, _shown(b)),
        "callgraph_adjacency": lambda b: callgraph.adjacency(callgraph.links(b.sites, _shown(b))),
        "callgraph_search": lambda b: callgraph.search_nodes(callgraph.nodes(callgraph.degrees(b.graph.call_edges, b.functions)), WORD),
        "ego_network": _ego,
        "diff_files": _diff("file"),
        "diff_functions": _diff("function"),
        "diff_classes": _diff("class"),
        "diff_stats": _diff_stats,
        "diff_callees": _diff_callees,
        "review_findings": _review,
        "sync_plan": _sync_plan,
        "review_lists": _review_lists,
        "review_recall": _review_recall,
        "sync_apply": _sync_apply,
        "sync_counts": lambda b: diff.sync_counts(_sync_plan(b)),
        "hash_record": _hash_record,
        "hash_stream": lambda b: changes.stream_hashes(b.spark, f"{b.folder}/file_hashes.parque[t]", b.graph.file_hashes.schema).select("path", "sha1"),
        "load_file_ids": _file_ids,
        "load_edges": _bound_edges,
        "load_tables": _loaded,
        "source_listing": lambda b: store.listed_files(b.graph.files, SKIPPED_DIRECTORIES, EXTENSIONS),
        "baseline_listing": lambda b: store.listed_files(b.graph.files, store.BASELINE_SKIPPED, store.BASELINE_EXTENSIONS),
        "module_descriptions": lambda b: store.module_descriptions(b.graph.files, b.graph.file_contents),
        "project_totals": lambda b: store.totals(b.graph.files, b.functions),
        "vector_search": _vectors,
        "vector_index_items": lambda b: vectors.index_items(b.functions).select("func_id", "item_id", "document"),
        "vector_store": _vector_store,
        "vector_fallback": _fallback,
        "semantic_hits": _semantic,
        "question_intents": lambda b: questions.questions(_items(b)),
        "question_functions": lambda b: questions.question_functions(_items(b), b.functions),
        "naive_retrieval": lambda b: questions.naive_retrieval(b.graph.file_contents, WORD),
        "context_budget": _budget,
        "question_retrieval": lambda b: _retrieval(b).select("item_id", "rank", "file_id", "tier", "hits", "size"),
        "question_budget": lambda b: questions.question_budget(_retrieval(b)),
        "raw_keywords": lambda b: _items(b).select("item_id", questions.raw_keyword(F.col("question")).alias("word")),
        "text_intents": _text_intents,
        "empty_answers": _empty,
        "baseline_answers": _baseline,
        "json_parts": lambda b: questions.json_parts(table(b.spark, b.folder, "documents"), "doc_id", "text"),
        "event_json": lambda b: questions.json_parts(table(b.spark, b.folder, "events"), "event_id", "props").where("object is not null").select("event_id", "object"),
        "call_words": lambda b: questions.call_words(b.graph.file_contents, b.functions),
        "citation_gate": lambda b: questions.citation_gate(b.answers(), b.paths()),
        "eval_scores": _scores,
        "eval_report": lambda b: questions.report(_scores(b)),
        "reflect_verdict": lambda b: questions.reflect_verdict(b.answers()),
        "result_truncation": lambda b: questions.shortened_lists(b.sites, "caller", ["line", "callee_name"]),
        "result_items": lambda b: questions.kept_items(b.sites, "caller", ["file", "line", "callee_name", "edge_id"]).select("caller", "at", "callee_name", "omitted"),
        "result_summary": lambda b: questions.result_summary(
            questions.kept_items(b.sites, "caller", ["file", "line", "callee_name", "edge_id"]), "caller", F.col("callee_name")),
        "trace_summary": lambda b: trace.summary(table(b.spark, b.folder, "events")),
        "trace_stream": _trace_stream,
        "script_extract": _scripts,
    }
    return {name: _q(f) for name, f in bound.items()}
