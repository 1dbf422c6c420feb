"""DuckDB SQL of the registered queries, written against the raw tables."""

from __future__ import annotations

from codestrata.operators.questions import CALL_WORD, CITATION, INTENTS, UNRESOLVED
from codestrata.operators.store import BASELINE_EXTENSIONS, BASELINE_SKIPPED
from codestrata.sources.source_tree import EXTENSIONS, SKIPPED_DIRECTORIES

NAME, WORD = "commit", "mosaic"

_BASE = r"""
f0 AS (SELECT file_id, path, name, coalesce(project, split_part(path, '/', 1)) AS project FROM files WHERE file_id IS NOT NULL),
h0 AS (SELECT snapshot_no, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path, lower(sha1) AS sha1, loaded_at FROM file_hashes),
delivered AS (
  SELECT project, snapshot_no FROM functions JOIN f0 USING (file_id)
  UNION SELECT project, snapshot_no FROM classes JOIN f0 USING (file_id)
  UNION SELECT split_part(path, '/', 1), snapshot_no FROM h0),
latest AS (SELECT project, max(snapshot_no) AS snapshot_no FROM delivered GROUP BY project),
fn_all AS (
  SELECT x.* EXCLUDE (qualified_name, name, rn), replace(qualified_name, '::', '.') AS qualified_name, x.name, path, project FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, func_id ORDER BY loaded_at DESC, file_id DESC, name DESC, qualified_name DESC, start_line DESC, end_line DESC) AS rn
    FROM functions WHERE func_id IS NOT NULL) x JOIN (SELECT file_id, path, project FROM f0) USING (file_id) WHERE rn = 1),
cl_all AS (
  SELECT x.* EXCLUDE (qualified_name, name, rn), replace(qualified_name, '::', '.') AS qualified_name, x.name, path, project FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, class_id ORDER BY loaded_at DESC, file_id DESC, name DESC, qualified_name DESC, start_line DESC, end_line DESC) AS rn
    FROM classes WHERE class_id IS NOT NULL) x JOIN (SELECT file_id, path, project FROM f0) USING (file_id) WHERE rn = 1),
fn AS (SELECT * FROM fn_all JOIN latest USING (project, snapshot_no)),
cl AS (SELECT * FROM cl_all JOIN latest USING (project, snapshot_no)),
sites AS (
  SELECT edge_id, qualified_name AS caller, fn.name AS caller_name, callee_name, path AS file, caller_line AS line, project
  FROM (SELECT DISTINCT edge_id, caller_func_id, callee_name, caller_line FROM call_edges WHERE callee_name IS NOT NULL)
  JOIN fn ON func_id = caller_func_id),
recs AS (
  SELECT project, 'file' AS kind, snapshot_no, path, '' AS name, sha1 AS value FROM (
    SELECT *, split_part(path, '/', 1) AS project, row_number() OVER (PARTITION BY snapshot_no, path ORDER BY loaded_at DESC, sha1 DESC) AS rn FROM h0 WHERE path IS NOT NULL AND snapshot_no IS NOT NULL) WHERE rn = 1
  UNION ALL SELECT project, 'function', snapshot_no, path, qualified_name, string_agg(l, ',' ORDER BY l) FROM (
    SELECT DISTINCT project, snapshot_no, path, qualified_name, coalesce(start_line::VARCHAR, '?') || '-' || coalesce(end_line::VARCHAR, '?') AS l FROM fn_all WHERE qualified_name IS NOT NULL AND path IS NOT NULL AND snapshot_no IS NOT NULL) GROUP BY ALL
  UNION ALL SELECT project, 'class', snapshot_no, path, qualified_name, string_agg(l, ',' ORDER BY l) FROM (
    SELECT DISTINCT project, snapshot_no, path, qualified_name, coalesce(start_line::VARCHAR, '?') || '-' || coalesce(end_line::VARCHAR, '?') AS l FROM cl_all WHERE qualified_name IS NOT NULL AND path IS NOT NULL AND snapshot_no IS NOT NULL) GROUP BY ALL),
near AS (SELECT project, snapshot_no, lag(snapshot_no) OVER (PARTITION BY project ORDER BY snapshot_no) AS previous_no FROM delivered),
steps AS (
  SELECT coalesce(n.kind, o.kind) AS kind, coalesce(n.project, o.project) AS project, coalesce(n.path, o.path) AS path, coalesce(n.name, o.name) AS name, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.value IS DISTINCT FROM o.value THEN 'changed' ELSE 'same' END AS change_kind
  FROM (SELECT r.* FROM recs r JOIN near USING (project, snapshot_no) WHERE previous_no IS NOT NULL) n
  FULL JOIN (SELECT r.* REPLACE (near.snapshot_no AS snapshot_no) FROM recs r JOIN near ON near.project = r.project AND near.previous_no = r.snapshot_no) o
  ON n.kind = o.kind AND n.project = o.project AND n.path = o.path AND n.name = o.name AND n.snapshot_no = o.snapshot_no),
last_steps AS (SELECT steps.* FROM steps JOIN latest USING (project, snapshot_no)),
last_two AS (SELECT project, snapshot_no AS head_no, previous_no AS base_no FROM near JOIN latest USING (project, snapshot_no) WHERE previous_no IS NOT NULL)
"""


def _sql(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_BASE}{', ' if body.lstrip().startswith('@') else ''}{body.lstrip().removeprefix('@')}"


def _spaced(c: str) -> str:
    return rf"' ' || regexp_replace(replace({c}, '::', '.'), '(\W)', ' \1 ', 'g') || ' '"


def _simple(c: str) -> str:
    return f"split_part(replace({c}, '::', '.'), '.', -1)"


def _refers(c: str, n: str) -> str:
    ends = " OR ".join(f"starts_with(lower({c}), lower({p})) OR ends_with(lower({c}), lower({p}))" for p in (n, _simple(n)))
    return (f"((contains({_spaced(c)}, {_spaced(n)}) OR ({_simple(n)} <> replace({n}, '::', '.') AND NOT contains({c}, '::') AND "
            f"contains({_spaced(c)}, {_spaced(_simple(n))}))) AND ({ends}))")


_WORDS = rf"words AS (SELECT callee_name, unnest(list_distinct(regexp_extract_all(replace(callee_name, '::', '.'), '\w+'))) AS word FROM (SELECT DISTINCT callee_name FROM sites))"


def _impact(sources: str) -> str:
    """Names reached by level: first the pairs of names and callers, then the walk."""
    return f"""@ {_WORDS},
src AS ({sources}),
names AS (SELECT DISTINCT caller AS target FROM sites WHERE caller IS NOT NULL UNION SELECT source FROM src),
meant AS (SELECT DISTINCT target, callee_name FROM names JOIN words ON word = {_simple('target')} WHERE {_refers('callee_name', 'target')}),
arcs AS (SELECT DISTINCT target, caller, file, line FROM meant JOIN sites USING (callee_name)),
hops AS (SELECT DISTINCT target, caller FROM arcs),
walk AS (SELECT source, source AS caller, 0 AS depth FROM src
  UNION SELECT source, hops.caller, depth + 1 FROM walk JOIN hops ON hops.target = walk.caller WHERE depth <= 3),
level AS (SELECT source, caller, min(depth) AS depth FROM walk GROUP BY ALL),
reached AS (
  SELECT l.source, l.caller, l.depth, min(struct_pack(file := a.file, line := a.line)) AS spot
  FROM level l JOIN level p ON p.source = l.source AND p.depth = l.depth - 1 JOIN arcs a ON a.target = p.caller AND a.caller = l.caller
  WHERE l.depth > 0 AND l.caller <> l.source GROUP BY ALL)
"""


_ONE = f"SELECT '{NAME}' AS source"
_CHANGED = "SELECT DISTINCT name AS source FROM last_steps WHERE kind = 'function' AND change_kind IN ('added', 'changed')"

_MODULES = r"""@ mods AS (
  SELECT file_id, path, project, CASE WHEN ends_with(path, '.py') THEN CASE WHEN contains(path, '/') THEN split_part(path, '/', -2) ELSE regexp_replace(path, '\.py$', '') END ELSE 'root' END AS module
  FROM f0 WHERE NOT regexp_matches(lower(path), 'session_|tmp|temp|venv')),
names AS (SELECT DISTINCT project, module AS m FROM mods),
imp AS (SELECT DISTINCT file_id, source FROM imports WHERE source IS NOT NULL),
resolved AS (
  SELECT project, source, arg_min(m, struct_pack(tier := tier, m := m)) AS to_module FROM (
    SELECT s.project, s.source, m, CASE WHEN source = m THEN 1 WHEN split_part(source, '.', 1) = m THEN 2 ELSE 3 END AS tier
    FROM (SELECT DISTINCT project, source FROM imp JOIN mods USING (file_id)) s JOIN names n ON n.project = s.project AND (contains(source, m) OR contains(m, source))) GROUP BY ALL),
deps AS (
  SELECT project, module AS from_module, to_module, count(DISTINCT struct_pack(a := path, b := source)) AS details
  FROM imp JOIN mods USING (file_id) JOIN resolved USING (project, source) WHERE module <> to_module GROUP BY ALL),
fan AS (
  SELECT project, module, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (
    SELECT project, to_module AS module, count(DISTINCT from_module) AS i, 0 AS o FROM deps GROUP BY ALL
    UNION ALL SELECT project, from_module, 0, count(DISTINCT to_module) FROM deps GROUP BY ALL) GROUP BY ALL),
linked AS (SELECT project, from_module AS module FROM deps UNION SELECT project, to_module FROM deps),
paths AS (
  SELECT project, [from_module, to_module] AS p FROM deps WHERE from_module < to_module
  UNION ALL SELECT paths.project, list_append(p, to_module) FROM paths JOIN deps ON deps.project = paths.project AND from_module = p[-1]
  WHERE to_module > p[1] AND NOT list_contains(p, to_module)),
cyc AS (SELECT paths.project, array_to_string(list_append(p, p[1]), '->') AS cycle, len(p) AS length FROM paths JOIN deps ON deps.project = paths.project AND from_module = p[-1] AND to_module = p[1])
"""

_DEGREES = r"""@ own AS (SELECT DISTINCT edge_id, caller_func_id, callee_name FROM call_edges),
spelled AS (SELECT lower(callee_name) AS callee, count(*) AS n FROM own WHERE callee_name IS NOT NULL GROUP BY ALL),
called AS (SELECT k, sum(n) AS called_by FROM (SELECT DISTINCT lower(name) AS k FROM fn) JOIN spelled ON ends_with(callee, k) GROUP BY ALL),
deg AS (
  SELECT func_id, qualified_name, path, coalesce(calls, 0) AS calls, coalesce(called_by, 0)::BIGINT AS called_by
  FROM fn LEFT JOIN (SELECT caller_func_id AS func_id, count(*) AS calls FROM own GROUP BY ALL) USING (func_id) LEFT JOIN called ON k = lower(name)
  WHERE qualified_name IS NOT NULL AND qualified_name <> ''),
ranked AS (
  SELECT *, split_part(path, '/', -1) AS file, row_number() OVER (PARTITION BY qualified_name ORDER BY calls + called_by DESC, func_id) AS pos FROM deg),
named AS (SELECT *, CASE WHEN pos = 1 THEN qualified_name ELSE qualified_name || '@' || file END AS node_id FROM ranked),
once AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY calls + called_by DESC, func_id) AS o FROM named),
shown AS (SELECT node_id, qualified_name, file, calls, called_by FROM once WHERE o = 1 ORDER BY calls + called_by DESC, func_id LIMIT 200),
short AS (SELECT DISTINCT caller, callee_name, split_part(file, '/', -1) AS file FROM sites WHERE length(callee_name) < 60),
calls AS (
  SELECT DISTINCT coalesce(a.node_id, b.node_id) AS source, callee_name FROM short LEFT JOIN shown a ON a.node_id = caller LEFT JOIN shown b ON b.node_id = caller || '@' || short.file
  WHERE coalesce(a.node_id, b.node_id) IS NOT NULL),
met AS (SELECT source, node_id AS target, callee_name FROM calls JOIN shown ON qualified_name = callee_name OR ends_with(qualified_name, '.' || callee_name)),
lnk AS (
  SELECT source, target FROM met WHERE source <> target
  UNION SELECT source, node_id FROM calls JOIN shown ON split_part(qualified_name, '.', -1) = split_part(callee_name, '.', -1)
  WHERE callee_name NOT IN (SELECT callee_name FROM met) AND source <> node_id)
"""


_CONTENTS = "@ newest AS (SELECT file_id, arg_max(content, loaded_at) AS content FROM file_contents WHERE content IS NOT NULL AND file_id IS NOT NULL GROUP BY ALL),\n"


def _intent(q: str) -> str:
    arms = []
    for pattern, name in INTENTS:
        if "(?!" in pattern:
            parts = pattern.rsplit("|", 1)
            arms.append(f"WHEN regexp_matches({q}, '{parts[0]}') OR (regexp_matches({q}, '调用关系') AND NOT regexp_matches({q}, '调用关系.*多少条')) THEN '{name}'")
        else:
            arms.append(f"WHEN regexp_matches({q}, '{pattern}') THEN '{name}'")
    return f"CASE WHEN {q} IS NULL THEN NULL {' '.join(arms)} ELSE 'unknown' END"


def _keywords(q: str) -> str:
    """Words with their position, distinct by first appearance."""
    return (f"""list_concat(list_concat(regexp_extract_all({q}, '["「」]([^"「」]+)["「」]', 1), [regexp_extract({q}, '(?:函数|方法|接口)\\s*[:：]?\\s*([a-zA-Z_][a-zA-Z0-9_.]*)', 1)]), """
            f"""list_concat(regexp_extract_all({q}, '([a-zA-Z_][a-zA-Z0-9_.]+)', 1), regexp_extract_all({q}, '([A-Z][a-zA-Z0-9_]{{2,}})', 1)))""")


_KEYWORDS = f"""@ kw0 AS (SELECT item_id, k, unnest(generate_series(1, len(k))) AS i FROM (SELECT item_id, {_keywords('question')} AS k FROM eval_items)),
kw AS (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, k[i] AS w, i FROM kw0) WHERE w <> '' GROUP BY ALL),
asked AS (SELECT item_id, w AS word, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) AS pos FROM kw)
"""

_ANSWERS = r"""@ ans AS (
  SELECT item_id, question, category, expected_type, keywords, min_count, coalesce(passage, '') || coalesce(chr(10) || '见 [' || a.path || ':' || a.start_line || ']', '') AS answer, expected_target
  FROM eval_items LEFT JOIN (SELECT name AS n, min(struct_pack(path := path, start_line := start_line, func_id := func_id)) AS a FROM fn GROUP BY ALL) ON n = expected_target),
stated AS (SELECT item_id, l, c FROM (SELECT item_id, unnest(string_split(answer, chr(10))) AS l0 FROM ans), LATERAL (SELECT trim(l0) AS l, regexp_extract_all(trim(l0), '@CITE@', 1) AS c) WHERE l <> '' AND NOT contains(l, '推测')),
cited AS (SELECT item_id, l, unnest(c) AS x FROM stated),
valid AS (SELECT p FROM (SELECT path AS p FROM files UNION SELECT name FROM files UNION SELECT path FROM file_hashes UNION SELECT source FROM imports) WHERE regexp_matches(p, '\.py|/|\\')),
known AS (SELECT c.f FROM (SELECT DISTINCT trim(split_part(x, ':', 1)) AS f FROM cited) c WHERE f <> '' AND EXISTS (SELECT 1 FROM valid WHERE contains(p, c.f))),
judged AS (SELECT item_id, l, count_if(known.f IS NULL) AS bad FROM cited LEFT JOIN known ON known.f = trim(split_part(x, ':', 1)) GROUP BY ALL),
gate AS (
  SELECT item_id, coalesce(verified, 0) AS verified, coalesce(caught, 0) AS caught, round(coalesce(verified / nullif(verified + caught, 0), 1.0), 6) AS confidence
  FROM (SELECT DISTINCT item_id FROM ans) LEFT JOIN (SELECT item_id, count_if(bad = 0) AS verified, count_if(bad > 0) AS caught FROM judged GROUP BY ALL) USING (item_id)),
scored AS (
  SELECT item_id, category, round((coalesce((INTENT = expected_type)::INT, 0)
    + CASE WHEN coalesce(len(keywords), 0) = 0 OR len(list_filter(keywords, lambda k: NOT contains(lower(answer), lower(k)))) = 0 THEN 1 ELSE 0 END
    + CASE WHEN min_count IS NULL OR coalesce(n, 0) >= min_count THEN 1 ELSE 0 END + confidence + CASE WHEN contains(answer, '推测') THEN 0.5 ELSE 1.0 END) / 5, 6)::DOUBLE AS score
  FROM ans JOIN gate USING (item_id) LEFT JOIN (SELECT name, count(*) AS n FROM fn GROUP BY ALL) c ON c.name = expected_target)
""".replace("@CITE@", CITATION).replace("INTENT", _intent("question"))

_HITS = f"""@ hits AS (
  SELECT file_id, ((length(lower(content)) - length(replace(lower(content), '{WORD}', ''))) // {len(WORD)})::INT AS hits, length(content) AS size FROM file_contents WHERE content IS NOT NULL),
best AS (SELECT file_id, hits, size::INT AS size FROM hits WHERE hits > 0 ORDER BY hits DESC, file_id LIMIT 6)
"""


def _diff(kind: str) -> str:
    return _sql(f"SELECT path, name, replace(change_kind, 'changed', 'modified') AS status FROM last_steps WHERE kind = '{kind}' AND change_kind <> 'same'")


_BOUND = """@ ordered AS (SELECT path, qualified_name, func_id, row_number() OVER (PARTITION BY path ORDER BY class_name IS NULL, coalesce(start_line, 0), func_id) AS o FROM fn WHERE path IS NOT NULL AND qualified_name IS NOT NULL),
named AS (SELECT path, qualified_name, arg_max(func_id, o) AS func_id, min(o) AS o FROM ordered GROUP BY ALL),
facts AS (SELECT DISTINCT edge_id, callee_name, caller_line, fn.path, fn.name, fn.qualified_name, func_id FROM call_edges JOIN fn ON func_id = caller_func_id WHERE callee_name IS NOT NULL),
given AS (SELECT edge_id, row_number() OVER () AS r, path, s AS spelled, CASE s WHEN 'simple' THEN name ELSE qualified_name END AS caller_name FROM facts, (VALUES ('simple'), ('qualified')) v(s)),
bound AS (SELECT r, edge_id, spelled, arg_min(func_id, struct_pack(a := named.qualified_name <> caller_name, b := o)) AS caller_func_id
  FROM given JOIN named ON named.path = given.path AND (named.qualified_name = caller_name OR ends_with(named.qualified_name, '.' || caller_name)) GROUP BY r, edge_id, spelled)
"""


def _listing(skipped: tuple[str, ...], extensions: tuple[str, ...]) -> str:
    """Paths by extension, without those in a directory that is left out."""
    names = ", ".join(f"'{d}'" for d in skipped)
    return (f"SELECT file_id, path FROM files WHERE regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) IN ({', '.join(repr(e) for e in extensions)}) "
            f"AND NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), [{names}])")


def _raw(q: str) -> str:
    """The keyword a question is about."""
    words = f"regexp_extract_all({q}, '([a-zA-Z_][a-zA-Z0-9_.]+)', 1)"
    best = f"list_extract(list_sort(list_transform({words}, lambda w, i: struct_pack(a := NOT contains(w, '.'), b := -length(w), c := i, w := w))), 1).w"
    named = f"nullif(regexp_extract({q}, '(?:函数|方法|接口)\\s*[:：]?\\s*([a-zA-Z_][a-zA-Z0-9_.]*)', 1), '')"
    quoted = f"""list_extract(regexp_extract_all({q}, '["「」]([^"「」]+)["「」]', 1), 1)"""
    return f"coalesce({quoted}, {named}, {best})"


_PLAN = "CASE change_kind WHEN 'added' THEN 'parse' WHEN 'removed' THEN 'remove' WHEN 'changed' THEN 'update' ELSE 'keep' END AS action"

P5_SQL = _sql(r"""@ edge AS (SELECT edge_id, caller_func_id, callee_name, min(loaded_at) AS loaded_at FROM call_edges WHERE edge_id IS NOT NULL GROUP BY ALL),
live AS (
  SELECT edge_id, edge.loaded_at, callee_name, replace(callee_name, '::', '.') AS n, fn.project, fn.file_id,
    CASE WHEN contains(qualified_name, '.') THEN regexp_extract(qualified_name, '^(.*)\.[^.]*$', 1) END AS owner
  FROM edge JOIN fn ON func_id = caller_func_id WHERE callee_name IS NOT NULL),
spell AS (SELECT DISTINCT project, file_id, callee_name, n, CASE WHEN regexp_matches(n, '^(self|this)\.') THEN owner END AS owner, split_part(n, '.', 1) AS head, replace(project, '-', '_') AS package FROM live),
ref AS (SELECT DISTINCT project, qualified_name AS q FROM fn WHERE coalesce(name, '') <> 'main' AND NOT regexp_matches(qualified_name, '(^|\.)main$')),
probe AS (
  SELECT project, file_id, callee_name, owner, owner || '.' || regexp_extract(n, '^(?:self|this)\.(.*)$', 1) AS q FROM spell WHERE regexp_matches(n, '^(self|this)\.')
  UNION ALL SELECT project, file_id, callee_name, owner, array_to_string(list_slice(p, i, len(p)), '.') FROM (
    SELECT *, unnest(generate_series(1, len(p))) AS i FROM (SELECT *, string_split(n, '.') AS p FROM spell WHERE NOT regexp_matches(n, '^(self|this)\.')))),
good AS (SELECT DISTINCT project, file_id, callee_name, owner FROM probe JOIN ref USING (project, q)),
names AS (SELECT DISTINCT project, name FROM cl WHERE name IS NOT NULL),
imported AS (SELECT DISTINCT file_id, regexp_extract(source, '^([^./:]*)', 1) AS root, unnest(names) AS name FROM imports WHERE source IS NOT NULL),
dead AS (
  SELECT s.* FROM spell s WHERE (head = package OR EXISTS (SELECT 1 FROM names c WHERE c.project = s.project AND c.name = head)
      OR EXISTS (SELECT 1 FROM imported i WHERE i.file_id = s.file_id AND i.name = head AND i.root = package) OR regexp_matches(n, '^(self|this)\.[^.]+$'))
    AND NOT EXISTS (SELECT 1 FROM names c WHERE c.project = s.project AND c.name = s.callee_name)
    AND NOT EXISTS (SELECT 1 FROM good g WHERE g.project = s.project AND g.file_id = s.file_id AND g.callee_name = s.callee_name AND g.owner IS NOT DISTINCT FROM s.owner)),
orphan AS (
  SELECT DISTINCT edge_id, 'caller_func_id' AS ref_field, date_trunc('week', loaded_at)::DATE AS period FROM edge WHERE caller_func_id IS NOT NULL AND caller_func_id NOT IN (SELECT func_id FROM fn)
  UNION SELECT DISTINCT edge_id, 'callee_name', date_trunc('week', loaded_at)::DATE FROM live l JOIN dead d ON d.project = l.project AND d.file_id = l.file_id AND d.callee_name = l.callee_name
    AND d.owner IS NOT DISTINCT FROM CASE WHEN regexp_matches(l.n, '^(self|this)\.') THEN l.owner END)
""")


_HIERARCHY = r"""@ called AS (
  SELECT DISTINCT func_id AS caller, project, replace(callee_name, '::', '.') AS n, CASE WHEN contains(qualified_name, '.') THEN regexp_extract(qualified_name, '^(.*)\.[^.]*$', 1) END AS owner
  FROM call_edges JOIN fn ON func_id = caller_func_id WHERE callee_name IS NOT NULL),
tails AS (
  SELECT caller, project, owner || '.' || regexp_extract(n, '^(?:self|this)\.(.*)$', 1) AS q FROM called WHERE regexp_matches(n, '^(self|this)\.')
  UNION SELECT caller, project, array_to_string(list_slice(p, i, len(p)), '.') FROM (
    SELECT caller, project, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT *, string_split(n, '.') AS p FROM called WHERE NOT regexp_matches(n, '^(self|this)\.')))),
named AS (
  SELECT DISTINCT class_id, project, trim(split_part(replace(regexp_replace(entry, '[\[<({].*$', ''), '::', '.'), '.', -1)) AS name FROM (SELECT class_id, project, unnest(base_classes) AS entry FROM cl)),
links AS (
  SELECT DISTINCT 'call' AS rec_kind, func_id AS child, caller AS parent FROM tails JOIN fn ON fn.project = tails.project AND qualified_name = q
  WHERE coalesce(name, '') <> 'main' AND NOT regexp_matches(qualified_name, '(^|\.)main$')
  UNION SELECT 'class', n.class_id, cl.class_id FROM named n JOIN cl ON cl.project = n.project AND cl.name = n.name WHERE n.name <> ''),
up(rec_kind, node_id, ancestor_id, distance) USING KEY (rec_kind, node_id, ancestor_id) AS (
  SELECT rec_kind, child, parent, 1::INT FROM links
  UNION SELECT up.rec_kind, node_id, parent, (min(distance) + 1)::INT FROM up JOIN links ON links.rec_kind = up.rec_kind AND child = ancestor_id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.up s WHERE s.rec_kind = up.rec_kind AND s.node_id = up.node_id AND s.ancestor_id = parent) GROUP BY ALL),
recs2 AS (SELECT 'call' AS rec_kind, func_id AS node_id FROM fn UNION SELECT 'class', class_id FROM cl),
top AS (SELECT * FROM recs2 r WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.rec_kind = r.rec_kind AND l.child = r.node_id)),
roots AS (SELECT up.rec_kind, up.node_id, ancestor_id AS root_id FROM up JOIN top ON top.rec_kind = up.rec_kind AND top.node_id = ancestor_id UNION ALL SELECT rec_kind, node_id, node_id FROM top),
above AS (SELECT rec_kind, node_id, max(distance) AS depth, bool_or(node_id = ancestor_id) AS looped FROM up GROUP BY ALL),
below AS (SELECT rec_kind, ancestor_id AS node_id, count(*) AS n FROM up GROUP BY ALL)
"""


def oracle_sql() -> dict[str, str]:
    r = True
    return {
        "p2_found": _sql(_HIERARCHY + "SELECT rec_kind, node_id, ancestor_id, distance FROM up", r),
        "p2_hierarchy": _sql(_HIERARCHY + "SELECT rec_kind, node_id, coalesce(depth, 0) AS depth, root_id, coalesce(n, 0) AS descendants, coalesce(looped, false) AS is_cyclic FROM recs2 LEFT JOIN above USING (rec_kind, node_id) LEFT JOIN below USING (rec_kind, node_id) LEFT JOIN roots USING (rec_kind, node_id)", r),
        "p5_found": f"{P5_SQL} SELECT DISTINCT edge_id, ref_field FROM orphan",
        "p5_report": f"{P5_SQL} SELECT 'call_edges' AS table_name, ref_field, period::VARCHAR AS period, count(*) AS orphans FROM orphan GROUP BY ALL",
        "p7_found": _sql("SELECT kind AS rec_kind, path, name AS rec_name, snapshot_no, change_kind FROM steps WHERE change_kind <> 'same'"),
        "callers_of": _sql("SELECT caller, file, line FROM sites WHERE " + _refers("callee_name", f"'{NAME}'")),
        "callees_of": _sql(f"SELECT DISTINCT callee_name AS callee, line FROM sites WHERE caller_name = '{NAME}' OR caller = '{NAME}' OR ends_with(caller, '.{NAME}')"),
        "callees_of_methods": _sql(f"@ t AS (SELECT DISTINCT qualified_name AS target, split_part(qualified_name, '.', -1) AS w FROM fn WHERE name = '{NAME}' AND contains(qualified_name, '.')) SELECT DISTINCT target, callee_name AS callee, line FROM sites JOIN t ON caller = target OR ((lower(caller) LIKE '%' || lower(target) OR lower(caller) LIKE lower(target) || '%') AND (ends_with(caller, '.' || target) OR ends_with(caller, '.' || w)))"),
        "search_functions": _sql(f"SELECT func_id, qualified_name, path, start_line, end_line FROM fn WHERE name ILIKE '%{WORD}%' OR qualified_name ILIKE '%{WORD}%' ORDER BY path, start_line, func_id LIMIT 30"),
        "search_files": f"SELECT file_id, path, name FROM files WHERE name ILIKE '%{WORD}%' OR path ILIKE '%{WORD}%' ORDER BY path LIMIT 10",
        "function_detail": _sql(f"SELECT func_id, qualified_name, path, start_line, end_line, class_name FROM fn WHERE name = '{NAME}' OR qualified_name = '{NAME}' ORDER BY func_id LIMIT 1"),
        "file_structure": _sql(f"@ one AS (SELECT file_id FROM files WHERE name ILIKE '%{WORD}%' OR path ILIKE '%{WORD}%' ORDER BY path LIMIT 1) SELECT 'function' AS kind, qualified_name, start_line, end_line FROM fn JOIN one USING (file_id) UNION ALL SELECT 'class', qualified_name, start_line, end_line FROM cl JOIN one USING (file_id)"),
        "structure_by_file": _sql(f"@ k AS (SELECT file_id, path, split_part(path, '/', -1) AS n, row_number() OVER (PARTITION BY split_part(path, '/', -1) ORDER BY file_id) AS pos FROM files WHERE path ILIKE '%{WORD}%') SELECT file_id, CASE WHEN pos = 1 THEN n WHEN pos = 2 AND contains(path, '/') THEN split_part(path, '/', -2) || '/' || n ELSE path END AS file_key, coalesce(c, 0) AS functions FROM k LEFT JOIN (SELECT file_id, count(*) AS c FROM fn GROUP BY ALL) USING (file_id)"),
        "graph_stats": _sql("SELECT 'files' AS metric, count(*) AS n FROM files UNION ALL SELECT 'functions', count(*) FROM fn UNION ALL SELECT 'classes', count(*) FROM cl UNION ALL SELECT 'call_edges', count(*) FROM (SELECT DISTINCT edge_id FROM call_edges) UNION ALL SELECT 'imports', count(*) FROM (SELECT DISTINCT import_id FROM imports)"),
        "change_impact": _sql(_impact(_ONE) + "SELECT caller, depth, spot.file AS file, spot.line AS line FROM reached", r),
        "impact_batch": _sql(_impact(_CHANGED) + "SELECT source, caller, depth FROM reached", r),
        "affected_files": _sql(_impact(_ONE) + "SELECT DISTINCT spot.file AS file, contains(split_part(lower(spot.file), '/', -1), 'test') OR contains(split_part(lower(spot.file), '/', -2), 'test') AS is_test FROM reached", r),
        "review_findings": _sql(_impact(_CHANGED) + ", sums AS (SELECT source, count_if(depth = 1) AS direct_callers, count(*) AS all_affected, count(DISTINCT spot.file) AS affected_files FROM reached GROUP BY ALL) SELECT source, replace(change_kind, 'changed', 'modified') AS status, coalesce(direct_callers, 0) AS direct_callers, coalesce(all_affected, 0) AS all_affected, coalesce(affected_files, 0) AS affected_files FROM (SELECT DISTINCT name AS source, change_kind FROM last_steps WHERE kind = 'function' AND change_kind IN ('added', 'changed')) LEFT JOIN sums USING (source)", r),
        "review_lists": _sql(_impact(_CHANGED.replace("IN ('added', 'changed')", "<> 'same'")) + ", ch AS (SELECT DISTINCT name AS source, replace(change_kind, 'changed', 'modified') AS status FROM last_steps WHERE kind = 'function' AND change_kind <> 'same') SELECT DISTINCT source, status, 'direct_caller' AS item_kind, caller AS item FROM ch JOIN reached USING (source) WHERE depth = 1 UNION ALL SELECT DISTINCT source, status, 'affected_file', spot.file FROM ch JOIN reached USING (source) WHERE spot.file IS NOT NULL", r),
        "review_recall": _sql("@ ch AS (SELECT DISTINCT split_part(name, '.', -1) AS name FROM last_steps WHERE kind = 'function' AND change_kind <> 'same') SELECT suite, count(*) AS expected, count(name) AS found, sum(CASE WHEN len(list_filter(keywords, lambda k: contains(passage, k))) > 0 THEN 1 ELSE 0 END)::BIGINT AS spoken, round(count(name) / count(*), 6) AS structural_recall, round(sum(CASE WHEN len(list_filter(keywords, lambda k: contains(passage, k))) > 0 THEN 1 ELSE 0 END) / count(*), 6) AS semantic_recall FROM eval_items LEFT JOIN ch ON name = expected_target WHERE expected_target IS NOT NULL GROUP BY ALL"),
        "related_impact": _sql(_impact(f"SELECT DISTINCT qualified_name AS source FROM fn WHERE contains(name, '{WORD}') AND qualified_name IS NOT NULL") + "SELECT DISTINCT caller, depth FROM reached", r),
        "read_file": _sql(_CONTENTS + f"""one AS (SELECT files.file_id FROM files JOIN newest USING (file_id) WHERE name ILIKE '%{WORD}%' OR path ILIKE '%{WORD}%' ORDER BY path LIMIT 1),
cut AS (SELECT string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM newest JOIN one USING (file_id))
SELECT i::INT AS line_no, l[i] AS line FROM (SELECT l, unnest(generate_series(1, least(50, len(l)))) AS i FROM cut)"""),
        "content_hashes": _sql(_CONTENTS.rstrip().rstrip(",") + " SELECT file_id, sha1(content) AS sha1 FROM newest"),
        "project_overview": _sql("SELECT project, CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 2) ELSE '' END AS directory, count(*) AS files, count_if(ends_with(path, '.py'))::BIGINT AS python_files, coalesce(sum(f), 0)::BIGINT AS functions, coalesce(sum(c), 0)::BIGINT AS classes FROM f0 LEFT JOIN (SELECT file_id, count(*) AS f FROM fn GROUP BY ALL) USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS c FROM cl GROUP BY ALL) USING (file_id) WHERE path IS NOT NULL GROUP BY ALL"),
        "graph_remove": _sql(f"""@ gone AS (SELECT file_id, path FROM files WHERE contains(path, '{WORD}')),
lost AS (SELECT func_id FROM functions WHERE file_id IN (SELECT file_id FROM gone) EXCEPT SELECT func_id FROM functions f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_id = f.file_id))
SELECT 'files' AS metric, count(*) AS n FROM files t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_id = t.file_id)
UNION ALL SELECT 'functions', count(*) FROM functions t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_id = t.file_id)
UNION ALL SELECT 'classes', count(*) FROM classes t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_id = t.file_id)
UNION ALL SELECT 'imports', count(*) FROM imports t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_id = t.file_id)
UNION ALL SELECT 'call_edges', count(*) FROM call_edges t WHERE NOT EXISTS (SELECT 1 FROM lost WHERE lost.func_id = t.caller_func_id)
UNION ALL SELECT 'file_hashes', count(*) FROM h0 t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.path = t.path)"""),
        "module_dependencies": _sql(_MODULES + "SELECT project, from_module, to_module, details FROM deps", r),
        "module_fan": _sql(_MODULES + "SELECT * FROM fan", r),
        "core_modules": _sql(_MODULES + "SELECT project, module, fan_in, fan_out, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY fan_in DESC, module) AS rank FROM fan WHERE fan_in > 0) WHERE rank <= 5", r),
        "module_cycles": _sql(_MODULES + "SELECT project, cycle, length::INT AS length FROM cyc", r),
        "module_files": _sql(_MODULES + "SELECT project, module, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS imports FROM mods LEFT JOIN (SELECT file_id, count(*) AS n FROM imp GROUP BY ALL) USING (file_id) GROUP BY ALL", r),
        "module_rings": _sql(_MODULES + ", reach AS (SELECT project, from_module, to_module FROM deps UNION SELECT reach.project, reach.from_module, deps.to_module FROM reach JOIN deps ON deps.project = reach.project AND deps.from_module = reach.to_module), mutual AS (SELECT a.* FROM reach a JOIN reach b ON a.project = b.project AND a.from_module = b.to_module AND a.to_module = b.from_module) SELECT project, min(to_module) AS ring, from_module AS module, count(*) AS modules FROM mutual GROUP BY project, from_module", r),
        "module_layers": _sql(_MODULES + "SELECT project, module, CASE WHEN most > 0 AND fan_in >= 0.5 * most THEN 0 WHEN fan_in > 0 OR fan_out > 0 THEN 1 ELSE 2 END AS layer FROM (SELECT *, max(fan_in) OVER (PARTITION BY project) AS most FROM fan)", r),
        "module_stats": _sql(_MODULES + "SELECT t.project, total_modules, coalesce(d, 0) AS total_dependencies, coalesce(w, 0) AS modules_with_deps, coalesce(c, 0) AS circular_dep_count, total_modules - coalesce(w, 0) AS orphan_count FROM (SELECT project, count(*) AS total_modules FROM names GROUP BY ALL) t LEFT JOIN (SELECT project, count(*) AS d FROM deps GROUP BY ALL) USING (project) LEFT JOIN (SELECT project, count(*) AS w FROM linked GROUP BY ALL) USING (project) LEFT JOIN (SELECT project, count(*) AS c FROM cyc GROUP BY ALL) USING (project)", r),
        "module_orphans": _sql(_MODULES + "SELECT project, m AS module FROM names WHERE NOT EXISTS (SELECT 1 FROM linked WHERE linked.project = names.project AND module = m)", r),
        "call_degrees": _sql(_DEGREES + "SELECT func_id, calls, called_by FROM deg"),
        "callgraph_nodes": _sql(_DEGREES + "SELECT * FROM shown"),
        "callgraph_links": _sql(_DEGREES + "SELECT * FROM lnk"),
        "callgraph_adjacency": _sql(_DEGREES + "SELECT coalesce(a.node_id, b.node_id) AS node_id, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM (SELECT target AS node_id, string_agg(source, ',' ORDER BY source) AS callers FROM (SELECT DISTINCT * FROM lnk) GROUP BY ALL) a FULL JOIN (SELECT source AS node_id, string_agg(target, ',' ORDER BY target) AS callees FROM (SELECT DISTINCT * FROM lnk) GROUP BY ALL) b ON a.node_id = b.node_id"),
        "callgraph_search": _sql(_DEGREES + f"SELECT (row_number() OVER (ORDER BY calls + called_by DESC, node_id))::INT AS rank, node_id FROM shown WHERE contains(lower(node_id), '{WORD}')"),
        "ego_network": _sql(_DEGREES + ", one AS (SELECT node_id FROM shown ORDER BY calls + called_by DESC, node_id LIMIT 1) SELECT * FROM lnk WHERE source IN (FROM one) OR target IN (FROM one)"),
        "diff_files": _diff("file"), "diff_functions": _diff("function"), "diff_classes": _diff("class"),
        "diff_stats": _sql("SELECT kind, project, replace(change_kind, 'changed', 'modified') AS status, count(*) AS n FROM last_steps GROUP BY ALL"),
        "diff_callees": _sql("@ s AS (SELECT sites.*, t FROM sites JOIN (SELECT edge_id, min(loaded_at) AS t FROM call_edges GROUP BY ALL) USING (edge_id)), b AS (SELECT DISTINCT caller, callee_name AS callee FROM s JOIN (SELECT project, min(t) AS start FROM s GROUP BY ALL) USING (project) WHERE t < start + INTERVAL 1 DAY), h AS (SELECT DISTINCT caller, callee_name AS callee FROM sites) SELECT caller, callee, 'gained' AS change FROM (FROM h EXCEPT FROM b) UNION ALL SELECT caller, callee, 'lost' FROM (FROM b EXCEPT FROM h)"),
        "sync_plan": _sql(f"SELECT project, path, {_PLAN} FROM last_steps WHERE kind = 'file'"),
        "sync_apply": _sql(f"""@ plan AS (SELECT project, path, {_PLAN} FROM last_steps WHERE kind = 'file'),
listed AS (SELECT path, snapshot_no = base_no AS old FROM recs JOIN last_two USING (project) WHERE kind = 'file' AND snapshot_no IN (base_no, head_no)),
hang AS (SELECT 'import' AS kind, path, source AS name, '' AS value FROM (SELECT DISTINCT import_id, file_id, source FROM imports WHERE source IS NOT NULL) JOIN files USING (file_id)
  UNION ALL SELECT 'call', file, concat_ws('>', caller, callee_name), coalesce(line::VARCHAR, '?') FROM sites),
versions AS (SELECT kind, path, name, value, snapshot_no = base_no AS old FROM recs JOIN last_two USING (project) WHERE kind <> 'file' AND snapshot_no IN (base_no, head_no)
  UNION ALL SELECT hang.*, old FROM hang JOIN listed USING (path)),
stale AS (SELECT path FROM plan WHERE action IN ('update', 'remove')), fresh AS (SELECT path FROM plan WHERE action IN ('parse', 'update'))
SELECT kind, path, name, value AS lines FROM versions v WHERE CASE WHEN old THEN NOT EXISTS (SELECT 1 FROM stale WHERE stale.path = v.path) ELSE EXISTS (SELECT 1 FROM fresh WHERE fresh.path = v.path) END"""),
        "sync_counts": _sql("SELECT project, count_if(change_kind = 'added') AS parsed, count_if(change_kind = 'changed') AS updated, count_if(change_kind = 'removed') AS removed, count_if(change_kind = 'same') AS unchanged, count_if(change_kind <> 'removed') AS total_files FROM last_steps WHERE kind = 'file' GROUP BY ALL"),
        "hash_record": _sql("SELECT path, value AS sha1 FROM recs JOIN last_two ON last_two.project = recs.project AND snapshot_no = head_no WHERE kind = 'file' AND path IN (SELECT path FROM fn UNION SELECT path FROM cl)"),
        "hash_stream": _sql("SELECT path, sha1 FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY snapshot_no DESC, loaded_at DESC, sha1 DESC) AS rn FROM h0 WHERE path IS NOT NULL) WHERE rn = 1"),
        "load_file_ids": _sql("@ p AS (SELECT DISTINCT path FROM h0 WHERE path <> '') SELECT path, min(file_id) AS file_id FROM files JOIN p USING (path) GROUP BY ALL UNION ALL SELECT path, (SELECT coalesce(max(file_id), 0) FROM files) + row_number() OVER (ORDER BY path) FROM p WHERE path NOT IN (SELECT path FROM files WHERE path IS NOT NULL AND file_id IS NOT NULL)"),
        "load_edges": _sql(_BOUND + "SELECT edge_id, spelled, caller_func_id FROM bound"),
        "load_tables": _sql(_BOUND + ", p AS (SELECT path FROM fn WHERE path <> '' UNION SELECT path FROM cl WHERE path <> '') SELECT 'files' AS metric, count(*) AS n FROM p UNION ALL SELECT 'functions', count(*) FROM fn UNION ALL SELECT 'classes', count(*) FROM cl UNION ALL SELECT 'imports', count(*) FROM (SELECT DISTINCT import_id, file_id, source FROM imports WHERE source IS NOT NULL) JOIN files USING (file_id) WHERE path IN (FROM p) UNION ALL SELECT 'call_edges', count(*) FROM bound WHERE spelled = 'qualified'"),
        "source_listing": _listing(SKIPPED_DIRECTORIES, EXTENSIONS),
        "baseline_listing": _listing(BASELINE_SKIPPED, BASELINE_EXTENSIONS),
        "module_descriptions": _sql(_CONTENTS + r"""d AS (SELECT file_id, project, path, string_split(path, '/') AS s FROM f0 WHERE len(string_split(path, '/')) > 2),
k AS (SELECT *, s[2] AS directory FROM d WHERE NOT regexp_matches(s[2], '^(\.|_|venv|node_modules)')),
h AS (SELECT project, directory, min(substring(trim(regexp_extract(substring(content, 1, 500), '(?s)["]{3}(.*?)["]{3}', 1)), 1, 100)) AS description FROM k JOIN newest USING (file_id) WHERE len(s) = 3 AND s[3] = '__init__.py' GROUP BY ALL)
SELECT project, directory, count_if(ends_with(path, '.py')) AS python_files, coalesce(any_value(description), '') AS description, bool_or(contains(lower(directory), 'tool') OR (s[3] = 'tools' AND len(s) > 3)) AS is_tool, bool_or(contains(lower(directory), 'agent') OR (s[3] = 'agent' AND len(s) > 3)) AS is_agent
FROM k LEFT JOIN h USING (project, directory) GROUP BY ALL"""),
        "project_totals": _sql("SELECT project, count(DISTINCT path) AS total_files, coalesce(any_value(n), 0) AS total_functions FROM f0 LEFT JOIN (SELECT project, count(*) AS n FROM fn GROUP BY ALL) USING (project) WHERE path IS NOT NULL GROUP BY ALL"),
        "vector_search": "SELECT query_id, vec_id, rank::INT AS rank, round(distance, 4) AS distance FROM (SELECT q.vec_id AS query_id, r.vec_id, list_cosine_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), r.vec_id) AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0) WHERE rank <= 10",
        "vector_index_items": _sql("SELECT func_id, md5(concat_ws(':', path, qualified_name, start_line::VARCHAR)) AS item_id, concat_ws(chr(10), '函数: ' || qualified_name, '文件: ' || path, '说明: ' || docstring) AS document FROM fn"),
        "vector_store": _sql("SELECT project, count(*) AS items, sum(length(concat_ws(chr(10), '函数: ' || qualified_name, '文件: ' || path, '说明: ' || docstring)))::BIGINT AS chars FROM fn WHERE project > (SELECT min(project) FROM fn) GROUP BY ALL"),
        "vector_fallback": f"SELECT item_id, vec_id, rank::INT AS rank FROM (SELECT item_id, r.vec_id, row_number() OVER (PARTITION BY item_id ORDER BY list_cosine_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), r.vec_id) AS rank FROM eval_items JOIN embeddings q ON q.vec_id = item_id, embeddings r WHERE {_intent('question')} IN ('unknown', 'search')) WHERE rank <= 3",
        "semantic_hits": "SELECT pair_id, round(s, 6) AS similarity, s >= 0.55 AS hit FROM (SELECT vec_id AS pair_id, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-9) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS a, label FROM embeddings) JOIN (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS b FROM embeddings GROUP BY ALL) USING (label))",
        "question_intents": _sql(_KEYWORDS + f"SELECT item_id, {_intent('question')} AS detected, {_intent('question')} = expected_type AS intent_correct, coalesce(words, '') AS words FROM eval_items LEFT JOIN (SELECT item_id, string_agg(word, ' ' ORDER BY pos) AS words FROM asked GROUP BY ALL) USING (item_id)"),
        "question_functions": _sql(_KEYWORDS + ", best AS (SELECT low, min(struct_pack(a := path, b := start_line, c := func_id, q := qualified_name)) AS m FROM (SELECT DISTINCT lower(word) AS low FROM asked) JOIN fn ON contains(lower(qualified_name), low) GROUP BY ALL) SELECT item_id, arg_min(m.q, pos) AS qualified_name FROM asked JOIN best ON low = lower(word) GROUP BY ALL"),
        "naive_retrieval": _sql(_HITS + "SELECT * FROM best"),
        "context_budget": _sql(_HITS + "SELECT file_id, size, least(size, 40000 - before)::BIGINT AS taken FROM (SELECT *, coalesce(sum(size) OVER (ORDER BY hits DESC, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM best) WHERE before < 40000"),
        "call_words": _sql(f"@ w AS (SELECT file_id, unnest(list_distinct(regexp_extract_all(content, '{CALL_WORD}', 1))) AS word FROM file_contents WHERE content IS NOT NULL) SELECT file_id, count(*) AS words, count(n) AS known FROM w LEFT JOIN (SELECT DISTINCT name AS n FROM fn) ON n = word GROUP BY ALL"),
        "raw_keywords": f"SELECT item_id, {_raw('question')} AS word FROM eval_items",
        "text_intents": f"SELECT doc_id, {_intent('text')} AS detected, {_raw('text')} AS word FROM documents",
        "empty_answers": _sql("SELECT item_id, coalesce(n, 0) = 0 AND d IS NULL AS empty FROM eval_items LEFT JOIN (SELECT name, count(*) AS n, min(docstring) AS d FROM fn GROUP BY ALL) ON name = expected_target"),
        "json_parts": "SELECT doc_id, CASE WHEN json_valid(o) THEN o END AS object, CASE WHEN json_valid(a) THEN a END AS array FROM (SELECT doc_id, nullif(regexp_extract(text, '(?s)\\{.*\\}'), '') AS o, nullif(regexp_extract(text, '(?s)\\[.*\\]'), '') AS a FROM documents)",
        "event_json": "SELECT event_id, regexp_extract(props, '(?s)\\{.*\\}') AS object FROM events WHERE json_valid(nullif(regexp_extract(props, '(?s)\\{.*\\}'), ''))",
        "citation_gate": _sql(_ANSWERS + "SELECT *, confidence >= 0.5 AS passed FROM gate"),
        "eval_scores": _sql(_ANSWERS + "SELECT * FROM scored"),
        "eval_report": _sql(_ANSWERS + "SELECT category, count(*) AS questions, count_if(score >= 0.7) AS passed, round(avg(score), 6) AS mean_score FROM scored GROUP BY ALL"),
        "reflect_verdict": _sql(_KEYWORDS + ", " + _ANSWERS.lstrip()[1:] + f"SELECT item_id, CASE WHEN regexp_matches(answer, '__truncated__|已省略|截断') THEN 'truncated' WHEN regexp_matches(answer, '{UNRESOLVED}') THEN 'unresolved' WHEN NOT regexp_matches(answer, '{CITATION}') AND item_id IN (SELECT item_id FROM asked) THEN 'no_citation' ELSE 'none' END AS verdict FROM ans"),
        "result_truncation": _sql("SELECT caller, least(n, 20) AS kept, greatest(n - 20, 0) AS omitted FROM (SELECT caller, count(*) AS n FROM sites GROUP BY ALL)"),
        "result_items": _sql("SELECT caller, rn::INT AS at, callee_name, greatest(n - 20, 0) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY file NULLS FIRST, line NULLS FIRST, callee_name, edge_id) AS rn, count(*) OVER (PARTITION BY caller) AS n FROM sites) WHERE rn <= 20"),
        "result_summary": _sql("SELECT caller, substring(j, 1, 8000) AS summary, length(j) AS chars FROM (SELECT caller, to_json(struct_pack(caller := caller, items := list(callee_name ORDER BY rn), omitted := greatest(any_value(n) - 20, 0)))::VARCHAR AS j FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY file NULLS FIRST, line NULLS FIRST, callee_name, edge_id) AS rn, count(*) OVER (PARTITION BY caller) AS n FROM sites) WHERE rn <= 20 GROUP BY caller)"),
        "trace_summary": "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
        "trace_stream": "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
        "script_extract": "SELECT file_id, length(trim(regexp_extract(content, '(?s)<script\\b[^>]*>(.*?)</script>', 1))) AS script_chars FROM file_contents WHERE regexp_matches(lower(content), '<(html|script|template)')",
    }
