"""Files nobody wrote by hand: generated, packed, third-party copies, and data stored as code."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.files import tasks
from codestrata.llm.lexers import LANGUAGES, plain_text
from codestrata.operators.store import newest_contents
from codestrata.session import python_rows
from codestrata.sources.tables import project_files

#: Names of attribute files, and the attributes that mark a path.
ATTRIBUTE_FILES = (".gitattributes",)
MARKS = {"linguist-generated": "generated", "linguist-vendored": "vendored", "generated": "generated", "vendored": "vendored"}

#: Attributes of a repository that declares none, in the syntax of an attribute file at its root.
DEFAULT_ATTRIBUTES = """
**/vendor/** vendored
**/vendors/** vendored
**/vendored/** vendored
**/third_party/** vendored
**/third-party/** vendored
**/thirdparty/** vendored
**/3rdparty/** vendored
**/3rd_party/** vendored
**/external/** vendored
**/externals/** vendored
**/deps/** vendored
**/node_modules/** vendored
**/bower_components/** vendored
**/jspm_packages/** vendored
**/site-packages/** vendored
**/dist-packages/** vendored
**/venv/** vendored
**/.venv/** vendored
**/Godeps/** vendored
**/Pods/** vendored
**/Carthage/** vendored
**/generated/** generated
**/__generated__/** generated
**/autogen/** generated
**/gen/** generated
**/generated-sources/** generated
**/generated_sources/** generated
**/codegen-out/** generated
**/dist/** generated
*_pb2.py generated
*_pb2_grpc.py generated
*.pb.go generated
*.pb.gw.go generated
*.pb.cc generated
*.pb.h generated
*.pb-c.c generated
*.pb-c.h generated
*.pb.rs generated
*OuterClass.java generated
*Grpc.java generated
*.gen.* generated
*.generated.* generated
*_generated.* generated
*.autogen.* generated
*.g.cs generated
*.g.ts generated
*.g.dart generated
*.g.go generated
*.designer.cs generated
*.Designer.cs generated
zz_generated.* generated
*.min.js generated
*-min.js generated
*.min.ts generated
*.bundle.js generated
*.chunk.js generated
*.[0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f].js generated
*.tab.c generated
lex.yy.c generated
"""

#: Directories whose next directory names a library.
VENDOR_ROOTS = ("vendor", "vendors", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "external", "externals",
                "deps", "node_modules", "bower_components", "site-packages", "dist-packages")

#: A packed file has so many semicolons and braces a line; hand-written ones have one or two.
PACKED_SIGNS = 12
#: Bytes of attribute files, at most, that are broadcast.
MAX_BROADCAST_RULES = 8 << 20
#: A mined pattern holds in so many files of so many projects, and for this share of the files that show it.
PATTERN_FILES, PATTERN_PROJECTS, PATTERN_SHARE = 4, 2, 0.9

_VERSION = r"v?\d+(?:\.\d+)+\S*"
GENERATED_HEADER = re.compile(
    r"code generated (?:by|from)\b|\bauto-?\s?generated\b|automatically generated\b|@generated\b|"
    r"generated (?:by|from|with) (?!hand)[^\n]{0,80}(?:do not (?:edit|modify)|don't edit|will be (?:lost|overwritten))|"
    r"(?:do not|don't) (?:edit|modify)[^\n]{0,40}(?:generated|by hand|manually)|this file (?:is|was) generated\b|"
    r"generated (?:file|code|source)\b[^\n]{0,60}(?:do not|don't)", re.I)
VENDORED_HEADER = re.compile(
    rf"(?:copied|imported|taken|vendored|borrowed|forked)\b[^\n]{{0,20}} from (?:the )?\S+(?: distribution| project| library)?,?[^\n]{{0,12}} {_VERSION}|"
    rf"^[\W_]*[\w.-]+ {_VERSION} \(c\)|^[\W_]*[\w.-]+ {_VERSION}[^\n]{{0,60}}(?:licen[cs]e|copyright)|vendored from\b|upstream,? do not patch", re.I | re.M)

# -- attribute files


def glob_regex(pattern: str) -> re.Pattern:
    """The regular expression of an attribute glob, for a path relative to the file's directory.

    ``*`` and ``?`` stop at a slash, ``**`` does not; a pattern without a slash
    matches the last path segment at any depth.
    """
    anywhere = "/" not in pattern.rstrip("/")
    if pattern.endswith("/"):
        pattern += "**"
    pattern = pattern.removeprefix("/")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return re.compile(("(?:[^/]+/)*" if anywhere else "") + out + r"\Z")


def read_attributes(text: str) -> list[tuple[str, str, bool | None]]:
    """(glob, mark, value) of every line of an attribute file that names a mark: True for ``mark``, False for ``-mark``, None for ``!mark``.

    A pattern that ends in a slash names a directory, and attributes are those
    of files, so it is left out.
    """
    rules = []
    for line in plain_text(text).split("\n"):
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#") or parts[0].endswith("/"):
            continue
        for word in parts[1:]:
            name, _, value = word.lstrip("-!").partition("=")
            if name in MARKS:
                rules.append((parts[0], MARKS[name], None if word.startswith("!") else not word.startswith("-") and value.lower() not in ("false", "0", "off")))
    return rules


class Attributes:
    """The rules of one repository: deeper directories win, then later lines."""

    def __init__(self, declared: list[tuple[str, str]]):
        self.rules = []
        for directory, text in sorted(declared, key=lambda d: d[0].count("/") if d[0] else -1):
            self.rules += [(directory, glob_regex(g), mark, value) for g, mark, value in read_attributes(text)]

    def marks(self, path: str) -> dict[str, bool]:
        found: dict[str, bool] = {}
        for directory, regex, mark, value in self.rules:
            inside = path if not directory else path.removeprefix(directory + "/") if path.startswith(directory + "/") else None
            if inside is not None and regex.match(inside):
                found.pop(mark, None)
                if value is not None:
                    found[mark] = value
        return found


@lru_cache(maxsize=1)
def _defaults() -> Attributes:
    return Attributes([("", DEFAULT_ATTRIBUTES)])


# -- contents

_OPENING = re.compile(r"\A\s*(?:(?:#(?!\[|include|define|if|pragma)[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|--[^\n]*)\s*)+")
#: A row of literals, with the comment that may end it. Every repetition is possessive: a number is
#: never split again, so a line that fails does so in one pass.
_LITERALS = re.compile(r"""^(?P<data>[\s\[\]{}(),]*+(?:(?:-?0[xX][0-9a-fA-F]++|-?\d[\d_]*+(?:\.\d++)?+(?:[eE][+-]?\d++)?+|b?["'][A-Za-z0-9+/=_\\-]{12,}+["'])[uUlLf]*+[\s,;\[\]{}()]*+)++)(?:(?://|\#|/\*).*)?$""")
_LONG_LITERAL = re.compile(r"""["'`][A-Za-z0-9+/=_\\-]{200,}["'`]""")
_DEFINED = re.compile(r"\b(?:def|fn|func|function|void|int|long|double|bool|string|object|char)\s+(?:\([^)\n]*\)\s*)?\*?([A-Za-z_]\w*)\s*[(<\[]")


def evidence(content: str, ext: str) -> tuple[str | None, str | None]:
    """(reason, common first word of the functions defined), from the content alone."""
    text = plain_text(content)
    m = _OPENING.match(text)
    head = m.group() if m else ""
    prefix = None
    names = [re.match(r"[A-Za-z][a-z0-9]*", n.lstrip("_")) for n in _DEFINED.findall(text)]
    firsts = Counter(n.group().lower() for n in names if n and n.group().lower() not in ("main", "init"))
    if firsts:
        word, times = firsts.most_common(1)[0]
        if times >= 0.8 * sum(firsts.values()):
            prefix = word
    if VENDORED_HEADER.search(head):
        return "vendored", prefix
    if GENERATED_HEADER.search(head):
        return "generated", prefix
    lines = [line for line in text.split("\n") if line.strip()]
    size = len(text.strip())
    if size:
        blob = sum(m.end("data") for line in lines if (m := _LITERALS.match(line))) + sum(len(x) for x in _LONG_LITERAL.findall(text))
        if blob >= 0.6 * size:
            return "data", prefix
        spaces = sum(1 for c in text if c.isspace())
        dense = sum(map(text.count, ";{}")) >= PACKED_SIGNS * len(lines)
        if ext in ("js", "ts", "css", "jsx", "mjs") and dense and spaces <= 0.2 * size:
            return "minified", prefix
    return None, prefix


# -- path features for mined patterns


def features(path: str) -> list[str]:
    """Equivalent patterns a path shows: each directory, and the ends of the name."""
    parts = path.split("/")
    found = {f"**/{d}/**" for d in parts[1:-1]}
    name = parts[-1]
    stem, _, ext = name.rpartition(".")
    for sign in "._-":
        head, found_sign, tail = stem.rpartition(sign)
        if found_sign and head and re.fullmatch(r"[A-Za-z][\w-]{1,15}", tail):
            found.add(f"*{sign}{tail}.{ext}")
    return sorted(found)


def library_names(path: str) -> list[str]:
    """The library whose copy a path lies in: the directory below a vendor root, without a version."""
    parts = path.split("/")[:-1]
    found = []
    for root, following in zip(parts, parts[1:]):
        if root in VENDOR_ROOTS and following not in VENDOR_ROOTS:
            found.append(re.sub(r"[-_@]v?\d+(?:\.\d+)*.*$", "", following).lower())
    return found


JUDGED = "file_id long, project string, declared int, path_mark string, content_mark string, prefix string, libraries array<string>, patterns array<string>"


def _judge_with(shared):
    """Judges rows whose rules stand beside them, or in ``shared``, a broadcast of rules by project."""
    return lambda batches: _judge(batches, None if shared is None else shared.value)


def _judge(batches: Iterator[pd.DataFrame], declared_rules: dict | None) -> Iterator[pd.DataFrame]:
    repositories: dict[str, Attributes] = {}
    for pdf in batches:
        rows = []
        own_rules = pdf["rules"] if declared_rules is None else pdf["project"].map(declared_rules.get)
        for file_id, path, project, content, rules in zip(pdf["file_id"], pdf["path"], pdf["project"], pdf["content"], own_rules):
            inside = path.partition("/")[2] or path
            declared, mark = None, None
            if rules is not None:
                if project not in repositories:
                    repositories[project] = Attributes([(r["directory"], r["text"]) for r in rules])
                    if len(repositories) > 500:
                        repositories = {project: repositories[project]}
                own = repositories[project].marks(inside)
                if own:
                    declared = int(any(own.values()))
                    mark = next((k for k, v in own.items() if v), None)
            if declared is None:
                mark = next((k for k, v in _defaults().marks(inside).items() if v), None)
            ext = path.rpartition(".")[2].lower()
            reason, prefix = evidence(content, ext) if isinstance(content, str) else (None, None)
            rows.append((file_id, project, declared, mark, reason, prefix, library_names(inside), features(path)))
        out = pd.DataFrame(rows, columns=["file_id", "project", "declared", "path_mark", "content_mark", "prefix", "libraries", "patterns"])
        out["declared"] = out["declared"].astype("Int32")
        yield out.astype({"file_id": "int64"})


def attribute_rules(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(project, rules): directory and text of each attribute file; one row per project that has any."""
    own = files.where(F.element_at(F.split("path", "/"), -1).isin(*ATTRIBUTE_FILES))
    directory = F.regexp_replace(F.regexp_replace("path", r"^[^/]+/", ""), r"/?[^/]+$", "")
    return (
        own.join(newest_contents(contents), "file_id")
        .groupBy("project").agg(F.array_sort(F.collect_set(F.struct(directory.alias("directory"), F.col("content").alias("text")))).alias("rules"))
    )


def judged_files(files: DataFrame, contents: DataFrame, stage) -> DataFrame:
    """One row per file: what its attributes, its path and its content say, and the patterns it shows.

    Attribute files of up to MAX_BROADCAST_RULES bytes together are handed to every
    task, so a project with most of the files is no larger a group than any
    other; beyond that they are joined by project.
    """
    known = project_files(files).where("path is not null")
    all_files = known.repartition(tasks(files), "file_id").join(newest_contents(contents), "file_id", "left")
    rules = stage.keep(attribute_rules(known, contents))
    size = rules.agg(F.sum(F.aggregate("rules", F.lit(0), lambda n, r: n + F.octet_length(r["text"])))).first()[0] or 0
    shared = None
    if size <= MAX_BROADCAST_RULES:
        texts = {r["project"]: [x.asDict() for x in r["rules"]] for r in rules.collect()}
        shared = files.sparkSession.sparkContext.broadcast(texts)
        all_files = all_files.withColumn("rules", F.lit(None).cast("string"))
    else:
        all_files = all_files.join(rules, "project", "left")
    return python_rows(all_files.select("file_id", "path", "project", "content", "rules"), _judge_with(shared), JUDGED)


def machine_made(files: DataFrame, contents: DataFrame, stage) -> DataFrame:
    """(file_id, reason) of files that no author of the project wrote by hand.

    A repository's own attribute files decide about the paths they name.
    Elsewhere default attributes do, then patterns mined from all files: the
    directories and name endings that (nearly) all go with files known to be
    machine made, and the names of libraries found below vendor directories,
    for copies that were moved elsewhere. Contents speak by their opening
    comment, by minified lines and by literal data. Files without content are
    judged by path alone; null paths and ids give no row.
    """
    judged = stage.keep(judged_files(files, contents, stage))
    known = F.when(F.col("declared").isNotNull(), F.col("declared") == 1).otherwise(F.col("path_mark").isNotNull() | F.col("content_mark").isNotNull())
    shown = judged.select("project", known.alias("made"), F.explode("patterns").alias("pattern"))
    mined = (
        shown.groupBy("pattern", "project").agg(F.count(F.lit(1)).alias("n"), F.count_if("made").alias("made"))
        .groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("made").alias("made"), F.count_if(F.col("made") > 0).alias("projects"))
        .where(f"made >= {PATTERN_FILES} and projects >= {PATTERN_PROJECTS} and made >= {PATTERN_SHARE} * n").select("pattern")
    )
    by_pattern = (
        judged.where("declared is null").select("file_id", F.explode("patterns").alias("pattern")).join(mined, "pattern", "left_semi")
        .select("file_id", F.lit("pattern").alias("reason"))
    )
    libraries = judged.select(F.explode("libraries").alias("prefix")).where("length(prefix) >= 4").distinct()
    copies = (
        judged.where("declared is null and prefix is not null").join(libraries, "prefix", "left_semi")
        .select("file_id", F.lit("copy").alias("reason"))
    )
    direct = judged.where(known).select("file_id", F.coalesce("path_mark", "content_mark").alias("reason"))
    every = direct.unionByName(by_pattern).unionByName(copies)
    return every.groupBy("file_id").agg(F.min("reason").alias("reason"))
