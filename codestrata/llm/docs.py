"""Functions paired with their documentation, by packrat grammars per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.files import source_files
from codestrata.llm.lexers import COMMENTS, STRINGS, plain_text
from codestrata.llm.peg import PackratGrammar
from codestrata.session import python_rows

#: A documentation worth keeping has so many words, or so many Chinese or Japanese characters.
LEAST_WORDS, LEAST_CJK = 5, 8


def _escaped(regex: str) -> str:
    return regex.replace("'", "\\'")


def _python_source() -> str:
    string, comment = _escaped(STRINGS["python"]), _escaped(COMMENTS["python"])
    return rf"""
File <- (Function | Line)*
Function <- @start Decorator* Head Body?
Decorator <- ~'[ \t]*\x40[^\n]*\n'
Head <- ~'[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*' Round (~'[ \t]*->[ \t]*' Type)? ~'[ \t]*:[ \t]*(?:\#[^\n]*)?'
Round <- ~'[(\[{{]' (Text | Round | ~'[^()\[\]{{}}"\'\#]+' | ~'{comment}')* ~'[)\]}}]'
Type <- (Text | Round | ~'[^:()\[\]{{}}"\'\n]+')+
Body <- ~'(?:[ \t]*(?:\#[^\n]*)?\n)*[ \t]*' Docstring
Docstring <- Text (~'(?:[ \t]|\\\n)*' Text)*
Text <- ~'{string}'
Line <- (Text | ~'{comment}' | ~'[^"\'\#\n]+' | ~'["\']')* (~'\n' | !Any) &Any | (Text | ~'{comment}' | ~'[^"\'\#\n]+' | ~'["\']')+ | ~'\n'
Any <- ~'[\s\S]'
"""


def _braced_source(language: str) -> str:
    string, comment = _escaped(re.sub(r"\(\?P<hashes>(.*?)\)(.*?)\(\?P=hashes\)", r"(?P<h>\1)\2(?P=h)", STRINGS[language])), _escaped(COMMENTS.get(language, r"//[^\n]*|/\*[\s\S]*?\*/"))
    annotation = {"rust": r"\#!?\[[^\n]*\]", "csharp": r"\[[^\n]*\]"}.get(language, r"\x40[\w.]+(?:\([^\n]*\))?")
    return rf"""
File <- (Documented | Line)*
Documented <- Comments Annotation* @start
Comments <- Comment+
Comment <- ~'[ \t]*(?:{comment})[ \t]*\n'
Annotation <- ~'[ \t]*(?:{annotation})[ \t]*(?:{comment})?[ \t]*\n'
Line <- (Text | ~'{comment}' | ~'[^"\'`/\n]+' | ~'["\'`/]')+ ~'\n?' | ~'\n'
Text <- ~'{string}'
"""


@lru_cache(maxsize=None)
def _grammar(language: str) -> PackratGrammar:
    return PackratGrammar(_python_source() if language == "python" else _braced_source(language))


def documentation(text: str, language: str, starts: list[int]) -> dict[int, str]:
    """Raw documentation by 1-based start line, for the ``starts`` that have any directly at them.

    For Python it is the docstring; for the other languages the comment block
    directly above the line, with annotation lines allowed in between.
    """
    offsets = [0]
    offsets += [m.end() for m in re.finditer("\n", text)]
    wanted = {offsets[s - 1]: s for s in starts if 1 <= s <= len(offsets)}
    found: dict[int, str] = {}
    if not wanted:
        return found
    grammar = _grammar(language)
    tests = {"start": wanted.__contains__}
    if language == "python":
        pending: list[tuple[int, int]] = []
        actions = {"Docstring": lambda a, b: pending.append((a, b)), "Function": lambda a, b: (
            found.__setitem__(wanted[a], text[pending[-1][0]:pending[-1][1]]) if pending and a <= pending[-1][0] < b else None)}
    else:
        last: list[tuple[int, int]] = []
        actions = {"Comments": lambda a, b: last.append((a, b)), "Documented": lambda a, b: found.__setitem__(wanted[b], text[last[-1][0]:last[-1][1]])}
    grammar.parse(text, "File", actions, tests)
    return found


_TAG_LINE = re.compile(r"^\s*(?:[:@\\]\w+.*|</?(?:param|returns?|exception|typeparam|value|remarks|see|seealso|inheritdoc)\b.*|(?:Args|Arguments|Parameters|Returns|Raises|Yields)\s*:\s*)$")
_MARKUP = re.compile(r"</?\w+[^>\n]*>|\{@\w+[^}]*\}")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def plain_documentation(raw: str, language: str) -> str:
    """The text without comment marks, quotes, markup and tag lines."""
    text = raw
    if language == "python":
        text = re.sub(r"^\s*[rRuUbBfF]{0,2}(\"\"\"|'''|\"|')", "", text)
        text = re.sub(r"(\"\"\"|'''|\"|')\s*$", "", text)
    lines = []
    for line in text.split("\n"):
        if language != "python":
            line = re.sub(r"^\s*(?:/{2,}!?|/\*+!?|\*+(?!/))?\s?", "", line)
            line = re.sub(r"\s*\*+/\s*$", "", line)
        if not _TAG_LINE.match(line):
            lines.append(_MARKUP.sub(" ", line).strip(" \t*-=#"))
    return re.sub(r"\n{2,}", "\n", "\n".join(lines)).strip()


def informative(doc: str) -> bool:
    """At least five words, or eight Chinese or Japanese characters."""
    cjk = len(_CJK.findall(doc))
    return cjk >= LEAST_CJK or len(_WORD.findall(_CJK.sub(" ", doc))) >= LEAST_WORDS


PAIRS = "func_id long, file_id long, language string, qualified_name string, start_line int, end_line int, code string, documentation string"


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, language, content, functions in zip(pdf["file_id"], pdf["language"], pdf["content"], pdf["functions"]):
            text = plain_text(content)
            lines = text.split("\n")
            count = len(lines) - (lines[-1] == "")
            inside = [f for f in functions if 1 <= f["start_line"] <= f["end_line"] <= count]
            found = documentation(text, language, sorted({f["start_line"] for f in inside})) if inside else {}
            for f in inside:
                raw = found.get(f["start_line"])
                doc = plain_documentation(raw, language) if raw else ""
                if informative(doc):
                    code = "\n".join(lines[f["start_line"] - 1:f["end_line"]])
                    rows.append((f["func_id"], file_id, language, f["qualified_name"], f["start_line"], f["end_line"], code, doc))
        yield pd.DataFrame(rows, columns=["func_id", "file_id", "language", "qualified_name", "start_line", "end_line", "code", "documentation"]).astype(
            {"func_id": "int64", "file_id": "int64", "start_line": "int32", "end_line": "int32"})


def documented_functions(functions: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """Code and documentation of the ``functions`` (records of the latest snapshots) that have any worth the name.

    Functions whose lines do not lie within their file's content, whose file has
    no content, or whose documentation has fewer than five words give no row.
    The functions of one file go to the task that holds its content.
    """
    source = source_files(files, contents, alike=True)
    listed = functions.where("start_line is not null and end_line is not null and func_id is not null").groupBy("file_id").agg(
        F.collect_list(F.struct("func_id", "qualified_name", "start_line", "end_line")).alias("functions")
    )
    return python_rows(source.join(listed, "file_id").select("file_id", "language", "content", "functions"), _pairs, PAIRS)
