"""Small lexers, one regular expression per language; helpers of the operators on source files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

#: Languages by path extension.
LANGUAGES = {
    "py": "python", "java": "java", "js": "javascript", "ts": "typescript",
    "go": "go", "c": "c", "h": "c", "rs": "rust", "cs": "csharp",
}

#: Extensions whose comments and literals read like another language's, though its grammar does not hold for them.
ALIKE = {"jsx": "javascript", "tsx": "typescript", "vue": "javascript", "cpp": "c", "hpp": "c", "cc": "c", "cxx": "c"}

KEYWORDS = {
    "python": "and as assert async await break class continue def del elif else except False finally for from global if "
              "import in is lambda None nonlocal not or pass raise return True try while with yield",
    "java": "abstract assert break case catch class continue default do else enum extends final finally for if implements import "
            "instanceof interface native new package private protected public return static strictfp switch synchronized "
            "throw throws transient try volatile while goto const",
    "javascript": "await break case catch class const continue debugger default delete do else enum export extends finally for "
                  "function if import in instanceof let new return super switch this throw try typeof var void while with yield",
    "typescript": "await break case catch class const continue debugger default delete do else enum export extends finally for "
                  "function if import in instanceof let new return super switch this throw try typeof var void while with yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package "
          "range return select struct switch type var",
    "c": "auto break case const continue default do else enum extern for goto if inline register restrict return sizeof "
         "static struct switch typedef union volatile while",
    "rust": "as async await break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref "
            "return static struct trait type unsafe use where while",
    "csharp": "abstract as base break case catch checked class const continue default delegate do else enum event explicit extern "
              "finally fixed for foreach goto if implicit in interface internal is lock namespace new operator out override params "
              "private protected public readonly ref return sealed sizeof stackalloc static struct switch this throw try typeof "
              "unchecked unsafe using virtual volatile while",
}
#: The basic type names of C, one token kind.
C_TYPES = "void char short int long float double signed unsigned bool _Bool"

_SLASHES = r"//[^\n]*|/\*[\s\S]*?\*/"
_QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*"'
_TICKED = r"'(?:[^'\\\n]|\\[\s\S])*'"
_PY_PREFIX = r"(?:[rRuUbBfFtT]{1,2})?"
COMMENTS = {"python": r"\#[^\n]*", "rust": r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*[\s\S]*?\*/)*\*/"}
STRINGS = {
    "python": rf'{_PY_PREFIX}"""(?:[^\\]|\\[\s\S])*?"""|' + rf"{_PY_PREFIX}'''(?:[^\\]|\\[\s\S])*?'''|"
              rf"{_PY_PREFIX}{_QUOTED}|{_PY_PREFIX}{_TICKED}",
    "java": rf'"""(?:[^\\]|\\[\s\S])*?"""|{_QUOTED}|{_TICKED}',
    "javascript": rf"{_QUOTED}|{_TICKED}|`(?:[^`\\]|\\[\s\S])*`",
    "typescript": rf"{_QUOTED}|{_TICKED}|`(?:[^`\\]|\\[\s\S])*`",
    "go": rf"{_QUOTED}|`[^`]*`|{_TICKED}",
    "c": rf"(?:u8|[uUL])?{_QUOTED}|[uUL]?{_TICKED}",
    "rust": r'b?r(?P<hashes>\#*)"[\s\S]*?"(?P=hashes)|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?' + r"'(?:[^'\\\n]|\\[^\n]{1,10}?)'",
    "csharp": rf'"""[\s\S]*?"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?{_QUOTED}|{_TICKED}',
}
#: How a string with letters before its quotes begins, as what a word may not begin with.
_STRING_START = dict.fromkeys(LANGUAGES.values(), "") | {
    "python": r"(?![rRuUbBfFtT]{1,2}[\"'])", "c": r"(?!(?:u8|[uUL])\"|[uUL]')", "rust": r"(?!b?r\#*\"|[bc]\"|b')", "csharp": r"(?![$@]+\")",
}
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[A-Za-z0-9_]*"
_OPERATORS = (
    r"\.\.\.|\.\.=|>>>=|<<=|>>=|\*\*=|//=|&&=|\|\|=|\?\?=|===|!==|&\^=|->|=>|::|:=|\+\+|--|<-|&&|\|\||\?\?|\?\.|\.\.|==|!=|<=|>=|"
    r"\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|&\^|[-+*/%&|^~!<>=?:;,.(){}\[\]@#$\\]"
)

#: Operators with one grammatical role share a token kind.
BINARY = frozenset("== != === !== <= >= && || ?? += -= /= %= &= |= ^= *= <<= >>= >>>= **= //= &&= ||= ??= &^= <- << &^ / % | ^ **".split())
SIGNS = frozenset("+ -".split())


@lru_cache(maxsize=None)
def _pattern(language: str) -> re.Pattern:
    word = r"[@$]?[^\W\d]\w*" if language == "csharp" else r"[^\W\d][\w$]*|\$[\w$]*"
    # words are the most frequent tokens and are tried early, unless they begin a string
    parts = [
        ("space", r"[ \t\f\v\xa0​]+|\\\n"), ("word", f"{_STRING_START[language]}(?:{word})"), ("line", r"\n"),
        ("comment", COMMENTS.get(language, _SLASHES)), ("string", STRINGS[language]),
        ("number", _NUMBER),
        ("operator", _OPERATORS), ("loose", word), ("other", r"[\s\S]"),
    ]
    if language == "python":
        # // and the prefix operators of other languages would hide Python's own tokens
        parts[6] = ("operator", r"\.\.\.|\*\*=|//=|>>=|<<=|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%&|^~<>=:;,.(){}\[\]@]")
    elif language not in ("javascript", "typescript"):
        # two stars are two pointers or dereferences there
        parts[6] = ("operator", _OPERATORS.replace(r"\*\*=|", "").replace(r"\*\*|", ""))
    if language == "c":
        parts.insert(2, ("directive", r"(?<![^\n])[ \t]*\#(?:\\\n|[^\n])*"))
    if language == "rust":
        parts.insert(5, ("lifetime", r"'[^\W\d]\w*(?!')"))
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in parts))


def plain_text(content: str) -> str:
    """Content with LF line ends and without a byte order mark."""
    return content.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


#: Groups within a pattern, and what they are part of.
_SAME_KIND = {"hashes": "string", "loose": "word"}
_CLOSING, _BEFORE_VALUE = frozenset(")]}"), frozenset(("return", "typeof", "case", "in", "of"))
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")


def tokens(text: str, language: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, offset) of every token, spaces and comments included."""
    pattern = _pattern(language)
    if language not in ("javascript", "typescript"):
        for m in pattern.finditer(text):
            kind = m.lastgroup
            yield _SAME_KIND.get(kind, kind), m.group(), m.start()
        return
    # a slash begins a regular expression where no value stands before it
    at, value = 0, False
    while at < len(text):
        for m in pattern.finditer(text, at):
            kind, body, start = m.lastgroup, m.group(), m.start()
            if body[0] == "/" and kind == "operator" and not value and (m := _REGEX.match(text, start)):
                yield "string", m.group(), start
                value = True
                at = m.end()
                break
            yield _SAME_KIND.get(kind, kind), body, start
            if kind == "operator":
                value = body in _CLOSING
            elif kind == "word":
                value = body not in _BEFORE_VALUE
            elif kind == "number" or kind == "string":
                value = True
        else:
            return


def _words(language: str) -> frozenset[str]:
    return frozenset(KEYWORDS[language].split())


@lru_cache(maxsize=None)
def _kinds(language: str) -> dict[str, str]:
    """Token kinds of fixed spellings."""
    kinds = {op: "BIN" for op in BINARY} | {op: "SIGN" for op in SIGNS} | {"++": "INC", "--": "INC"}
    kinds |= {w: w for w in _words(language)}
    if language == "c":
        kinds |= {w: "TYPE" for w in C_TYPES.split()}
    if language == "python":
        kinds |= {"None": "NUM", "True": "NUM", "False": "NUM", "//": "BIN", ">>": "BIN", "**": "**", "/": "/", "->": "->", "...": "NUM", ":=": ":="}
        kinds |= {w: "AUG" for w in "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()}
    if language == "go":
        kinds |= {"<-": "<-"}
    if language in ("rust", "csharp"):
        kinds |= {"|": "|", "||": "||", "..": "..", "..=": ".."}
    if language == "rust":
        kinds |= {"&&": "&&"}
    return kinds


_DIRECTIVE = re.compile(r"\s*\#\s*(?:(?:include|include_next|import|define|undef|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|error|warning|line|pragma|\d+)\b|$)")
#: After a line that ends in one of these kinds Go reads a semicolon.
_GO_END = frozenset("ID NUM STR break continue fallthrough return INC ) ] }".split())
_JS_END = frozenset("ID NUM STR break continue return this super INC ) ] }".split())
_JS_START = frozenset("ID NUM STR INC this super @ { function class const let var if for while do switch try throw return import export new "
                      "typeof void delete await yield break continue debugger".split())


def grammar_tokens(text: str, language: str) -> list[tuple[str, int]]:
    """(kind, offset) of the tokens a grammar reads.

    Comments and spaces are left out. Python gets NEWLINE, INDENT and DEDENT,
    Go its semicolons, the scripting languages an END where a line break may
    end a statement. What no rule of the lexer covers is an ERROR token.
    """
    kinds = _kinds(language)
    out: list[tuple[str, int]] = []
    if language == "python":
        return _python_tokens(text, kinds)
    last, broken, depth = "", False, []
    ends = _GO_END if language == "go" else _JS_END if language in ("javascript", "typescript") else ()
    for kind, body, at in tokens(text, language):
        if kind == "comment":
            broken = broken or "\n" in body
            continue
        if kind == "space":
            continue
        if kind == "line":
            broken = True
            continue
        if kind == "word":
            name = kinds.get(body, "ID")
        elif kind == "number":
            name = "NUM"
        elif kind == "string":
            name = "STR"
        elif kind == "directive":
            name = "DIRECTIVE" if _DIRECTIVE.match(body) else "ERROR"
        elif kind == "lifetime":
            name = "LIFE"
        elif kind == "operator":
            name = kinds.get(body, body)
        else:
            name = "ERROR"
        if broken and last in ends:
            if language == "go":
                out.append((";", at))
            elif name in _JS_START and (not depth or depth[-1] == "{"):
                out.append(("END", at))
        broken = False
        if name in "([{":
            depth.append(name)
        elif name in ")]}" and depth:
            depth.pop()
        out.append((name, at))
        last = name
    if language == "go" and last in ends:
        out.append((";", len(text)))
    return out


def _python_tokens(text: str, kinds: dict[str, str]) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    indents, depth, fresh, width = [0], 0, True, 0
    for kind, body, at in tokens(text, "python"):
        if kind == "line":
            if depth == 0 and not fresh:
                out.append(("NEWLINE", at))
            if depth == 0:
                fresh, width = True, 0
            continue
        if kind == "space":
            if fresh and "\n" not in body:
                width = 0
                for c in body:
                    width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + 1
            continue
        if kind == "comment":
            continue
        if fresh and depth == 0:
            if width > indents[-1]:
                indents.append(width)
                out.append(("INDENT", at))
            while width < indents[-1]:
                indents.pop()
                out.append(("DEDENT", at))
            if width != indents[-1]:
                out.append(("ERROR", at))
        fresh = False
        name = {"number": "NUM", "string": "STR", "other": "ERROR"}.get(kind) or kinds.get(body, "ID" if kind == "word" else body)
        if name in "([{":
            depth += 1
        elif name in ")]}":
            depth = max(0, depth - 1)
        out.append((name, at))
    if out and out[-1][0] != "NEWLINE" and not (depth == 0 and fresh):
        out.append(("NEWLINE", len(text)))
    out += [("DEDENT", len(text))] * (len(indents) - 1)
    return out


@lru_cache(maxsize=None)
def _pieces_pattern(language: str) -> re.Pattern:
    parts = [("comment", COMMENTS.get(language, _SLASHES)), ("string", STRINGS[language])]
    if language == "rust":
        parts.append(("lifetime", r"'[^\W\d]\w*(?!')"))
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in parts))


def text_pieces(text: str, language: str) -> list[tuple[str, str, int]]:
    """(kind, text, offset) of comments and string literals, searched for without reading the code between."""
    found = []
    for m in _pieces_pattern(language).finditer(text):
        kind = "string" if m.lastgroup == "hashes" else m.lastgroup
        if kind != "lifetime":
            found.append((kind, m.group(), m.start()))
    return found
