"""Operators on source files: syntax, documentation, natural language, origin."""

import ast

import pytest

from codestrata.llm import docs, natural, origin, queries, syntax
from codestrata.llm.derivatives import Grammar
from codestrata.llm.peg import PackratGrammar
from tests.conftest import rows

VALID = {
    "python": ["", "# only\n", "x = [i for i in range(3) if i]\n", "async def f(a, *, b: int = 1, **k) -> int:\n    '''d'''\n    async with a as b:\n        yield b\n",
               "@a.b(1)\nclass A(B, metaclass=M):\n    x: int = 3\n    def f(self): return {**a, 'b': 1}, lambda *x: x\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    del a[1:2], b\n",
               "if a:\n  b = '}}{{' # (\nelif not c in d: e\nelse:\n  f = a if b else c\n", "x = (1,\n  2)\nfrom . import (a,\n  b as c)\n", "match x:\n    case [1, *r] if r:\n        pass\n    case _:\n        pass\n", "print(f'{a}', *b, **c, end='')\n", "with open(a) as f, open(b): pass"],
    "java": ["package a.b;\nimport java.util.*;\n/** d */\n@A(x = 1)\npublic class C<T extends B> extends D<T> implements E, F<G<H>> {\n  private final int[] x = {1, 2};\n  static { y = 1; }\n  C() { super(); }\n  @Override public <U> List<U> m(final U... u) throws X { for (int i = 0; i < 3; i++) { a[i] += 1; } for (var v : u) if (v instanceof G g) return null; else continue;\n  try (R r = new R()) { f(x -> x + 1, C::new, (a, b) -> { return a; }); } catch (A | B e) { throw e; } finally { }\n  return switch (x) { case 1 -> a; default -> b; }; } }",
             "enum A { X(1) { void f() { } }, Y; int z; }", "interface A { default int f() { return (int) 3.0; } }", "record P(int x, int y) { }", "class A { int f() { String s = \"\\\"\"; char c = '\\''; return a ? b : c; } }"],
    "c": ["#include <a.h>\n#define X(a) \\\n  (a)\nstatic const unsigned char T[] = {0x1, 2,};\ntypedef struct s { int a:3; struct s *n; } s_t;\nint main(int argc, char **argv) { int *p = (int *)malloc(sizeof(int)); for (;;) { if (!p->a[1]++) goto out; } do { x = y ? 1 : 2; } while (0);\n switch (x) { case 1: break; default: ; }\nout:\n return -1; }\nint f(void);\nenum e { A, B = 2 };\nint (*fp)(int, char *);\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T struct {\n\ta, b int `json:\"a\"`\n\tE\n}\n\nfunc (t *T) M(a ...int) (n int, err error) {\n\tfor i := range a {\n\t\tif v, ok := m[i]; ok {\n\t\t\tcontinue\n\t\t} else if x {\n\t\t\tgo f()\n\t\t}\n\t}\n\tswitch v := a.(type) {\n\tcase int, string:\n\t\tx = []T{{1, 2}, {a: 3}}\n\tdefault:\n\t\tdefer func() { r <- 1 }()\n\t}\n\treturn t.a + 1, nil\n}\n"],
    "rust": ["//! d\nuse a::{b, c::*};\n#[derive(Debug)]\npub struct P<'a, T: X + 'a> { pub x: &'a T, y: Vec<Option<i64>> }\nenum E { A(i32), B { c: u8 }, C = 3 }\nimpl<'a, T> Tr for P<'a, T> where T: X { fn f(&mut self, a: i64) -> Result<(), E> { let v: Vec<_> = a.iter().map(|x| x + 1).collect::<Vec<_>>(); if let Some(x) = y { return Err(E::A(1)); } else { } for i in 0..10 { println!(\"{}\", i); } match a { 1 | 2 => { } E::B { c, .. } if c > 1 => f()?, _ => (), } while x < y && !z { break; } P { x: &a, y } } }\npub const A: &[i64] = &[1, 2];\nfn g<F>(f: F) where F: Fn(i32) -> i32 { unsafe { *p = 'a'; } }\n"],
    "csharp": ["using System;\nusing A = B.C;\nnamespace N {\n  [Obsolete(\"x\")]\n  public class C<T> : D<T>, IE where T : class, new() {\n    public int P { get; private set; } = 3;\n    private readonly int[] a = { 1, 2 };\n    public C(int x) : base(x) { }\n    public async Task<int> M(ref int a, params object[] b) { foreach (var x in b) { if (x is int y) continue; } var z = from1 ?? new List<int> { 1 }; try { await F(a => a + 1); } catch (E e) when (e.X > 1) { throw; } using (var r = f()) { } switch (a) { case 1: break; default: return 2; } return a switch { 1 => 2, _ => 3 }; }\n    int Q => 3;\n  }\n  enum E { A = 1, B }\n}\n"],
    "javascript": ["", "import a, { b as c } from 'x';\nimport 'fs';\nexport default class A extends B.C {\n  #p = 1\n  static async *m(a, { b, c = 1 }, ...r) { yield* a; }\n  get x() { return this.#p }\n}\nconst f = async (a) => { await a }, g = x => ({ y: x, [z]: 1, ...w })\nlet r = /[/]\\/(/g.test(s) ? `a${b}` : s / 2\nfor (const k of o) if (k in o) continue; else break\nvar i = 0\ni++\nfunction h() { return }\nnew X(1).y?.[2]?.(3)\nlabel: while (1) { try { throw e } catch { } finally { } }\nswitch (a) { case 1: b(); default: c() }\n!function(){return e|1?t:q(e,8)}();\n"],
    "typescript": ["import type { A } from './a';\nexport interface I<T> extends J { a?: string; b(x: number): void; [k: string]: any }\ntype U = 'a' | B<C[]> & { d: number } | ((x: any) => void);\nexport enum E { A, B = 2 }\nabstract class X<T> extends Y<T> implements I<T> {\n  private readonly a: number = 1;\n  constructor(private b?: string) { super() }\n  m<K extends keyof T>(k: K, ...r: any[]): Promise<T> { return (a as any)!.b<C>(d) }\n}\nexport function f(a: any, b: any): any { const v: any = \"x\"; return v }\nconst g = (x: number): number => x\n"],
}
INVALID = {
    "python": ["def f(:\n", "x = (1\n", "if a:\nb = 1\n", "  x = 1\n", "x = 'a\n", "<<<<<<< HEAD\nx = 1\n", "class A {\n}\n", "def f():\n    a\n   b\n", "print a b\n", "x = lenb)\n", "The report builder drops it.\n", "import \n"],
    "java": ["class A { void f() { g(; } }", "class A { int x = 1 }", "class A : B { }", "class A { void f() { a(b\"); } }", "pointer format 1\n", "class A {", "## title\n", "def f(a, b):\n    return a\n"],
    "c": ["int f(int a { return a; }", "int f() { return 1 }", "int f() { if (a { } }", "<!DOCTYPE html>\n", "a;b c;d\n1;x y;2\n", "int f() {", "int f() {\n=======\n}", "# heading\n\nSome text here.\n"],
    "go": ["", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nfunc f() { a b }\n"],
    "rust": ["fn f( { }", "fn f() { let x = ; }", "fn f() { a) }", "fn f() {", "impl A { fn f() { } ", "def f(a):\n    pass\n", "fn f() { let s = \"a; }"],
    "csharp": ["class A { void F() { b = a } }", "class A { void F( { } }", "class A {", "class A extends B { }"],
    "javascript": ["function f( { }", "const x = ;", "f(a b)", "class A { f() { }", "let a: number = 1;", "foo bar\n", "if (a { }", "x = \"a\n", "<<<<<<< HEAD\na()\n"],
    "typescript": ["function f(a: ) { }", "interface A { a: }", "const x: = 1;", "class A {"],
}


@pytest.mark.parametrize("language", VALID)
def test_grammars(language):
    for text in VALID[language]:
        assert syntax.parse_verdict(text, language) == (None, None, None), text
        assert syntax.parse_verdict("﻿" + text.replace("\n", "\r\n"), language)[0] is None, text
    for text in INVALID[language]:
        assert syntax.parse_verdict(text, language)[0] is not None, text


def test_python_cases_agree_with_its_parser():
    for text in VALID["python"]:
        ast.parse(text)
    for text in INVALID["python"]:
        with pytest.raises(SyntaxError):
            ast.parse(text)


def test_failing_token_and_truncation():
    assert syntax.parse_verdict("class A {\n  int x = 1\n}", "java") == ("token", 3, "}")
    assert syntax.parse_verdict("int f() {\n  a();\n", "c")[0] == "truncated"


def test_derivatives_start_afresh(monkeypatch):
    monkeypatch.setattr("codestrata.llm.derivatives.MAX_NODES", 5)
    g = Grammar('start: "(" start* ")" | ID')
    for _ in range(3):
        assert g.failure(["(", "ID", "(", ")", ")"]) is None
        assert g.failure(["(", "ID"]) == 2
        assert g.failure([")"]) == 0


def test_packrat():
    g = PackratGrammar("List <- ~'\\(' (List | Word)* ~'\\)'\nWord <- ~'[a-z]+ ?'")
    seen = []
    assert g.parse("(ab (c d))", "List", {"Word": lambda a, b: seen.append((a, b))}) == 10
    assert seen == [(1, 4), (5, 7), (7, 8)]
    assert g.parse("(ab", "List") is None


PY = '''import os

class A:
    """Class text that is long enough here."""

    @property
    def p(self, x: dict = {"a": ":"}) -> "int":
        # note

        """Gives the number of all open items.

        :param x: input
        """
        return 1

    def q(self):
        """TODO"""

async def r(a,
            b="#("): "One line of documentation here."

def s():
    x = """not a docstring at all here"""
'''


def test_python_documentation():
    got = docs.documentation(PY, "python", [7, 16, 19, 22])
    assert set(got) == {7, 16, 19}
    assert docs.documentation(PY, "python", [6])[6] == got[7]
    assert docs.plain_documentation(got[7], "python") == "Gives the number of all open items."
    assert [docs.informative(docs.plain_documentation(got[k], "python")) for k in (7, 16, 19)] == [True, False, True]


def test_comment_documentation():
    java = 'class A {\n    /**\n     * Returns the least of all values. <b>Fast</b>\n     * @param a input one two three\n     */\n    @Override\n    int f() { return "/* no"; }\n\n    // far away comment with many words\n\n    int g() { }\n}\n'
    got = docs.documentation(java, "java", [7, 11])
    assert set(got) == {7}
    assert docs.plain_documentation(got[7], "java") == "Returns the least of all values.  Fast"
    rust = "/// Keeps the\n/// pending ranges in order.\n#[inline]\nfn f() {}\n/// short\nfn g() {}\n"
    got = docs.documentation(rust, "rust", [4, 6])
    assert docs.informative(docs.plain_documentation(got[4], "rust")) and not docs.informative(docs.plain_documentation(got[6], "rust"))
    assert docs.informative("符号表会收集所有未解析的调用") and not docs.informative("待补充")
    cs = "/// <summary>\n/// Sorts the rows of a table.\n/// </summary>\n/// <param name=\"a\">the long first input value</param>\n[Obsolete]\nint F() {}\n"
    assert docs.plain_documentation(docs.documentation(cs, "csharp", [6])[6], "csharp") == "Sorts the rows of a table."


def test_segments():
    js = "// The loader keeps the rows in order\n// foo(bar, 0);\nconst q = \"SELECT id, name FROM t WHERE line > 3\";\n/* see\n * src/a/b.cfg */\nf('Der Planer prüft die Liste der Klassen'); // 符号表会收集所有未解析的调用\nconst u = 'a b'\n"
    assert [s.strip() for s in natural.segments(js, "javascript")] == ["The loader keeps the rows in order", "Der Planer prüft die Liste der Klassen", "符号表会收集所有未解析的调用"]
    assert natural.segments("## title\n\nThis is a page of plain text about code.\n\n* an item of the list \"with many words in it\"\n", "python") == []
    assert natural.segments("<!DOCTYPE html>\n<p title=\"five words stand in here\">x</p>", "javascript") == []
    assert natural.segments("", "python") == []


def test_origin_evidence():
    assert origin.evidence("// Code generated by x. DO NOT EDIT.\npackage a\n", "go")[0] == "generated"
    assert origin.evidence("package a\n\n// this writer puts a DO NOT EDIT banner into generated code\n", "go")[0] is None
    assert origin.evidence("# libfoo v1.2.3 (c) the authors\n", "py")[0] == "vendored"
    assert origin.evidence("!function(){" + "function a(e,t){return e|2?t:q(e,8)}" * 40 + "}();", "js")[0] == "minified"
    assert origin.evidence("D = [\n" + "    0x1f, 0x92, 0x03,\n" * 60 + "]\n", "py")[0] == "data"
    assert origin.evidence("".join(f"NAME{i} = {i * 7}\n" for i in range(80)), "py")[0] is None
    assert origin.evidence("def foo_a(): pass\ndef foo_b(): pass\n", "py")[1] == "foo"
    assert origin.evidence("", "py") == (None, None)


def test_literal_rows_with_comments_take_one_pass():
    assert origin.evidence(("1024, " * 5 + "// row\n") * 30, "rs")[0] == "data"
    assert origin.evidence(("0x1f, 'c', " * 5 + "# row\n") * 30, "py")[0] is None
    assert origin.evidence(("7, // " + "the words of a person about this constant\n") * 30, "go")[0] is None
    assert origin.evidence("1024, " * 20_000 + "in words\n" + "1987 " * 40 + "were the years\n" + "12.5e3_0" * 5_000, "rs")[0] is None


def test_attribute_precedence():
    a = origin.Attributes([("", "*.js generated\nlib/** vendored\nlib/own/** -vendored\n# c\n"), ("app", "*.js -generated\n/top.py linguist-generated=true\n[ab].c generated\n")])
    assert a.marks("x/y.js") == {"generated": True}
    assert a.marks("app/deep/y.js") == {"generated": False}
    assert a.marks("lib/own/z.py") == {"vendored": False} and a.marks("lib/z.py") == {"vendored": True}
    assert a.marks("app/top.py") == {"generated": True} and a.marks("app/sub/top.py") == {}
    assert a.marks("app/a.c") == {"generated": True} and a.marks("app/c.c") == {}


def test_machine_made_over_tables(spark, folder):
    names = ["p/src/a.py", "p/vendor/quux/b.py", "p/src/c_pb2.py", "p/src/quux_d.py", "p/src/distance/e.py", "r/x/gen.py", "r/vendor/f.py", "r/.gitattributes", "p/src/nothing.py"]
    contents = {1: "def f():\n    pass\n", 4: "def quux_a():\n    pass\ndef quux_b():\n    pass\n", 6: "x = 1\n", 7: "y = 1\n", 8: "x/* generated\nvendor/** -vendored\n"}
    d = folder(files=[{"file_id": i + 1, "path": n, "name": n.split("/")[-1], "project": n[0]} for i, n in enumerate(names)],
               file_contents=[{"file_id": i, "content": c} for i, c in contents.items()])
    assert rows(queries.p1_found(spark, d), "file_id") == [(2,), (3,), (4,), (6,)]


def test_files_over_tables(spark, folder):
    f = lambda i, n: {"file_id": i, "path": f"p/{n}", "name": n, "project": "p"}
    fn = lambda i, file, a, b, no=1: {"snapshot_no": no, "func_id": i, "file_id": file, "name": "f", "qualified_name": "f", "start_line": a, "end_line": b}
    good = "def f():\n    '''Gives the number of open items.'''\n"
    d = folder(
        files=[f(1, "a.py"), f(2, "b.java"), f(3, "c.js"), f(4, "d.txt"), f(5, "e.py")],
        file_contents=[{"file_id": 1, "content": good}, {"file_id": 2, "content": "class A {"}, {"file_id": 3, "content": None}, {"file_id": 4, "content": "(("}, {"file_id": 5, "content": ""}],
        functions=[fn(1, 1, 1, 2), fn(2, 1, 1, 3), fn(3, 1, 2, 1), fn(4, 1, None, 2), fn(5, 3, 1, 1), fn(6, 9, 1, 1)],
        documents=[{"doc_id": i, "text": t, "lang": l} for i, (t, l) in enumerate([("The quick loader keeps all of the rows", "en"), ("Der Planer prüft die Liste der Klassen", "deu"), (None, "fr"), ("x", None)])],
    )
    assert rows(queries.p3_found(spark, d), "func_id") == [(1,)]
    assert rows(queries.p6_found(spark, d), "file_id") == [(2,)]
    assert rows(queries.p6_rates(spark, d), "language", "files", "invalid") == [("java", 1, 1), ("python", 2, 0)]
    assert rows(queries.p4_found(spark, d), "file_id", "nl_lang") == [(1, "en")]


#: Python statements, right and wrong ones; a line break within one is written \\n.
STATEMENTS = r"""
f() = 3
1 = x
def f(a, a=1, b): pass
def f(a, b=1, *, c, d=2, **k): pass
def f(a, /, b=1, *args, c, **k,): pass
def f(a=1, /, b=2): pass
def f(a=1, /, b): pass
def f(*, **k): pass
def f(*): pass
def f(*a: int, b: int = 3) -> x: pass
def f(/, a): pass
def f(**k, a): pass
lambda x, y=1, *z, w, **k: x
lambda x=1, y: x
lambda: 0
x = lambda a: a + 1, 2
a, *b = c
*a, = c
(a, b) = [c, d] = e
[a, (b, c)] += d
(a) += 1
a.b[c].d += 1
a + b = c
None = 1
x: int = 3
(x): int
x.y: int
x, y: int = 3
for x, y in z: pass
for x: pass
for f() in z: pass
for a.b in z: pass
for *a, b in z: pass
del a, b.c, (d, [e])
del f()
with a as b, c as d: pass
with (a as b, c as d): pass
with (a, b): pass
with (a): pass
with a as f(): pass
with (a as b): pass
if (x := 3): pass
if x := 3: pass
x := 3
f(x := 3)
f(a=1, b)
f(**k, *a)
f(a=1, *b, **c)
f(*a, b, c=1)
f(x for x in y)
f(x for x in y, 1)
[x for x in a if b else c]
[x async for x in a if b if c]
[y := 1, y**2]
x[a:b, ::c, *d]
x[a := 1]
{**a, 'b': c, **d}
{*a, b}
{a: b for a in c}
print "x"
async def f(): await x
class A(B, metaclass=C): pass
class A[T: int, *U, **V]: pass
type X[T] = int
def f[T](x: T) -> T: pass
try:\n  pass\nexcept* A as b:\n  pass
try:\n  pass\nexcept (A, B):\n  pass
try:\n  pass
match x:\n  case [1, *r] if r: pass\n  case {"a": b, **c}: pass\n  case A(x=1, y=B()) | None: pass\n  case (1 as x): pass\n  case _: pass
match x:\n  case A(b as c): pass
return x, *y
yield
x = yield y
x = await y
@a.b(c)\ndef f(): pass
@x := y\ndef f(): pass
raise A from b
global a, b
assert x, y
a if b else c = 3
x = a if b
not a = b
-a = b
a.b = c = d[1] = 3
"a" = b
"a".b = c
f().x = 3
f()[1] = 3
a = b == c = d
a < b > c
a is not b
a not in b
x = not y
x = (yield)
x = [*a, *b]
x = *a
x = *a, b
a: b = yield c
import a.b as c, d
from . import x
from ... import (a as b, c,)
from .a.b import *
def f(): return
if a: b
else: c
a; b; c;
if x:\n pass\nelif y:\n pass\nelse:\n pass
while x: break
f(a)(b)[c].d
x = f"{a}" "b"
...
a = ...
... = a
def f(a: int = 1, *b: str, c: bool = True, **d: x): pass
f(a.b=1)
f(a=)
f(,)
f(a,,b)
(a, b
a = [1, 2
def f(a b): pass
def f(a,,b): pass
class A: x: int; y = 2
print(*a, sep="")
@x
lambda *, a: a
lambda *: a
lambda *a, b=1: a
lambda a, /, b: a
x = a @ b
x @= b
x **= 2
x //= 2
a ** -b
a --b
a ++ b
a = b,
a, = b
() = a
[] = a
a.b: c
a[b]: c = d
(a, b): c
for x in *a, b: pass
for x in a if b else c: pass
exec "x"
x = 1 if 2 else 3 if 4 else 5
x = lambda: (yield)
def f(x=lambda a, b=1: a): pass
{a: b, c}
{a, b: c}
[a for b in c for d in e if f]
(a for b in c)
a[b for b in c]
a[1:2, 3]
a[]
a()
a(**b)
async for x in y: pass
async x
await x
nonlocal a
"""


def test_python_statements_against_its_own_parser():
    import ast
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for line in STATEMENTS.strip().split("\n"):
            text = line.replace("\\n", "\n") + "\n"
            try:
                ast.parse(text)
                right = True
            except SyntaxError:
                right = False
            assert (syntax.parse_verdict(text, "python")[0] is None) == right, text


def test_deep_nesting_is_parsed_on_an_own_stack():
    text = "def f(a=" + "(" * 20_000 + ")" * 20_000 + "):\n    'one two three'\n\n\ndef g():\n    'four five'\n"
    assert docs.documentation(text, "python", [1, 5]) == {1: "'one two three'", 5: "'four five'"}
    g = PackratGrammar("List <- ~'\\(' (List | Word)* !Word ~'\\)'?\nWord <- ~'[a-z]+ ?' &Any\nAny <- ~'[\\s\\S]'")
    for text in ("(a (b c) d)", "(a (b", "x", "()", "((a) b) c"):
        def told(parse, text=text):
            seen = []
            return parse(text, "List", {"Word": lambda a, b: seen.append((a, b))}, {}), seen

        fast, words = told(g.parse)
        deep = g._parse_deep(text, "List", {"Word": None}, {})
        assert (deep[0] if deep else None) == fast and [(a, b) for _, a, b in (deep[1] if deep else ())] == words


def test_attribute_marks_can_be_unspecified_and_the_newest_file_counts(spark, make):
    import datetime as dt

    from codestrata.session import Stage
    from tests.conftest import T0

    a = origin.Attributes([("", "*.js generated\nkeep.js !generated\nno.js -generated\nlib/ vendored\n")])
    assert a.marks("a.js") == {"generated": True} and a.marks("keep.js") == {} and a.marks("no.js") == {"generated": False} and a.marks("lib/x.c") == {}
    files = make("files", [{"file_id": i, "path": p, "name": p, "project": "p"} for i, p in enumerate(["p/.gitattributes", "p/a.py", "p/b.py"])])
    contents = make("file_contents", [{"file_id": 0, "content": "a.py generated\n", "loaded_at": T0}, {"file_id": 0, "content": "b.py generated\n", "loaded_at": T0 + dt.timedelta(hours=1)},
                                      {"file_id": 1, "content": "x = f(1)\n"}, {"file_id": 2, "content": "y = g(2)\n"}])
    for most in (origin.MAX_BROADCAST_RULES, 0):
        origin.MAX_BROADCAST_RULES, kept = most, origin.MAX_BROADCAST_RULES
        try:
            assert rows(origin.machine_made(files, contents, Stage(spark, "p1")), "file_id") == [(2,)]
        finally:
            origin.MAX_BROADCAST_RULES = kept


def test_short_packed_and_data_files():
    assert origin.evidence("[1,2,3,\n4,5,6]\n", "py")[0] == "data"
    assert origin.evidence("a=1;b=2;function f(){g();h();}if(a){b;c;}for(;;){d;}", "js")[0] == "minified"
    assert origin.evidence("const a = 1;\nfunction f() {\n  return a;\n}\n", "js")[0] is None and origin.evidence("", "js")[0] is None


def test_docstrings_of_files_without_content(spark, make):
    files = make("files", [{"file_id": i, "path": f"p/{i}.cpp", "name": "x", "project": "p"} for i in (1, 2, 3)])
    contents = make("file_contents", [{"file_id": 1, "content": "// this comment has words enough for running text\n# define X\n# include <y>\nint a;\n"}, {"file_id": 3, "content": None}])
    documents = make("documents", [{"doc_id": 1, "text": "the loader keeps the list of files and drops what is not used", "lang": "en"}, {"doc_id": 2, "text": "der Leser behält die Liste der Dateien", "lang": "de"}])
    told = spark.createDataFrame([(1, "'the reader keeps all of the files'"), (2, "'the reader keeps all of the files'"), (3, None), (9, "'the reader keeps all of the files'")], "file_id long, docstring string")
    got = natural.natural_language(files, contents, documents, told)
    assert [(r.file_id, r.nl_lang, r.file_bytes is None) for r in got.orderBy("file_id").collect()] == [(1, "en", False), (2, "en", True)]
