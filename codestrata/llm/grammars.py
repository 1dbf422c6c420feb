"""Grammars of token kinds, one per language, as texts for ``derivatives.Grammar``.

They accept what the languages' parsers accept, at times more (types and names
are not checked), and no rule is left-recursive.
"""

from __future__ import annotations

import re
from functools import lru_cache

from codestrata.llm.derivatives import Grammar

#: Parameters in Python's order: without defaults before those with, one slash, one star; ``typed`` marks where an annotation may stand.
_PARAMETERS = r"""
params: plain ["," [params | slash | star]] | lateparams
lateparams: given ["," [lateparams | lateslash | star]]
slash: "/" ["," [behind | star]]
lateslash: "/" ["," [latebehind | star]]
behind: plain ["," [behind | star]] | latebehind
latebehind: given ["," [latebehind | star]]
star: "*" starred ["," [keyed | doubled]] | "*" "," keyed | doubled
keyed: (plain | given) ["," [keyed | doubled]]
doubled: "**" plain [","]
plain: ID typed
given: ID typed "=" test
starred: ID startyped
allparams: params | star
"""
_PARAMETER_RULES = "lateparams lateslash latebehind allparams params slash behind star keyed doubled plain given starred startyped typed".split()


def _parameters(prefix: str, typed: str) -> str:
    """The parameter rules with names of their own, and with or without annotations."""
    text = _PARAMETERS + f"typed: {typed}\nstartyped: {typed.replace('test', '[' + chr(34) + '*' + chr(34) + '] test') if typed != 'nothing*' else typed}\n"
    return re.sub(r"\b(" + "|".join(_PARAMETER_RULES) + r")\b", lambda m: prefix + m.group(), text)


PYTHON = r"""
start: line*
line: NEWLINE | compound | simple
simple: small (";" small)* [";"] NEWLINE
small: tests | (targets "=")+ (tests | yields) | single AUG (tests | yields) | single ":" test ["=" (tests | yields)]
 | "del" deleted ("," deleted)* [","] | "pass" | "break" | "continue" | "return" [tests] | "raise" [test ["from" test]]
 | "import" dotted ["as" ID] ("," dotted ["as" ID])* | "from" source "import" imported
 | "global" names | "nonlocal" names | "assert" test ["," test] | "type" ID [typeparams] "=" test | "ID" ID [typeparams] "=" test
targets: target ("," target)* [","]
target: ["*"] (ID | reference | "(" [targets] ")" | "[" [targets] "]")
single: ID | reference | "(" single ")"
deleted: ID | reference | "(" [deleted ("," deleted)* [","]] ")" | "[" [deleted ("," deleted)* [","]] "]"
reference: atom trailer* ("." ID | "[" subscripts "]")
yields: "yield" ["from"] [tests]
names: ID ("," ID)*
dotted: ID ("." ID)*
source: ("." | NUM)* dotted | ("." | NUM)+
imported: "*" | aliases | "(" aliases [","] ")"
aliases: ID ["as" ID] ("," ID ["as" ID])*
suite: simple | NEWLINE INDENT line+ DEDENT
compound: "if" named ":" suite ("elif" named ":" suite)* ["else" ":" suite] | ["async"] "while" named ":" suite ["else" ":" suite]
 | ["async"] "for" targets "in" tests ":" suite ["else" ":" suite] | ["async"] "with" withitems ":" suite
 | "try" ":" suite (("except" ["*"] [test ["as" ID]] ":" suite)+ ["else" ":" suite] ["finally" ":" suite] | "finally" ":" suite)
 | decorator* (["async"] "def" ID [typeparams] "(" [d_allparams] ")" ["->" test] ":" suite | "class" ID [typeparams] ["(" [args] ")"] ":" suite)
 | "ID" tests ":" NEWLINE INDENT ("ID" patterns ["if" named] ":" suite)+ DEDENT
patterns: pattern ("," pattern)* [","]
pattern: item ["as" ID]
decorator: "@" named NEWLINE
typeparams: "[" typeparam ("," typeparam)* [","] "]"
typeparam: ["*" | "**"] ID [":" test] ["=" test]
withitems: withitem ("," withitem)* | "(" withitem ("," withitem)* [","] ")"
withitem: test ["as" target]
tests: item ("," item)* [","] | yields
item: test | "*" test
named: test | ID ":=" test
test: chain ["if" chain "else" test] | "lambda" [l_allparams] ":" test
chain: unary (infix unary)*
infix: "BIN" | "**" | "SIGN" | "*" | "<" | ">" | "in" | "not" "in" | "is" ["not"] | "and" | "or" | "@" | "&" | "/" | "|"
unary: ("not" | "SIGN" | "~" | "await")* atom trailer*
atom: ID | NUM | STR+ | "(" [group] ")" | "[" [group] "]" | "{" [entries] "}"
group: groupitem (comp+ | ("," groupitem)* [","]) | yields
groupitem: named | "*" test | patternas
patternas: item "as" ID
comp: ["async"] "for" targets "in" chain ("if" chain)*
entries: pair (comp+ | ("," pair)* [","]) | member (comp+ | ("," member)* [","])
pair: test ":" test ["as" ID] | "**" chain
member: named | "*" chain
trailer: "(" [args] ")" | "[" subscripts "]" | "." ID
args: arglist | named comp+
arglist: (named | "*" test | patternas) ["," [arglist]] | keywords | doublings
keywords: (ID "=" (test | patternas) | "*" test) ["," [keywords | doublings]]
doublings: (ID "=" test | "**" test) ["," [doublings]]
subscripts: subscript ("," subscript)* [","]
subscript: named | "*" test | [test] ":" [test] [":" [test]]
nothing: "NEVER"
""" + _parameters("d_", '[":" test]') + _parameters("l_", "nothing*")

#: What the languages with braces share; each adds its own words.
BRACED = r"""
exprs: expr ("," expr)*
expr: operand (infix operand | "?" expr ":" expr)*
infix: BIN | SIGN | "*" | "&" | "<" | ">" | ">" ">" | ">" ">" ">" | "="
prefix: SIGN | "!" | "~" | INC | "*" | "&"
"""

JAVA = BRACED + r"""
start: [annotation* "package" name ";"] ("import" ["static"] name ["." "*"] ";")* (typedecl | ";")*
name: ID ("." ID)*
annotation: "@" name ["(" [argument ("," argument)* [","]] ")"]
argument: [ID "="] (expr | annotation | arrayof)
modifier: "public" | "private" | "protected" | "static" | "final" | "abstract" | "native" | "synchronized" | "transient" | "volatile" | "strictfp" | "default" | annotation
typedecl: modifier* (classdecl | enumdecl | "@" "interface" ID body)
classdecl: ("class" ID [typeparams] | "interface" ID [typeparams] | ID ID [typeparams] "(" [params] ")") ("extends" types | "implements" types | ID types)* body
enumdecl: "enum" ID ["implements" types] "{" [constant ("," constant)*] [","] [";" member*] "}"
constant: annotation* ID ["(" [exprs] ")"] [body]
typeparams: "<" typeparam ("," typeparam)* ">"
typeparam: ID ["extends" type ("&" type)*]
types: type ("," type)*
type: annotation* ID [typeargs] ("." ID [typeargs])* ("[" "]")* ["..."]
typeargs: "<" [typearg ("," typearg)*] ">"
typearg: type | "?" [("extends" | ID) type]
body: "{" member* "}"
member: ";" | ["static"] block | typedecl | modifier* [typeparams] (type ID "(" [params] ")" ("[" "]")* rest | ID "(" [params] ")" rest | type declarators ";" | ID block)
rest: ["throws" types] (block | ";" | "default" expr ";")
params: param ("," param)*
param: modifier* type ID ("[" "]")*
declarators: declarator ("," declarator)*
declarator: ID ("[" "]")* ["=" (expr | arrayof)]
arrayof: "{" [(expr | arrayof) ("," (expr | arrayof))*] [","] "}"
block: "{" statement* "}"
statement: block | ";" | modifier* type declarators ";" | expr ";" | typedecl | ID ":" statement
 | "if" "(" expr ")" statement ["else" statement] | "while" "(" expr ")" statement | "do" statement "while" "(" expr ")" ";"
 | "for" "(" [modifier* type declarators | exprs] ";" [expr] ";" [exprs] ")" statement | "for" "(" modifier* type ID ":" expr ")" statement
 | "return" [expr] ";" | "throw" expr ";" | "break" [ID] ";" | "continue" [ID] ";" | "assert" expr [":" expr] ";"
 | "synchronized" "(" expr ")" block | "switch" "(" expr ")" cases
 | "try" ["(" resource (";" resource)* [";"] ")"] block ("catch" "(" modifier* type ("BIN" type)* ID ")" block)* ["finally" block]
resource: modifier* type ID "=" expr | expr
cases: "{" (label statement* | "case" exprs ["=>" | "->"] (expr ";" | block | "throw" expr ";") | "default" "->" (expr ";" | block | "throw" expr ";"))* "}"
label: "case" exprs ":" | "default" ":"
operand: (prefix | "(" type ("&" type)* ")")* primary postfix*
primary: ID | NUM | STR | "(" expr ")" | "new" type ["(" [exprs] ")"] [body | arrayof] | "new" type ("[" [expr] "]")+ [arrayof] | lambda
 | "switch" "(" expr ")" cases | ID typeargs "::" (ID | "new")
lambda: (ID | "(" [ID ("," ID)* | params] ")") "->" (expr | block)
postfix: "." [typeargs] (ID | "class" | "new" type "(" [exprs] ")" [body]) | "(" [exprs] ")" | "[" [expr] "]" | INC | "::" (ID | "new") | "instanceof" ["final"] type [ID]
"""

C = r"""
exprs: assign ("," assign)*
assign: operand (infix operand | "?" exprs ":" assign)*
infix: BIN | SIGN | "*" | "&" | "<" | ">" | ">" ">" | "="
prefix: SIGN | "!" | "~" | INC | "*" | "&" | "sizeof"
start: (DIRECTIVE | external | ";")*
external: specs ["*"* declarator (initial ("," "*"* declarator [initial])* ";" | ("," "*"* declarator [initial])* ";" | (plain ";")* block)] | specs ";" | ID "(" [exprs] ")" [";"]
qualifier: "static" | "extern" | "const" | "volatile" | "inline" | "register" | "restrict" | "typedef" | "auto"
specs: qualifier* kind (qualifier | TYPE)*
kind: TYPE | ID | ("struct" | "union") [ID] ["{" (DIRECTIVE | field)* "}"] | "enum" [ID] ["{" [enumerator ("," enumerator)* [","]] "}"]
enumerator: DIRECTIVE* ID ["=" assign] DIRECTIVE*
field: specs [fielddeclarator ("," fielddeclarator)*] ";"
fielddeclarator: "*"* declarator [":" assign]
declarator: ("const" | "restrict" | "volatile" | "*")* (ID | "(" declarator ")") suffix*
suffix: "[" ["static"] [assign] "]" | "(" [params] ")"
params: param ("," param)* ["," "..."]
param: specs abstract
abstract: ("*" | "const" | "restrict" | "volatile")* [ID | "(" abstract ")"] suffix*
initial: "=" value
value: assign | "{" [element ("," element)*] [","] "}"
element: DIRECTIVE* [designator+ "="] value DIRECTIVE*
designator: "." ID | "[" assign "]"
plain: specs "*"* declarator [initial] ("," "*"* declarator [initial])*
block: "{" (DIRECTIVE | statement)* "}"
statement: block | ";" | plain ";" | exprs ";" | "if" "(" exprs ")" DIRECTIVE* statement [DIRECTIVE* "else" DIRECTIVE* statement]
 | "while" "(" exprs ")" statement | "do" statement "while" "(" exprs ")" ";" | "for" "(" [plain | exprs] ";" [exprs] ";" [exprs] ")" statement
 | "switch" "(" exprs ")" statement | "case" assign ":" [statement] | "default" ":" [statement] | ID ":" [statement]
 | "return" [exprs] ";" | "break" ";" | "continue" ";" | "goto" ID ";" | field
operand: (prefix | "(" specs abstract ")")* (primary postfix* | "{" [element ("," element)*] [","] "}")
primary: ID | NUM | STR+ [ID STR*] | "(" exprs ")" | "sizeof" "(" specs abstract ")" | "(" block ")"
postfix: "." ID | "->" ID | "[" exprs "]" | "(" [callarg ("," callarg)*] ")" | INC
callarg: assign | specs abstract
"""

CSHARP = r"""
exprs: expr ("," expr)*
expr: operand (infix operand | "?" expr ":" expr)*
start: ("extern" ID ID ";" | ["ID"] "using" ["static"] [ID "="] type ";")* (attribute | namespace | typedecl | ";" | statement)*
name: ID ("." ID)*
namespace: "namespace" name (";" | "{" ("using" ["static"] [ID "="] type ";")* (namespace | typedecl | ";")* "}" [";"])
attribute: "[" [(ID | "return") ":"] attr ("," attr)* [","] "]"
attr: type ["(" [arg ("," arg)*] ")"]
modifier: attribute | "public" | "private" | "protected" | "internal" | "static" | "readonly" | "sealed" | "abstract" | "virtual" | "override" | "extern" | "unsafe" | "new" | "volatile" | "const" | "ref" | "event"
typedecl: modifier* ["ID"] (("class" | "struct" | "interface" | "ID" ["class" | "struct"]) ID [typeparams] ["(" [params] ")"] [":" bases] where* (body | ";") [";"]
 | "enum" ID [":" type] "{" [attribute* ID ["=" expr] ("," attribute* ID ["=" expr])*] [","] "}" [";"] | "delegate" type ID [typeparams] "(" [params] ")" where* ";")
bases: type ["(" [args] ")"] ("," type)*
where: ID ID ":" constraint ("," constraint)*
constraint: type | "class" ["?"] | "struct" | "new" "(" ")" | "default"
typeparams: "<" attribute* ["in" | "out"] ID ("," ["in" | "out"] ID)* ">"
type: simpletype ("[" ","* "]" | "?" | "*")*
simpletype: ID ["::" ID] [typeargs] ("." ID [typeargs])* | "(" type [ID] ("," type [ID])+ ")"
typeargs: "<" [type] ("," [type])* ">"
body: "{" member* "}"
member: ";" | typedecl | modifier* ["ID"] (type (name [typeargs] ["." "this" "[" params "]"] (method | property | [initial] ("," ID [initial])* ";") | "this" "[" params "]" property | "operator" anyop "(" params ")" tail)
 | [("~")] ID "(" [params] ")" [":" ("base" | "this") "(" [args] ")"] tail | ("implicit" | "explicit") "operator" type "(" params ")" tail)
anyop: BIN | SIGN | "*" | "&" | "<" | ">" | "!" | "~" | INC | "|" | ">" ">"
method: "(" [params] ")" where* tail
tail: block | "=>" expr ";" | ";"
property: "{" (modifier* ID (";" | block | "=>" expr ";"))* "}" ["=" expr ";"] | "=>" expr ";"
initial: "=" (expr | arrayof)
arrayof: "{" [(expr | arrayof) ("," (expr | arrayof))*] [","] "}"
params: param ("," param)*
param: attribute* ["ref" | "out" | "in" | "params" | "this" | ID] type ID ["=" expr]
args: arg ("," arg)*
arg: [ID ":"] ["ref" | "out" | "in"] (expr | type ID)
block: "{" statement* "}"
statement: block | ";" | ["const" | "ref" | "using" | ID] type ID [initial] ("," ID [initial])* ";" | expr ";" | ID ":" statement
 | ["static"] ["ID"] type ID [typeparams] "(" [params] ")" where* tail
 | "if" "(" expr ")" statement ["else" statement] | "while" "(" expr ")" statement | "do" statement "while" "(" expr ")" ";"
 | "for" "(" [type ID [initial] ("," ID [initial])* | exprs] ";" [expr] ";" [exprs] ")" statement
 | ["ID"] "foreach" "(" (type ID | ID "(" ID ("," ID)* ")") "in" expr ")" statement
 | "return" ["ref"] [expr] ";" | "throw" [expr] ";" | "break" ";" | "continue" ";" | "goto" (ID | "case" expr | "default") ";" | ID ("return" expr | "break") ";"
 | "lock" "(" expr ")" statement | ["ID"] "using" "(" (type ID [initial] | expr) ")" statement | ("checked" | "unchecked" | "unsafe") block | "fixed" "(" type ID initial ")" statement
 | "switch" "(" expr ")" "{" (("case" pattern [ID expr] | "default") ":" statement*)* "}"
 | "try" block ("catch" ["(" type [ID] ")"] [ID "(" expr ")"] block)* ["finally" block]
pattern: expr | type ID | ("<" | ">" | "BIN") expr
operand: (prefix | "ID" | "(" type ")" | ".." | "ref" | "throw")* primary postfix* | ".."
infix: BIN | SIGN | "*" | "&" | "<" | ">" | ">" ">" | "=" | "is" ["ID"] | "as" | "|" | "||" | "in" | ".."
prefix: SIGN | "!" | "~" | INC | "*" | "&"
primary: ID [typeargs] | NUM | STR | "this" | "base" | "(" arg ("," arg)* ")" | "default" ["(" type ")"] | ("typeof" | "sizeof") "(" type ")" | ("checked" | "unchecked") "(" expr ")"
 | "new" [type] ("(" [args] ")" [arrayof | object] | "[" [exprs] "]" ("[" ","* "]")* [arrayof] | arrayof | object) | lambda | "delegate" ["(" [params] ")"] block | "stackalloc" type [arrayof] | arrayof | "[" [exprs] [","] "]"
object: "{" [[("[" exprs "]") | ID] "=" (expr | arrayof) ("," [("[" exprs "]") | ID] "=" (expr | arrayof))*] [","] "}"
lambda: ["static"] ["ID"] (ID | "(" [params | ID ("," ID)*] ")") "=>" (expr | block)
postfix: ("." | "?.") ID [typeargs] | "?" "[" exprs "]" | "(" [args] ")" | "[" [exprs] "]" | INC | "!" | "->" ID | "switch" "{" [pattern [ID expr] "=>" expr ("," pattern [ID expr] "=>" expr)*] [","] "}" | ID object | "{" [ID ":" pattern ("," ID ":" pattern)*] "}"
"""

GO = r"""
start: ";"* "package" ID ";" ("import" imports ";")* (declaration ";")*
imports: ["." | ID] STR | "(" ";"* ((["." | ID] STR) ";"*)* ")"
declaration: "const" consts | "var" vars | "type" typedecls | function
consts: const | "(" ";"* (const ";"*)* ")"
const: ID ("," ID)* [type] ["=" exprs]
vars: var | "(" ";"* (var ";"*)* ")"
var: ID ("," ID)* (type ["=" exprs] | "=" exprs)
typedecls: typedecl | "(" ";"* (typedecl ";"*)* ")"
typedecl: ID [typeparams] ["="] type
typeparams: "[" ID ("," ID)* union ("," ID ("," ID)* union)* [","] "]"
union: ["~"] type (("BIN") ["~"] type)*
function: "func" [parameters] ID [typeparams] parameters [result] [block]
parameters: "(" [parameter ("," parameter)* [","]] ")"
parameter: [ID] ["..."] type
result: type | parameters
type: ID ["." ID] ["[" type ("," type)* "]"] | "*" type | "[" [expr | "..."] "]" type | "map" "[" type "]" type | ["<-"] "chan" ["<-"] type | "func" parameters [result]
 | "struct" "{" ";"* ((ID ("," ID)* type | ["*"] ID ["." ID]) [STR] ";"*)* "}" | "interface" "{" ";"* ((ID parameters [result] | union) ";"*)* "}" | "(" type ")"
block: "{" [statements] "}"
statements: ";"* [statement] (";" [statement])*
statement: declaration | simple | "return" [exprs] | "break" [ID] | "continue" [ID] | "goto" ID | "fallthrough" | block | ifs | ("go" | "defer") expr | ID ":" [statement]
 | "for" [head] block | "switch" [[simple] ";"] [simple] "{" ";"* (("case" (exprs | types) | "default") ":" statements)* "}" | "select" "{" ";"* (("case" simple | "default") ":" statements)* "}"
types: type ("," type)*
head: flat | [flatsimple] ";" [flat] ";" [flatsimple] | [flats ("=" | ":=")] "range" flat
ifs: "if" [flatsimple ";"] flat block ["else" (ifs | block)]
simple: exprs [assigning] | [exprs ("=" | ":=")] "range" expr
assigning: INC | "=" exprs | ":=" exprs | "BIN" exprs | "<-" expr
flatsimple: flats [INC | ("=" | ":=" | "BIN") flats]
flats: flat ("," flat)*
flat: flatoperand (infix flatoperand)*
flatoperand: prefix* flatprimary postfix*
flatprimary: ID | NUM | STR | "(" (expr | type) ")" | "func" parameters [result] block | "[" [expr | "..."] "]" type ["(" [exprs] ")"] | "[" [expr | "..."] "]" type literal
exprs: expr ("," expr)*
expr: operand (infix operand)*
infix: BIN | SIGN | "*" | "&" | "<" | ">" | ">" ">"
prefix: SIGN | "!" | "*" | "&" | "<-" | "BIN"
operand: prefix* primary (postfix | literal)*
primary: ID | NUM | STR | "(" (expr | type) ")" | "func" parameters [result] block | "[" [expr | "..."] "]" type [literal] | "map" "[" type "]" type [literal] | "struct" "{" ";"* "}" [literal] | ["<-"] "chan" type | "interface" "{" "}"
literal: "{" ";"* [element ("," ";"* element)* [","]] ";"* "}"
element: [(expr | literal) ":"] (expr | literal)
postfix: "." (ID | "(" (type | "type") ")") | "(" [callarg ("," callarg)* ["..."] [","]] ")" | "[" [[expr] ":" [expr] [":" expr] | expr ("," type)* | type] "]"
callarg: expr | type
"""

RUST = r"""
start: attribute* item*
attribute: "#" ["!"] "[" tree* "]"
tree: "(" tree* ")" | "[" tree* "]" | "{" tree* "}" | leaf
leaf: ID | NUM | STR | LIFE | BIN | SIGN | INC | "*" | "&" | "&&" | "|" | "||" | "<" | ">" | "=" | "," | ";" | ":" | "::" | "." | ".." | "..." | "!" | "?" | "#" | "$" | "@" | "~" | "->" | "=>"
 | "as" | "async" | "await" | "break" | "const" | "continue" | "dyn" | "else" | "enum" | "extern" | "fn" | "for" | "if" | "impl" | "in" | "let" | "loop" | "match" | "mod" | "move" | "mut" | "pub" | "ref" | "return" | "static" | "struct" | "trait" | "type" | "unsafe" | "use" | "where" | "while"
visible: "pub" ["(" tree* ")"]
item: attribute* [visible] (use | function | struct | enum | impl | trait | constant | alias | module | macro | "extern" ID ID ["as" ID] ";" | "extern" [STR] "{" item* "}" | "ID" "!" ID ("(" tree* ")" [";"] | "{" tree* "}")) | ";"
use: "use" usetree ";"
usetree: ["::"] ID ("::" ID)* ["::" ("*" | "{" [usetree ("," usetree)*] [","] "}")] ["as" ID] | "*" | "{" [usetree ("," usetree)*] [","] "}"
module: ["unsafe"] "mod" ID (";" | "{" attribute* item* "}")
constant: ("const" | "static" ["mut"]) ID ":" type ["=" expr] ";"
alias: "type" ID [generics] [":" bounds] [where] ["=" type] ";"
struct: "struct" ID [generics] ([where] "{" [field ("," field)*] [","] "}" | "(" [attribute* [visible] type ("," attribute* [visible] type)*] [","] ")" [where] ";" | ";")
field: attribute* [visible] ID ":" type
enum: "enum" ID [generics] [where] "{" [variant ("," variant)*] [","] "}"
variant: attribute* ID ["(" [type ("," type)*] [","] ")" | "{" [field ("," field)*] [","] "}"] ["=" expr]
impl: ["unsafe"] "impl" [generics] ["!"] type ["for" type] [where] "{" attribute* item* "}"
trait: ["unsafe"] "trait" ID [generics] [":" bounds] [where] "{" item* "}"
generics: "<" [generic ("," generic)*] [","] ">"
generic: attribute* (LIFE [":" LIFE (SIGN LIFE)*] | ID [":" bounds] ["=" type] | "const" ID ":" type ["=" expr])
bounds: [bound (SIGN bound)*]
bound: LIFE | ["?"] ["for" generics] path | "(" bound ")"
where: "where" [clause ("," clause)*] [","]
clause: type ":" bounds | LIFE ":" LIFE (SIGN LIFE)*
function: ("const" | "async" | "unsafe" | "extern" [STR])* "fn" ID [generics] "(" [param ("," param)*] [","] ")" ["->" type] [where] (block | ";")
param: attribute* (["&" [LIFE]] ["mut"] ID | pattern) [":" type] | "..."
path: ["::"] segment ("::" segment)*
segment: ID [["::"] typeargs] ["(" [type ("," type)*] ")" ["->" type]] | "<" type ["as" path] ">"
typeargs: "<" [typearg ("," typearg)*] [","] ">"
typearg: LIFE | type | NUM | block | ID "=" type | ID ":" bounds | SIGN NUM
type: path | ("&" | "&&") [LIFE] ["mut"] type | "*" ("const" | "mut") type | "[" type [";" expr] "]" | "(" [type ("," type)*] [","] ")" | ("dyn" | "impl") bounds | "!" | ["for" generics] ["unsafe"] ["extern" [STR]] "fn" "(" [[ID ":"] type ("," [ID ":"] type)*] ")" ["->" type]
block: "{" attribute* (statement)* [expr] "}"
statement: ";" | item | attribute* "let" pattern [":" type] ["=" expr ["else" block]] ";" | expr ";" | blocklike
blocklike: attribute* [LIFE ":"] (["unsafe" | "async" ["move"] | "const"] block | "if" cond block ("else" "if" cond block)* ["else" block] | "while" cond block | "for" pattern "in" flat block | "loop" block | "match" flat arms) | path "!" "{" tree* "}"
cond: condpart ("&&" condpart)*
condpart: flat | "let" pattern "=" flat
arms: "{" attribute* (arm)* "}"
arm: attribute* ["|"] pattern ["if" cond] "=>" (expr [","] | blocklike [","])
pattern: onepattern ("|" onepattern)*
onepattern: ["ref"] ["mut"] ID ["@" pattern] | path ["(" [pattern ("," pattern)*] [","] ")" | "{" [fieldpattern ("," fieldpattern)*] [","] [".."] "}"] | [SIGN] NUM [".." [[SIGN] NUM]] | STR [".." STR] | ".." [NUM] | ("&" | "&&") ["mut"] pattern | "(" [pattern ("," pattern)*] [","] ")" | "[" [pattern ("," pattern)*] [","] "]"
fieldpattern: attribute* (["ref"] ["mut"] ID [":" pattern] | "..")
exprs: expr ("," expr)* [","]
expr: operand (infix operand | "as" type)*
infix: BIN | SIGN | "*" | "&" | "&&" | "|" | "||" | "<" | ">" | ">" ">" | "=" | ".."
prefix: SIGN | "!" | "*" | ("&" | "&&") ["mut" | ID ("const" | "mut")] | ".."
operand: prefix* primary postfix* | ".."
primary: path [literal] | NUM | STR | "(" [exprs] ")" | "[" [expr (";" expr | ("," expr)* [","])] "]" | blocklike | closure | path "!" ("(" tree* ")" | "[" tree* "]") | "return" [expr] | "break" [LIFE] [expr] | "continue" [LIFE]
literal: "{" [fieldvalue ("," fieldvalue)*] [","] [".." expr] "}"
fieldvalue: attribute* (ID | NUM) [":" expr] | ".." expr
closure: ["static"] ["async"] ["move"] ("|" [pattern1 [":" type] ("," pattern1 [":" type])*] [","] "|" | "||") ["->" type] expr
pattern1: onepattern
postfix: "." (ID ["::" typeargs] | NUM | "await") | "(" [exprs] ")" | "[" expr "]" | "?"
flat: flatoperand (infix flatoperand | "as" type)*
flatoperand: prefix* flatprimary postfix* | ".."
flatprimary: path | NUM | STR | "(" [exprs] ")" | "[" [expr (";" expr | ("," expr)* [","])] "]" | blocklike | closure | path "!" ("(" tree* ")" | "[" tree* "]")
macro: path "!" ("(" tree* ")" ";" | "[" tree* "]" ";" | "{" tree* "}")
"""

#: JavaScript; the marked places are filled for TypeScript.
SCRIPT = r"""
start: (statement | END)* [short]
endmark: ";" | END
block: "{" (statement | END)* [short] "}"
statement: block | ";" | short endmark | function | class | "if" "(" exprs ")" branch [[END] "else" branch] | "while" "(" exprs ")" branch | "do" branch [END] "while" "(" exprs ")" [endmark]
 | "for" ["await"] "(" [("var" | "let" | "const") binding (("," binding)* | ("in" | ID) exprs) | exprs] [";" [exprs] ";" [exprs]] ")" branch
 | "switch" "(" exprs ")" "{" (END | ("case" exprs | "default") ":" (statement | END)* [short])* "}" | "try" block [END] ("catch" ["(" target TS_TYPED ")"] block [END])* ["finally" block] | ID ":" statement
 | "export" ["default"] (function | class) | "with" "(" exprs ")" branch TS_STATEMENT
branch: [END] (statement | short)
short: ("var" | "let" | "const") binding ("," binding)* | exprs | "return" [exprs] | "throw" exprs | "break" [ID] | "continue" [ID] | "debugger"
 | "import" imported | "export" exported TS_SHORT
imported: STR | clause ID STR
clause: ID ["," starred] | starred
starred: "*" "as1" | "*" ID ID | "{" [alias ("," alias)*] [","] "}"
alias: anyname [ID anyname]
exported: ("var" | "let" | "const") binding ("," binding)* | "{" [alias ("," alias)*] [","] "}" [ID STR] | "*" [ID ID] ID STR | "default" assign
binding: target TS_TYPED ["=" assign]
target: ID | "{" [field ("," field)*] [","] "}" | "[" [element] ("," [element])* "]"
field: "..." target | (anyname | STR | NUM | "[" assign "]") [":" target] ["=" assign]
element: ["..."] target ["=" assign]
function: ["ID"] "function" ["*"] [ID] TS_PARAMS signature body
signature: "(" [param ("," param)*] [","] ")" TS_TYPED
param: TS_MODIFIER ["..."] target TS_OPTIONAL ["=" assign]
body: block
class: TS_CLASS decorator* "class" [ID] TS_PARAMS ["extends" operand] TS_IMPLEMENTS "{" (member | ";" | END)* "}"
decorator: "@" ID ("." ID)* ["(" [exprs] ")"] [END]
member: decorator* TS_MEMBER ("ID")* ["*"] ["#"] (anyname | STR | NUM | "[" assign "]") TS_PARAMS (signature (body | TS_BODYLESS) | TS_FIELD ["=" assign]) | "static1"
anyname: ID | "await" | "break" | "case" | "catch" | "class" | "const" | "continue" | "debugger" | "default" | "delete" | "do" | "else" | "enum" | "export" | "extends" | "finally" | "for" | "function" | "if" | "import" | "in" | "instanceof" | "let" | "new" | "return" | "super" | "switch" | "this" | "throw" | "try" | "typeof" | "var" | "void" | "while" | "with" | "yield"
exprs: assign ("," assign)*
assign: operand (infix operand | "?" assign ":" assign TS_AS)* | arrow | "yield" ["*"] [assign] | "..." assign
arrow: ["ID"] (ID | TS_PARAMS signature) "=>" (assign | block)
infix: BIN | SIGN | "*" | "&" | "<" | ">" | ">" ">" | ">" ">" ">" | "=" | "in" | "instanceof"
prefix: SIGN | "!" | "~" | INC | "typeof" | "void" | "delete" | "await"
operand: prefix* primary postfix* TS_CAST | prefix* arrow
primary: ID | NUM | STR | "this" | "super" | "(" exprs ")" | "[" [assign | ","] ("," [assign])* "]" | object | function | class | "new" ("." ID | primary2 ["(" [exprs] [","] ")"]) | "import" ("(" exprs ")" | "." ID)
primary2: (ID | "this" | "(" exprs ")") (("." ["#"] anyname) | "[" exprs "]")* TS_ARGS
object: "{" [property ("," property)*] [","] "}"
property: ("ID")* ["*"] (anyname | STR | NUM | "[" assign "]") ([":" assign] | signature body) ["=" assign] | "..." assign
postfix: ("." | "?.") ["#"] anyname | "?." "[" exprs "]" | "?." "(" [exprs] ")" | TS_ARGS "(" [exprs] [","] ")" | "[" exprs "]" | INC | STR TS_POSTFIX
"""
TYPES = r"""
typed: [":" type]
type: ["BIN" | "&"] typepart (("BIN" | "&") typepart)* ["extends" type "?" type ":" type] | ["new"] [typeparams] "(" [param ("," param)*] [","] ")" "=>" type | ID "ID" type
typepart: ("ID" | "typeof")* typecore ("[" [type] "]")*
typecore: ID ["." ID ("." ID)*] [typeargs] | STR | [SIGN] NUM | "void" | "this" | "{" (typemember | ";" | "," | END)* "}" | "[" [["..."] [ID ["?"] ":"] type ("," ["..."] [ID ["?"] ":"] type)*] [","] "]" | "(" type ")" | "typeof" ID ("." ID)* | "import" "(" STR ")" ("." ID)*
typemember: ("ID")* (anyname | STR | NUM | "[" (ID (":" | "in") type | assign) "]") ["?"] ([":" type] | signature) | [typeparams] signature
typeargs: "<" type ("," type)* ">"
typeparams: "<" typeparam ("," typeparam)* [","] ">"
typeparam: ["const"] ID ["extends" type] ["=" type]
interface: ["export" ["default"]] ["ID"] ("ID" ID [typeparams] ["extends" type ("," type)*] "{" (typemember | ";" | "," | END)* "}" | ["const"] "enum" ID "{" [(ID | STR) ["=" assign] ("," (ID | STR) ["=" assign])*] [","] "}" | ("ID") (ID ("." ID)* | STR) block)
"""
TS_FILL = {
    "TS_TYPED": "typed", "TS_STATEMENT": "| interface", "TS_SHORT": '| ["export"] ["ID"] "ID" ID [typeparams] "=" type | "import" "ID" clause ID STR | "ID" ("var" | "let" | "const") binding | ["export"] "ID" "function" ID [typeparams] signature | ["export"] "function" ID [typeparams] signature',
    "TS_PARAMS": "[typeparams]", "TS_MODIFIER": 'decorator* ("ID")*', "TS_OPTIONAL": '["?"] typed', "TS_CLASS": '["ID"]',
    "TS_IMPLEMENTS": '[typeargs] ["ID" type ("," type)*]', "TS_MEMBER": "", "TS_BODYLESS": "ends", "TS_FIELD": '["?"] ["!"] typed', "TS_AS": "",
    "TS_CAST": '("ID" (type | "const"))*', "TS_ARGS": "[typeargs]", "TS_POSTFIX": '| "!"',
}
JS_FILL = {
    "TS_TYPED": "", "TS_STATEMENT": "", "TS_SHORT": "", "TS_PARAMS": "", "TS_MODIFIER": "", "TS_OPTIONAL": "", "TS_CLASS": "",
    "TS_IMPLEMENTS": "", "TS_MEMBER": "", "TS_BODYLESS": "never", "TS_FIELD": "", "TS_AS": "", "TS_CAST": "", "TS_ARGS": "", "TS_POSTFIX": "",
}


def _script(fill: dict[str, str], extra: str = "") -> str:
    text = SCRIPT
    for mark in sorted(fill, key=len, reverse=True):
        text = text.replace(mark, fill[mark])
    return text + extra


SOURCES = {
    "python": PYTHON, "java": JAVA, "c": C, "csharp": CSHARP, "go": GO, "rust": RUST,
    "javascript": _script(JS_FILL, '\nnever: "NEVER"\n'), "typescript": _script(TS_FILL, TYPES + '\nends: ";"\n'),
}


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    """The grammar of a language; one per Python worker, with its derivatives."""
    return Grammar(SOURCES[language])
