"""Recognition by derivatives of grammars, memoised over hash-consed nodes.

A grammar is a set of rules without left recursion. The derivative of a grammar
by a token is the grammar of what may follow that token. Equal grammars are one
node, and each pair of node and token is derived once, so a text whose states
recur costs one look-up per token.
"""

from __future__ import annotations

import re

#: Nodes kept; beyond it the tables start afresh, which bounds a task's memory.
MAX_NODES = 400_000

_PART = re.compile(r'\s*(?:"([^"]+)"|(\w+)\s*(:)?|([|()\[\]*+]))')


class Grammar:
    """The rules of one language, and the derivatives met so far."""

    def __init__(self, source: str, start: str = "start"):
        self.rules: dict[str, tuple] = {}
        self._read(source)
        self.start = start
        self._fresh()

    # -- reading: name: parts, with "token" or TOKEN, [optional], (group), | choice, * and +
    def _read(self, source: str) -> None:
        parts, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _PART.match(source, at)
            quoted, word, colon, sign = m.groups()
            parts.append(("rule", word) if colon else ("token", quoted) if quoted else
                         (("token" if word.isupper() else "name"), word) if word else ("sign", sign))
            at = m.end()
            while at < len(source) and source[at].isspace():
                at += 1
        i = 0
        while i < len(parts):
            name = parts[i][1]
            body, i = self._choice(parts, i + 1)
            self.rules[name] = body

    def _choice(self, parts, i):
        options, row = [], []
        while i < len(parts) and parts[i][0] != "rule" and parts[i] not in (("sign", ")"), ("sign", "]")):
            kind, value = parts[i]
            if parts[i] == ("sign", "|"):
                options.append(row)
                row = []
                i += 1
                continue
            if kind == "sign":
                inner, i = self._choice(parts, i + 1)
                item = ("maybe", inner) if value == "[" else inner
            else:
                item = (kind, value)
            i += 1
            while i < len(parts) and parts[i] in (("sign", "*"), ("sign", "+")):
                item = ("star", item) if parts[i][1] == "*" else ("row", (item, ("star", item)))
                i += 1
            row.append(item)
        options.append(row)
        built = [("row", tuple(o)) if len(o) != 1 else o[0] for o in options]
        return (built[0] if len(built) == 1 else ("any", tuple(built))), i

    # -- nodes: integers; EMPTY accepts nothing, DONE only the end
    def _fresh(self) -> None:
        self.node: list[tuple] = [("empty",), ("done",)]
        self.index: dict[tuple, int] = {("empty",): 0, ("done",): 1}
        self.can_end: dict[int, bool] = {0: False, 1: True}
        self.memo: dict[tuple[int, str], int] = {}
        self.named: dict[str, int] = {}
        self.first = self._ref(self.start)

    def _make(self, node: tuple) -> int:
        at = self.index.get(node)
        if at is None:
            at = self.index[node] = len(self.node)
            self.node.append(node)
        return at

    def _ref(self, name: str) -> int:
        return self._make(("ref", name))

    def _build(self, e: tuple) -> int:
        kind = e[0]
        if kind == "token":
            return self._make(("token", e[1]))
        if kind == "name":
            return self._ref(e[1])
        if kind == "star":
            return self._make(("star", self._build(e[1])))
        if kind == "maybe":
            return self._any((self._build(e[1]), 1))
        if kind == "any":
            return self._any(self._build(x) for x in e[1])
        out = 1
        for x in reversed(e[1]):
            out = self._row(self._build(x), out)
        return out

    def _row(self, a: int, b: int) -> int:
        if a == 0 or b == 0:
            return 0
        if a == 1:
            return b
        if b == 1:
            return a
        head = self.node[a]
        if head[0] == "row":
            return self._row(head[1], self._row(head[2], b))
        return self._make(("row", a, b))

    def _any(self, options) -> int:
        flat: set[int] = set()
        for o in options:
            node = self.node[o]
            flat.update(node[1] if node[0] == "any" else (o,))
        flat.discard(0)
        if not flat:
            return 0
        return flat.pop() if len(flat) == 1 else self._make(("any", tuple(sorted(flat))))

    def _body(self, name: str) -> int:
        if name not in self.named:
            self.named[name] = self._build(self.rules[name])
        return self.named[name]

    def nullable(self, at: int) -> bool:
        """Whether the text may end here."""
        known = self.can_end.get(at)
        if known is None:
            self.can_end[at] = False
            node = self.node[at]
            kind = node[0]
            known = (
                True if kind == "star" else False if kind == "token"
                else self.nullable(node[1]) and self.nullable(node[2]) if kind == "row"
                else any(self.nullable(o) for o in node[1]) if kind == "any"
                else self.nullable(self._body(node[1]))
            )
            self.can_end[at] = known
        return known

    def derive(self, at: int, token: str) -> int:
        """The node of what may follow ``token`` from node ``at``."""
        known = self.memo.get((at, token))
        if known is not None:
            return known
        node = self.node[at]
        kind = node[0]
        if kind == "token":
            out = 1 if node[1] == token else 0
        elif kind == "row":
            out = self._row(self.derive(node[1], token), node[2])
            if self.nullable(node[1]):
                out = self._any((out, self.derive(node[2], token)))
        elif kind == "any":
            out = self._any(self.derive(o, token) for o in node[1])
        elif kind == "star":
            out = self._row(self.derive(node[1], token), at)
        elif kind == "ref":
            out = self.derive(self._body(node[1]), token)
        else:
            out = 0
        self.memo[at, token] = out
        return out

    def failure(self, kinds: list[str]) -> int | None:
        """None if the tokens are a text of the language, else the index of the
        first token with an empty derivative; their number if the text stops short."""
        if len(self.node) > MAX_NODES:
            self._fresh()
        memo, at = self.memo, self.first
        for i, kind in enumerate(kinds):
            following = memo.get((at, kind))
            at = self.derive(at, kind) if following is None else following
            if at == 0:
                return i
        return None if self.nullable(at) else len(kinds)
