"""Packrat parsing of parsing-expression grammars over a text, with offsets and actions."""

from __future__ import annotations

import re

_PART = re.compile(r"\s*(?:(\w+)\s*<-|~'((?:[^'\\]|\\.)*)'|@(\w+)|(\w+)|([|()*+?&!]))")


class PackratGrammar:
    """Rules like ``name <- first second* | ~'regex'``; choices are ordered.

    ``~'...'`` matches a regular expression at the current offset, ``@name`` a
    predicate given at parse time, ``&x`` and ``!x`` look ahead. Every (rule,
    offset) is tried once. A rule with an action reports its start and end.
    """

    def __init__(self, source: str, flags: int = 0):
        parts, self.rules = [], {}
        source, at = source.strip(), 0
        while at < len(source):
            m = _PART.match(source, at)
            rule, regex, test, name, sign = m.groups()
            parts.append(("rule", rule) if rule else ("match", re.compile(regex.replace("\\'", "'"), flags)) if regex is not None else
                         ("test", test) if test else ("name", name) if name else ("sign", sign))
            at = m.end()
            while at < len(source) and source[at].isspace():
                at += 1
        i = 0
        while i < len(parts):
            name = parts[i][1]
            self.rules[name], i = self._choice(parts, i + 1)

    def _choice(self, parts, i):
        options, row = [], []
        while i < len(parts) and parts[i][0] != "rule" and parts[i] != ("sign", ")"):
            if parts[i] == ("sign", "|"):
                options.append(("row", row))
                row = []
                i += 1
                continue
            look = None
            if parts[i] in (("sign", "&"), ("sign", "!")):
                look = parts[i][1]
                i += 1
            if parts[i] == ("sign", "("):
                item, i = self._choice(parts, i + 1)
            else:
                item = parts[i]
            i += 1
            if i < len(parts) and parts[i] in (("sign", "*"), ("sign", "+"), ("sign", "?")):
                item = (parts[i][1], item)
                i += 1
            row.append((look, item) if look else item)
        options.append(("row", row))
        return (options[0] if len(options) == 1 else ("any", options)), i

    def parse(self, text: str, start: str, actions=None, tests=None) -> int | None:
        """Offset where ``start`` ends, or None; actions run for the rules of the final parse only."""
        memo: dict[tuple[str, int], tuple] = {}

        def step(e, at):
            kind = e[0]
            if kind == "match":
                m = e[1].match(text, at)
                return None if m is None else (m.end(), ())
            if kind == "name":
                key = (e[1], at)
                if key not in memo:
                    memo[key] = None
                    got = step(self.rules[e[1]], at)
                    memo[key] = None if got is None else (got[0], (*got[1], (e[1], at, got[0])) if actions and e[1] in actions else got[1])
                return memo[key]
            if kind == "row":
                seen: list = []
                for x in e[1]:
                    got = step(x, at)
                    if got is None:
                        return None
                    at = got[0]
                    seen += got[1]
                return at, tuple(seen)
            if kind == "any":
                for x in e[1]:
                    got = step(x, at)
                    if got is not None:
                        return got
                return None
            if kind in "*+":
                seen, times = [], 0
                while True:
                    got = step(e[1], at)
                    if got is None or got[0] == at:
                        break
                    at = got[0]
                    seen += got[1]
                    times += 1
                return None if kind == "+" and not times else (at, tuple(seen))
            if kind == "?":
                return step(e[1], at) or (at, ())
            if kind == "test":
                return (at, ()) if tests[e[1]](at) else None
            got = step(e[1], at)
            return (at, ()) if (got is None) == (kind == "!") else None

        try:
            got = step(("name", start), 0)
        except RecursionError:
            got = self._parse_deep(text, start, actions, tests)
        if got is None:
            return None
        for name, a, b in got[1]:
            actions[name](a, b)
        return got[0]

    def _parse_deep(self, text: str, start: str, actions, tests):
        """The same parse on a stack of its own, for texts nested deeper than Python's calls may be."""
        memo: dict[tuple[str, int], tuple] = {}

        def step(e, at):
            kind = e[0]
            if kind == "match":
                m = e[1].match(text, at)
                return None if m is None else (m.end(), ())
            if kind == "test":
                return (at, ()) if tests[e[1]](at) else None
            if kind == "name":
                key = (e[1], at)
                if key not in memo:
                    memo[key] = None
                    got = yield self.rules[e[1]], at
                    memo[key] = None if got is None else (got[0], (*got[1], (e[1], at, got[0])) if actions and e[1] in actions else got[1])
                return memo[key]
            if kind == "any":
                for x in e[1]:
                    got = yield x, at
                    if got is not None:
                        return got
                return None
            if kind in ("row", "*", "+"):
                seen: list = []
                begun, parts = at, iter(e[1]) if kind == "row" else iter(lambda: e[1], None)
                for x in parts:
                    got = yield x, at
                    if kind == "row" and got is None:
                        return None
                    if kind != "row" and (got is None or got[0] == at):
                        break
                    at = got[0]
                    seen += got[1]
                return None if kind == "+" and at == begun else (at, tuple(seen))
            got = yield e[1], at
            if kind == "?":
                return got or (at, ())
            return (at, ()) if (got is None) == (kind == "!") else None

        waiting, got = [step(("name", start), 0)], None
        while waiting:
            try:
                following = waiting[-1].send(got)
            except StopIteration as done:
                got = done.value
                waiting.pop()
            else:
                got = None
                waiting.append(step(*following))
        return got
