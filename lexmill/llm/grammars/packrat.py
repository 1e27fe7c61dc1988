"""Packrat parsing-expression grammars, compiled to Python recognisers.

A grammar is text, one rule after another::

    name <- expression

with ordered choice ``/``, ``* + ?``, predicates ``& !``, groups, ``'literal'``
and ``<NAME>`` for a named set of token kinds.  In character grammars
``~name~`` stands for a named regular expression.  Each rule keeps its result
per position (that makes the parse linear); every failed terminal outside
predicates moves the furthest failure forward.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_PIECE = re.compile(r"\s+|#[^\n]*|(?P<def>\w+)\s*<-|(?P<lit>'(?:[^'\\]|\\.)*')|<(?P<set>\w+)>|~(?P<rx>\w+)~|(?P<name>\w+)|(?P<op>[/*+?&!()])")


def _read(grammar: str) -> dict[str, list]:
    parts, at = [], 0
    while at < len(grammar):
        m = _PIECE.match(grammar, at)
        if not m:
            raise ValueError(f"grammar: {grammar[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            parts.append((m.lastgroup, m[m.lastgroup]))
    rules: dict[str, list] = {}
    k = 0

    def choice():
        nonlocal k
        options = [sequence()]
        while k < len(parts) and parts[k] == ("op", "/"):
            k += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("choice", options)

    def sequence():
        nonlocal k
        items = []
        while k < len(parts) and parts[k] not in (("op", "/"), ("op", ")")) and parts[k][0] != "def":
            items.append(item())
        return items[0] if len(items) == 1 else ("seq", items)

    def item():
        nonlocal k
        kind, value = parts[k]
        k += 1
        if (kind, value) in (("op", "&"), ("op", "!")):
            return ("look", value == "&", item())
        if (kind, value) == ("op", "("):
            e = choice()
            k += 1
        elif kind == "lit":
            e = ("lit", value[1:-1].replace("\\'", "'").replace("\\\\", "\\"))
        else:
            e = (kind, value)
        while k < len(parts) and parts[k][0] == "op" and parts[k][1] in "*+?":
            e = ("repeat", parts[k][1], e)
            k += 1
        return e

    while k < len(parts):
        name = parts[k][1]
        k += 1
        rules[name] = choice()
    return rules


class _Code:
    def __init__(self, rules: dict, tokens: bool, sets: dict, regexes: dict):
        self.rules, self.tokens, self.sets, self.regexes, self.lines, self.n = rules, tokens, sets, regexes, [], 0
        self.outermost = False

    def put(self, depth: int, line: str) -> None:
        self.lines.append(" " * depth + line)

    def var(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def expr(self, e, at: str, depth: int, quiet: bool = False) -> str:
        out, kind = self.var(), e[0]
        if kind in ("lit", "set", "rx"):
            if kind == "rx":
                m = self.var()
                self.put(depth, f"{m} = x_{e[1]}(S, {at})")
                self.put(depth, f"{out} = {m}.end() if {m} else -1")
            else:
                if kind == "set":
                    test = f"S[{at}] in set_{e[1]}"
                elif self.tokens:
                    test = f"S[{at}] == {e[1]!r}"
                else:
                    test = f"S.startswith({e[1]!r}, {at})"
                self.put(depth, f"{out} = {at} + {1 if self.tokens else len(e[1])} if {test} else -1")
            if not quiet:
                self.put(depth, f"if {out} < 0 and {at} > far: far = {at}")
        elif kind == "name":
            self.put(depth, f"{out} = r_{e[1]}({at})")
        elif kind == "seq":
            self.put(depth, f"{out} = -1")
            for k, x in enumerate(e[1]):
                at = self.expr(x, at, depth + k, quiet)
                if k < len(e[1]) - 1:
                    self.put(depth + k, f"if {at} >= 0:")
            self.put(depth + len(e[1]) - 1, f"{out} = {at}")
        elif kind == "choice":
            for k, x in enumerate(e[1]):
                got = self.expr(x, at, depth + k, quiet)
                self.put(depth + k, f"{out} = {got}")
                if k < len(e[1]) - 1:
                    self.put(depth + k, f"if {out} < 0:")
        elif kind == "look":
            got = self.expr(e[2], at, depth, True)
            self.put(depth, f"{out} = {at} if {got} {'>=' if e[1] else '<'} 0 else -1")
        elif kind == "repeat":
            if e[1] == "?":
                got = self.expr(e[2], at, depth, quiet)
                self.put(depth, f"{out} = {got} if {got} >= 0 else {at}")
            else:
                if e[1] == "+":
                    first = self.expr(e[2], at, depth, quiet)
                    self.put(depth, f"{out} = {first}")
                    self.put(depth, f"while {out} >= 0:")
                else:
                    self.put(depth, f"{out} = {at}")
                    self.put(depth, "while True:")
                got = self.expr(e[2], out, depth + 1, quiet)
                self.put(depth + 1, f"if {got} <= {out}: break")
                self.put(depth + 1, f"{out} = {got}")
                if self.outermost:
                    self.put(depth + 1, "forget()")
        else:
            raise ValueError(kind)
        return out

    def build(self, start: str) -> str:
        self.put(0, "def parse(S):")
        self.put(1, "far = 0")
        # A repetition in the start rule is never taken back, so what was kept for it can go.
        self.put(1, "def forget():")
        for name in self.rules:
            self.put(2, f"M_{name}.clear()")
        for name, e in self.rules.items():
            self.outermost = name == start
            self.put(1, f"M_{name} = {{}}")
            self.put(1, f"def r_{name}(p):")
            self.put(2, "nonlocal far")
            self.put(2, f"r = M_{name}.get(p)")
            self.put(2, "if r is not None: return r")
            got = self.expr(e, "p", 2)
            self.put(2, f"M_{name}[p] = {got}")
            self.put(2, f"return {got}")
        self.put(1, f"return r_{start}(0), far")
        return "\n".join(self.lines)


def compile_grammar(grammar: str, start: str, tokens: bool, sets: dict[str, frozenset] | None = None, regexes: dict[str, str] | None = None) -> Callable:
    """A function of the input (list of token kinds or text): (end of the match or -1, furthest failure)."""
    scope = {f"set_{k}": v for k, v in (sets or {}).items()} | {f"x_{k}": re.compile(v).match for k, v in (regexes or {}).items()}
    exec(_Code(_read(grammar), tokens, sets or {}, regexes or {}).build(start), scope)  # noqa: S102 - our own generated code
    return scope["parse"]
