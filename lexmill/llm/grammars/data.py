"""Strict JSON and TOML 1.0 as character grammars."""

from __future__ import annotations

import datetime
import re

from lexmill.llm.grammars.packrat import compile_grammar

_json = compile_grammar(
    """
    file <- ~ws~ value ~end~
    value <- ~scalar~ ~ws~ / '{' ~ws~ ('}' / member (',' ~ws~ member)* '}') ~ws~ / '[' ~ws~ (']' / value (',' ~ws~ value)* ']') ~ws~
    member <- ~string~ ~ws~ ':' ~ws~ value
    """,
    "file",
    False,
    regexes={
        "ws": r"[ \t\n\r]*",
        "end": r"\Z",
        "string": r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"',
        "scalar": r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?![0-9.eE+\-\w])|(?:true|false|null)\b',
    },
)


def json_furthest_failure(text: str) -> int:
    end, far = _json(text)
    return -1 if end == len(text) else far


_toml = compile_grammar(
    """
    file <- (~blank~ (~newline~ / &~end~ / line ~tail~ (~newline~ / &~end~)))* ~blank~ ~end~
    line <- '[[' ~sp~ keys ']]' / '[' ~sp~ keys ']' / keys '=' ~sp~ value
    keys <- key ('.' ~sp~ key)*
    key <- (~bare~ / ~basic~ / ~literal~) ~sp~
    value <- ~multi_basic~ / ~multi_literal~ / ~basic~ / ~literal~ / ~datetime~ / ~number~ / ~word~ / array / inline
    array <- '[' ~gap~ (value ~gap~ (',' ~gap~ value ~gap~)* (',' ~gap~)?)? ']'
    inline <- '{' ~sp~ ('}' / pair (',' ~sp~ pair)* '}')
    pair <- keys '=' ~sp~ value ~sp~
    """,
    "file",
    False,
    regexes={
        "sp": r"[ \t]*",
        "blank": r"[ \t]*(?:#[^\x00-\x08\x0a-\x1f\x7f]*+)?",
        "tail": r"[ \t]*(?:#[^\x00-\x08\x0a-\x1f\x7f]*+)?",
        "newline": r"\r?\n",
        "gap": r"(?:[ \t]|\r?\n|#[^\x00-\x08\x0a-\x1f\x7f]*+\r?\n)*+",
        "end": r"\Z",
        "bare": r"[A-Za-z0-9_-]+",
        "basic": r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|U(?:0000(?![dD][89a-fA-F])|000[1-9a-fA-F]|0010)[0-9a-fA-F]{4}))*+"',
        "literal": r"'[^'\x00-\x08\x0a-\x1f\x7f]*+'",
        "multi_basic": r'"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f\r]|\r\n|\\(?:[btnfr"\\]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|U(?:0000(?![dD][89a-fA-F])|000[1-9a-fA-F]|0010)[0-9a-fA-F]{4}|[ \t]*\r?\n)|"{1,2}(?!"))*+"{3,5}',
        "multi_literal": r"'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f\r]|\r\n|'{1,2}(?!'))*+'{3,5}",
        "datetime": r"(?:\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[-+](?:[01]\d|2[0-3]):[0-5]\d)?)?|(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?)(?![\w.:+-])",
        "number": r"(?:0x[0-9A-Fa-f]+(?:_[0-9A-Fa-f]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*|[-+]?(?:inf|nan)|[-+]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][-+]?\d(?:_?\d)*)?)(?![\w.:+-])",
        "word": r"(?:true|false)(?![\w.-])",
    },
)

_DATE = re.compile(r"(?<![\w.-])\d{4}-\d\d-\d\d")


class _Node(dict):
    """A table and how it came about, for the rules against defining things twice."""

    def __init__(self, how: str):
        super().__init__()
        self.how = how


def _toml_clash(text: str) -> int:
    """Offset of the first key or table that TOML forbids to define (again), or -1; for text the grammar accepts."""
    key = re.compile(r"""[ \t]*(?:([A-Za-z0-9_-]+)|"((?:[^"\\]|\\.)*)"|'([^']*)')[ \t]*(\.?)""")
    root = _Node("header")
    now, at, n = root, 0, len(text)
    skip = re.compile(r"(?:[ \t\r\n]|#[^\n]*)*")

    def read_keys(at: int) -> tuple[list[str], int]:
        out = []
        while True:
            m = key.match(text, at)
            raw = m[1] if m[1] is not None else m[3] if m[3] is not None else m[2]
            if m[2] and "\\" in m[2]:
                raw = re.sub(r"\\(?:u(.{4})|U(.{8})|(.))", lambda x: chr(int(x[1] or x[2], 16)) if x[1] or x[2] else {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r"}.get(x[3], x[3]), m[2])
            out.append(raw)
            at = m.end()
            if not m[4]:
                return out, at

    def assign(table: _Node, keys: list[str], value) -> bool:
        for k in keys[:-1]:
            nxt = table.get(k)
            if nxt is None:
                nxt = table[k] = _Node("dotted")
            elif not isinstance(nxt, _Node) or nxt.how not in ("dotted", "implied"):
                return False
            nxt.how = "dotted"
            table = nxt
        if keys[-1] in table:
            return False
        table[keys[-1]] = value
        return True

    def read_value(at: int):
        c = text[at]
        if text.startswith(('"""', "'''"), at):
            q = text[at : at + 3]
            m = re.compile(r'"""(?:[^"\\]|\\[\s\S]|"{1,2}(?!"))*+"{3,5}' if q == '"""' else r"'''(?:[^']|'{1,2}(?!'))*+'{3,5}").match(text, at)
            return 0, m.end()
        if c in "\"'":
            return 0, re.compile(r'"(?:[^"\\]|\\.)*+"|' + r"'[^']*+'").match(text, at).end()
        if c == "[":
            at = skip.match(text, at + 1).end()
            while text[at] != "]":
                v, at = read_value(at)
                if v is None:
                    return None, at
                at = skip.match(text, at).end()
                if text[at] == ",":
                    at = skip.match(text, at + 1).end()
            return 0, at + 1
        if c == "{":
            table = _Node("inline")
            at = skip.match(text, at + 1).end()
            while text[at] != "}":
                start = at
                keys, at = read_keys(at)
                v, at = read_value(skip.match(text, text.index("=", at) + 1).end())
                if v is None or not assign(table, keys, v):
                    return None, start
                at = skip.match(text, at).end()
                if text[at] == ",":
                    at = skip.match(text, at + 1).end()
            freeze(table)
            return table, at + 1
        m = re.compile(r"[^,\]}\n\r#]*").match(text, at)
        if d := _DATE.match(text, at):
            try:
                datetime.date.fromisoformat(d[0])
            except ValueError:
                return None, at
        return 0, m.end()

    def freeze(table: _Node) -> None:
        table.how = "inline"
        for v in table.values():
            if isinstance(v, _Node):
                freeze(v)

    while True:
        at = skip.match(text, at).end()
        if at >= n:
            return -1
        start = at
        if text[at] == "[":
            many = text.startswith("[[", at)
            keys, at = read_keys(at + 1 + many)
            at = text.index("]", at) + 1 + many
            table = root
            for k in keys[:-1]:
                nxt = table.get(k)
                if nxt is None:
                    nxt = table[k] = _Node("implied")
                if isinstance(nxt, list):
                    nxt = nxt[-1]
                if not isinstance(nxt, _Node) or nxt.how == "inline":
                    return start
                table = nxt
            had = table.get(keys[-1])
            if many:
                if had is None:
                    table[keys[-1]] = had = []
                if not isinstance(had, list):
                    return start
                now = _Node("header")
                had.append(now)
            elif had is None:
                now = table[keys[-1]] = _Node("header")
            elif isinstance(had, _Node) and had.how == "implied":
                had.how, now = "header", had
            else:
                return start
        else:
            keys, at = read_keys(at)
            value, at = read_value(skip.match(text, text.index("=", at) + 1).end())
            if value is None or not assign(now, keys, value):
                return start


def toml_furthest_failure(text: str) -> int:
    end, far = _toml(text)
    return far if end != len(text) else _toml_clash(text)
