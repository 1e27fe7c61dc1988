"""Functions and methods paired with their documentation.

Signatures are found by regular expressions on text whose strings and comments
are masked; bodies are delimited by a stack of indentations (Python) or of
braces (PowerShell); comments are attached by line distance.  Pairs without
documentation, or with a trivial one, are dropped.  Null content, files that
do not parse and files of other languages give no pairs.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import syntax

#: Words that must remain beside those of the names.
LEAST_WORDS = 5

PAIRS = "file_id bigint, line_no int, end_line int, kind string, name string, signature string, docstring string, source_file string"

# ------------------------------------------------------------------ triviality

_LETTERS = regex.compile(r"\p{L}+")
_HUMP = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
# Marks that editors and people leave where text is still to be written.
_SLOT = re.compile(r"_(?:summary|description|type|name)_|\[(?:summary|description|type|name)\]|<(?:summary|description|type|name)>", re.I)
_STAND_IN = re.compile(
    r"^\W*(?:TODO|FIXME|XXX|TBD|TBA|TBC|WIP|HACK|todo|fixme|tbd)\b(?!\s+(?:items?|lists?|entries))"
    r"|^\W*(?i:lorem\s+ipsum)\b"
    r"|^\W*(?i:placeholder(?:\s+(?:text|docstring|documentation|description|comment|for)\b|\W*$))"
    r"|^\W*(?i:to\s+be\s+(?:documented|written|done|added|completed|described|defined|filled))\b"
    r"|^\W*(?i:(?:please\s+)?(?:add|write|insert|put|fill\s+in)\s+(?:a\s+|an\s+|the\s+|your\s+|some\s+)?(?:docstring|documentation|description|doc|docs|summary)s?\b)"
    r"|^\W*(?i:(?:the\s+|a\s+|this\s+)?(?:docstring|documentation|description|summary|text)\s+(?:goes|go|comes|follows|will\s+(?:go|come|follow|be\s+(?:added|written|replaced)))\b)"
    r"|^\W*(?i:(?:the\s+)?(?:documentation|docstring|description)\s+(?:of\s+\S+\s+\S+\s+)?(?:is\s+)?(?:still\s+)?(?:missing|pending|to\s+follow))\b"
    r"|^\W*(?i:(?:document|describe)\s+(?:me|this)\b)"
    r"|^\W*(?i:not\s+(?:yet\s+)?documented)\b"
    r"|^\W*(?i:(?:auto-?generated\s+)?(?:docstring|documentation)\s+(?:stub|template|placeholder))\b"
)


def words(text: str) -> list[str]:
    return [w.lower() for run in _LETTERS.findall(text) for w in _HUMP.split(run)]


def is_trivial(doc: str | None, name: str, params: list[str]) -> bool:
    """Fewer than LEAST_WORDS words beside those of the names, or only a stand-in for text to come."""
    if not doc:
        return True
    own = set(words(name.rpartition(".")[2])).union(*(words(p) for p in params)) if params else set(words(name.rpartition(".")[2]))

    def too_few(text: str) -> bool:
        left = 0
        for w in words(text):
            left += w not in own
            if left >= LEAST_WORDS:
                return False
        return True

    if too_few(doc):
        return True
    parts = re.split(r"\n\s*\n", _SLOT.sub(" ", doc))
    kept = [p for p in parts if not _STAND_IN.match(p)]
    return too_few("\n\n".join(kept))


# ---------------------------------------------------------------------- Python

_PY_MASK = re.compile(
    r"""(?P<string>(?<![\w])[rRbBuUfF]{0,2}(?:\"\"\"[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'))"""
    r"|(?P<comment>\#[^\n]*)|(?P<joined>\\\n)"
)
_BRACKET = re.compile(r"[()\[\]{}\n]")
_LINE = re.compile(r"(?m)^([ \t\f]*)(?=[^\s])(?:(?P<def>(?:async[ \t]+)?def)[ \t]+(?P<name>\w+)|(?P<class>class)[ \t]+(?P<cname>\w+))?")
_PARAM = re.compile(r"^\s*\*{0,2}\s*(\w+)")


class _Masked:
    """Text with strings and comments blanked and logical lines joined; offsets stay those of the text."""

    def __init__(self, text: str):
        self.strings: dict[int, int] = {}

        def blank(m: re.Match) -> str:
            if m.lastgroup == "string":
                self.strings[m.start()] = m.end()
                return "\x02" + "\x01" * (m.end() - m.start() - 1)
            return " " * (m.end() - m.start())

        masked = _PY_MASK.sub(blank, text)
        depth, out, last = 0, [], 0
        for m in _BRACKET.finditer(masked):
            c = m[0]
            if c == "\n":
                if depth:
                    out += [masked[last : m.start()], " "]
                    last = m.end()
            else:
                depth += 1 if c in "([{" else -1 if depth else 0
        self.text = "".join(out) + masked[last:]


def _indent(blank: str) -> int:
    col = 0
    for c in blank:
        col = (col // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else col + 1
    return col


def _close(text: str, at: int) -> int:
    """Place after the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m[0] in "([{" else -1
        if not depth:
            return m.end()
    return len(text)


def _split_args(text: str) -> list[tuple[int, int]]:
    """Spans between the commas of depth 0."""
    spans, depth, start = [], 0, 0
    for m in re.finditer(r"[()\[\]{},]", text):
        if m[0] == "," and not depth:
            spans.append((start, m.start()))
            start = m.end()
        elif m[0] != ",":
            depth += 1 if m[0] in "([{" else -1
    return [*spans, (start, len(text))]


def _docstring(text: str, masked: _Masked, at: int) -> str | None:
    """The value of the string that is the first statement from ``at``, or None."""
    flat, n = masked.text, len(masked.text)
    while at < n and flat[at] in " \t\f\n":
        at += 1
    start, depth = at, 0
    while at < n and flat[at] == "(":
        depth += 1
        at += 1
        while at < n and flat[at] in " \t\f":
            at += 1
    if at >= n or flat[at] != "\x02":
        return None
    while at < n:
        if flat[at] == "\x02":
            at = masked.strings[at]
        elif flat[at] == ")" and depth:
            depth -= 1
            at += 1
        elif flat[at] in " \t\f":
            at += 1
        else:
            break
    if depth or at < n and flat[at] not in "\n;":
        return None
    try:
        value = ast.literal_eval("(" + text[start:at] + "\n)")
    except (ValueError, SyntaxError):
        return None
    return value if isinstance(value, str) else None


def python_functions(text: str) -> list[tuple]:
    """(line, end line, kind, name, signature, docstring or None, parameter names) of each def, in order."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    masked = _Masked(text)
    flat = masked.text
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_at = lambda at: bisect_right(starts, at)
    stack: list[list] = []  # open blocks: [indent, is class, name, index of its item]
    items: list[list] = []
    end = 1
    for m in _LINE.finditer(flat):
        indent = _indent(m[1])
        while stack and stack[-1][0] >= indent:
            gone = stack.pop()
            if gone[3] is not None:
                items[gone[3]][1] = end
        stop = flat.find("\n", m.end())
        end = line_at(stop if stop >= 0 else len(flat))
        if m["def"]:
            bracket = flat.find("(", m.end())
            close = _close(flat, bracket)
            colon = close
            depth = 0
            while colon < len(flat) and (flat[colon] != ":" or depth):
                depth += (flat[colon] in "([{") - (flat[colon] in ")]}")
                colon += 1
            spans = _split_args(flat[bracket + 1 : close - 1])
            params = [p[1] for a, b in spans if (p := _PARAM.match(flat[bracket + 1 + a : bracket + 1 + b]))]
            method = bool(stack) and stack[-1][1]
            name = f"{stack[-1][2]}.{m['name']}" if method else m["name"]
            begin = m.start("def")
            signature = re.sub(r"[ \t]*(?:\\?\n)\s*", " ", text[begin:colon]).strip()
            items.append([line_at(begin), end, "method" if method else "function", name, signature, _docstring(text, masked, colon + 1), params])
            stack.append([indent, False, m["name"], len(items) - 1])
        elif m["class"]:
            stack.append([indent, True, m["cname"], None])
    for gone in stack:
        if gone[3] is not None:
            items[gone[3]][1] = end
    return [tuple(i) for i in items]


# ------------------------------------------------------------------ PowerShell

_PS_MASK = re.compile(
    r"(?P<comment><\#[\s\S]*?\#>)|(?P<here>@'[ \t]*\n(?:[\s\S]*?\n)??'@|@\"[ \t]*\n(?:[\s\S]*?\n)??\"@)"
    r"|(?P<single>'(?:[^']|'')*')|(?P<double>\"(?:[^\"`]|`[\s\S]|\"\")*\")|(?P<line>(?<![\w`])\#[^\n]*)"
)
_PS_FUNCTION = re.compile(r"(?im)(?:^|(?<=[;{}\s]))(?P<def>function)[ \t]+(?P<name>(?:\w+:)?[\w.-]+)(?=[\s({])")
_PS_PARAM = re.compile(r"(?is)\s*(?:\[[^\]]*\]\s*)*param\s*(?=\()")
_DOT_KEYWORD = re.compile(r"(?m)^[ \t]*\.[A-Za-z]+")


def powershell_functions(text: str) -> list[tuple]:
    """As python_functions; the docstring is the first comment, above or inside, that says something."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    comments: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        if m.lastgroup == "comment":
            comments.append((m.start(), m.end()))
        return re.sub(r"[^\n]", " ", m[0]) if m.lastgroup in ("comment", "line") else re.sub(r"[^\n]", "\x01", m[0])

    flat = _PS_MASK.sub(blank, text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_at = lambda at: bisect_right(starts, at)
    ends = {line_at(b - 1): (a, b) for a, b in comments if re.compile(r"[ \t]*(?:\n|\Z)").match(text, b)}
    firsts = {a: (a, b) for a, b in comments}
    closes: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", flat):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.start()
    out = []
    for m in _PS_FUNCTION.finditer(flat):
        brace = flat.find("{", m.end())
        if brace < 0:
            continue
        line = line_at(m.start("def"))
        found = []
        if (span := ends.get(line - 1)) is not None:
            found.append(span)
        at = brace + 1
        while at < len(text) and text[at].isspace():
            at += 1
        if at in firsts:
            found.append(firsts[at])
        head = flat[m.end() : brace]
        params = re.findall(r"\$(\w+)", head)
        body_from = brace + 1
        if p := _PS_PARAM.match(flat, body_from):
            params += re.findall(r"\$(\w+)", flat[p.end() : _close(flat, p.end())])
        docs = [_DOT_KEYWORD.sub(" ", text[a + 2 : b - 2]).strip() for a, b in found]
        doc = next((d for d in docs if not is_trivial(d, m["name"], params)), docs[0] if docs else None)
        signature = re.sub(r"\s+", " ", text[m.start("def") : brace]).strip()
        out.append((line, line_at(closes.get(brace, len(text) - 1)), "function", m["name"], signature, doc, params))
    return out


_FINDERS = {"python": python_functions, "powershell": powershell_functions}


def file_pairs(text: str, language: str) -> list[tuple]:
    """(line, end line, kind, name, signature, docstring) of each documented function of a text that parses.

    The grammar, which costs most, is asked only where there is something to keep or the scan could not make sense of the text.
    """
    try:
        found = [(*item[:5], doc.strip()) for *item, doc, params in _FINDERS[language](text) if doc and not is_trivial(doc, item[3], params)]
    except (IndexError, ValueError, RecursionError):
        if syntax.failure(text, language) < 0:
            raise
        return []
    return found if found and syntax.failure(text, language) < 0 else []


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for file_id, path, text in zip(f["file_id"], f["source_file"], f["content"]):
            language = syntax.language_of(path)
            if language in _FINDERS and text and not pd.isna(file_id):
                rows += [(file_id, *pair, path) for pair in file_pairs(text, language)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAIRS.split(", ")])


_SIGNATURE = re.compile(r"\((.*)\)", re.S)


def signature_params(signature: str | None) -> list[str]:
    m = _SIGNATURE.search(signature or "")
    if not m:
        return []
    flat = _PY_MASK.sub(lambda x: " " * len(x[0]), m[1])
    # The return annotation may hold brackets too: stop at the one that closes the parameters.
    depth = 0
    for x in re.finditer(r"[()]", flat):
        depth += 1 if x[0] == "(" else -1
        if depth < 0:
            flat = flat[: x.start()]
            break
    return [p[1] for a, b in _split_args(flat) if (p := _PARAM.match(flat[a:b]))]


def _useful_items(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keep = [not is_trivial(doc, name or "", signature_params(sig)) for doc, name, sig in zip(f["docstring"], f["name"], f["signature"])]
        f = f[keep]
        yield f.assign(end_line=None, docstring=f["docstring"].str.strip())[[c.split()[0] for c in PAIRS.split(", ")]]


def extracted_pairs(files: DataFrame) -> DataFrame:
    """Pairs of the files' own text; rows delivered again give theirs once."""
    return files.select("file_id", "source_file", "content").mapInPandas(_pairs, PAIRS).dropDuplicates(["file_id", "line_no"])


def _clean_kind(kind: Column) -> Column:
    return F.lower(F.trim(kind))


def earlier_pairs(items: DataFrame) -> DataFrame:
    """Pairs among items of an earlier run, without those of files that failed then."""
    wanted = items.where(_clean_kind(F.col("kind")).isin("function", "method")).where("docstring IS NOT NULL AND line_no IS NOT NULL AND file_id IS NOT NULL")
    wanted = wanted.select("file_id", "line_no", _clean_kind(F.col("kind")).alias("kind"), "name", "signature", "docstring", "source_file")
    pairs = wanted.mapInPandas(_useful_items, PAIRS).join(syntax.failed_items(items), "file_id", "left_anti")
    # A method listed under two kinds is one: keep the more telling kind.
    return pairs.groupBy("file_id", "line_no").agg(F.max_by(F.struct(*[c.split()[0] for c in PAIRS.split(", ")[2:]]), F.struct("kind", "docstring")).alias("x")).select("file_id", "line_no", "x.*")


def documented(files: DataFrame, items: DataFrame) -> DataFrame:
    """file_id, line_no, end_line, kind, name, signature, docstring, source_file of every documented function or method."""
    return extracted_pairs(files).unionByName(earlier_pairs(items))
