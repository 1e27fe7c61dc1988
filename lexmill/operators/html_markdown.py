"""HTML pages as Markdown.

Pages are read by the standard library's tokenizer into a small tree; a stack
closes what authors leave open, and it is written from its leaves up, so pages
may be nested to any depth.  Three dialects say where the main content is:
``madcap``, ``sphinx`` and ``auto``, which looks for signs of the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and boxes that never hold content, and where content lies.
DROPPED = frozenset(["script", "style", "noscript", "link", "nav", "footer"])
DROPPED_CLASSES = frozenset(["MCBreadcrumbsBox_0", "MCRelationshipsProxy_0", "MCTopicToolbar_0", "footer", "sidenav", "topic-toolbar"])
DROPPED_IDS = frozenset(["mc-toc"])
CONTENT = {
    "madcap": (("class", "topic-content"), ("class", "MCBody"), ("id", "mc-main-content")),
    "auto-madcap": (("class", "topic-content"), ("class", "MCBody")),
    "sphinx": (("role", "main"), ("class", "body"), ("class", "document")),
}
#: Deepest nesting of tables; each level doubles the text.
MOST_TABLES = 12
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote dd div dl dt fieldset figure form h1 h2 h3 h4 h5 h6 header hr main ol p pre section table ul".split())
# An opening tag closes these, up to the element that bounds the search.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "a": ({"a"}, set()), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}


class Node:
    __slots__ = ("name", "attrs", "children", "parent", "inner", "made")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent
        self.inner = self.made = ""  # Markdown of what is inside, and of the whole

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo.extend(reversed(n.children))
        return "".join(out)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, names: set, bounds: set) -> None:
        n, last = self.at, None
        while n.parent is not None and n.name not in bounds:
            if n.name in names:
                last = n
            n = n.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._close({"p"}, {"td", "th", "li", "div", "section", "article", "table"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.name != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def read_html(html: str) -> Node:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def is_madcap(root: Node) -> bool:
    for n in root.walk():
        if n.name == "div" and any("MC" in c or c == "topic-content" for c in n.classes()):
            return True
        if n.name == "meta" and n.attrs.get("name") == "generator" and "madcap" in n.attrs.get("content", "").lower():
            return True
    return False


def _prune(root: Node) -> None:
    def gone(n: Node) -> bool:
        return n.name in DROPPED or n.name == "div" and (n.attrs.get("id") in DROPPED_IDS or not DROPPED_CLASSES.isdisjoint(n.classes()))

    for n in list(root.walk()):
        n.children = [c for c in n.children if isinstance(c, str) or not gone(c)]


def _content(root: Node, dialect: str) -> Node | None:
    divs = [n for n in root.walk() if n.name == "div"]
    for attr, value in CONTENT[dialect]:
        for n in divs:
            if value in n.classes() if attr == "class" else n.attrs.get(attr) == value:
                return n
    body = next((n for n in root.walk() if n.name == "body"), None)
    # The tokenizer adds no body of its own; a page without one is all body.
    return body if body is not None or any(n.name == "html" for n in root.walk()) and not root.text().strip() else root


# One writer for each kind of element; it finds the Markdown of what is inside in ``inner``.


def _paragraph(text: str) -> str:
    return f"\n\n{text}\n\n"


def _block(n: Node) -> str:
    text = n.inner.strip()
    return _paragraph(text) if text else ""


def _heading(n: Node) -> str:
    return _paragraph("#" * int(n.name[1]) + " " + n.inner.strip())


def _listing(n: Node) -> str:
    """Direct entries only; blank ones are left out but counted."""
    own = [c.inner.strip() for c in n.children if isinstance(c, Node) and c.name == "li"]
    marks = ["- "] * len(own) if n.name == "ul" else [f"{k}. " for k in range(1, len(own) + 1)]
    return "\n" + "\n".join(m + text for m, text in zip(marks, own) if text) + "\n"


def _grid(n: Node) -> str:
    """Rows at any depth; the first one is taken for the head.

    The cells of a table inside come again in the rows around it, so text doubles with each level.
    """
    around, depth = n, 0
    while around is not None:
        depth += around.name == "table"
        around = around.parent
    if depth > MOST_TABLES:
        raise ValueError(f"tables nested more than {MOST_TABLES} deep")
    rows = [[c.inner.strip().replace("\n", " ") for c in tr.walk() if c.name in ("td", "th")] for tr in n.walk() if tr.name == "tr"]
    lines = ["| " + " | ".join(cells) + " |" for cells in rows]
    if rows:
        lines.insert(1, "|" + "|".join("---" for _ in rows[0]) + "|")
    return _paragraph("\n".join(lines))


def _fenced(n: Node) -> str:
    """The language is the first class of the code inside, without its usual prefixes."""
    named = [c.classes()[:1] for c in n.walk() if c.name == "code"][:1]
    language = "".join(named[0]) if named else ""
    for prefix in ("language-", "lang-"):
        language = language.replace(prefix, "")
    return _paragraph("\n".join(["```" + language, n.text().rstrip(), "```"]))


def _around(mark: str):
    return lambda n: mark + n.inner.strip() + mark


_WRITERS = (
    dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), _heading)
    | dict.fromkeys(("p", "div", "section", "article"), _block)
    | dict.fromkeys(("ul", "ol"), _listing)
    | dict.fromkeys(("strong", "b"), _around("**"))
    | dict.fromkeys(("em", "i"), _around("*"))
    | {"table": _grid, "pre": _fenced, "code": lambda n: f"`{n.text()}`", "br": lambda n: "\n", "hr": lambda n: _paragraph("---")}
)


def _write(root: Node) -> str:
    """Markdown of a tree, from its leaves up, so that depth does not matter."""
    for n in reversed(list(root.walk())):
        n.inner = "".join(c if isinstance(c, str) else c.made for c in n.children)
        writer = _WRITERS.get(n.name)
        n.made = writer(n) if writer else n.inner
    return root.made


def tidy(text: str) -> str:
    """At most one blank line in a row, then no blanks at line ends and one line end at the end."""
    return "\n".join(map(str.rstrip, re.sub("\n\n\n+", "\n\n", text).splitlines())).strip() + "\n"


def to_markdown(html: str, dialect: str = "auto") -> str:
    """Markdown of a page; '' if it has no content element."""
    root = read_html(html)
    if dialect == "auto":
        dialect = "auto-madcap" if is_madcap(root) else "sphinx"
    _prune(root)
    content = _content(root, dialect)
    return "" if content is None else tidy(_write(content))


def convert(pages: DataFrame, html: str = "html", out: str = "markdown", dialect: str = "auto") -> DataFrame:
    """``pages`` with ``out`` instead of ``html``; null stays null, a page that cannot be read becomes an error note."""
    rest = [c for c in pages.columns if c not in (html, out)]

    def one(x):
        if x is None:
            return None
        try:
            return to_markdown(x, dialect)
        except Exception as e:  # noqa: BLE001 - one broken page must not end the job
            return f"# ERROR reading page\n\n{e}\n"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[rest].assign(**{out: [one(x) for x in f[html]]})

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)
    return pages.select(*[F.col(f"`{c}`") for c in rest], html).mapInPandas(run, f"{kinds}{', ' if kinds else ''}`{out}` string")
