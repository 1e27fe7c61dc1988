"""Documentation items of Python sources, and their Markdown."""

from __future__ import annotations

import ast
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.paths import base_name

ITEM = "kind string, name string, signature string, docstring string, item_no int"


def _doc(node: ast.AST) -> str:
    first = node.body[0] if node.body else None
    value = first.value if isinstance(first, ast.Expr) else None
    return value.value.strip() if isinstance(value, ast.Constant) and isinstance(value.value, str) else ""


def _param(a: ast.arg, stars: str = "", default: ast.expr | None = None) -> str:
    note = f": {ast.unparse(a.annotation)}" if a.annotation else ""
    return f"{stars}{a.arg}{note}{f' = {ast.unparse(default)}' if default is not None else ''}"


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """The definition in one line, with annotations and all defaults, without decorators."""
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    shown = [_param(x, default=d) for x, d in zip(plain, defaults)]
    if a.posonlyargs:
        shown.insert(len(a.posonlyargs), "/")
    if a.vararg:
        shown.append(_param(a.vararg, "*"))
    elif a.kwonlyargs:
        shown.append("*")
    shown += [_param(x, default=d) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    if a.kwarg:
        shown.append(_param(a.kwarg, "**"))
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{word} {node.name}({', '.join(shown)}){f' -> {ast.unparse(node.returns)}' if node.returns else ''}"


def _shown(node: ast.AST) -> bool:
    return bool(_doc(node)) or not node.name.startswith("_")


def items_of(source: str, file_name: str) -> list[tuple[str, str, str, str]]:
    """(kind, name, signature, docstring), breadth first; one ``error`` item for a file that does not parse.

    A method is listed under its class and again, like any function, under its bare name.
    """
    try:
        tree = ast.parse(source, filename=file_name)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("error", file_name, "", str(e))]
    out = []
    if doc := _doc(tree):
        out.append(("module", file_name.rpartition(".")[0] or file_name, "", doc))
    todo = deque([tree])
    while todo:
        node = todo.popleft()
        todo.extend(ast.iter_child_nodes(node))
        if isinstance(node, ast.ClassDef):
            out.append(("class", node.name, f"class {node.name}", _doc(node)))
            out += [("method", f"{node.name}.{m.name}", signature(m), _doc(m)) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and _shown(m)]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and _shown(node):
            out.append(("function", node.name, signature(node), _doc(node)))
    return out


def extract(files: DataFrame, path: str = "source_file", text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Items of every Python file (.py, .pyi), with ``keep`` columns; null text gives none."""
    keep = keep or [path]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for own, name, source in zip(f[keep].itertuples(index=False, name=None), f[path], f[text]):
                rows += [(*own, *item, k) for k, item in enumerate(items_of(source, name.rpartition("/")[2]))]
            yield pd.DataFrame(rows, columns=[*keep, "kind", "name", "signature", "docstring", "item_no"])

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    python = F.lower(F.col(path)).rlike(r"\.pyi?$") & F.col(text).isNotNull()
    return files.where(python).select(*dict.fromkeys([*keep, path, text])).mapInPandas(run, f"{kinds}, {ITEM}")


def item_markdown(source_file: Column | str = "source_file") -> Column:
    """Markdown of one item, from its kind, name, signature and docstring."""
    src = base_name(source_file)
    doc = F.coalesce("docstring", F.lit(""))
    doc_part = F.when(doc != "", F.concat(F.lit("\n\n"), doc, F.lit("\n"))).otherwise(F.lit(""))
    sig = F.coalesce("signature", F.lit(""))
    sig_part = F.when(sig != "", F.concat(F.lit("\n```python\n"), sig, F.lit("\n```\n"))).otherwise(F.lit(""))
    kind = F.lower(F.trim("kind"))
    return (
        F.when(kind == "module", F.concat(F.lit("\n> *Source: `"), src, F.lit("`*\n\n\n"), doc, F.lit("\n")))
        .when(kind == "class", F.concat(F.lit("\n## `"), "name", F.lit("`\n\n*Source: `"), src, F.lit("`*\n"), doc_part))
        .when(kind.isin("function", "method"), F.concat(F.lit("\n### `"), "name", F.lit("`\n"), sig_part, doc_part))
        .when(kind == "error", F.concat(F.lit("\n> **Parse error in `"), src, F.lit("`**: "), doc, F.lit("\n")))
    )


def module_markdown(items: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``group``, n_items, n_documented, markdown: the items of each group as one document."""
    shown = items.withColumn("__md", item_markdown()).where("`__md` IS NOT NULL")
    key = F.struct(*[F.col(c) for c in order], F.col("__md").alias("md"))
    made = shown.groupBy(group).agg(F.count("*").alias("n_items"), F.count_if(F.coalesce(F.col("docstring"), F.lit("")) != "").alias("n_documented"), F.array_sort(F.collect_list(key)).alias("parts"))
    return made.select(group, "n_items", "n_documented", F.concat(F.lit("# "), F.col(group), F.lit("\n\n"), F.array_join(F.transform("parts", lambda x: x["md"]), "\n")).alias("markdown"))
