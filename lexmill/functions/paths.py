"""Expressions over '/'-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.config import Category


def relative_path(path: Column | str, root: str) -> Column:
    """Path below ``root``; paths outside it stay whole."""
    path = F.col(path) if isinstance(path, str) else path
    root = root.rstrip("/") + "/"
    bare = F.regexp_replace(path, r"^file:/*(?=/)|^file:", "")
    return F.when(bare.startswith(root), F.substring(bare, len(root) + 1, 1 << 30)).otherwise(bare)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column | str) -> Column:
    """Lower-case suffix with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def module_label(path: Column | str, wanted: Column | bool = True) -> Column:
    """Name of the folder a file lies in, '' where the category has no such field."""
    parts = F.split(path, "/")
    wanted = F.lit(wanted) if isinstance(wanted, bool) else wanted
    return F.when(wanted & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(F.lit(""))


def detect_category(path: Column | str, categories: tuple[Category, ...] | list[Category]) -> Column:
    """First category with a folder above the file; the last category otherwise."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.lit(categories[-1].name)
    for c in reversed(categories):
        for p in c.paths:
            out = F.when(path.startswith(p.rstrip("/") + "/"), F.lit(c.name)).otherwise(out)
    return out


def package_key(path: Column | str, depth: int = 3) -> Column:
    """Group of a Python file: its first ``depth`` path parts, or two, or its bare name."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return (
        F.when(n >= depth, F.array_join(F.slice(parts, 1, depth), "."))
        .when(n >= 2, F.array_join(F.slice(parts, 1, 2), "."))
        .otherwise(F.replace(F.element_at(parts, -1), F.lit(".py"), F.lit("")))
    )
