"""Declarative retrieval categories, checked when they are made.

A category names the folders and suffixes of its files and how their text is
cut.  Rules that the cutting needs (a size above its overlap, no folder in two
categories) are enforced here instead of failing in the middle of a build.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Sizes and overlaps in characters where a category names none.
DEFAULT_CHUNK_SIZE = 1200
DEFAULT_EXTENSIONS = (".md",)
CHUNK_OVERLAP = 200
CHILD_OVERLAP = 50


@dataclass(frozen=True)
class Category:
    name: str
    paths: tuple[str, ...] = ()
    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
    chunk_strategy: str = "heading"
    chunk_size: int = DEFAULT_CHUNK_SIZE
    child_chunk_size: int = 0
    module_field: bool = False
    description: str = ""
    chunk_overlap: int = CHUNK_OVERLAP
    child_overlap: int = CHILD_OVERLAP

    def __post_init__(self):
        if not self.name:
            raise ValueError("a category needs a name")
        if self.whole and not self.child_chunk_size:
            return
        if not self.whole and self.chunk_size <= self.chunk_overlap:
            raise ValueError(f"category {self.name}: chunk_size must be above the overlap of {self.chunk_overlap}")
        if self.child_chunk_size and self.child_chunk_size <= self.child_overlap:
            raise ValueError(f"category {self.name}: child_chunk_size must be above the overlap of {self.child_overlap}")
        if self.child_chunk_size and self.chunk_size == 0 and self.chunk_strategy != "whole_file":
            raise ValueError(f"category {self.name}: chunk_size 0 leaves no parents to cut children from")

    @property
    def whole(self) -> bool:
        """Files of this category stay in one piece."""
        return self.chunk_strategy == "whole_file" or self.chunk_size == 0

    @property
    def has_children(self) -> bool:
        return bool(self.child_chunk_size)


@dataclass(frozen=True)
class Settings:
    categories: tuple[Category, ...] = field(default_factory=tuple)
    data_root: str = ""
    project: str = "knowledge base"

    def __post_init__(self):
        names = [c.name for c in self.categories]
        if len(set(names)) < len(names):
            raise ValueError("category names must differ")
        roots = [(p.rstrip("/") + "/", c.name) for c in self.categories for p in c.paths]
        for i, (a, x) in enumerate(roots):
            for b, y in roots[i + 1 :]:
                if x != y and (a.startswith(b) or b.startswith(a)):
                    raise ValueError(f"categories {x} and {y} share the folder {max(a, b, key=len)}")

    def by_name(self, name: str) -> Category:
        return next(c for c in self.categories if c.name == name)
