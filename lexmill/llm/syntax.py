"""Source files that do not parse, by packrat grammars, and their rates.

A file's language is that of its extension.  The grammar must consume the
whole text; the furthest failure gives line, column and, with what stands
there, the cause.  Null content and unknown extensions give no verdict; an
empty file is valid except as JSON.  Nesting so deep that the parser would need
more than ``FRAMES`` frames (some 300,000 brackets) gives no verdict either:
``valid`` is null and the cause ``too_deep``, and the rates count it apart.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.grammars import data, powershell, python

GRAMMARS = {
    "python": python.furthest_failure,
    "json": data.json_furthest_failure,
    "toml": data.toml_furthest_failure,
    "powershell": powershell.furthest_failure,
}
# The languages of the extensions.
EXTENSIONS = {".py": "python", ".pyi": "python", ".json": "json", ".toml": "toml", ".ps1": "powershell"}
CAUSES = ("merge_conflict", "wrong_language", "truncated", "syntax", "too_deep")
#: Frames a grammar may nest; they are some 200 bytes each, on the heap.
FRAMES = 1_000_000

_MARKER = re.compile(r"(?m)^(<{7}|>{7})(?= |\r?$)|^={7}\r?$")


def language_of(path: str | None) -> str | None:
    dot = path.rfind(".") if path else -1
    return EXTENSIONS.get(path[dot:].lower()) if dot >= 0 else None


def failure(text: str, language: str) -> int:
    """Offset of the furthest failure, -1 if valid, -2 if nested too deep to tell."""
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    try:
        return GRAMMARS[language](text)
    except RecursionError:
        return -2


_ENDLESS = re.compile(r"""[rbuf]{0,2}("{3}|'{3}|["'])|(@["'])""", re.I)


def _open_to_the_end(rest: str) -> bool:
    """Does a string that starts here never end?"""
    m = _ENDLESS.match(rest)
    if m[2]:
        return f"\n{m[2][1]}@" not in rest
    quote, at = m[1], m.end()
    while at < len(rest):
        if rest[at] == "\\":
            at += 2
        elif rest.startswith(quote, at):
            return False
        elif len(quote) == 1 and rest[at] == "\n":
            return False
        else:
            at += 1
    return True


def cause_of(text: str, language: str, at: int) -> str:
    markers = [(m.start(), m[0][:1]) for m in _MARKER.finditer(text)]
    opened = [p for p, c in markers if c == "<"]
    if opened and at >= opened[0] - 1 and any(c == ">" for _, c in markers):
        return "merge_conflict"
    if text.strip() and any(failure(text, other) == -1 for other in GRAMMARS if other != language and not (other == "toml" and language == "json")):
        return "wrong_language"
    rest = text[at:].strip()
    if not rest or not text[at:].strip("\"' \n\r") or _ENDLESS.match(rest) and _open_to_the_end(rest):
        return "truncated"
    return "syntax"


def verdict(text: str, language: str) -> tuple[bool | None, int, int, str | None]:
    """(valid, line, column, cause) of one text; line and column are 0 for valid ones and those too deep to tell."""
    at = failure(text, language)
    if at < 0:
        return (True, 0, 0, None) if at == -1 else (None, 0, 0, "too_deep")
    place = at
    head = text[:place].replace("\r\n", "\n").replace("\r", "\n")
    return False, head.count("\n") + 1, len(head) - head.rfind("\n"), cause_of(text, language, at)


def _verdicts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for file_id, repo, path, text in zip(f["file_id"], f["repo"], f["source_file"], f["content"]):
            language = language_of(path)
            if language is None or text is None:
                continue
            rows.append((file_id, repo, path, language, *verdict(text, language)))
        yield pd.DataFrame(rows, columns=["file_id", "repo", "source_file", "language", "valid", "line_no", "column_no", "cause"])


def check_files(files: DataFrame) -> DataFrame:
    """file_id, repo, source_file, language, valid, line_no, column_no, cause: one row a file with a verdict."""
    made = files.select("file_id", "repo", "source_file", "content").mapInPandas(
        _verdicts, "file_id bigint, repo string, source_file string, language string, valid boolean, line_no int, column_no int, cause string"
    )
    return made.dropDuplicates(["file_id"])


# Messages of failures to get at a file, and of faults of syntax.
_NO_ACCESS = (
    r"no such file|is a directory|not a directory|permission|access (is )?denied|timed? ?out|connection|quota|disk|network|"
    r"unreachable|fetch|download|reading|not found|cannot open|broken pipe|i/o error|input/output error|too many open|read-only|stale file|device"
)
_SYNTAX = (
    r"syntax|unexpected|invalid|unmatched|unterminated|never closed|expected|indent|literal|does not match|cannot assign|"
    r"unindent|eof while|eol while|unclosed|missing|parse|token|must be|not allowed|line \d+\)?\s*$"
)


def is_syntax_message(message: Column) -> Column:
    low = F.lower(message)
    # A message that ends in (name, line n) comes from a parser whatever words the file's name holds.
    return F.coalesce(low.rlike(r"\([^()]*, line \d+\)\s*$") | (low.rlike(_SYNTAX) & ~low.rlike(_NO_ACCESS)), F.lit(False))


def item_kind(kind: Column) -> Column:
    return F.lower(F.trim(kind))


def failed_items(items: DataFrame) -> DataFrame:
    """file_id of each earlier extraction that stopped at a fault of syntax."""
    return items.where((item_kind(F.col("kind")) == "error") & is_syntax_message(F.col("docstring"))).select("file_id").where("file_id IS NOT NULL").distinct()


def not_parsing(files: DataFrame, items: DataFrame) -> DataFrame:
    return check_files(files).where("NOT valid").select("file_id").unionByName(failed_items(items)).distinct()


def rates(files: DataFrame, items: DataFrame) -> DataFrame:
    """repo, language, n_files, n_failed, rate and a count for each cause; earlier extractions count as Python."""
    now = check_files(files).select("repo", "language", F.coalesce("valid", F.lit(True)).alias("ok"), "cause")
    extension = F.lower(F.regexp_extract("source_file", r"(\.[^./]+)$", 1))
    language = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        language = F.when(extension == e, name).otherwise(language)
    failed = (item_kind(F.col("kind")) == "error") & is_syntax_message(F.col("docstring"))
    before = (
        items.where("file_id IS NOT NULL")
        .groupBy("file_id")
        .agg(F.min(F.element_at(F.split("source_file", "/"), 2)).alias("repo"), F.min(language).alias("language"), F.max(F.coalesce(failed, F.lit(False))).alias("bad"))
        .select("repo", "language", (~F.col("bad")).alias("ok"), F.when(F.col("bad"), "syntax").alias("cause"))
    )
    return (
        now.unionByName(before)
        .groupBy("repo", "language")
        .agg(F.count("*").alias("n_files"), F.count_if(~F.col("ok")).alias("n_failed"), *[F.count_if(F.col("cause") == c).alias(f"n_{c}") for c in CAUSES])
        .withColumn("rate", F.round(F.col("n_failed") / F.col("n_files"), 6))
    )
