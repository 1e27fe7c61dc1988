"""Text expressions; everything stays inside whole-stage code or the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text: Unicode separators and the control characters for spacing.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD_CLASS = r"[\p{L}\p{N}_]+"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def universal_newlines(c: Column | str) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def decode(content: Column | str) -> Column:
    """UTF-8 bytes as text with U+FFFD for what is malformed, universal line ends, stripped."""
    return strip(universal_newlines(F.make_valid_utf8(F.col(content).cast("string") if isinstance(content, str) else content.cast("string"))))


def tokens(c: Column | str) -> Column:
    """Lower-case words; null text has no tokens."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD_CLASS), F.lit(0)), F.array().cast("array<string>"))


def clean_markdown(c: Column | str) -> Column:
    """At most one blank line in a row, no blanks at line ends, one line end at the end."""
    fewer = F.regexp_replace(c, r"\n{3,}", "\n\n")
    lines = F.regexp_replace(fewer, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    bare = F.regexp_replace(lines, r"(?md)[\t\x0b-\r\x1c-\x20\x85\p{Z}]+$", "")
    return F.concat(strip(bare), F.lit("\n"))


def truncated(c: Column | str, most: int = 2000, mark: str = "\n... [truncated]") -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(mark))).otherwise(F.col(c) if isinstance(c, str) else c)


def right_part(c: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n <= 0, F.lit("")).when(F.length(c) <= n, c).otherwise(F.substring(c, F.length(c) - n + 1, n))
