"""Cutting texts into chunks: whole files, heading sections, sliding windows, parents with children.

A sliding window ends at its last sentence end or line end past the overlap,
if it has one, and the next starts ``overlap`` characters before that end.
What is new in each window is one match of a bounded regular expression, so a
text is cut in one linear pass inside the JVM, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.arrays import with_overlap
from lexmill.functions.text import strip


def _window_pattern(size: int, overlap: int) -> str:
    fresh = size - overlap

    def step(least: int, most: int) -> str:
        # A line end may be the window's last character; a full stop needs its blank inside the window.
        stop = rf"|.{{{least},{most - 1}}}(?:(?<=\n)|(?<=\.)(?= ))" if most - 1 >= least else ""
        return rf".{{{most - 1}}}\n{stop}|.{{{most}}}"

    return rf"(?s)\A.{{1,{size}}}\z|\A(?:{step(overlap + 2, size)})|(?<!\A)\G(?:.{{1,{fresh}}}\z|{step(2, fresh)})"


def char_split(text: Column | str, size: int, overlap: int) -> Column:
    """Array of the stripped, non-blank windows of ``text``."""
    if size <= overlap:
        raise ValueError("a window must be larger than its overlap")
    text = F.col(text) if isinstance(text, str) else text
    fresh = F.regexp_extract_all(text, F.lit(_window_pattern(size, overlap)), F.lit(0))
    # Every extract but the last has two characters at least, or as many as a window brings.
    windows = with_overlap(fresh, F.lit(overlap), F.lit(min(2, size - overlap)))
    return F.when(F.length(text) <= size, non_blank(F.array(text))).otherwise(non_blank(windows))


def non_blank(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda x: F.length(x) > 0)


def heading_sections(text: Column | str) -> Column:
    """Stripped, non-blank sections, each from a second- or third-level heading to the next."""
    return non_blank(F.split(text, r"(?md)(?=^#{2,3} )"))


def heading_chunks(text: Column | str, size: int, overlap: int) -> Column:
    """Sections up to ``size`` whole, longer ones as windows."""
    return F.flatten(F.transform(heading_sections(text), lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(char_split(s, size, overlap))))


def flat_chunks(text: Column | str, strategy: str, size: int, overlap: int) -> Column:
    """Whole text for whole_file or size 0, heading chunks for any other strategy."""
    if strategy == "whole_file" or size == 0:
        return non_blank(F.array(text))
    return heading_chunks(strip(text), size, overlap)


def parent_chunks(text: Column | str, strategy: str, size: int, overlap: int) -> Column:
    """As flat_chunks, but a strategy other than whole_file and heading slides windows over the text."""
    if strategy == "whole_file":
        return non_blank(F.array(text))
    return heading_chunks(strip(text), size, overlap) if strategy == "heading" else char_split(strip(text), size, overlap)


def explode_flat(files: DataFrame, strategy: str, size: int, overlap: int, path: str = "source_path", text: str = "text") -> DataFrame:
    """Columns of ``files`` but the text, with chunk_no, id and text of each chunk."""
    rest = [c for c in files.columns if c != text]
    cut = files.select(*rest, F.posexplode(flat_chunks(F.col(text), strategy, size, overlap)).alias("chunk_no", "text"))
    return cut.withColumn("id", F.md5(F.concat_ws("|", F.col(path), F.col("chunk_no").cast("string"))))


def explode_parents(files: DataFrame, strategy: str, size: int, overlap: int, path: str = "source_path", text: str = "text") -> DataFrame:
    rest = [c for c in files.columns if c != text]
    cut = files.select(*rest, F.posexplode(parent_chunks(F.col(text), strategy, size, overlap)).alias("parent_no", "text"))
    return cut.withColumn("parent_id", F.md5(F.concat(F.col(path), F.lit("|p"), F.col("parent_no").cast("string"))))


def explode_children(parents: DataFrame, size: int, overlap: int, path: str = "source_path") -> DataFrame:
    """Windows over each parent; a parent is never blank, so each gives one at least."""
    rest = [c for c in parents.columns if c != "text"]
    cut = parents.select(*rest, F.posexplode(char_split(F.col("text"), size, overlap)).alias("child_no", "text"))
    return cut.withColumn("id", F.md5(F.concat(F.col(path), F.lit("|p"), F.col("parent_no").cast("string"), F.lit("|c"), F.col("child_no").cast("string"))))
