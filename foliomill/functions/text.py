"""Markdown measures: lines, headings, tables, figures, white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a strip sees it: Unicode's, and the four separators.
BLANK = r"[\s\x1c-\x1f]"
#: Characters that end a line.
BREAK = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
HEADING = r"(?mdU)^#{1,6}\s+\S"
TABLE_DIVIDER = r"(?mdU)^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
FIGURE = r"(?i:!\[[^\]]*\]\([^)]*\)|<!--\s*image\s*-->)"


def strip(text: Column) -> Column:
    """text without white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def has_text(text: Column) -> Column:
    """Whether there is anything but white space."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def is_blank(text: Column) -> Column:
    return ~has_text(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_with_ends(text: Column) -> Column:
    """Array of the lines of text, each with its line break."""
    return F.regexp_extract_all(text, F.lit(rf"[^{BREAK}]*(?:\r\n|[{BREAK}])|[^{BREAK}]+"), F.lit(0))


def without_end(line: Column) -> Column:
    return F.regexp_replace(line, rf"(?:\r\n|[{BREAK}])$", "")


def count_headings(markdown: Column) -> Column:
    """Heading lines, in code fences too."""
    return F.regexp_count(markdown, F.lit(HEADING))


def count_tables(markdown: Column) -> Column:
    """Divider rows of tables with two columns or more."""
    return F.regexp_count(markdown, F.lit(TABLE_DIVIDER))


def count_figures(markdown: Column) -> Column:
    """Images and image comments."""
    return F.regexp_count(markdown, F.lit(FIGURE))


def figures_in_position(markdown: Column) -> Column:
    """There are no figures, or text follows the last one."""
    tail = F.regexp_extract(markdown, rf"(?s)^.*(?:{FIGURE})(.*)$", 1)
    return (count_figures(markdown) == 0) | ~is_blank(tail)


def count_seam_tables(markdown: Column) -> Column:
    """Tables that only blank lines part from a table before them.

    The non-blank line before a divider's header row is the last one at least two rows up: among the
    non-blank lines the second before the divider, or the first if a blank line stands before it.
    """
    divider = lambda line: line.rlike(TABLE_DIVIDER.replace("(?mdU)", "(?U)"))

    def counted(lines: Column) -> Column:
        spoken = F.filter(
            F.transform(lines, lambda x, n: F.struct(x.alias("line"), F.when((n > 0) & is_blank(F.get(lines, n - 1)), 1).otherwise(2).alias("up"))),
            lambda s: has_text(s["line"]),
        )
        bar = lambda line: F.coalesce(line.rlike(r"(?U)^[\s\x1c-\x1f]*\|"), F.lit(False))
        return let(spoken, lambda found: F.size(F.filter(found, lambda s, n: divider(s["line"]) & bar(F.get(found, n - s["up"])["line"]))))

    lines = F.transform(lines_with_ends(markdown), without_end)
    return F.when(markdown.isNull() | ~F.contains(markdown, F.lit("---")), 0).otherwise(let(lines, counted)).cast("long")


def text_length(markdown: Column) -> Column:
    """Code points of the stripped text."""
    return F.length(strip(markdown))
