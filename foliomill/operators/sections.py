"""Sections: heading-aware division of Markdown into bounded, named pieces.

A document is one row, and all steps are expressions over its text: nothing is shuffled. Places to cut
are marked inside the text and the text is then split at the marks, so every step takes time in
proportion to the text. The mark is a character; where a text holds it already, it is written as the
mark and a zero, and put back in what is returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import states
from foliomill.functions.naming import output_filename, section_filename, slug
from foliomill.functions.text import BREAK, has_text, let, without_end

MARK = "\uffff"
LINE_START, GAP = rf"(?<![^{BREAK}])", rf"[\s&&[^{BREAK}]]"
# what stands at few places comes first and is looked back from, so that other characters cost one comparison
FENCE_START = rf"(?U)[`~](?<={LINE_START}{GAP}{{0,3}}[`~])(?:(?<=`)``|(?<=~)~~)"
HEADING_START = rf"(?U)#(?<={LINE_START}#)#{{0,5}}{GAP}"
LINE_END = rf"[{BREAK}](?<!\r(?=\n))"
HEADING = r"(?U)^(#{1,6})\s+(.*?)\s*#*\s*$"


def _held(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(f"{MARK}0"))


def _freed(text: Column) -> Column:
    return F.replace(text, F.lit(f"{MARK}0"), F.lit(MARK))


def _cut(parts: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """The texts of parts joined, those together that follow one for which opens(part, number) holds."""
    return F.split(F.array_join(F.transform(parts, lambda p, n: F.when(opens(p, n), F.concat(F.lit(f"{MARK}c"), p)).otherwise(p)), ""), f"{MARK}c")


def _marked(text: Column) -> Column:
    """text with a mark before each heading outside code fences. Every fence line toggles, so each second stretch from fence to fence is code."""
    stretches = F.split(F.regexp_replace(text, FENCE_START, f"{MARK}f$0"), f"{MARK}f")
    return F.array_join(F.transform(stretches, lambda s, n: F.when(n % 2 == 1, s).otherwise(F.regexp_replace(s, HEADING_START, f"{MARK}h$0"))), "")


def _pieces(text: Column) -> Column:
    """What precedes the first heading, then a piece from each heading to the next."""
    return F.split(_marked(text), f"{MARK}h")


def _level(piece: Column, number: Column) -> Column:
    return F.when(number > 0, F.length(F.regexp_extract(piece, "^#+", 0)))


def _title(block: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(block, rf"^[^{BREAK}]*", 0), HEADING, 2)


def _section(title: Column, text: Column) -> Column:
    return F.struct(title.alias("title"), text.alias("text"))


def _blocks(pieces: Column, level: Column) -> Column:
    """Pieces joined into blocks that begin at headings of a level; a blank start is left out."""
    cut = _cut(pieces, lambda p, n: _level(p, n) == level)
    named = F.transform(cut, lambda b, n: _section(F.when(n > 0, _title(b)).otherwise(F.lit("")), b))
    return F.filter(named, lambda b, n: (n > 0) | has_text(b["text"]))


def _bytes(text: Column) -> Column:
    return F.octet_length(_freed(text))


def _merged(blocks: Column, min_bytes: int) -> Column:
    """A block opens a group if it is the first or large enough; the others join the one before."""
    texts = _cut(F.transform(blocks, lambda b: b["text"]), lambda t, n: (n > 0) & (_bytes(t) >= min_bytes))
    return F.transform(texts, lambda t, n: _section(F.when(n > 0, _title(t)).otherwise(F.get(blocks, F.lit(0))["title"]), t))


def _divided(group: Column, top: Column, max_bytes: int) -> Column:
    """A group over max_bytes is cut once at the next level inside it, fences counting from its start."""

    def cut(pieces: Column) -> Column:
        below = F.array_min(F.filter(F.transform(pieces, _level), lambda level: level > top))
        return let(below, lambda level: F.when(level.isNull(), F.array(group)).otherwise(let(_blocks(pieces, level), ride)))

    def ride(found: Column) -> Column:
        """An untitled first piece goes with the next; pieces without a title have the group's."""
        one, two = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        joined = F.concat(F.array(_section(two["title"], F.concat(one["text"], two["text"]))), F.slice(found, 3, F.size(found)))
        own = F.when((F.size(found) > 1) & (one["title"] == ""), joined).otherwise(found)
        return F.transform(own, lambda s: _section(F.coalesce(F.nullif(s["title"], F.lit("")), group["title"]), s["text"]))

    return F.when(_bytes(group["text"]) > max_bytes, let(_pieces(group["text"]), cut)).otherwise(F.array(group))


def _at_top(text: Column, then: Callable[[Column, Column], Column]) -> Column:
    """then(blocks at the highest level present, that level), or the whole text as one untitled section where it has no heading."""

    def cut(pieces: Column) -> Column:
        whole = F.array(_section(F.lit(""), F.array_join(pieces, "")))
        return let(F.array_min(F.transform(pieces, _level)), lambda top: F.when(top.isNull(), whole).otherwise(let(_blocks(pieces, top), lambda blocks: then(blocks, top))))

    return F.when(text.isNotNull(), F.transform(let(_pieces(_held(text)), cut), lambda s: _section(_freed(s["title"]), _freed(s["text"]))))


def sections_of(text: Column, min_bytes: int = states.SECTION_MIN_BYTES, max_bytes: int = states.SECTION_MAX_BYTES) -> Column:
    """Array of (title, text): blocks at the highest heading level present, small ones joined to the one before, large ones divided once."""
    return _at_top(text, lambda blocks, top: F.flatten(F.transform(_merged(blocks, min_bytes), lambda g: _divided(g, top, max_bytes))))


def headings(docs: DataFrame, key: str = "doc_id", markdown: str = "markdown") -> DataFrame:
    """(key, at, level, title) of the headings outside code fences; at counts lines from 0."""
    ended = F.regexp_replace(_marked(_held(F.col(markdown))), LINE_END, f"$0{MARK}l")
    lines = docs.select(key, F.posexplode(F.split(ended, f"{MARK}l")).alias("at", "raw")).where(F.col("raw").startswith(f"{MARK}h"))
    line = F.substring(without_end(F.col("raw")), 3, 1 << 30)
    return lines.select(key, "at", F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), _freed(F.regexp_extract(line, HEADING, 2)).alias("title"))


def blocks_at_top(docs: DataFrame, key: str = "doc_id", markdown: str = "markdown") -> DataFrame:
    """(key, block, title, text) of the blocks at the highest heading level present, from 1; a blank start is left out, and a text without heading is one block."""
    found = docs.select(key, F.posexplode(_at_top(F.col(markdown), lambda blocks, top: blocks)).alias("at", "s"))
    return found.select(key, (F.col("at") + 1).alias("block"), "s.title", "s.text")


def split_into_sections(docs: DataFrame, key: str = "doc_id", markdown: str = "markdown", min_bytes: int = states.SECTION_MIN_BYTES, max_bytes: int = states.SECTION_MAX_BYTES) -> DataFrame:
    """(key, ordinal, title, text) of each document's sections. A null text has none, an empty one is one section."""
    found = docs.select(key, F.posexplode(sections_of(F.col(markdown), min_bytes, max_bytes)).alias("at", "s"))
    return found.select(key, (F.col("at") + 1).alias("ordinal"), "s.title", "s.text")


def plan_outputs(docs: DataFrame, threshold: int = states.SECTION_THRESHOLD_BYTES, min_bytes: int = states.SECTION_MIN_BYTES, max_bytes: int = states.SECTION_MAX_BYTES) -> DataFrame:
    """The files of each document (content_hash, filename, markdown).

    Returns (content_hash, output_filename, text, bytes, section_ordinal, section_title). Documents up to
    the threshold, and those with fewer than two sections, are one file.
    """
    md = F.col("markdown")
    whole = F.array(F.struct(F.lit(False).alias("many"), F.lit("").alias("title"), md.alias("text")))
    several = lambda found: F.transform(found, lambda s: F.struct(F.lit(True).alias("many"), s["title"].alias("title"), s["text"].alias("text")))
    files = F.when(F.octet_length(md) > threshold, let(sections_of(md, min_bytes, max_bytes), lambda found: F.when(F.size(found) > 1, several(found)).otherwise(whole))).otherwise(whole)
    rows = docs.select("content_hash", slug(F.col("filename")).alias("slug"), F.posexplode(files).alias("at", "file")).select("content_hash", "slug", (F.col("at") + 1).alias("ordinal"), "file.*")
    many = F.col("many")
    name = F.when(many, section_filename(F.col("slug"), F.col("content_hash"), F.col("ordinal"), F.col("title"), slug(F.col("title")))).otherwise(output_filename(F.col("slug"), F.col("content_hash")))
    return rows.select(
        "content_hash",
        name.alias("output_filename"),
        "text",
        F.octet_length("text").cast("long").alias("bytes"),
        F.when(many, F.col("ordinal")).alias("section_ordinal"),
        F.when(many, F.nullif(F.col("title"), F.lit(""))).alias("section_title"),
    )


def superseded_outputs(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier outputs of the documents in new that new does not name again."""
    again = previous.join(new.select("content_hash").distinct(), "content_hash", "left_semi")
    return again.join(new.select("content_hash", "output_filename"), ["content_hash", "output_filename"], "left_anti")
