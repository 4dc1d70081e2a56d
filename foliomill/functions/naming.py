"""Names of files: display names, slugs, output and section filenames."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.text import let, strip

MAX_SLUG, MAX_SECTION_SLUG, HASH_PREFIX = 80, 40, 12


def display_name(raw: Column) -> Column:
    """The last component of an uploaded name, stripped; document.pdf where nothing is left."""
    last = F.element_at(F.split(F.replace(F.coalesce(F.nullif(raw, F.lit("")), F.lit("document.pdf")), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.coalesce(F.nullif(strip(last), F.lit("")), F.lit("document.pdf"))


@cache
def ascii_folds() -> tuple[dict[str, str], dict[str, str]]:
    """What characters outside ASCII leave in ASCII when they are decomposed: those that leave one letter, and those that leave more."""
    one, more = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        left = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if left:
            (one if len(left) == 1 else more)[chr(code)] = left
    return one, more


def nfkd_ascii(name: Column) -> Column:
    """Compatibility decomposition without what is not ASCII. It is that of each character, as reordering moves marks only."""
    one, more = ascii_folds()
    table = F.create_map(*[F.lit(x) for pair in more.items() for x in pair])
    ascii_only = lambda c: c.rlike(r"^[\x00-\x7F]*$")
    spelled = lambda single: F.array_join(F.transform(F.regexp_extract_all(single, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c <= "\x7f", c).otherwise(F.coalesce(F.element_at(table, c), F.lit("")))), "")
    folded = lambda single: F.when(ascii_only(single), single).otherwise(spelled(single))
    return let(name, lambda n: F.when(ascii_only(n), n).otherwise(let(F.translate(n, "".join(one), "".join(one.values())), folded)))


def slug(name: Column) -> Column:
    """A safe, recognisable form of a name."""
    stem = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    return _slug_of_ascii(nfkd_ascii(F.regexp_replace(stem, r"(?i)\.pdf$", "")))


def _slug_of_ascii(text: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, MAX_SLUG), "^-+|-+$", "")
    return let(cut, lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("document")))


def output_filename(slugged: Column, content_hash: Column) -> Column:
    """Slug--hash12.md; a hash that is no lower-case SHA-256 is an error."""
    name = F.concat(slugged, F.lit("--"), F.substring(content_hash, 1, HASH_PREFIX), F.lit(".md"))
    return F.when(content_hash.rlike("^[0-9a-f]{64}$"), name).otherwise(F.raise_error(F.lit("content_hash must be a lowercase hex SHA-256 digest")))


def section_filename(slugged: Column, content_hash: Column, ordinal: Column, title: Column, title_slug: Column) -> Column:
    """Slug--hash12--ordinal-title.md; an untitled section is called section."""
    short = F.regexp_replace(F.substring(title_slug, 1, MAX_SECTION_SLUG), "^-+|-+$", "")
    named = F.when(strip(F.coalesce(title, F.lit(""))) == "", F.lit("section")).otherwise(F.coalesce(F.nullif(short, F.lit("")), F.lit("section")))
    return F.concat(slugged, F.lit("--"), F.substring(content_hash, 1, HASH_PREFIX), F.lit("--"), F.format_string("%03d", ordinal), F.lit("-"), named, F.lit(".md"))
