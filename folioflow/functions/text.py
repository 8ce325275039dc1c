"""Text functions as Column expressions. A NULL argument gives NULL unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space; what is stripped and split at, so that other SQL engines agree.
BLANK = r"[ \t\n\r\f\x0B]"

# Words that carry no meaning in a keyword search.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his how i if in into is it its no not of on or our she so "
    "such that the their them then there these they this to was we were what when which who will with you your"
).split()


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^{BLANK}+|{BLANK}+$", "")


def count_tokens(t: Column) -> Column:
    """Tokens of a text by the rule of four characters each."""
    return F.floor(F.length(t) / 4).cast("long")


def slugify(t: Column) -> Column:
    """Lower-case letters and digits with underscores between, at most 50 characters; the cut may leave an underscore at the end."""
    joined = F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, 50)


def document_slug(stem: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def pretty_title(stem: Column) -> Column:
    """Hyphens and underscores become blanks and the first character upper-case; the rest stays as it is."""
    spaced = strip(F.regexp_replace(stem, "[-_]+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def content_hash(t: Column) -> Column:
    return F.substring(F.sha2(t, 256), 1, 16)


def cache_key(t: Column, model: Column) -> Column:
    return F.substring(F.sha2(F.concat(model, F.lit("::"), t), 256), 1, 32)


def chunk_id(doc: Column, path: Column, index: Column) -> Column:
    """Names a chunk by its document, the last heading of its section path, a hash of the path and its number."""
    leaf = F.element_at(F.split(path, " > ", -1), -1)
    number = F.when(index < 1000, F.lpad(index.cast("string"), 3, "0")).otherwise(index.cast("string"))
    return F.concat(doc, F.lit("__"), slugify(leaf), F.lit("__"), F.substring(F.sha2(path, 256), 1, 8), F.lit("__chunk"), number)


def section_path(parents: Column, heading: Column) -> Column:
    return F.array_join(F.concat(F.coalesce(parents, F.array().cast("array<string>")), F.array(heading)), " > ")


def heading_prefix(heading: Column) -> Column:
    return F.concat(F.lit("# "), heading, F.lit("\n\n"))


def breadcrumb(path: Column, heading: Column) -> Column:
    """The line that names the section; empty when the path is only the heading."""
    return F.when(path == heading, F.lit("")).otherwise(F.concat(F.lit("_Section: "), path, F.lit("_\n\n")))


def preview(t: Column, size: int, dots: bool = False) -> Column:
    """The first ``size`` characters; with ``dots``, flattened to one line and, where cut, ending in three dots within ``size``."""
    if not dots:
        return F.substring(t, 1, size)
    flat = F.regexp_replace(t, "\n", " ")
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 3), F.lit("..."))).otherwise(flat)


def terms(t: Column) -> Column:
    """Lower-case runs of letters and digits in order, without stop words; NULL gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(found, lambda x: ~x.isin(*STOP_WORDS))


def blank_terms(t: Column) -> Column:
    """Distinct lower-case words between ASCII blanks."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), f"{BLANK}+", -1), lambda x: x != ""))
