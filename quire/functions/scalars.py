"""Scalar functions as Column expressions; every one stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_trim(col) -> Column:
    return F.lower(F.trim(_col(col)))


def regexp_replace_clean(col, keep: str = r"a-z ") -> Column:
    """Lower case with every character outside the ``keep`` class removed."""
    return F.regexp_replace(F.lower(_col(col)), f"[^{keep}]", "")


def split_regex(col, pattern: str) -> Column:
    return F.split(_col(col), pattern)


def concat_lit(*parts) -> Column:
    """Join columns and literals (given as ``F.lit``) to one string."""
    return F.concat(*[_col(p).cast("string") for p in parts])


def char_length(col) -> Column:
    return F.length(_col(col))


def byte_length(col) -> Column:
    """UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(_col(col)), F.lit(0))


def bytes_per_word(col) -> Column:
    return F.try_divide(byte_length(col), word_count_tokens(col))


def coalesce_default(col, default) -> Column:
    return F.coalesce(_col(col), F.lit(default))


def url_last_segment(col) -> Column:
    """Last path segment, ignoring trailing slashes."""
    return F.regexp_extract(_col(col), r"([^/]+)/*$", 1)


def safe_filename(col) -> Column:
    return F.translate(_col(col), "/\\:", "___")


def word_count_tokens(col) -> Column:
    """Words between white space; 0 for an empty or null text."""
    words = F.filter(F.split(_col(col), r"\s+"), lambda x: x != "")
    return F.coalesce(F.size(words), F.lit(0))


def word_count_split(col) -> Column:
    """Length of the plain split on white space: 1 for an empty text."""
    return F.size(F.split(_col(col), r"\s+"))


def sentence_count_punct(col) -> Column:
    return F.size(F.split(_col(col), r"[.!?]+"))


def date_trunc_month(col) -> Column:
    return F.date_trunc("month", _col(col))


def json_field(col, path: str) -> Column:
    return F.get_json_object(_col(col), path)


def minmax_scale(col, lo, hi, eps: float = 1e-8) -> Column:
    """(x - lo) / (hi - lo + eps) with bounds taken from an aggregate."""
    return (_col(col) - _col(lo)) / (_col(hi) - _col(lo) + F.lit(eps))


def type_cast(col, to: str) -> Column:
    """Cast that gives null instead of an error for a malformed value."""
    return _col(col).try_cast(to)


def year_to_int(col) -> Column:
    return _col(col).try_cast("int")


def template_prompt(instruction: str, col) -> Column:
    return F.format_string("Instruct: %s\nQuery: %s", F.lit(instruction), _col(col))


def array_distinct_ordered(col) -> Column:
    """Drop blanks and repeats, keeping first-seen order."""
    return F.array_distinct(F.filter(_col(col), lambda x: x.isNotNull() & (F.trim(x) != "")))
