"""Functions on object keys and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBJECT = "(sub-[A-Za-z0-9]+)"
SUBJECT_FOLDER = SUBJECT + "/"


def subject_of(key: Column) -> Column:
    """The first subject label in a key, ``unknown`` where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(key, SUBJECT, 1), F.lit("")), F.lit("unknown"))


def subject_folder_of(key: Column) -> Column:
    """The first subject label that names a folder, else NULL."""
    return F.nullif(F.regexp_extract(key, SUBJECT_FOLDER, 1), F.lit(""))


def basename_of(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def derivative_of(key: Column) -> Column:
    """The path part after ``derivatives``, ``unknown`` where there is none."""
    parts = F.split(key, "/")
    at = F.array_position(parts, F.lit("derivatives")).cast("int")
    return F.when(at > 0, F.coalesce(F.try_element_at(parts, at + 1), F.lit("unknown"))) \
        .otherwise(F.lit("unknown"))


def stem_of(key: Column) -> Column:
    return F.regexp_replace(key, r"\.[^./]*$", "")


def with_suffix(key: Column, suffix: str) -> Column:
    return F.concat(stem_of(key), F.lit(suffix))


def suffix_of(key: Column) -> Column:
    return F.regexp_extract(key, r"(\.[^./]*)$", 1)


def decode_text(content: Column) -> Column:
    """UTF-8 with U+FFFD in the place of bad bytes."""
    return F.make_valid_utf8(content.cast("string"))


def whole_json(content: Column) -> Column:
    """The text as a VARIANT, NULL unless all of it is one JSON value. Spark's parser stops behind the first value and lets anything follow;
    what follows cannot suit an array and an object alike, so the text must parse in both."""
    inside = lambda head, tail: F.try_parse_json(F.concat(F.lit(head), content, F.lit(tail))).isNotNull()
    value = F.try_parse_json(content)
    return F.when(value.isNotNull() & inside("[", "]") & inside('{"v":', "}"), value)


def json_preview(content: Column, length: int = 1500) -> Column:
    """The parsed JSON written out again, or the raw text where it does not parse; cut for display."""
    return F.substring(F.coalesce(F.to_json(whole_json(content)), content), 1, length)


def guess_column(columns: list[str], keywords: list[str], exact: str | None = None) -> str | None:
    """The column named ``exact``, else the first one whose lower-cased name holds any keyword."""
    if exact in columns:
        return exact
    return next((c for c in columns if any(k in c.lower() for k in keywords)), None)
