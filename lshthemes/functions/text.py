"""Text and label functions, all built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def preview(body: Column | str, title: Column | str, limit: int | None = None) -> Column:
    """Text shown under a result.

    With a ``limit`` (abstracts) the body is cut there and marked with dots. Without one (posts) it is
    shown whole, unless it only repeats the title.
    """
    body, title = _col(body), _col(title)
    if limit is None:
        return F.when((F.length(body) > 0) & ~body.eqNullSafe(title), body)
    cut = F.concat(F.substring(body, 1, limit), F.lit("..."))
    return F.when(F.length(body) > limit, cut).when(F.length(body) > 0, body)


def headline(title: Column | str, body: Column | str) -> Column:
    """Title and start of the body; the dots are part of the format and always there."""
    start = F.substring(F.coalesce(_col(body), F.lit("")), 1, 200)
    return F.concat(F.coalesce(_col(title), F.lit("")), F.lit("\n\n"), start, F.lit("..."))


def label_tokens(label: Column | str) -> Column:
    """Distinct lower-case words of a label, letters of any script included."""
    words = F.regexp_extract_all(F.lower(_col(label)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(words)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens of two token sets; 0 where one is empty."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / either)


def substring_count(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part``, from left to right."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, F.floor(gone / F.length(part)).cast("bigint")).otherwise(
        F.lit(0).cast("bigint")
    )


def title_case(text: Column | str) -> Column:
    """First letter of every run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    cased = F.transform(
        runs,
        lambda run: F.concat(F.upper(F.substr(run, F.lit(1), F.lit(1))), F.lower(F.substr(run, F.lit(2)))),
    )
    return F.array_join(cased, "")


def clean_label(raw: Column | str) -> Column:
    """Tidy a label written by someone else: trim, drop stars, quotes and later lines, cap at 50."""
    text = F.regexp_replace(_col(raw), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    text = F.replace(text, F.lit("*"), F.lit(""))
    text = F.regexp_replace(text, r"^[\"']+|[\"']+\z", "")
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    return F.when(
        F.length(line) > 50, F.concat(F.substring(line, 1, 47), F.lit("..."))
    ).otherwise(line)


def best_label(label: Column | str) -> Column:
    """Aggregate: the longest label, the greater by code point among equals."""
    return F.max_by(label, F.struct(F.length(_col(label)), _col(label)))
