"""Text expressions. Everything here stays inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.fixed_values import EMAIL_PATTERN, NA_TOKENS

# \A and \z rather than ^ and $: Java's $ also matches before a final newline.
_OUTER_WHITESPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_PLAIN_WORDS = r"\A[A-Za-z ]*\z"
_CASED_OR_NOT = (
    r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]+|[^\p{IsLowercase}\p{IsUppercase}\p{Lt}]+"
)


def header_name(name: str) -> str:
    """A column header as a plain identifier: lower case, each run of white space an underscore."""
    return re.sub(r"\s+", "_", name.strip().lower())


def null_if_na(text: Column, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """Null where the text is one of the tokens that stand for a missing cell."""
    return F.when(~text.isin(*tokens), text)


def strip_whitespace(text: Column) -> Column:
    """Remove all Unicode whitespace from both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, _OUTER_WHITESPACE, "")


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others.

    ``initcap`` only starts a word after a space, so it serves text made of
    ASCII letters and spaces; anything else is split into letter runs first.
    """
    runs = F.regexp_extract_all(text, F.lit(_CASED_OR_NOT), F.lit(0))
    by_run = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(text.rlike(_PLAIN_WORDS), F.initcap(text)).otherwise(by_run)


def is_email(text: Column) -> Column:
    """True for a well-formed address, false for anything else including null."""
    return F.coalesce(text, F.lit("")).rlike(EMAIL_PATTERN)


def is_one_of_ignoring_case(text: Column, allowed: Iterable[str]) -> Column:
    """Case-insensitive membership; null is not a member. No trimming."""
    return F.lower(F.coalesce(text, F.lit(""))).isin(*allowed)
