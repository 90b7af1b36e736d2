"""Cleaning and normalising text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The emoji blocks that are dropped.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lower_each(c: Column) -> Column:
    """Lower case of each character by itself, as SQL engines have it: without the two letters whose lower case is longer or goes by what follows."""
    return F.lower(F.translate(c, "\u0130\u03a3", "i\u03c3"))


def clean_text(c: Column) -> Column:
    """Null and '' give ''. White space is collapsed before emoji go, so two spaces can remain where one stood between."""
    collapsed = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(collapsed, EMOJI, ""))


def fingerprint_text(c: Column) -> Column:
    """Lower case, no emoji, signs as spaces (letters, digits and marks of all scripts stay), one space between words."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), EMOJI, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def contains_any_case(c: Column, needle: str) -> Column:
    """Literal substring in any case; a null text has none."""
    return F.coalesce(F.contains(F.lower(c), F.lower(F.lit(needle))), F.lit(False))


def hits_with_context(text: Column, pattern: str, width: int) -> Column:
    """array<struct<hit, context>>: every match of ``pattern``, with ``width`` characters on either side.

    Splitting at the pattern gives the pieces between matches; lengths added up give the places.
    """

    def placed(hits: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            total = lambda a: F.aggregate(F.transform(a, lambda x: F.char_length(x)), F.lit(0), lambda s, x: s + x)

            def one(hit: Column, i: Column) -> Column:
                start = total(F.slice(pieces, 1, i + 1)) + total(F.slice(hits, 1, i))
                first = F.greatest(start - width, F.lit(0))
                return F.struct(hit.alias("hit"), F.substring(text, first + 1, start - first + F.char_length(hit) + width).alias("context"))

            return F.transform(hits, one)

        return let(F.split(text, pattern, -1), with_pieces)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
