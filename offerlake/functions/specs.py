"""Memory, storage and traffic from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import hits_with_context, let

# The words that tell the kinds of size apart, and how a size is written before or after such a word.
STORAGE = "(?:ssd|hdd|nvme|disk|storage|space)"
TRAFFIC = "(?:bandwidth|bw|transfer|traffic|data)"
MEMORY = "(?:ram|memory)"
SIZE = r"(?iU)\d+(?:\.\d+)?\s*(?:TB|GB)\b"
AMOUNT = r"(\d+(?:\.\d+)?)\s*(TB|GB)"
BEFORE, AFTER = "(?iU)" + AMOUNT + r"\s*{word}\b", r"(?iU){word}\s*[:\-]?\s*" + AMOUNT + r"\b"
WINDOW = 30


def _gb(number: Column, unit: Column) -> Column:
    n = number.try_cast("double")
    return F.when(F.upper(unit) == "TB", n * 1024).otherwise(n).try_cast("int")


def ram_mb(c: Column) -> Column:
    """The first number of GB, else the first whole number of MB."""
    gb, mb = F.regexp_extract(c, r"(?iU)(\d+(?:\.\d+)?)\s*GB", 1), F.regexp_extract(c, r"(?iU)(\d+)\s*MB", 1)
    return F.when(gb != "", (gb.try_cast("double") * 1024).try_cast("int")).when(mb != "", mb.try_cast("int"))


def _sized(c: Column, own: str, other: str) -> Column:
    """A size before or after a word of its own kind, else the first whose surroundings name neither the other kind nor memory."""
    out = F.when(F.nullif(c, F.lit("")).isNull(), None)
    for pattern in (BEFORE.replace("{word}", own), AFTER.replace("{word}", own)):
        number = F.regexp_extract(c, pattern, 1)
        out = out.when(number != "", _gb(number, F.regexp_extract(c, pattern, 2)))
    free = F.filter(hits_with_context(c, SIZE, WINDOW), lambda x: ~x["context"].rlike(f"(?i){other}|{MEMORY}"))
    first = let(F.try_element_at(free, F.lit(1)), lambda x: _gb(F.regexp_extract(x["hit"], r"(?U)^(\d+(?:\.\d+)?)", 1), F.right(x["hit"], F.lit(2))))
    return out.otherwise(first)


def storage_gb(c: Column) -> Column:
    return _sized(c, STORAGE, TRAFFIC)


def bandwidth_gb(c: Column) -> Column:
    """-1 for *unlimited*, wherever it stands."""
    return F.when(c.rlike(r"(?i)\bunlimited\b"), F.lit(-1)).otherwise(_sized(c, TRAFFIC, STORAGE))
