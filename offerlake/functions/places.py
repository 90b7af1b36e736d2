"""Locations and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, clean_text

# Regions that count as a location by themselves.
REGIONS = "US|USA|EU|Europe|Asia|Germany|Netherlands|France|UK|Singapore|Japan"
# Fixed value: how a text labels its location.
LABELLED = r"(?i)(?:location|datacenter|dc)[\s:]+([A-Za-z\s,]+?)(?:\n|$|\.)"


def location(c: Column) -> Column:
    """What follows a location label up to a line's end or a period, else a region's name."""
    labelled = F.regexp_extract(c, LABELLED, 1)
    region = F.regexp_extract(c, rf"(?i)(?:{REGIONS})\b", 0)
    return blank_to_null(clean_text(F.coalesce(blank_to_null(labelled), blank_to_null(region))))


def posted_at(c: Column, default: Column | None = None) -> Column:
    """ISO 8601, UTC where it has no offset; a value that can't be read gives ``default`` or null."""
    found = F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))
    return found if default is None else F.coalesce(found, default)
