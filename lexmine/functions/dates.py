"""Timestamp parsing for feed dates (results in the session time zone, UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 2822 without the optional day name; Spark rejects the day-name letter
# when parsing, so it is stripped first.
RFC2822_PATTERNS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z")


def rfc2822(col: Column) -> Column:
    s = F.trim(F.regexp_replace(col, r"^\s*[A-Za-z]{3},\s*", ""))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in RFC2822_PATTERNS])


def rfc3339(col: Column) -> Column:
    return F.try_to_timestamp(F.trim(col))
