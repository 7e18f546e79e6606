"""Date reading with explicit formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats that are read, in order; a weekday in front is removed before.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss 'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm:ss 'GMT'", "d MMM yyyy HH:mm:ss", "MMM d, yyyy", "MMM d yyyy",
    "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/MM/dd", "yyyy年M月d日", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "MM/dd/yyyy",
)


def parse_date(text: Column) -> Column:
    """A UTC timestamp by the first format that fits, else January 1 of a year named in the text, else null."""
    t = F.regexp_replace(F.trim(text), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,\s*", "")
    t = F.regexp_replace(t, r"(?i)^(jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\.", "$1")
    year = F.nullif(F.regexp_extract(t, r"\b(19\d{2}|20[0-2]\d)\b", 1), F.lit(""))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS], F.try_to_timestamp(year, F.lit("yyyy")))
