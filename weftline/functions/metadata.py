"""Counts, dates and the five metadata features of a post."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import strip

METADATA_FEATURES = ("log1p_likes", "log1p_comments", "log1p_reposts", "posting_time_sin", "posting_time_cos")
#: Tried in this order, then ISO 8601.
DATE_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy-M-d")
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def parse_count(value: Column) -> Column:
    """A number truncated toward zero and not below it; 0 for anything that isn't a finite number."""
    text = strip(F.coalesce(value.cast("string"), F.lit("")))
    number = F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    whole = F.when(F.abs(number) < F.lit(9.2e18), number).try_cast("long")
    return F.greatest(F.coalesce(whole, F.lit(0).cast("long")), F.lit(0).cast("long"))


def parse_datetime(value: Column) -> Column:
    """A timestamp without zone, null where no format fits."""
    text = strip(value.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp_ntz"))
    return F.coalesce(*tries, iso)


def preferred(value: Column, fallback: Column) -> Column:
    """The value unless it is null or has no characters; one of only white space still counts."""
    return F.when(F.length(value) > 0, value).otherwise(fallback)


def metadata_columns(likes: Column, comments: Column, reposts: Column, published: Column) -> list[Column]:
    """The five features; the time of day is (0, 0), off the unit circle, where it is missing."""
    seconds = F.hour(published) * 3600 + F.minute(published) * 60 + F.floor(F.second(published))
    angle = F.lit(2 * math.pi) * seconds / F.lit(86400.0)
    logs = [F.log1p(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("double")) for x in (likes, comments, reposts)]
    return [*logs, F.coalesce(F.sin(angle), F.lit(0.0)), F.coalesce(F.cos(angle), F.lit(0.0))]


def metadata_vector(likes: Column, comments: Column, reposts: Column, published: Column) -> Column:
    return F.array(*metadata_columns(likes, comments, reposts, published))
