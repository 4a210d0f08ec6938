"""Scalar expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(ts: Column) -> Column:
    """0 (Sunday) to 6."""
    return (F.dayofweek(ts) - 1).cast("bigint")


def whole_second(ts: Column) -> Column:
    return F.floor(F.date_part(F.lit("second"), ts)).cast("bigint")


def truncated(unit: str, ts: Column) -> Column:
    """date_trunc that stays without a time zone."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def dot(a: Column, b: Column) -> Column:
    """Inner product of arrays of numbers, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("bigint")


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def without_tags(html: Column) -> Column:
    """Markup out by pattern; bodies of scripts and styles stay."""
    return F.regexp_replace(html, "<[^>]*>", "")
