"""Column functions over times of notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ymd(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def note_date(meta: Column, mtime: Column) -> Column:
    """The metadata's date, created or created_at, first ten characters; else mtime's day."""

    def named(key: str) -> Column:
        value = F.trim(F.regexp_replace(F.regexp_extract(meta, rf"(?m)^{key}:[ \t]*(.*)$", 1), "[\"']", ""))
        return F.when(F.length(value) >= 7, F.replace(F.substring(value, 1, 10), F.lit("/"), F.lit("-")))

    return F.coalesce(named("date"), named("created"), named("created_at"), ymd(mtime))
