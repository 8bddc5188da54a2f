"""Timestamp parsing, rendering and differences, all in UTC."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


_ZONE = r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)?"
_DASHED = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}(:[0-9]{{2}}(:[0-9]{{2}}([.,][0-9]{{1,9}})?)?)?{_ZONE})?$"
_COMPACT = rf"^[0-9]{{8}}([T ][0-9]{{2}}([0-9]{{2}}([0-9]{{2}}([.,][0-9]{{1,9}})?)?)?{_ZONE})?$"


def parse_iso(text: Column | str) -> Column:
    """ISO-8601 text with a full date to a timestamp; no zone means UTC, all else is NULL.

    Dates may be written with or without dashes, times down to the hour. A time or a year
    alone is no date.
    """
    text = F.col(text) if isinstance(text, str) else text
    dashed = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    dashed = F.regexp_replace(dashed, r"([T ]\d{2})(\d{2})(?=\d{2}|[.,Z+-]|$)", "$1:$2")
    dashed = F.regexp_replace(dashed, r"([T ]\d{2}:\d{2})(\d{2})", "$1:$2")
    dashed = F.regexp_replace(dashed, r"^(.{10}[T ]\d{2})(?=[Z+-]|$)", "$1:00")
    dashed = F.regexp_replace(dashed, r"^(.{10}[T ]\d{2}:\d{2})(?=[Z+-]|$)", "$1:00")
    dashed = F.regexp_replace(dashed, ",", ".")
    return F.when(text.rlike(_DASHED) | text.rlike(_COMPACT), F.try_to_timestamp(dashed))


def iso_format(ts: Column | str) -> Column:
    """Render as 2024-01-31T12:00:00+00:00, with six digits of a second where there are any."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    fraction = F.when(F.unix_micros(ts) % 1000000 == 0, F.lit("")).otherwise(F.date_format(ts, ".SSSSSS"))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def moment(as_of: Column | datetime | str | None) -> Column:
    """The time a job is asked for; the current time if none is given."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def before(as_of: Column, days: int = 0, seconds: float = 0) -> Column:
    return as_of - F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def micros_between(start: Column | str, end: Column | str) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.unix_micros(end) - F.unix_micros(start)
