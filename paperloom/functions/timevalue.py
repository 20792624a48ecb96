"""Time values: struct<start, end, precision, original_text>, half-open intervals in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (pattern, precision), widest shape first; each is tried on the whole text before the next.
SHAPES = (
    (r"(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::\d{2})?(Z|[+-]\d{2}:?\d{2})?", "instant"),
    (r"(\d{4})年(\d{1,2})月(\d{1,2})日\s*(\d{1,2})时(?::?(\d{1,2})分)?", "instant"),
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", "day"),
    (r"(\d{4})年(\d{1,2})月(\d{1,2})日", "day"),
    (r"(\d{4})-(\d{1,2})", "month"),
    (r"(\d{4})年(\d{1,2})月", "month"),
    (r"(\d{4})年", "year"),
    (r"(\d{4})(?!\d|-\d)", "year"),
)


def _offset_minutes(zone: Column) -> Column:
    digits = F.regexp_replace(zone, ":", "")
    minutes = F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")
    return F.when((zone == "") | (zone == "Z"), 0).when(F.substring(digits, 1, 1) == "-", -minutes).otherwise(minutes)


def _moment(y: Column, mo: Column, d: Column, h: Column, mi: Column) -> Column:
    return F.try_make_timestamp(y, mo, d, h, mi, F.lit(0))


def parse_time(text: Column) -> Column:
    """The first shape that occurs decides; an impossible date is unknown."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    result = F.struct(F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.lit("unknown").alias("precision"), F.lit(None).cast("string").alias("original_text"))
    unknown = result
    for shape, precision in reversed(SHAPES):
        part = lambda k, s=shape: F.regexp_extract(raw, s, k).try_cast("int")
        y = part(1)
        if precision == "instant":
            local = _moment(y, part(2), part(3), part(4), F.coalesce(part(5), F.lit(0)))
            zone = F.regexp_extract(raw, shape, 6) if "Z|" in shape else F.lit("")
            start = F.try_add(local, F.make_dt_interval(F.lit(0), F.lit(0), -_offset_minutes(zone)))
            end = F.lit(None).cast("timestamp")
        else:
            month = F.lit(1) if precision == "year" else part(2)
            day = part(3) if precision == "day" else F.lit(1)
            start = _moment(y, month, day, F.lit(0), F.lit(0))
            step = {"day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[precision]
            end = start + F.expr(step)
        found = F.struct(start.alias("start"), end.alias("end"), F.lit(precision).alias("precision"), F.regexp_extract(raw, shape, 0).alias("original_text"))
        result = F.when(raw.rlike(shape), F.when(start.isNull(), unknown).otherwise(found)).otherwise(result)
    return result


def is_valid(precision: Column, start: Column, end: Column) -> Column:
    """Unknown has no bounds; an instant no end; all others end after their start."""
    return (
        F.when(precision == "unknown", start.isNull() & end.isNull())
        .when(precision == "instant", start.isNotNull() & end.isNull())
        .when(precision.isin("day", "month", "year", "range"), F.coalesce(end > start, F.lit(False)))
        .otherwise(F.lit(False))
    )


def bounds_end(precision: Column, start: Column, end: Column) -> Column:
    """The end of the absolute bounds: an instant ends where it starts."""
    return F.when(precision == "instant", start).otherwise(end)


def stored_end(precision: Column, end: Column) -> Column:
    return F.when(precision != "instant", end)


def intersects(precision: Column, start: Column, end: Column, window_from: Column, window_to: Column) -> Column:
    """Half-open intersection; instants by their start, both window edges as [from, to); unknown never."""
    inside = (start >= window_from) & (start < window_to)
    across = (start < window_to) & (F.coalesce(end, start) > window_from)
    return F.coalesce(F.when(precision == "unknown", False).when(precision == "instant", inside).otherwise(across), F.lit(False))


def late_discovery(start: Column, end: Column, discovered: Column) -> Column:
    return F.coalesce(discovered > F.coalesce(end, start + F.expr("INTERVAL 1 DAY")), F.lit(False))
