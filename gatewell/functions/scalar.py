"""Scalar functions: local time, calendar keys, shares and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewell.sources.adapters import ZONE


def utc_time(day: Column, code: Column) -> Column:
    """The UTC time of a date and an HHMMSS code, without a zone."""
    code = F.lpad(code, 6, "0")
    part = lambda i: F.substring(code, i, 2).cast("int")
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), part(1), part(3), part(5))


def local_time(day: Column, code: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_time(day, code))


def day_index(day: Column, start: Column, days: Column) -> Column:
    """Days since the start, held within the axis."""
    return F.least(F.greatest(F.datediff(day, start), F.lit(0)), days - 1)


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def daypart(hour: Column) -> Column:
    return F.when(hour.between(0, 5), "night").when(hour.between(6, 11), "morning").when(hour.between(12, 17), "afternoon").otherwise("evening")


def format_share(num: Column, den: Column, decimals: int = 2) -> Column:
    """num / den as a percentage with so many decimals (none to 9), rounded half up, in integers alone; null if den is 0."""
    unit = 10**decimals
    top, twice = num.cast("decimal(20,0)") * (200 * unit) + den.cast("decimal(20,0)"), den.cast("decimal(20,0)") * 2
    scaled = F.when(den != 0, F.call_function("div", top, twice)).cast("long")
    whole = F.call_function("div", scaled, F.lit(unit)).cast("string")
    return F.concat(whole, *([F.lit("."), F.lpad((scaled % unit).cast("string"), decimals, "0")] if decimals else []), F.lit("%"))


def entity_key(salt: str, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, 20)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(a))
