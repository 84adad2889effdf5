"""Dates and times; the session's time zone should be UTC."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions import column

#: Directives of strptime as patterns of Spark.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%B": "MMMM", "%b": "MMM", "%I": "hh", "%p": "a", "%f": "SSSSSS", "%A": "EEEE", "%Z": "z"}
#: Formats that are tried one after the other: fixed values.
FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%d-%m-%Y %H:%M:%S", "%m/%d/%y %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d-%m-%Y", "%m/%d/%y"]
#: Zones of abbreviations: fixed values.
ZONES = {"IST": "Asia/Kolkata", "PST": "America/Los_Angeles", "EST": "America/New_York", "CST": "America/Chicago", "MST": "America/Denver", "JST": "Asia/Tokyo", "CET": "Europe/Berlin", "EET": "Europe/Istanbul", "BST": "Europe/London", "AEDT": "Australia/Sydney", "ACST": "Australia/Adelaide"}
DAY = 86_400


def pattern(fmt: str) -> str:
    """A strptime format as a Spark pattern."""
    for a, b in DIRECTIVES.items():
        fmt = fmt.replace(a, b)
    return fmt.replace("T", "'T'") if "'T'" not in fmt else fmt


@column
def date2ts(c, fmt="%Y-%m-%d", millis=False):
    t = F.try_to_timestamp(c, F.lit(pattern(fmt)))
    return F.unix_millis(t) if millis else F.unix_seconds(t)


@column
def ts2datetime(c, fmt="%Y-%m-%d %H:%M:%S"):
    return F.coalesce(F.date_format(F.timestamp_seconds(c), pattern(fmt)), F.lit(""))


@column
def millis2datetime(c, fmt="%Y-%m-%d %H:%M:%S"):
    return F.coalesce(F.date_format(F.timestamp_millis(c.cast("long")), pattern(fmt)), F.lit(""))


def current_ts(millis=False):
    return F.unix_millis(F.current_timestamp()) if millis else F.unix_seconds(F.current_timestamp())


def current_date(fmt="%Y-%m-%d"):
    return F.date_format(F.current_timestamp(), pattern(fmt))


def current_time(fmt="%Y-%m-%d %H:%M:%S"):
    return F.date_format(F.current_timestamp(), pattern(fmt))


@column
def obj2ts(c, millis=False):
    t = c.cast("timestamp")
    return F.unix_millis(t) if millis else F.unix_seconds(t)


@column
def is_leap_year(year):
    return ((year % 400 == 0) | ((year % 4 == 0) & (year % 100 != 0))).cast("int")


@column
def month_days(year, month):
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


@column
def expand_date_range(c):
    """A year, month or day as [start, end) in epoch seconds; null for anything else."""
    parts = F.filter(F.split(c, "[年月日-]+", 4), lambda p: F.length(p) > 0)
    y, m, d = (F.get(parts, F.lit(k)).try_cast("int") for k in range(3))
    n = F.size(parts)
    start = F.try_make_timestamp(y, F.when(n > 1, m).otherwise(1), F.when(n > 2, d).otherwise(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    end = F.when(n == 1, F.add_months(start, 12)).when(n == 2, F.add_months(start, 1)).when(n == 3, F.date_add(start, 1))
    return F.when(start.isNotNull() & (n <= 3), F.struct(F.unix_seconds(start).alias("start"), F.unix_seconds(end.cast("timestamp")).alias("end")))


@column
def fill_date(first, second=None):
    """The range of one date, or from the start of the first to the end of the second."""
    a = expand_date_range(first)
    if second is None:
        return a
    b = F.when(second.isNull(), a).otherwise(expand_date_range(second))
    return F.struct(a["start"].alias("start"), b["end"].alias("end"))


@column
def normalize_isotime(c):
    """ISO 8601 to epoch milliseconds."""
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    return F.when(iso, F.unix_millis(c.try_cast("timestamp")))


@column
def custom_datetime_to_timestamp(c, fmt):
    return F.unix_millis(F.try_to_timestamp(c, F.lit(pattern(fmt))))


@column
def native_datetime_to_timestamp(c, fmt="%B %d, %Y %I:%M:%S %p %Z", tz_name=None):
    """A local time with a zone's abbreviation (or a zone given) to epoch milliseconds."""
    local = F.try_to_timestamp(F.regexp_replace(c, r"\s+\S+$", "") if "%Z" in fmt else c, F.lit(pattern(fmt.replace(" %Z", "")).replace("MMMM dd", "MMMM d").replace("hh", "h")))
    zone = F.lit(tz_name) if tz_name else F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.regexp_extract(c, r"(\S+)$", 1))
    return F.unix_millis(F.to_utc_timestamp(local, zone))


@column
def normalize_time(c):
    """ISO first, then each of FORMATS; null where there is no - or / or none fits."""
    tries = [normalize_isotime(c), *(F.when(c.rlike(_shape(f)), F.unix_millis(F.try_to_timestamp(c, F.lit(pattern(f))))) for f in FORMATS)]
    return F.when(c.rlike("[-/]"), F.coalesce(*tries))


def _shape(fmt: str) -> str:
    out = fmt
    for a, b in (("%Y", r"\d{4}"), ("%y", r"\d{2}"), ("%m", r"\d{2}"), ("%d", r"\d{2}"), ("%H", r"\d{2}"), ("%M", r"\d{2}"), ("%S", r"\d{2}")):
        out = out.replace(a, b)
    return f"^{out}$"


#: An instant is the same in every zone, so these have other names alone.
custom_datetime_to_beijing_timestamp = custom_datetime_to_timestamp
native_datetime_to_beijing_timestamp = native_datetime_to_timestamp
