"""Date and time functions.  Session time zone is UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loamframe import codes


_ZONE = r"(Z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
_CLOCK = r"(?:(?:T|,? +)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AP]M))?)? ?" + _ZONE
_MONTH = "((?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*)[.]?"
_WEEKDAY = "(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*[.]?,? +)?"
#: Whole texts in upper case; three groups for the date, then hour, minute, second, fraction, half of the day, zone.
_COMPACT = r"^(\d{4})(\d{2})(\d{2})" + _CLOCK + "$"
_COMPACT_CLOCK = r"^(\d{4})(\d{2})(\d{2})[T_ -]?(\d{2})(\d{2})(\d{2})(?:[.](\d{1,9}))?()" + _ZONE + "$"
_YEAR_FIRST = r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})" + _CLOCK + "$"
_YEAR_LAST = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})" + _CLOCK + "$"
_DAY_ABOVE_12 = r"^(1[3-9]|[23]\d)[/.-](\d{1,2})[/.-](\d{4})" + _CLOCK + "$"
_MONTH_FIRST = "^" + _WEEKDAY + _MONTH + r" +(\d{1,2})(?:ST|ND|RD|TH)?,? +(\d{4})" + _CLOCK + "$"
_DAY_FIRST = "^" + _WEEKDAY + r"(\d{1,2})(?:ST|ND|RD|TH)?[ -]+" + _MONTH + r"[ ,-]+(\d{4})" + _CLOCK + "$"


def _moment(f: Column) -> Column:
    """Timestamp of the fields year, month, day, hour, minute, second, fraction, half of the day, zone; empty ones left out."""
    part = lambda k: F.nullif(F.get(f, F.lit(k)), F.lit(""))
    number = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
    named = (F.position(F.substring(part(1), 1, 3), F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC")) + 2) / 3
    month = F.coalesce(part(1).try_cast("int"), named.cast("int"))
    hour = F.when(part(7).isNull(), number(3)).otherwise(number(3) % 12 + F.when(part(7) == "PM", F.lit(12)).otherwise(F.lit(0)))
    zone = F.coalesce(F.regexp_replace(part(8), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2"), F.lit("Z"))
    zone = F.when(zone.isin("UTC", "GMT"), F.lit("Z")).when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
    iso = F.format_string("%s-%02d-%02dT%02d:%02d:%02d.%s%s", part(0), month, number(2), hour, number(4), number(5), F.substring(F.coalesce(part(6), F.lit("0")), 1, 6), zone)
    return F.try_to_timestamp(iso)


def to_utc(text: Column) -> Column:
    """Date or timestamp text → UTC timestamp; unreadable text → NULL.

    Besides ISO forms: 20200605, 20200605T101500, 2020/6/5, 6/5/2020 (month first, unless only the day can be first),
    June 5 2020, 5 Jun 2020, with a weekday before and a time of day behind.  The whole text has to be one of these.
    A zone in the text is honoured; text without one is taken as UTC.
    """
    plain = F.trim(text)
    upper = F.upper(plain)
    rest = "|$4|$5|$6|$7|$8|$9"
    forms = [(_COMPACT, "$1|$2|$3"), (_COMPACT_CLOCK, "$1|$2|$3"), (_YEAR_FIRST, "$1|$2|$3"), (_DAY_ABOVE_12, "$3|$2|$1"), (_YEAR_LAST, "$3|$1|$2"),
             (_MONTH_FIRST, "$3|$1|$2"), (_DAY_FIRST, "$3|$2|$1")]
    fields = F.coalesce(*[F.when(upper.rlike(pattern), F.regexp_replace(upper, pattern, date + rest)) for pattern, date in forms])
    # a lambda's variable is worked out once
    written = F.transform(F.array(F.split(fields, "[|]")), _moment)[0]
    return F.coalesce(F.try_to_timestamp(plain), written)


def datetime_from_name(name: Column) -> Column:
    """Moment written in a file name: date with time, else date, else a year."""
    stamp = F.regexp_replace(F.regexp_extract(name, r"(\d{8}[_T-]?\d{6})", 1), "[_T-]", "")
    day = F.regexp_extract(name, r"(\d{8})", 1)
    year = F.regexp_extract(name, r"((?:19|20)\d{2})(?!\d)", 1)
    return F.coalesce(
        F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMddHHmmss")),
        F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyyMMdd")),
        F.try_to_timestamp(F.nullif(year, F.lit("")), F.lit("yyyy")),
    )


def datetime_from_map(properties: Column, name: Column | None = None) -> Column:
    """Moment of an item: a known key, else any readable value, else its name, else the default."""
    known = codes.COLUMN_ALIASES["datetime"] + ["datetime"]
    entries = F.map_entries(properties)
    parsed = F.transform(
        entries,
        lambda e: F.struct(
            F.lower(e["key"]).isin(known).alias("known"), to_utc(e["value"]).alias("moment")
        ),
    )
    named = F.filter(parsed, lambda e: e["known"] & e["moment"].isNotNull())
    any_value = F.filter(parsed, lambda e: e["moment"].isNotNull())
    choices = [F.get(named, F.lit(0))["moment"], F.get(any_value, F.lit(0))["moment"]]
    if name is not None:
        choices.append(datetime_from_name(name))
    return F.coalesce(*choices, F.lit(codes.DEFAULT_DATETIME).cast("timestamp"))


def station_time(raw: Column, collection: Column) -> Column:
    """Daily collections keep the date part; the real-time one keeps the text."""
    return F.when(collection == "swob-realtime", raw).otherwise(F.substring(raw, 1, 10))


def interval_bounds(collection: Column, start: Column, end: Column) -> Column:
    """Closed request interval; the real-time collection runs to the last second of the day."""
    realtime = collection == "swob-realtime"
    return F.struct(
        F.when(realtime, F.concat(start, F.lit("T00:00:00Z"))).otherwise(start).alias("start"),
        F.when(realtime, F.concat(end, F.lit("T23:59:59Z"))).otherwise(end).alias("end"),
    )


def image_id(day: Column) -> Column:
    """``YYYY_MMdd`` id of an acquisition."""
    return F.date_format(day, "yyyy_MMdd")
