"""Column functions on dates and times. Times are wall-clock times without a zone, those of Tokyo where an input tells its offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import col

# The layouts that the lenient parser reads, after offset and fractions are cut off, and the form of reports.
LENIENT_LAYOUTS = ["yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d", "yyyy.M.d", "yyyy年M月d日 H時m分", "yyyy年M月d日", "yyyyMMdd"]
REPORT_FORM = "yyyy年M月d日"
LOWEST_DATE, HIGHEST_DATE = "1970-01-01", "2999-01-01"
ZONE = "Asia/Tokyo"


def _try_ntz(c: Column, layout: str) -> Column:
    return F.try_to_timestamp(c, F.lit(layout)).cast("timestamp_ntz")


# a date and a time, with a fraction of a second and an offset or not
WRITTEN = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2} \d{1,2}:\d{1,2}(?::\d{1,2})?)(?:[.,]\d+)?\s*(Z|z|UTC|[+-]\d{2}(?::?\d{2})?)?$"


def _spaced(c) -> Column:
    """With a space before the time; 20240105T101112, with or without seconds, as 2024-01-05 10:11:12."""
    text = F.regexp_replace(F.trim(col(c)), r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(?!\d)", "$1-$2-$3 $4:$5")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?!\d)", "$1-$2-$3 $4:$5:$6")
    return F.regexp_replace(text, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})T", "$1 ")


def _as_written(c) -> Column:
    text = F.regexp_replace(_spaced(c), WRITTEN, "$1")
    return F.coalesce(*(_try_ntz(text, layout) for layout in LENIENT_LAYOUTS))


def parse_lenient(c, zone: str = ZONE) -> Column:
    """A timestamp from any of LENIENT_LAYOUTS, with T or a space before the time; null for anything else.

    A time with an offset, Z or UTC becomes the time of the zone; one without is taken as it is."""
    offset = F.regexp_extract(_spaced(c), WRITTEN, 2)
    digits = F.rpad(F.regexp_replace(offset, "[^0-9]", ""), 4, "0")
    minutes = (digits.substr(1, 2).try_cast("int") * 60 + digits.substr(3, 2).try_cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1)
    utc = _as_written(c) - F.make_dt_interval(mins=F.when(offset.isin("Z", "z", "UTC"), F.lit(0)).otherwise(minutes))
    return F.when(offset != "", F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)).otherwise(_as_written(c))


def parse_lenient_date(c) -> Column:
    """The day as it is written, whatever the offset."""
    return _as_written(c).cast("date")


def _time(c, zone: str | None) -> Column:
    """The time of a string, or of a date or timestamp column; null for what isn't one. The branch is chosen when the plan is made.

    With a zone, times that tell their offset, and timestamps with a zone, are moved to it."""
    kind, text = F.typeof(col(c)), col(c).cast("string")
    plain = col(c).try_cast("timestamp_ntz")
    moved = plain if zone is None else F.convert_timezone(F.current_timezone(), F.lit(zone), plain)
    return F.when(kind == "string", _as_written(text) if zone is None else parse_lenient(text, zone)).when(kind == "timestamp", moved).otherwise(plain)


def parse_follow_time(c) -> Column:
    """Y年M月D日 with or without H時m分 at the start of a string, else what parse_lenient makes of it."""
    day = F.regexp_extract(col(c), r"^\s*(\d{4}年\d{1,2}月\d{1,2}日)", 1)
    clock = F.regexp_extract(col(c), r"^\s*\d{4}年\d{1,2}月\d{1,2}日\s*(\d{1,2}時\d{1,2}分)", 1)
    return F.coalesce(_try_ntz(F.concat(day, F.lit(" "), clock), "yyyy年M月d日 H時m分"), _try_ntz(day, REPORT_FORM), parse_lenient(c))


def parse_report_date(c) -> Column:
    """yy/MM/dd, yyyy/MM/dd and yyyy-MM-dd as 年月日; strings of that form stay; null for all else. Years from 69 on are 19xx."""
    raw = F.trim(col(c))
    century = F.when(raw.substr(1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    date = (
        F.when(raw.rlike(r"^\d{2}/\d{2}/\d{2}$"), F.try_to_date(F.concat(century, raw), "yyyy/MM/dd"))
        .when(raw.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.try_to_date(raw, "yyyy/MM/dd"))
        .when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    )
    return F.coalesce(F.date_format(date, REPORT_FORM), F.when(raw.rlike(r"^\d{4}年\d{1,2}月\d{1,2}日$"), raw))


def month_key(c) -> Column:
    """yyyy-MM of a day as it is written; null for what isn't one."""
    return F.date_format(_time(c, None), "yyyy-MM")


def jp_date(c, zone: str = ZONE) -> Column:
    """年月日 in the zone; '' for null and for what isn't a time."""
    return F.coalesce(F.date_format(_time(c, zone), REPORT_FORM), F.lit(""))


def jp_datetime(c, zone: str = ZONE) -> Column:
    """年月日 HH時mm分 in the zone; '' for null and for what isn't a time."""
    return F.coalesce(F.date_format(_time(c, zone), "yyyy年M月d日 HH時mm分"), F.lit(""))


def publish_date(c) -> Column:
    """The day as it is written; '' for null and for what isn't one."""
    return F.coalesce(F.date_format(_time(c, None), "yyyy-MM-dd"), F.lit(""))


def poll_window(ts) -> Column:
    """What a poll looks back on: two hours, or from 22:00 the day before to 07:00 in the hour from 07:00."""
    day = F.date_trunc("DAY", col(ts)).cast("timestamp_ntz")
    early = F.hour(col(ts)) == 7
    start = F.when(early, day - F.expr("interval 2 hours")).otherwise(col(ts) - F.expr("interval 2 hours"))
    return F.struct(start.alias("from"), F.when(early, day + F.expr("interval 7 hours")).otherwise(col(ts)).alias("to"))


def event_header(c) -> Column:
    """M/D of a date string; the string itself if it isn't one."""
    return F.coalesce(F.date_format(_as_written(c), "M/d"), col(c))
