"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.dates import HIGHEST_DATE, LOWEST_DATE, parse_lenient_date, publish_date
from ledgerloom.functions.text import contains_any, null_if_blank, prefix_int


def _bound(value: str | None, otherwise: str) -> Column:
    return F.coalesce(parse_lenient_date(F.lit(value)), F.to_date(F.lit(otherwise)))


def filter_date_range(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows whose date lies between two days, both included; bounds that can't be read are far away."""
    return df.filter(parse_lenient_date(column).between(_bound(start, LOWEST_DATE), _bound(end, HIGHEST_DATE)))


def filter_blocked_or_range(df: DataFrame, start: str | None, end: str | None, followed: str = "followed_at", blocked: str = "is_blocked") -> DataFrame:
    """Rows that are blocked (1) or whose date lies in the range."""
    in_range = F.coalesce(parse_lenient_date(followed).between(_bound(start, LOWEST_DATE), _bound(end, HIGHEST_DATE)), F.lit(False))
    return df.filter(in_range | (prefix_int(F.col(blocked).cast("string")) == 1))


def exclude_names(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows whose name, without ASCII white space, has none of the terms in it; names that are null stay."""
    name = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", "")
    return df.filter(~contains_any(name, terms))


def first_month(year: int) -> int:
    """The first month that reports of a year count: May before 2026."""
    return 1 if year >= 2026 else 5


def filter_year_month(df: DataFrame, ts: str, year: int, min_month: int | None = None) -> DataFrame:
    least = first_month(year) if min_month is None else min_month
    return df.filter((F.year(ts) == year) & (F.month(ts) >= least))


def filter_since(df: DataFrame, date: str, since: str) -> DataFrame:
    """By the order of strings, not of dates."""
    return df.filter(F.col(date) >= since)


def drop_header_echo(df: DataFrame, key: str = "id", labels: dict[str, str] | None = None) -> DataFrame:
    """Without rows that repeat the header: an id that reads 'id' in any case, or a column that holds its own label."""
    echo = F.coalesce(F.lower(F.trim(key)) == "id", F.lit(False))
    for column, label in (labels or {}).items():
        echo = echo | F.coalesce(F.trim(column) == label, F.lit(False))
    return df.filter(~echo)


def unread_mentions(df: DataFrame, channel_id: Column | None = None) -> DataFrame:
    """Mentions that are known to be unread and, where a channel id is given, have one."""
    unread = F.col("is_read").eqNullSafe(F.lit(False))
    return df.filter(unread if channel_id is None else unread & channel_id.isNotNull())


def public_only(df: DataFrame, status: str = "privacy_status") -> DataFrame:
    return df.filter(F.col(status) == "public")


def project_video(df: DataFrame, watch: str, analytics: str) -> DataFrame:
    """id, title, addresses to watch and analyse, day of publishing, and counts, 0 where missing."""
    count = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    urls = [F.concat(F.lit(base), "id").alias(name) for base, name in ((watch, "watch_url"), (analytics, "analytics_url"))]
    return df.select("id", "title", *urls, publish_date("published_at").alias("published_on"), count("view_count"), count("like_count"))


def filter_time_window(df: DataFrame, ts: str, start: Column, stop: Column) -> DataFrame:
    return df.filter(F.col(ts).between(start, stop))


def project_inflow(df: DataFrame) -> DataFrame:
    """The day of following, cut from the merged time, and false for missing flags."""
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("v1", "v2", "v3", "v4") if c in df.columns]
    rest = [c for c in df.columns if c not in ("date", "v1", "v2", "v3", "v4")]
    return df.select(*rest, F.substring(F.col("followed_at").cast("string"), 1, 10).alias("date"), *flags)


def project_student(df: DataFrame) -> DataFrame:
    """Student rows with the first filled of the alternative fields; fields that df lacks count as null."""
    first = lambda *names: F.coalesce(F.lit(None).cast("string"), *(null_if_blank(c) for n in names if (c := _field(df, n)) is not None))
    plain = lambda name: F.coalesce(F.lit(None).cast("string"), *([c] if (c := _field(df, name)) is not None else [])).alias(name)
    return df.select(
        first("id", "user_id", "uid").alias("id"),
        plain("name"),
        plain("email"),
        first("course_name", "learning_course_name", "learning_course.name").alias("course_name"),
        first("course_start_at", "learning_course.start_at").alias("course_start_at"),
        F.coalesce(first("motivation", "learning_course.motivation", "course.motivation"), F.lit("")).alias("motivation"),
    )


def _field(df: DataFrame, name: str) -> Column | None:
    """A field as a string by its path; None where the schema has no such path or it leads to a struct, list or map."""
    kind = df.schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return None if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.col(name).cast("string")


LANDING_FIELDS = ["landing_name", "landing", "landing_source", "from", "landing.name", "utm.source"]


def coalesce_landing(df: DataFrame, only_null: bool = False, fields: list[str] | None = None) -> DataFrame:
    """landing_name from the first filled field, else ''. With only_null, an empty landing_name stays as it is.

    Fields that df lacks are passed over, and so is a `landing` that is a struct, of which only the name counts."""
    found = F.coalesce(*(null_if_blank(c) for n in fields or LANDING_FIELDS if (c := _field(df, n)) is not None), F.lit(""))
    own = _field(df, "landing_name")
    name = F.coalesce(own, found) if only_null and own is not None else found
    return df.withColumn("landing_name", name)


def highlight_flags(df: DataFrame, today: Column, mentions_a: str = "mentions_a", mentions_b: str = "mentions_b") -> DataFrame:
    """report_today, has_mention_a and has_mention_b."""
    return df.withColumns({
        "report_today": F.coalesce(F.col("report_date") == today, F.lit(False)),
        "has_mention_a": F.coalesce(F.col(mentions_a) > 0, F.lit(False)),
        "has_mention_b": F.coalesce(F.col(mentions_b) > 0, F.lit(False)),
    })


def highlight_count(df: DataFrame) -> DataFrame:
    """How many rows of highlight_flags() report today."""
    return df.agg(F.count_if("report_today").alias("n"))
