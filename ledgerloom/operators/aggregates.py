"""Counts, rates and totals of the reports. Dense results come from a spine joined to one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import MARK, null_if_blank, normalize_code, normalize_name
from ledgerloom.operators.filters import exclude_names, filter_year_month

NO_CHANNEL = "チャンネル不明"


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def filled(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) != ""


def rate(hits: Column, of: Column) -> Column:
    """Per cent to one decimal, null for none."""
    return F.round(F.try_divide(hits, of) * 100, 1)


def month_spine(spark: SparkSession) -> DataFrame:
    return spark.range(1, 13).select(F.col("id").cast("int").alias("month"))


def dense_on_empty(df: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the spine with the counts of df, 0 where it has none."""
    counts = [c for c in df.columns if c not in keys]
    return spine.join(df, keys, "left").select(*keys, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts))


def by_month(df: DataFrame, ts: str, **counts: Column) -> DataFrame:
    """Twelve months with some counts, in one aggregate."""
    found = df.groupBy(F.month(ts).alias("month")).agg(*(c.alias(n) for n, c in counts.items()))
    return dense_on_empty(found, month_spine(df.sparkSession), ["month"])


def latest_per_key(df: DataFrame, key: str, times: list[str], name: str = "name", seq: str = "_seq") -> DataFrame:
    """Of each key the latest of the first filled time field, and the last name that isn't null."""
    return df.groupBy(key).agg(F.max(F.coalesce(*times)).alias("blocked_at"), F.max_by(name, F.when(F.col(name).isNotNull(), F.col(seq))).alias(name))


def merge_by_user(df: DataFrame) -> DataFrame:
    """One row for each uid above 0 of (_seq, uid, name, view_name, followed_at, blocked_at, is_blocked, landing, link).

    Latest times, highest flag, first landing and link that aren't blank. A name alone stays; of several rows the first
    filled one of: first name, second name, first view name, second view name, third name, third view name, and so on.
    Tasks send on one partial row and the two first rows of a uid, however many it has.
    """
    rows = df.filter("uid > 0")
    first = lambda c: F.min_by(c, F.when(null_if_blank(c).isNotNull(), F.col("_seq"))).alias(c)
    own = F.coalesce(null_if_blank("name"), null_if_blank("view_name"))
    out = rows.groupBy("uid").agg(
        F.max("followed_at").alias("followed_at"), F.max("blocked_at").alias("blocked_at"), F.max("is_blocked").alias("is_blocked"),
        first("landing"), first("link"), F.count("*").alias("n"), F.min_by("name", "_seq").alias("own"), F.min_by(own, F.when(own.isNotNull(), F.col("_seq"))).alias("any"),
    )
    place = F.row_number().over(Window.partitionBy("uid").orderBy("_seq"))
    two = rows.select("uid", "_seq", "name", "view_name").withColumn("place", place).filter("place <= 2")
    at = lambda c, k: F.max(F.when(F.col("place") == k, null_if_blank(c)))
    two = two.groupBy("uid").agg(F.coalesce(at("name", 1), at("name", 2), at("view_name", 1), at("view_name", 2)).alias("early"))
    # a filled name of the first two rows comes before all others; without one the first filled is the one that is due
    name = F.when(F.col("n") == 1, F.col("own")).otherwise(F.coalesce("early", "any"))
    return out.join(two, "uid").select("uid", name.alias("name"), "followed_at", "blocked_at", "is_blocked", "landing", "link")


def monthly_counts(df: DataFrame, ts: str, year: int, min_month: int | None = None) -> DataFrame:
    return by_month(filter_year_month(df, ts, year, min_month), ts, n=F.count("*"))


def year_total(df: DataFrame, ts: str, year: int, name: str, excluded: list[str], min_month: int | None = None) -> DataFrame:
    return exclude_names(filter_year_month(df, ts, year, min_month), name, excluded).agg(F.count("*").alias("n"))


def tag_totals(df: DataFrame, tags: list[str], mark: str = MARK) -> DataFrame:
    """For each tag column: rows whose cell contains the mark, and their share in per cent."""
    counts = df.agg(F.count("*").alias("all"), *(count_if(F.contains(F.col(t), F.lit(mark))).alias(t) for t in tags))
    long = counts.unpivot(["all"], tags, "tag", "n")
    return long.select("tag", "n", rate(F.col("n"), F.col("all")).alias("pct"))


def tag_monthlies(df: DataFrame, ts: str, tags: list[str], mark: str = MARK) -> DataFrame:
    return by_month(df, ts, **{t: count_if(F.contains(F.col(t), F.lit(mark))) for t in tags})


def attendance_by_event_month(long: DataFrame, mark: str = MARK, min_month: int = 5) -> DataFrame:
    """Cells of long rows (header, cell) that equal the mark, white space at the ends aside, by the month M of headers 'M/D参加'; months before min_month stay 0."""
    month = F.regexp_extract("header", r"^(\d{1,2})/\d{1,2}参加$", 1).try_cast("int")
    hits = long.filter(F.regexp_replace("cell", r"^[\s\x00]+|[\s\x00]+$", "") == mark).withColumn("month", month).filter(F.col("month") >= min_month)
    return dense_on_empty(hits.groupBy("month").agg(F.count("*").alias("n")), month_spine(long.sparkSession), ["month"])


def nonblank_monthlies(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    return by_month(df, ts, **{c: count_if(filled(c)) for c in columns})


def keyword_counts(df: DataFrame, ts: str, column: str, keywords: dict[str, str]) -> DataFrame:
    """For each month and name the rows whose column contains the name's keyword; a row may count for several."""
    return by_month(df, ts, **{n: count_if(F.contains(F.col(column), F.lit(k))) for n, k in keywords.items()})


def attributed_contracts(df: DataFrame, ts: str, source: str, contract: str, a: str, b: str, daily: str, short: str, overview: str, top: str) -> DataFrame:
    """Contracts by month and source: a; b; b every day, or b and not short; top; overview if it isn't top."""
    has = lambda word: F.contains(F.coalesce(source, F.lit("")), F.lit(word))
    signed = df.filter(filled(contract))
    return by_month(signed, ts, from_a=count_if(has(a)), from_b=count_if(has(b)), from_b_long=count_if(has(b + daily) | (has(b) & ~has(short))), from_top=count_if(has(f"{overview} {top}")), from_overview=count_if(has(overview) & ~has(f"{overview} {top}")))


def cooccurrence_monthlies(df: DataFrame, ts: str, a: str, b: str) -> DataFrame:
    return by_month(df, ts, n=count_if(filled(a) & filled(b)))


def conversion_rates(df: DataFrame, month: str, since: str, flags: list[str], date: str = "date") -> DataFrame:
    """Shares of rows (date as text, flags) with each flag in a month (yyyy-MM), the one before, and all since a day."""
    before = F.date_format(F.add_months(F.to_date(F.lit(f"{month}-01")), -1), "yyyy-MM")
    periods = {"month": F.substring(date, 1, 7) == month, "previous": F.substring(date, 1, 7) == before, "since": F.col(date) >= since}
    counts = [count_if(when & F.col(f) if f else when).alias(f"{p}_{f}") for p, when in periods.items() for f in ["", *flags]]
    row = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.lit(f).alias("flag"), rate(F.col(f"{p}_{f}"), F.col(f"{p}_")).alias("pct")) for p in periods for f in flags)))
    return df.agg(*counts).select(row.alias("r")).select("r.*")


def event_conversion(events: DataFrame, dates: DataFrame, since: str, until: str) -> DataFrame:
    """For each date: people who hoped and came, of those who hoped, and the rate; dates outside of the range stay as nulls."""
    inside = events.filter(F.col("date").between(F.to_date(F.lit(since)), F.to_date(F.lit(until))))
    found = inside.groupBy("date").agg(count_if(F.col("hope")).alias("hoped"), count_if(F.col("hope") & F.col("attend")).alias("came"))
    return dates.join(found, "date", "left").withColumn("pct", rate(F.col("came"), F.col("hoped")))


def mention_counts(df: DataFrame, key: Column, name: str, channel: str = "channel", label: str = NO_CHANNEL) -> DataFrame:
    """Rows by key and channel, a channel without a name under the label."""
    return df.filter(key.isNotNull()).groupBy(key.alias(name), F.coalesce(null_if_blank(channel), F.lit(label)).alias("channel")).agg(F.count("*").alias("n"), F.min("_seq").alias("_seq"))


def mention_counts_by_name(df: DataFrame, sender: str = "user_name") -> DataFrame:
    name = normalize_name(sender)
    return mention_counts(df, F.when(name != "", name), "name")


def channel_label(counts: DataFrame, key: str) -> DataFrame:
    """Counts by channel (key, channel, n, _seq) as one text: '<channel>より<n>件', in order of appearance."""
    merged = counts.groupBy(key, "channel").agg(F.sum("n").alias("n"), F.min("_seq").alias("_seq"))
    part = F.concat("channel", F.lit("より"), F.col("n").cast("string"), F.lit("件"))
    lists = merged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_seq", part.alias("part")))).alias("p"))
    return lists.select(key, F.array_join(F.transform("p", lambda p: p["part"]), " / ").alias("label"))


def group_by_status(df: DataFrame, column: str, order: list[str], unknown: str = "unknown") -> DataFrame:
    """Sizes of the status groups in the given order, unknown last; groups without rows are 0."""
    code = normalize_code(column)
    sizes = df.groupBy(F.when(code.isin(order), code).otherwise(F.lit(unknown)).alias("status")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.createDataFrame([(k, s) for k, s in enumerate([*order, unknown])], "place int, status string")
    return spine.join(sizes, "status", "left").select("place", "status", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def first_seen_order(df: DataFrame, column: str, seq: str = "_seq") -> DataFrame:
    return df.filter(filled(column)).groupBy(column).agg(F.min(seq).alias("first_seq"))


def last_wins_dim(df: DataFrame, key: str, value: str, seq: str = "_seq") -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, seq).alias(value))


def row_totals(df: DataFrame, columns: list[str], out: str = "total") -> DataFrame:
    """df with the sum of some columns; those that it doesn't have count as 0."""
    have = [F.coalesce(c, F.lit(0)) for c in columns if c in df.columns]
    return df.withColumn(out, sum(have, F.lit(0)).cast("bigint"))


def column_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))


def month_share(df: DataFrame, num: str, den: str, out: str = "share") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.try_divide(num, den), F.lit(0.0)))


def daily_average(df: DataFrame, year: int, today: Column, n: str = "n") -> DataFrame:
    """Months (month, n) with n for each day: of the month, or of what has passed of the current one."""
    start = F.make_date(F.lit(year), F.col("month"), F.lit(1))
    days = F.when(F.trunc(today, "MM") == start, F.day(today)).otherwise(F.day(F.last_day(start)))
    return df.withColumn("per_day", F.coalesce(F.try_divide(n, days), F.lit(0.0)))


def funnel(totals: DataFrame, steps: list[str], attended: str, total: str) -> DataFrame:
    """One row of totals as step ratios: each step to the one before, attendance to the last step (0 for none), and all to the grand total."""
    pairs = [(f"{b}_of_{a}", F.try_divide(b, a)) for a, b in zip(steps, steps[1:])]
    pairs.append((f"{attended}_of_{steps[-1]}", F.coalesce(F.try_divide(attended, steps[-1]), F.lit(0.0))))
    pairs += [(f"{s}_of_{total}", F.try_divide(s, total)) for s in [*steps, attended]]
    return totals.select(*(v.alias(n) for n, v in pairs))
