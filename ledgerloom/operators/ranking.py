"""First rows, newest rows and report orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import null_if_blank
from ledgerloom.workspace import new_path

LEAST_VIDEOS, MOST_VIDEOS, USUAL_VIDEOS, COMMENTS = 1, 100, 50, 20
OLDEST = "1900-01-01"


def first_row_per_key(df: DataFrame, key: str, seq: str = "_seq") -> DataFrame:
    """One shuffle of at most a row for each key and task: the first row is a minimum of structs."""
    rest = [c for c in df.columns if c not in (key, seq)]
    first = df.groupBy(key).agg(F.min_by(F.struct(seq, *rest), seq).alias("r"))
    return first.select(key, "r.*").select(df.columns)


def top_n_recent(df: DataFrame, part: str, ts: str, key: str, n: int = USUAL_VIDEOS) -> DataFrame:
    """The newest n public rows of each part, n between 1 and 100; ties go to the smaller key."""
    n = min(max(n, LEAST_VIDEOS), MOST_VIDEOS)
    newest = Window.partitionBy(part).orderBy(F.desc(ts), F.asc(key))
    return df.filter("privacy_status = 'public'").withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def first_n_list(videos: DataFrame, comments: DataFrame, key: str = "video_id", n: int = COMMENTS) -> DataFrame:
    """Videos with the array of their first n comments that aren't blank; without comments the array is empty."""
    text = F.coalesce(null_if_blank("text_display"), null_if_blank("text_original"))
    first = comments.withColumn("comment", text).filter("comment is not null")
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("rank") <= n)
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "comment"))).alias("c"))
    lists = lists.select(key, F.transform("c", lambda c: c["comment"]).alias("comments"))
    return videos.join(lists, key, "left").withColumn("comments", F.coalesce("comments", F.array().cast("array<string>")))


def latest_login(df: DataFrame, key: str = "user_id", ts: str = "created_at") -> DataFrame:
    return df.groupBy(key).agg(F.max(ts).alias("latest_login_at"))


def inflow_order() -> list[Column]:
    return [F.desc_nulls_last("followed_at"), F.desc("uid")]


def students_order() -> list[Column]:
    return [F.desc(F.coalesce("course_join_date", F.to_date(F.lit(OLDEST)))), F.asc("id")]


def unread_order(key: str = "id", ts: str = "created_at") -> list[Column]:
    """Oldest first, those without a time before all; ties by the key."""
    return [F.asc_nulls_first(ts), F.asc(key)]


def sort_inflow(df: DataFrame) -> DataFrame:
    return df.orderBy(*inflow_order())


def sort_students(df: DataFrame) -> DataFrame:
    return df.orderBy(*students_order())


def sort_unread(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(*unread_order(key))


def numbered(df: DataFrame, *order: Column, name: str = "_seq", path: str | None = None) -> DataFrame:
    """df with the place of each row, from 0, in an order over all rows; of equal ones either may come first.

    Rows are dealt to ranges of the order and sorted in them, which is written once (to path, else into the shared folder), and
    each gets its place in its range and the number of rows in the ranges before. The driver adds up one count for each
    shuffle partition, which is all that is collected and broadcast. An order read from a table again is no order; this one is a column.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "numbered")
    ranges = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranges.withColumn(name, F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path).withColumn("_range", F.shiftright(name, 33))
    before, starts = 0, []
    for r in sorted(rows.groupBy("_range").count().collect()):
        starts.append((r[0], before))
        before += r[1]
    starts = spark.createDataFrame(starts, "_range long, _start long")
    at = F.col("_start") + F.col(name).bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), "_range").withColumn(name, at).drop("_range", "_start")
