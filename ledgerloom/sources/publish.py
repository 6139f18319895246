"""Reports and messages as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_COLUMNS = ["id", "name", "email", "last_sign_in_at", "course_name", "course_start_at", "course_progress", "status"]
CSV_OPTIONS = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_partitioned_csv(df: DataFrame, path: str, by: str = "motivation", order: list[str] | None = None, unknown: str = "unknown") -> None:
    """The fixed columns, in a folder `group=<group>` for each group under by_<by>, and in one for all under all.

    With an order of groups, whatever isn't one of them is unknown, and groups without rows get a file of headers alone.
    Columns that df lacks are empty. Groups are trimmed; blank ones are unknown.
    """
    name = F.coalesce(F.nullif(F.trim(by), F.lit("")), F.lit(unknown))
    group = name if order is None else F.when(name.isin(order), name).otherwise(F.lit(unknown))
    fixed = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in CSV_COLUMNS]
    rows = df.select(group.alias("group"), *fixed)
    rows.write.mode("overwrite").partitionBy("group").options(**CSV_OPTIONS).csv(f"{path}/by_{by}")
    if order is not None:
        here = {r[0] for r in rows.select("group").distinct().collect()}  # as many as the order has, and unknown
        nothing = rows.sparkSession.createDataFrame([], rows.drop("group").schema)
        for missing in [g for g in [*order, unknown] if g not in here]:
            nothing.write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{path}/by_{by}/group={missing}")
    rows.drop("group").write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{path}/all")


def copy_table(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a report; an empty one changes nothing. Tells whether it was copied."""
    report = spark.read.parquet(source)
    if report.isEmpty():
        return False
    report.write.mode("overwrite").parquet(target)
    return True


def outbox(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Messages (recipient, text, ...) with their mode, a broadcast without a recipient, and their number in order of seq."""
    mode = F.when(F.coalesce(F.trim("recipient"), F.lit("")) == "", F.lit("broadcast")).otherwise(F.lit("push"))
    return df.select("recipient", mode.alias("mode"), F.col(seq).alias("seq"), "text")


def write_outbox(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Append messages; those of a numbered batch take the place of what an earlier try of that batch wrote."""
    if batch is None:
        outbox(df).write.mode("append").parquet(path)
    else:
        outbox(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(path)
