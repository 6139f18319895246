"""Pivots, unpivots and lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import MARK, flag_mark
from ledgerloom.operators.aggregates import first_seen_order

# What follows the day in the headers of the report's event columns.
HOPE, ATTEND = "参加希望", "参加"
MOST_CATEGORIES = 500


def event_labels(day: str) -> tuple[str, str]:
    """Headers of the two columns of an event: who hopes to come, and who came. M/D of days as yyyy-MM-dd, other texts as they are."""
    try:
        date = dt.date.fromisoformat(day)
    except ValueError:
        return f"{day}{HOPE}", f"{day}{ATTEND}"
    return f"{date.month}/{date.day}{HOPE}", f"{date.month}/{date.day}{ATTEND}"


def pivot_events(df: DataFrame, dates: list[str], key: str = "uid", mark: str = MARK) -> DataFrame:
    """Long rows (key, date, hope, attend) as two columns for each of the given dates, a mark or '', under the headers of the report.

    Dates a year apart have the same headers, as they have there; unpivot_report() reads such columns by position."""
    wide = [flag_mark(F.max(F.when(F.col("date") == d, F.col(kind))), mark) for d in dates for kind in ("hope", "attend")]
    out = df.groupBy(key).agg(*(c.alias(f"c{k}") for k, c in enumerate(wide)))
    return out.toDF(key, *(label for d in dates for label in event_labels(d)))


def pivot_schedule(df: DataFrame, categories: list[str] | None = None, key: str = "id", seq: str = "_seq", most: int = MOST_CATEGORIES) -> DataFrame:
    """Long rows (key, category, due) as a column of the latest due date for each of the given categories, or else of those found, in the order of the smallest seq.

    Categories that are found become columns, so no more than `most` are taken; ValueError beyond."""
    if categories is None:
        found = first_seen_order(df, "category", seq).orderBy("first_seq", "category").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} categories")
        categories = [r[0] for r in found]
    if not categories:
        return df.select(key).distinct()
    return df.groupBy(key).pivot("category", categories).agg(F.max("due"))


def spread_list(df: DataFrame, column: str, n: int, prefix: str) -> DataFrame:
    """An array as n columns, null where it is shorter."""
    return df.select(*(c for c in df.columns if c != column), *(F.get(column, F.lit(k)).alias(f"{prefix}{k + 1}") for k in range(n)))


def unpivot_report(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide event columns as rows (keys, header, cell), null cells too; of columns with equal names each."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    cells = [F.struct(F.lit(name).alias("header"), F.col(f"c{k}").alias("cell")) for k, name in enumerate(df.columns) if name in columns]
    return plain.select(*(F.col(f"c{df.columns.index(k)}").alias(k) for k in keys), F.inline(F.array(*cells)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """An array column without repeats, the first of each in place."""
    return df.withColumn(column, F.array_distinct(column))
