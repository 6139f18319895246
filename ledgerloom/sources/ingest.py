"""Landed files and pages as tables with an order of arrival."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.dates import parse_report_date, poll_window
from ledgerloom.functions.text import null_if_blank

# Where list answers keep their rows; "$" is the root itself.
LIST_PATHS = ["$.data", "$.result", "$.items", "$.list"]
MEMBER_PATHS = ["$.users", "$.data", "$.records"]
LOGIN_PATHS = ["$.data", "$.logins", "$.records"]
NESTED_PATHS = ["$.data.data"]
PAGE_ROWS = 1 << 32


def read_envelope(spark: SparkSession, path: str, paths: list[str] | None = None) -> DataFrame:
    """Rows (source, pos, row variant) of JSON answers, a file each: the first of some paths that holds a list, or the root. Bad JSON has no rows."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.try_parse_json("value").alias("page"))
    rows = F.coalesce(*(F.try_variant_get("page", p, "array<variant>") for p in [*(paths or LIST_PATHS), "$"]))
    return pages.select("source", F.posexplode(rows).alias("pos", "row"))


def concat_pages(df: DataFrame, page: str = "page", last_page: Column | None = None, pos: str = "pos", feed: str | None = None, first: int = 1) -> DataFrame:
    """Rows of pages from the first one up to the last, or up to the first page without rows, with _seq, their order over all pages.

    Each feed has pages of its own, if a column of feeds is given; rows without one are a feed, too. A feed without its first
    page has no rows. Only a row for each page and task is shuffled before the rows are joined to the ends of their feeds.
    """
    key = feed or "_feed"
    alike = lambda a, b: a[key].eqNullSafe(b[key])
    kept = df.filter(F.col(page) >= first) if last_page is None else df.filter((F.col(page) >= first) & (F.col(page) <= last_page))
    kept = kept if feed else kept.withColumn(key, F.lit(0))
    pages = kept.select(key, F.col(page).cast("bigint").alias("_page")).distinct()
    # a page whose next one is missing ends its feed
    later = pages.select(F.col(key).alias("_of"), (F.col("_page") - 1).alias("_before"))
    ends = pages.join(later, pages[key].eqNullSafe(later["_of"]) & (pages["_page"] == later["_before"]), "left_anti")
    ends = ends.groupBy(key).agg(F.min("_page").alias("_end"))
    firsts = pages.filter(F.col("_page") == first).select(key)
    ends = ends.join(firsts, alike(ends, firsts), "left_semi").withColumnRenamed(key, "_of")
    kept = kept.join(ends if feed else F.broadcast(ends), kept[key].eqNullSafe(ends["_of"])).filter(F.col(page) <= F.col("_end")).drop("_end", "_of")
    return (kept if feed else kept.drop(key)).withColumn("_seq", F.col(page).cast("bigint") * PAGE_ROWS + F.col(pos))


def polled_pages(df: DataFrame, poll: str = "polled_at", page: str = "page", ts: str = "ts", most: int = 5, pos: str = "pos") -> DataFrame:
    """Rows of the pages that each poll reads, with _seq, their order in the poll: `most` pages at most, none from the first one without rows on, and none after the first that has a row older than the poll's window.

    Pages come newest first, so what is older than a window ends it. Each page of that kind is a minimum of partial minima.
    """
    pages = concat_pages(df, page, F.lit(most), pos, feed=poll)
    oldest = pages.groupBy(poll, page).agg(F.min(ts).alias("_oldest"))
    stops = oldest.filter(F.col("_oldest") < poll_window(poll)["from"]).groupBy(F.col(poll).alias("_poll")).agg(F.min(page).alias("_stop"))
    read = pages.join(stops, F.col(poll).eqNullSafe(F.col("_poll")), "left")
    return read.filter(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_stop", "_poll")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A written report: CSV with a header, where short rows end in nulls, or Parquet.

    The header is a row like others: its labels become the names of the columns as they are, equal and empty ones, too, and
    data are bound to them by position. Each file of a report in parts has the same header. A report without a file of
    its own header has no columns. Columns with equal names are told apart by position only, as in resolve_headers().
    """
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path)
    first = spark.read.csv(path).head(1)
    labels = [label or "" for label in first[0]] if first else []
    if not labels:
        return spark.createDataFrame([], T.StructType([]))
    places = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(labels))])
    return spark.read.schema(places).option("header", True).option("enforceSchema", True).csv(path).toDF(*labels)


def resolve_headers(df: DataFrame, synonyms: dict[str, list[str]], positional: dict[str, int] | None = None, required: tuple[str, ...] = ("followed_at",)) -> DataFrame:
    """Columns under their logical names: by the first synonym that is a trimmed header (the last of equal ones), else by position, else null.

    Raises ValueError if a required one has no header."""
    at = {label.strip(): k for k, label in enumerate(df.columns)}
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    out = []
    for name, labels in synonyms.items():
        found = next((at[label] for label in labels if label in at), None)
        if found is None and name in required:
            raise ValueError(f"no header for {name}")
        found = (positional or {}).get(name) if found is None else found
        present = found is not None and found < len(df.columns)
        out.append((F.col(f"c{found}") if present else F.lit(None).cast("string")).alias(name))
    return plain.select(out)


class _Cells(HTMLParser):
    """Texts of the cells of each row, or of each list item's links and their addresses."""

    def __init__(self, row: str, cell: tuple[str, ...]):
        super().__init__()
        self.row, self.cell, self.rows, self.open = row, cell, [], False

    def handle_starttag(self, tag, attrs):
        if tag == self.row:
            self.rows.append([])
        elif tag in self.cell and self.rows:
            self.open = True
            self.rows[-1].append("")
            if tag == "a":
                self.rows[-1].append(dict(attrs).get("href") or "")

    def handle_endtag(self, tag):
        if tag in self.cell or tag == self.row:
            self.open = False

    def handle_data(self, data):
        if self.open and self.rows[-1]:
            k = -2 if "a" in self.cell else -1
            self.rows[-1][k] += data


def html_cells(df: DataFrame, html: str, key: str, row: str = "tr", cells: tuple[str, ...] = ("td",)) -> DataFrame:
    """(key, pos, cells) of the rows of pages; null and broken pages give what can be read of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for k, page in zip(batch[key], batch[html]):
                parser = _Cells(row, cells)
                parser.feed(page or "")
                found += [(k, pos, [c.strip() for c in r]) for pos, r in enumerate(parser.rows) if r]
            yield pd.DataFrame(found, columns=[key, "pos", "cells"])

    schema = T.StructType([df.select(key).schema[0], *T.StructType.fromDDL("pos int, cells array<string>")])
    return df.select(key, html).mapInPandas(run, schema)


def extract_html_rows(df: DataFrame, html: str = "html", key: str = "page_id", min_cells: int = 7) -> DataFrame:
    """Name, e-mail and report date of table rows with enough cells and a date that can be read."""
    rows = html_cells(df, html, key).filter(F.size("cells") >= min_cells)
    get = lambda k: F.get("cells", F.lit(k))
    out = rows.select(key, "pos", get(0).alias("name"), get(1).alias("email"), parse_report_date(get(6)).alias("report_date"))
    return out.filter("report_date is not null")


def read_channel_list(spark: SparkSession, path: str) -> DataFrame:
    """name and url of lines 'name,url' or 'url'; blank lines are left out, a missing name is the url."""
    parts = F.split("value", ",", 2)
    name, url = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    url = F.coalesce(url, name)
    return lines.select(F.coalesce(null_if_blank(F.when(F.size(parts) > 1, name)), url).alias("name"), url.alias("url")).filter(F.col("url") != "")
