"""Polled feeds as streams, each message once, and the dashboard as a running aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.functions.dates import poll_window
from ledgerloom.operators.aggregates import count_if, dense_on_empty, filled, month_spine
from ledgerloom.operators.filters import filter_time_window, filter_year_month, unread_mentions
from ledgerloom.operators.ranking import numbered
from ledgerloom.sources.publish import write_outbox

#: How long an id is remembered after it has been seen for the last time.
KEEP_DAYS = 90
#: Parts of the state, by hashes of ids.
BUCKETS = 64
#: What queries that keep state by key are started with. Batches without rows, which would only sweep expired keys, would never end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Once(StatefulProcessor):
    """Of each bucket of keys the rows whose key it doesn't know: of each key the first by a column, nulls before all.

    The state of a bucket is its keys with the time they were seen last, read and written once a batch; a call for each key would
    take longer than all else."""

    def __init__(self, by: str, columns: list[str], keep_ms: int):
        self.by, self.columns, self.keep_ms = by, columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "keys array<string>, at array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, known, first = timerValues.getCurrentProcessingTimeInMs(), {}, None
        if self.seen.exists():
            known = {k: at for k, at in zip(*self.seen.get()) if at >= now - self.keep_ms}
        here: set[str] = set()
        for batch in rows:
            here.update(batch["key"])
            new = batch[~batch["key"].isin(known)]
            first = new if first is None else pd.concat([first, new])
            first = first.sort_values(self.by, na_position="first", kind="stable").drop_duplicates("key")
        known |= dict.fromkeys(here, now)
        self.seen.update((list(known), list(known.values())))
        if first is not None and len(first):
            yield first[self.columns]

    def close(self) -> None:
        pass


def once(df: DataFrame, key: str, by: str, keep_days: int = KEEP_DAYS, buckets: int = BUCKETS) -> DataFrame:
    """Each key of a stream once, however late it comes: the row with the least `by`, those without a time before all.

    A key is remembered by its value for keep_days after it was seen last, in processing time, so state follows what is polled and not all
    that ever was. Keys are dealt to buckets by hash, whose number a checkpoint holds on to; a task holds the keys of one, so there should
    be one for each million keys that are remembered. Rows without a key are told apart by all that they hold. The sinks
    below start queries with the settings that this state needs.
    """
    # the columns go by numbers meanwhile, since names that begin with an underscore get lost on the way to Python
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    whole = F.concat(F.lit("-"), F.sha2(F.to_json(F.struct(*plain.columns)), 256))
    keyed = plain.withColumn("key", F.coalesce(F.concat(F.lit("+"), F.col(f"c{df.columns.index(key)}").cast("string")), whole))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    processor = Once(f"c{df.columns.index(by)}", plain.columns, keep_days * 24 * 3600 * 1000)
    first = keyed.groupBy("bucket").transformWithStateInPandas(processor, outputStructType=plain.schema, outputMode="Append", timeMode="ProcessingTime")
    return first.toDF(*df.columns)


def stream_chats(chats: DataFrame, channel: str, ts: str = "ts", key: str = "id", polled: str = "polled_at", keep_days: int = KEEP_DAYS) -> DataFrame:
    """Chats of one channel that lie in the window of the poll they came with, both ends in, each once.

    Which pages a poll reads is decided where they land (see ingest.polled_pages). A chat on the border of two windows comes
    once. Without a time of the chat or of the poll there is no window, and the chat does not come.
    """
    window = poll_window(polled)
    inside = filter_time_window(chats.filter(F.col("channel") == channel), ts, window["from"], window["to"])
    return once(inside, key, ts, keep_days)


def stream_unread(mentions: DataFrame, ts: str = "ts", key: str = "id", channel_id: Column | None = None, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Unread mentions, with a channel where one is given, each once, at whatever age they are seen first."""
    return once(unread_mentions(mentions, channel_id), key, ts, keep_days)


@contextmanager
def _keyed_state(spark: SparkSession):
    """Queries started inside keep their state by key, as once() needs; a query holds on to the settings that it starts with."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> StreamingQuery:
    with _keyed_state(df.sparkSession):
        return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_outbox(feed: DataFrame, path: str, checkpoint: str, order: list[Column] | None = None, messages: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Write messages (recipient, text, seq) of all that has come in to an outbox; a batch that is run again replaces what it wrote.

    With an order, such as account and then oldest first, seq is the place of a row in its batch; messages makes rows of
    the feed to messages. Ordering is by ranges (see numbered()), in one folder beside the checkpoint that each batch writes anew.
    """

    def write(batch: DataFrame, k: int) -> None:
        if order:
            batch = numbered(batch, *order, name="seq", path=f"{checkpoint}-order")
        write_outbox(messages(batch), path, k)

    return _start(feed, write, checkpoint, "append")


def to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    with _keyed_state(df.sparkSession):
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_monthly(df: DataFrame, ts: str, columns: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts of each month so far: n rows, and for each of some columns the rows where it is filled. Rows without a time are left out."""
    counts = [F.count("*").alias("n"), *(count_if(filled(c)).alias(c) for c in columns)]
    return df.filter(F.col(ts).isNotNull()).groupBy(F.date_trunc("MONTH", ts).alias("month")).agg(*counts)


class Versions:
    """Versions of a table under one folder. One counts once its marker is there, which is put up when all of it has been written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def published(self) -> list[int]:
        marks = self.of(f"{self.path}/_published")
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(marks)) if self.fs.exists(marks) else []

    def folder(self, k: int) -> str:
        return f"{self.path}/version={k}"

    def publish(self, k: int) -> None:
        """Put up the marker of a version; of the others the one before stays, for those who read it."""
        self.fs.create(self.of(f"{self.path}/_published/{k}"), True).close()
        for old in self.published()[:-2]:
            self.fs.delete(self.of(f"{self.path}/_published/{old}"), False)
            self.fs.delete(self.of(self.folder(old)), True)

    def read(self, k: int) -> DataFrame:
        return self.spark.read.parquet(self.folder(k))


def publish_totals(changed: DataFrame, path: str, k: int, key: str = "month") -> None:
    """Version k of a table of totals: the newest one with the rows of `changed` in the place of those with their key.

    A version that is out stays as it is, so a batch that is run again changes nothing; one that was cut off is written anew.
    """
    versions = Versions(changed.sparkSession, path)
    out = versions.published()
    if k in out:
        return
    rows = changed.withColumn("_new", F.lit(1))
    if out:
        rows = rows.unionByName(versions.read(out[-1]).withColumn("_new", F.lit(0)))
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in changed.columns if c != key)), "_new").alias("r"))
    newest.select(key, "r.*").write.mode("overwrite").parquet(versions.folder(k))
    versions.publish(k)


def totals_to_table(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of running totals. A batch hands over the months that it changes, which are merged into the newest version."""
    return _start(totals, lambda batch, k: publish_totals(batch, path, k), checkpoint, "update")


def read_totals(spark: SparkSession, path: str, year: int | None = None, min_month: int | None = None) -> DataFrame:
    """The newest version that is out, by month; of one year twelve months (month as a number), those without rows, or left out by filter_year_month(), as 0."""
    versions = Versions(spark, path)
    out = versions.published()
    if not out:
        raise ValueError(f"no totals are out in {path}")
    totals = versions.read(out[-1])
    if year is None:
        return totals
    inside = filter_year_month(totals, "month", year, min_month).withColumn("month", F.month("month"))
    return dense_on_empty(inside, month_spine(spark), ["month"])
