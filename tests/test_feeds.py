"""Streams over several polls with one checkpoint."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import joins, ranking
from ledgerloom.sources import ingest, publish
from ledgerloom.streaming import feeds
from ledgerloom.workspace import new_path

MENTION = "id long, account string, is_read boolean, ts timestamp_ntz, text string"


def at(day, hour=12, minute=0):
    return dt.datetime(2025, 1, day, hour, minute)


class Polls:
    """Rows land poll by poll; each poll is a run of its own of the query."""

    def __init__(self, spark, kind):
        self.spark, self.kind, self.landed, self.checkpoint = spark, kind, new_path(spark, "landed"), new_path(spark, "progress")

    def run(self, rows, start):
        self.spark.createDataFrame(rows, self.kind).write.mode("append").parquet(self.landed)
        query = start(self.spark.readStream.schema(self.kind).parquet(self.landed), self.checkpoint)
        query.awaitTermination()


def test_unread_mentions_come_once_at_any_age(spark):
    """Late ones, repeated ones, some without a time or an id, and two accounts, oldest first in each."""
    polls, out = Polls(spark, MENTION), new_path(spark, "outbox")
    order = [F.asc("account"), *ranking.unread_order(ts="ts")]
    messages = lambda df: df.select(F.col("account").alias("recipient"), "seq", F.coalesce("text", F.lit("?")).alias("text"))
    start = lambda df, checkpoint: feeds.to_outbox(feeds.stream_unread(df, ts="ts"), out, checkpoint, order, messages)
    seen = []

    def run(*rows):
        polls.run(rows, start)
        now = [(r.recipient, r.text) for r in spark.read.parquet(out).orderBy("batch", "seq").collect()]
        fresh, seen[:] = now[len(seen) :], now
        assert now[: len(now) - len(fresh)] == seen[: len(now) - len(fresh)]
        return fresh

    assert run((1, "b", False, at(10), "b1"), (2, "a", False, at(10, 13), "a2"), (3, "a", False, at(10, 12), "a3"), (4, "a", True, at(10), "read"), (5, "a", None, at(10), "unknown"), (2, "a", False, at(10, 13), "a2")) == [("a", "a3"), ("a", "a2"), ("b", "b1")]
    assert run((6, "a", False, at(1), "days late"), (7, "a", False, at(11), "a7"), (3, "a", False, at(10, 12), "a3"), (8, "a", False, None, "no time")) == [("a", "no time"), ("a", "days late"), ("a", "a7")]
    assert run((6, "a", False, at(1), "days late"), (1, "b", False, at(10), "b1"), (8, "a", False, None, "no time")) == []
    assert sorted(run((None, "c", False, at(2), "x"), (None, "c", False, at(2), "y"), (None, "c", False, at(2), "x"), (9, "a", True, at(2), "z"))) == [("c", "x"), ("c", "y")]
    assert run((None, "c", False, at(2), "x"), (9, "a", False, at(2), "z")) == [("a", "z")]


CHAT = "id long, channel string, ts timestamp_ntz, polled_at timestamp_ntz, page int, _pos int"


def test_chats_of_the_poll_windows(spark):
    polls, out = Polls(spark, CHAT), new_path(spark, "chats")
    start = lambda df, checkpoint: feeds.to_table(feeds.stream_chats(df, "c"), out, checkpoint)
    row = lambda id_, ts, polled, channel="c": (id_, channel, ts, polled, 1, 0)
    polls.run([row(1, at(9, 21, 59), at(10, 7, 40)), row(2, at(9, 22), at(10, 7, 40)), row(3, at(10, 7), at(10, 7, 40)), row(4, at(10, 7, 20), at(10, 7, 40)), row(5, at(10, 6), at(10, 7, 40), "d"), row(6, None, at(10, 7, 40)), row(7, at(10, 6), None)], start)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [2, 3]
    # seen too early before; on the border of two windows; older than its window
    polls.run([row(4, at(10, 7, 20), at(10, 9)), row(3, at(10, 7), at(10, 9)), row(8, at(10, 6, 59), at(10, 9)), row(9, at(10, 9), at(10, 9)), row(9, at(10, 9), at(10, 11))], start)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [2, 3, 4, 9]


def test_pages_of_a_poll(spark):
    """Pages up to the first with a row older than the window, up to an empty one, and five at most; polls without a time are one."""
    poll = at(10, 9)
    page = lambda p, page_, *times: [(10 * page_ + k, "c", t, p, page_, k) for k, t in enumerate(times)]
    rows = page(poll, 1, at(10, 8), at(10, 7)) + page(poll, 2, at(10, 6), None) + page(poll, 3, at(10, 8))
    rows += page(at(10, 11), 1, at(10, 10)) + page(at(10, 11), 3, at(10, 10))
    rows += [r for k in range(1, 8) for r in page(at(10, 13), k, at(10, 12))] + page(None, 1, at(1)) + page(None, 2, at(1))
    got = ingest.polled_pages(spark.createDataFrame(rows, CHAT).repartition(3), pos="_pos").collect()
    assert sorted((str(r.polled_at), r.page, r._pos) for r in got) == sorted(
        [(str(poll), 1, 0), (str(poll), 1, 1), (str(poll), 2, 0), (str(poll), 2, 1), (str(at(10, 11)), 1, 0)] + [(str(at(10, 13)), k, 0) for k in range(1, 6)] + [("None", 1, 0), ("None", 2, 0)]
    )
    assert [r.page for r in sorted(got, key=lambda r: r._seq) if r.polled_at == poll] == [1, 1, 2, 2]
    assert ingest.polled_pages(spark.createDataFrame([], CHAT), pos="_pos").count() == 0


def test_windows_are_joined_by_hours(spark):
    rows = spark.createDataFrame([(k, at(10, k // 4, 15 * (k % 4))) for k in range(96)] + [(97, None)], "id int, ts timestamp_ntz")
    windows = spark.createDataFrame([("a", at(9, 22), at(10, 7)), ("b", at(10, 6, 30), at(10, 8, 45)), ("none", None, at(10)), ("back", at(10, 9), at(10, 8))], "name string, from timestamp_ntz, to timestamp_ntz")
    found = joins.in_windows(rows, windows, "ts")
    due = [(k, n) for k in range(96) for n, a, b in (("a", 0, 28), ("b", 26, 35)) if a <= k <= b]
    assert sorted((r.id, r.name) for r in found.collect()) == due
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def totals(spark, path, *of):
    return {r.month: (r.n, r.a) for r in feeds.read_totals(spark, path, *of).collect()}


def test_running_totals(spark):
    polls, path = Polls(spark, "ts timestamp_ntz, a string"), new_path(spark, "totals")
    with pytest.raises(ValueError):
        feeds.read_totals(spark, path)
    start = lambda df, checkpoint: feeds.totals_to_table(feeds.stream_monthly(df, "ts", ["a"]), path, checkpoint)
    month = lambda m: dt.datetime(2025, m, 1)
    polls.run([(at(3), "x"), (at(4), " "), (dt.datetime(2025, 3, 9), None), (None, "x")], start)
    assert totals(spark, path) == {month(1): (2, 1), month(3): (1, 0)}
    polls.run([(dt.datetime(2025, 3, 31, 23), "y"), (dt.datetime(2024, 12, 31), "y")], start)
    polls.run([(dt.datetime(2025, 5, 1), "y")], start)
    assert totals(spark, path) == {month(1): (2, 1), month(3): (2, 1), month(5): (1, 1), dt.datetime(2024, 12, 1): (1, 1)}
    assert totals(spark, path, 2025, 1) == {m: {1: (2, 1), 3: (2, 1), 5: (1, 1)}.get(m, (0, 0)) for m in range(1, 13)}
    assert totals(spark, path, 2025) == {m: (1, 1) if m == 5 else (0, 0) for m in range(1, 13)}
    versions = feeds.Versions(spark, path)
    out = versions.published()
    assert len(out) == 2
    # a batch that is run again changes nothing; one that was cut off is not read, and is written anew
    changed = spark.createDataFrame([(month(1), 99, 99)], "month timestamp_ntz, n long, a long")
    feeds.publish_totals(changed, path, out[-1])
    changed.write.parquet(versions.folder(out[-1] + 1))
    assert totals(spark, path)[month(1)] == (2, 1) and versions.published() == out
    feeds.publish_totals(changed, path, out[-1] + 1)
    assert totals(spark, path) == {month(1): (99, 99), month(3): (2, 1), month(5): (1, 1), dt.datetime(2024, 12, 1): (1, 1)}


def test_places_in_an_order(spark):
    rows = spark.createDataFrame([(k, (k * 7919) % 101 if k % 10 else None) for k in range(400)], "id int, v int").repartition(5)
    got = ranking.numbered(rows, F.desc_nulls_last("v"), F.asc("id")).collect()
    order = sorted(range(400), key=lambda k: ((0, -((k * 7919) % 101)) if k % 10 else (1, 0), k))
    assert [r.id for r in sorted(got, key=lambda r: r._seq)] == order and sorted(r._seq for r in got) == list(range(400))
    assert ranking.numbered(rows.filter("false"), F.asc("id")).count() == 0


def test_a_batch_run_again_keeps_its_order(spark):
    path = new_path(spark, "outbox")
    publish.write_outbox(ranking.numbered(spark.createDataFrame([("a", 2, "x"), ("a", 1, "y")], "recipient string, ts int, text string"), F.asc("ts"), name="seq"), path, 0)
    assert [r.text for r in publish.read_outbox(spark, path).orderBy("seq").collect()] == ["y", "x"]


class Held:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms


def test_keys_are_forgotten_after_they_were_last_seen():
    once = feeds.Once("t", ["k", "t"], keep_ms=100)
    once.seen = Held()

    def run(ms, *batches):
        frames = [pd.DataFrame({"key": [k for k, _ in b], "k": [k for k, _ in b], "t": [t for _, t in b]}) for b in batches]
        return [tuple(r) for out in once.handleInputRows((0,), iter(frames), At(ms)) for r in out.itertuples(index=False)]

    assert run(0, [("a", 5.0), ("b", 2.0)], [("a", 3.0), ("c", 1.0)]) == [("c", 1.0), ("b", 2.0), ("a", 3.0)]
    assert run(90, [("a", 3.0), ("d", 1.0)]) == [("d", 1.0)]
    assert run(150, [("a", 3.0), ("b", 2.0)]) == [("b", 2.0)]  # a was seen again at 90, b was not
    assert set(once.seen.get()[0]) == {"a", "b", "d"}
    assert run(1000, []) == [] and once.seen.get() == ([], [])
