"""Hand-written rows for the operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates as agg
from ledgerloom.operators import filters, joins, ranking, reshape
from ledgerloom.sources import ingest, publish
from ledgerloom.workspace import new_path

DAY = dt.datetime(2025, 5, 1)


def test_merge_blocks(spark):
    friends = spark.createDataFrame([(1, 1, "", None, DAY, 0, "l"), (2, 1, "again", None, None, 0, "l")], "_seq long, uid long, name string, followed_at timestamp_ntz, blocked_at timestamp_ntz, is_blocked int, landing string")
    early = dt.datetime(2025, 1, 1)
    blocks = spark.createDataFrame([(1, 1, "b", early), (2, 9, "nine", early), (3, 2, "x", None), (4, 0, "zero", early)], "_seq long, uid long, name string, blocked_at timestamp_ntz")
    got = {(r.uid, r._seq): (r.name, r.blocked_at, r.is_blocked) for r in joins.merge_blocks(friends, agg.latest_per_key(blocks, "uid", ["blocked_at"])).collect()}
    assert got == {(1, 1): ("b", early, 1), (1, 2): ("again", None, 0), (9, None): ("nine", early, 1)}


def test_merge_by_user(spark):
    kind = "_seq long, uid long, name string, view_name string, followed_at timestamp_ntz, blocked_at timestamp_ntz, is_blocked int, landing string, link string"
    names = lambda rows: {r.uid: r.name for r in agg.merge_by_user(spark.createDataFrame([(k, u, n, v, DAY, None, 0, "", "") for k, (u, n, v) in enumerate(rows)], kind)).collect()}
    assert names([(1, None, "v1"), (1, "", None), (1, "c", None), (2, None, "v"), (0, "gone", None)]) == {1: "v1", 2: None}


def test_months(spark):
    rows = spark.createDataFrame([(dt.datetime(2025, 4, 1), ), (dt.datetime(2025, 5, 1), ), (dt.datetime(2025, 5, 9), ), (dt.datetime(2026, 1, 1), ), (None, )], "t timestamp_ntz")
    assert {r.month: r.n for r in agg.monthly_counts(rows, "t", 2025).collect()} == {m: 2 * (m == 5) for m in range(1, 13)}
    assert {r.month: r.n for r in agg.monthly_counts(rows, "t", 2026).collect()}[1] == 1
    months = spark.createDataFrame([(2, 29), (3, 6)], "month int, n long")
    got = {r.month: r.per_day for r in agg.daily_average(months, 2024, F.to_date(F.lit("2024-03-03"))).collect()}
    assert got == {2: 1.0, 3: 2.0}


def test_attribution_is_exclusive_for_top_and_overview(spark):
    rows = spark.createDataFrame([(DAY, "overview Top", "y"), (DAY, "overview", "y"), (DAY, "overview", " ")], "t timestamp_ntz, s string, c string")
    got = agg.attributed_contracts(rows, "t", "s", "c", a="A", b="B", daily="d", short="s", overview="overview", top="Top").filter("month = 5").first()
    assert (got.from_top, got.from_overview) == (1, 1)


def test_attendance_and_keywords(spark):
    long = spark.createDataFrame([("4/9参加", "◯"), ("7/9参加", "◯"), ("7/9参加希望", "◯"), ("7/9参加", "x")], "header string, cell string")
    assert {r.month: r.n for r in agg.attendance_by_event_month(long).collect()} == {m: int(m == 7) for m in range(1, 13)}
    rows = spark.createDataFrame([(DAY, "A short")], "t timestamp_ntz, s string")
    got = agg.keyword_counts(rows, "t", "s", {"a": "A", "b": "A short"}).filter("month = 5").first()
    assert (got.a, got.b) == (1, 1)


def test_rates(spark):
    day = dt.date(2025, 1, 1)
    events = spark.createDataFrame([("A", day, True, True), ("B", day, True, False), ("C", day, False, True), ("C", dt.date(2025, 1, 2), False, True)], "uid string, date date, hope boolean, attend boolean")
    got = {r.date.day: r.pct for r in agg.event_conversion(events, agg.distinct_sorted(events, "date"), "2025-01-01", "2025-01-31").collect()}
    assert got == {1: 50.0, 2: None}
    rows = spark.createDataFrame([("2025-02-01", True), ("2025-01-31", False)], "date string, v1 boolean")
    got = {(r.period, r.flag): r.pct for r in agg.conversion_rates(rows, "2025-02", "2025-01-01", ["v1"]).collect()}
    assert got == {("month", "v1"): 100.0, ("previous", "v1"): 0.0, ("since", "v1"): 50.0}


def test_ranks(spark):
    videos = spark.createDataFrame([("c", k, k, "public") for k in range(3)] + [("c", 9, 9, "private")], "ch string, id int, ts int, privacy_status string")
    take = lambda n: sorted(r.id for r in ranking.top_n_recent(videos, "ch", "ts", "id", n).collect())
    assert (take(2), take(0), take(500)) == ([1, 2], [2], [0, 1, 2])
    comments = spark.createDataFrame([("v", k, " " if k == 3 else f"t{k}", None) for k in range(25)], "video_id string, pos int, text_display string, text_original string")
    got = {r.video_id: r.comments for r in ranking.first_n_list(spark.createDataFrame([("v",), ("w",)], "video_id string"), comments).collect()}
    assert len(got["v"]) == 20 and got["v"][3] == "t4" and got["w"] == []


def test_date_range_and_headers(spark):
    rows = spark.createDataFrame([("2025-01-01",), ("2025/1/31",), ("x",), (None,), ("2025-02-01",)], "d string")
    assert filters.filter_date_range(rows, "d", "2025-01-01", "2025-01-31").count() == 2
    report = spark.createDataFrame([("a", "b")], "` 追加日 ` string, other string")
    got = ingest.resolve_headers(report, {"followed_at": ["追加日"], "x": ["none"], "y": ["none"]}, {"y": 1}).first()
    assert tuple(got) == ("a", None, "b")
    with pytest.raises(ValueError):
        ingest.resolve_headers(report, {"followed_at": ["none"]})


def test_two_keys(spark):
    people = spark.createDataFrame([("1", "A B")], "id string, name string")
    counts = [spark.createDataFrame([(k, 1)], f"{c} string, n long") for k, c in (("1", "id"), ("AB", "name"))]
    assert joins.dual_key_sum_join(people, *counts).first().n_mentions == 2
    assert joins.dual_key_sum_join(people, *counts, dedupe=True).first().n_mentions == 1


def test_orders(spark):
    """Reports come in the order that is due, ties included."""
    at = lambda d: dt.datetime(2025, 1, d)
    rows = spark.createDataFrame([(1, at(2)), (2, at(3)), (3, None), (4, at(3))], "uid long, followed_at timestamp_ntz").repartition(3)
    assert [r.uid for r in ranking.sort_inflow(rows).collect()] == [4, 2, 1, 3]
    students = spark.createDataFrame([(5, None), (3, at(9).date()), (4, at(9).date()), (1, dt.date(1900, 1, 1))], "id long, course_join_date date").repartition(3)
    assert [r.id for r in ranking.sort_students(students).collect()] == [3, 4, 1, 5]
    unread = spark.createDataFrame([(2, at(2)), (1, at(2)), (3, at(1)), (4, None)], "id long, created_at timestamp_ntz").repartition(3)
    assert [r.id for r in ranking.sort_unread(unread).collect()] == [4, 3, 1, 2]
    assert [r.uid for r in agg.distinct_sorted(rows.union(rows), "uid").collect()] == [1, 2, 3, 4]


def test_merge_by_user_takes_names_in_order(spark):
    kind = "_seq long, uid long, name string, view_name string, followed_at timestamp_ntz, blocked_at timestamp_ntz, is_blocked int, landing string, link string"
    rng = random.Random(4)
    some = lambda: rng.choice([None, "", " ", "a", "b", "c"])
    rows = [(k, rng.randint(1, 30), n and f"{n}{k}".replace(" ", "") if n and n.strip() else n, v and v.strip() and f"v{v}{k}" or v, DAY, None, 0, "", "") for k in range(120) for n, v in [(some(), some())]]
    due = {}
    for uid in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == uid]
        order = [r[2] for r in own[:2]] + [r[3] for r in own[:2]] + [x for r in own[2:] for x in r[2:4]]
        due[uid] = own[0][2] if len(own) == 1 else next((x for x in order if x and x.strip()), None)
    assert {r.uid: r.name for r in agg.merge_by_user(spark.createDataFrame(rows, kind).repartition(4)).collect()} == due


def test_pages_stop_at_the_first_empty_one(spark):
    rows = [("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("a", 4, 0), ("b", 2, 0), ("c", 1, 0), ("c", 2, 0), ("c", 3, 0)]
    pages = spark.createDataFrame(rows, "feed string, page int, pos int")
    kept = lambda df: sorted((r.feed, r.page, r.pos) for r in df.collect())
    assert kept(ingest.concat_pages(pages, feed="feed")) == [r for r in rows if r[0] != "b" and r[1] < 4]
    assert kept(ingest.concat_pages(pages, last_page=F.lit(2), feed="feed")) == [r for r in rows if r[0] != "b" and r[1] < 3]
    assert kept(ingest.concat_pages(pages.filter("feed = 'a'"))) == rows[:3]
    assert ingest.concat_pages(pages.filter("feed = 'b'")).count() == 0 == ingest.concat_pages(pages.filter("false")).count()
    order = [r.page for r in ingest.concat_pages(pages, feed="feed").filter("feed = 'c'").orderBy("_seq").collect()]
    assert order == [1, 2, 3]


def test_missing_fields(spark):
    bare = spark.createDataFrame([(7,)], "user_id long")
    assert filters.project_student(bare).first().asDict() == {"id": "7", "name": None, "email": None, "course_name": None, "course_start_at": None, "motivation": ""}
    rows = spark.createDataFrame([("", ("n",), ("s",)), (None, (None,), ("s",)), (None, None, None)], "landing_name string, landing struct<name:string>, utm struct<source:string>")
    assert [r.landing_name for r in filters.coalesce_landing(rows).collect()] == ["n", "s", ""]
    assert [r.landing_name for r in filters.coalesce_landing(rows, only_null=True).collect()] == ["", "s", ""]
    assert [r.landing_name for r in filters.coalesce_landing(rows.drop("landing_name").withColumn("landing", F.lit("l")), only_null=True).collect()] == ["l"] * 3
    assert filters.coalesce_landing(bare).first().landing_name == ""


def test_csv_for_each_status(spark):
    path = new_path(spark, "csv")
    rows = spark.createDataFrame([(1, " good ", "g"), (2, "odd", "u"), (3, None, "u")], "id long, status string, extra string")
    publish.write_partitioned_csv(rows, path, by="status", order=["very_good", "good"])
    read = lambda p: spark.read.option("header", True).csv(f"{path}/{p}")
    assert {g: [r.id for r in read(f"by_status/group={g}").orderBy("id").collect()] for g in ("very_good", "good", "unknown")} == {"very_good": [], "good": ["1"], "unknown": ["2", "3"]}
    assert read("all").columns == read("by_status/group=very_good").columns == publish.CSV_COLUMNS
    assert read("all").count() == 3 and [r.status for r in read("by_status/group=good").collect()] == [" good "]


def test_batches_are_written_once(spark):
    path = new_path(spark, "outbox")
    rows = spark.createDataFrame([("a", 1, "x"), ("", 2, "y")], "recipient string, seq long, text string")
    publish.write_outbox(rows, path, batch=0)
    publish.write_outbox(rows, path, batch=0)
    publish.write_outbox(rows, path, batch=1)
    found = publish.read_outbox(spark, path)
    assert found.columns == ["recipient", "mode", "seq", "text"] and found.count() == 4


def test_the_report_can_be_read_back(spark):
    """Events to columns, written as CSV, read with its header, to rows again, and counted by month; two years share a header."""
    events = spark.createDataFrame([(1, "2025-07-09", True, True), (2, "2025-07-09", True, False), (2, "2024-07-09", False, True), (3, "2025-05-01", None, True), (3, "2025-04-01", False, True)], "uid long, date string, hope boolean, attend boolean")
    days = ["2024-07-09", "2025-04-01", "2025-05-01", "2025-07-09", "later"]
    wide = reshape.pivot_events(events, days)
    assert wide.columns == ["uid"] + [f"{d}{word}" for d in ("7/9", "4/1", "5/1", "7/9", "later") for word in ("参加希望", "参加")]
    path = new_path(spark, "wide") + ".csv"
    line = F.concat_ws(",", *(F.col(f"c{k}").cast("string") for k in range(len(wide.columns))))
    wide.toDF(*(f"c{k}" for k in range(len(wide.columns)))).select(line.alias(",".join(wide.columns))).repartition(2).write.option("header", True).option("sep", "\u0001").csv(path)
    report = ingest.read_report(spark, path)
    assert report.columns == wide.columns and report.count() == 3
    long = reshape.unpivot_report(report, ["uid"], [c for c in report.columns if c != "uid"])
    assert long.count() == 30
    assert {r.month: r.n for r in agg.attendance_by_event_month(long).collect()} == {m: {5: 1, 7: 2}.get(m, 0) for m in range(1, 13)}
    stripped = spark.createDataFrame([("7/9参加", " ◯ "), ("7/9参加", "◯ x"), ("7/9参加", None)], "header string, cell string")
    assert {r.month: r.n for r in agg.attendance_by_event_month(stripped).collect()}[7] == 1


def test_labels_that_come_twice(spark):
    path = new_path(spark, "report") + ".csv"
    rows = spark.createDataFrame([("d,old,x,new",), ("e,,,",), ("f",)], "value string").repartition(3)
    rows.select(F.col("value").alias(" 追加日,名前,,名前 ")).write.option("header", True).option("sep", "\u0001").csv(path)
    report = ingest.read_report(spark, path)
    assert [c.strip() for c in report.columns] == ["追加日", "名前", "", "名前"]
    got = ingest.resolve_headers(report, {"followed_at": ["追加日"], "name": ["氏名", "名前"], "other": ["none"], "third": ["none"]}, {"third": 2})
    assert sorted(tuple(r) for r in got.collect()) == [("d", "new", None, "x"), ("e", None, None, None), ("f", None, None, None)]
    nothing = new_path(spark, "nothing") + ".csv"
    rows.filter("false").select(F.lit("x")).write.csv(nothing)
    assert ingest.read_report(spark, nothing).columns == []


def test_pages_without_a_feed(spark):
    rows = [("a", 1, 0), (None, 1, 0), (None, 1, 1), (None, 2, 0), (None, 4, 0), ("b", 2, 0)]
    pages = spark.createDataFrame(rows, "feed string, page int, pos int").repartition(2)
    assert sorted((str(r.feed), r.page, r.pos) for r in ingest.concat_pages(pages, feed="feed").collect()) == [("None", 1, 0), ("None", 1, 1), ("None", 2, 0), ("a", 1, 0)]


def test_schedule_of_the_categories_that_are_found(spark):
    rows = spark.createDataFrame([(1, "b", "d1", 5), (1, "a", "d2", 7), (2, "b", "d3", 9), (2, " ", "d4", 1), (3, None, "d5", 2), (2, "b", "d0", 3)], "id int, category string, due string, _seq int")
    got = reshape.pivot_schedule(rows)
    assert got.columns == ["id", "b", "a"]
    assert sorted(map(tuple, got.collect())) == [(1, "d1", "d2"), (2, "d3", None), (3, None, None)]
    with pytest.raises(ValueError):
        reshape.pivot_schedule(rows, most=1)
    assert reshape.pivot_schedule(rows.filter("id = 3")).columns == ["id"]
    assert reshape.pivot_schedule(rows, ["a", "z"]).columns == ["id", "a", "z"]


def test_first_seen_order_over_the_sorted_report(spark):
    rows = spark.createDataFrame([(1, dt.date(2025, 1, 1), "x"), (2, dt.date(2025, 3, 1), "y"), (3, None, "z"), (4, dt.date(2025, 3, 1), "x")], "id int, course_join_date date, category string").repartition(3)
    order = agg.first_seen_order(ranking.numbered(rows, *ranking.students_order()), "category").orderBy("first_seq").collect()
    assert [tuple(r) for r in order] == [("y", 0), ("x", 1), ("z", 3)]
