"""Hand-written rows for the column functions."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, nested, text


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, c {kind}")
    return [r[0] for r in df.select(make(F.col("c")).alias("v"), "k").orderBy("k").collect()]


def test_ids_and_blanks(spark):
    assert values(spark, ["https://x/my_page/12", "https://x/my_page/12/", "abc", None], text.uid_from_link) == [12, 12, 0, 0]
    assert values(spark, ["　", " ", "", "x", None], text.null_if_blank) == [None, None, None, "x", None]
    assert values(spark, ["-", " Null ", "x", "未設定"], text.null_if_blankish) == [None, None, "x", None]
    assert values(spark, ["12ab", " -3", "x", "99999999999999999999"], text.prefix_int) == [12, -3, 0, 0]


def test_names_and_masks(spark):
    assert values(spark, ["Ａ　Ｂ（x）", "A B (y)", None], text.normalize_name) == ["ＡＢ", "AB", ""]
    assert values(spark, ["abcdefg", "abcdefgh"], text.mask) == ["abcdefg", "abcd...efgh"]
    assert values(spark, ["ＡＢ１ "], text.nfkc) == ["AB1"]


def test_texts(spark):
    assert values(spark, ["a。b\r\nc、d \n", None], text.format_comment) == ["a。\nb c、\nd", ""]
    sizes = values(spark, ["", "x" * 2000, "x" * 2001, None], lambda c: F.transform(text.chunk_text(c), F.length))
    assert sizes == [[], [2000], [2000, 1], []]
    assert values(spark, ['a"b', " "], lambda c: text.link_cell(c, F.lit('l"'))) == ['=HYPERLINK("a""b","l""")', 'l"']
    assert values(spark, ["see docs.google.com/spreadsheets/d/k1 x", "none"], text.sheet_url) == ["https://docs.google.com/spreadsheets/d/k1", None]


def test_tags(spark):
    names = ["参加希望 ２０２５／１０／０９", "参加2025年10月9日（木）", "参加 2025/2/30", "参加", None]
    got = values(spark, names, lambda c: nested.event_tag(text.nfkc(c)))
    day = dt.date(2025, 10, 9)
    assert [r and tuple(r) for r in got] == [("hope", day), ("attend", day), None, None, None]
    names = ["2025年7月9日入会", "入会 2025-07", "07/2025 入会", "2025年13月入会", "2024年1月"]
    assert values(spark, [names], nested.join_months, "array<string>") == [["2025年 07月入会"]]


def test_dates(spark):
    assert values(spark, ["26/03/10", "2026-03-10", "2026年3月10日", "3/10", "70/01/01"], dates.parse_report_date) == ["2026年3月10日"] * 3 + [None, "1970年1月1日"]
    got = values(spark, ["2025年7月9日 8時05分", "2025年7月9日", "x", "2025-07-09T08:05:00+09:00"], dates.parse_follow_time)
    assert got == [dt.datetime(2025, 7, 9, 8, 5), dt.datetime(2025, 7, 9), None, dt.datetime(2025, 7, 9, 8, 5)]
    polls = [dt.datetime(2025, 7, 9, 7, 40), dt.datetime(2025, 7, 9, 9, 0)]
    got = [tuple(r) for r in values(spark, polls, dates.poll_window, "timestamp_ntz")]
    assert got == [(dt.datetime(2025, 7, 8, 22), dt.datetime(2025, 7, 9, 7)), (dt.datetime(2025, 7, 9, 7), dt.datetime(2025, 7, 9, 9))]


KIND = "array<struct<name:string,is_completed:boolean,started_at:timestamp_ntz,scheduled_completed_at:timestamp_ntz,category_blocks:array<struct<name:string,is_completed:boolean>>>>"


def test_categories(spark):
    course = lambda *done: [(f"c{k}", d, None, None, [("b", True), (f"b{k}", None)]) for k, d in enumerate(done)]
    rows = [course(True, False, True, False), course(True, True), [], course(False, None)]
    assert values(spark, rows, lambda c: nested.current_category(c)["name"], KIND) == ["c3", None, None, "c0"]
    assert values(spark, rows, nested.current_category_name, KIND) == ["c3", "全て完了", "全て完了", "c0"]
    assert values(spark, rows, nested.current_block_name, KIND) == ["b3", "", "", "b0"]
    first, last = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    twice = [("a", True, None, first, []), ("", True, None, first, []), ("a", True, None, last, [])]
    assert values(spark, [twice], nested.schedule_map, KIND) == [{"a": last}]


def test_risk(spark):
    now = F.expr("timestamp_ntz '2025-01-13 00:00:00'")
    flag = lambda c: nested.risk_flag(F.lit("離脱"), F.lit(None).cast("timestamp_ntz"), F.lit("x"), c, F.lit(None).cast("timestamp_ntz"), now)
    assert values(spark, [dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2), None], flag, "timestamp_ntz") == ["声かけ必須", "", ""]


def test_offsets_and_bad_dates(spark):
    rows = ["2025-07-09T00:30:00Z", "2025-07-09T23:30:00+00:00", "2025-07-09 08:05:00.250 +0900", "2025/7/9 20:00 -05:00", "2025-07-09", "x", "", None]
    day = lambda d, h=0, m=0: dt.datetime(2025, 7, d, h, m)
    due = [day(9, 9, 30), day(10, 8, 30), day(9, 8, 5), day(10, 10), day(9), None, None, None]
    assert values(spark, rows, dates.parse_lenient) == due
    assert values(spark, rows, dates.parse_follow_time) == due
    assert values(spark, rows, dates.parse_lenient_date) == [dt.date(2025, 7, 9)] * 5 + [None] * 3
    assert values(spark, rows, dates.month_key) == ["2025-07"] * 5 + [None] * 3
    assert values(spark, rows, dates.publish_date) == ["2025-07-09"] * 5 + [""] * 3
    assert values(spark, rows, dates.jp_date) == [f"2025年7月{d}日" for d in (9, 10, 9, 10, 9)] + [""] * 3
    assert values(spark, rows, dates.jp_datetime) == [f"2025年7月{x}分" for x in ("9日 09時30", "10日 08時30", "9日 08時05", "10日 10時00", "9日 00時00")] + [""] * 3
    assert values(spark, [day(9, 23, 30), None], dates.jp_datetime, "timestamp_ntz") == ["2025年7月9日 23時30分", ""]
    assert values(spark, [day(9, 23, 30).replace(tzinfo=dt.timezone.utc)], dates.jp_datetime, "timestamp") == ["2025年7月10日 08時30分"]
    assert values(spark, [dt.date(2025, 7, 9), None], dates.month_key, "date") == ["2025-07", None]


def test_find_key(spark):
    deep = "[" * 5000 + "]" * 5000
    rows = ['{"k": null, "b": {"k": 1}}', '{"a": {"k": null, "z": {"k": 5}}, "b": {"k": 2}}', '{"a": [{"b": {"k": [1, "x"]}}, {"k": 2}]}', '{"k": "s"}', "{bad", deep, "", None, '{"b": [3, {"k": 7}], "k": 6}']
    assert values(spark, rows, lambda c: nested.find_key(c, "k")) == [None, "2", '[1, "x"]', "s", None, None, None, None, "6"]


def test_links_and_performers(spark):
    rows = ["a https://u/?uLand=q1_x http://v?uLand=q2", "http://v?uLand=q2", "none", None]
    assert values(spark, rows, lambda c: text.performer(c, {"q1": "Ann"}, "nobody")) == ["Ann", "nobody", "nobody", "nobody"]
    assert values(spark, rows, lambda c: text.performer(c, {}, "nobody")) == ["nobody"] * 4
    good = ["https://docs.google.com/spreadsheets/d/k-1/edit"]
    assert values(spark, good, lambda c: text.doc_id_from_url(c, strict=True)) == ["k-1"]
    for bad in ("k-1", "x https://docs.google.com/spreadsheets/d/k", None):
        with pytest.raises(Exception, match="no spreadsheet address"):
            values(spark, [bad], lambda c: text.doc_id_from_url(c, strict=True))


def test_event_map(spark):
    kind = "array<struct<id:int,tags:array<struct<name:string>>>>"
    tags = [("参加希望 2025/10/09",), ("参加2025年10月9日（木）",), ("参加 2025/10/01",), ("参加",), (None,)]
    day = lambda d: dt.date(2025, 10, d)
    got = values(spark, [[(2, []), (1, tags)], [(2, tags)], [(1, [])], [], None], lambda c: nested.event_map(c, 1), kind)
    assert [{d: tuple(v) for d, v in m.items()} for m in got] == [{day(9): (True, True), day(1): (False, True)}, {}, {}, {}, {}]


def test_iso_forms(spark):
    rows = ["2025-07-09T10:00:00+09", "20250709T101112Z", "20250709T1011", "20250709T101112.5+0900", "2025-07-09T10:00:00,5-05", "20250709", "20250709T10", "2025-07-09T10:00:00+9"]
    at = lambda *x: dt.datetime(2025, 7, *x)
    assert values(spark, rows, dates.parse_lenient) == [at(9, 10), at(9, 19, 11, 12), at(9, 10, 11), at(9, 10, 11, 12), at(10, 0), at(9), None, None]
    assert values(spark, rows, dates.month_key) == ["2025-07"] * 6 + [None] * 2


KEYED = [
    '{"k": null, "b": {"k": 1}}', '{"a": {"k": null, "z": {"k": 5}}, "b": {"k": 2}}', '{"a": [{"b": {"k": [1, "x"]}}, {"k": 2}]}', '{"k": "s"}', "{bad", "", " ", None, '{"b": [3, {"k": 7}], "k": 6}',
    '{"z": {"k": "first"}, "a": {"k": "second"}}', '[{"z": 1}, [{"k": true}]]', '{"a": "{\\\\"k\\\\": 1}", "b": {"k": "ü\\\\n"}}', '{"a": {"b": {"c": {"k": 9}}}, "d": {"k": 8}}', '{"d": {"k": 8}, "a": {"b": {"c": {"k": 9}}}}',
    '{"a": {"k": 1.50}}', '{"k": 123456789012345678901}', '{"a": 1, "a": {"k": 2}}', "3", '"k"', "[]", "{}", '{"a": [[[[{"k": 4}]]]]}', '{"a": [null, {"x": null}], "k": {}}', '  {"b": {"k": ""}}', "[" * 3000 + "]" * 3000, '{"a": {"b": {"c": 1}}}', '{"a": NaN, "k": 3}',
]


def test_keys_near_the_root_and_below(spark):
    """with_key() is find_key() for all; what is sure is right without Python."""
    rows = spark.createDataFrame([(k, v, "clash") for k, v in enumerate(KEYED)], "id int, v string, name string").repartition(3)
    due = [r[0] for r in rows.orderBy("id").select(nested.find_key("v", "k")).collect()]
    assert due[:10] == [None, "2", '[1, "x"]', "s", None, None, None, None, "6", "first"]
    assert [r.found for r in nested.with_key(rows, "v", "k", "found").orderBy("id").collect()] == due
    for levels in (1, 2, 3, 5):
        near = [r.n for r in rows.orderBy("id").select(nested.near_key("v", "k", levels).alias("n")).collect()]
        assert all(n.value == d for n, d in zip(near, due) if n.sure)
        assert sum(n.sure for n in near) >= 8 + levels and all(n.value is None or n.sure for n in near)
    plan = rows.select(nested.near_key("v", "k").alias("n"))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_nfkc_of_different_values(spark):
    rows = [" Ａｂ１－／　", "ｶﾞ", "①", "山 田（x）", "a\tb\n", "", "　", None, "ﬁ", "é", "\x1cx\x1f", "\x85x", "（＃１）~＼"] * 2
    due = [None if v is None else unicodedata.normalize("NFKC", v).strip() for v in rows]
    frame = spark.createDataFrame([(k, v, 1) for k, v in enumerate(rows)], "id int, v string, known int").repartition(3)
    assert [r.out for r in text.with_nfkc(frame, "v", "out").orderBy("id").collect()] == due == values(spark, rows, text.nfkc)
    assert text.with_nfkc(frame.filter("false"), "v", "out").count() == 0
    sent = text.with_nfkc(frame, "v", "out")._jdf.queryExecution().optimizedPlan().toString()
    assert sent.index("ArrowEvalPython") < sent.index("Aggregate")  # different values alone reach Python
