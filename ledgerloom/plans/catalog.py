"""Registered queries over the driver's tables and the SQL they are compared with.

A query is registered with the input views it takes (see inputs.py) and its SQL, in which @view stands for a view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import dates, nested, text
from ledgerloom.operators import aggregates as agg
from ledgerloom.operators import filters, joins, ranking, reshape
from ledgerloom.plans.inputs import VIEWS, duckdb_view, spark_view
from ledgerloom.sources import ingest, publish
from ledgerloom.streaming import feeds
from ledgerloom.workspace import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
YEAR = 2001
STEPS = ["leads", "consult", "contract"]
MONTHS = "(SELECT unnest(range(1, 13))::INTEGER AS month)"


def query(*views: str, sql: str | None = None):
    """Register a function of some views, or of driver tables if no view has the name."""

    def register(run: Callable[..., DataFrame]):
        def on(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(*(spark_view(spark, sf_dir, v) if v in VIEWS else spark.read.parquet(f"{sf_dir}/{v}.parquet") for v in views))

        on.__name__ = run.__name__
        QUERIES[run.__name__] = on
        if sql:
            ORACLES[run.__name__] = re.sub(rf"@({'|'.join(VIEWS)})\b", lambda m: duckdb_view(m[1]), sql)
        return run

    return register


def monthly_sql(view: str, ts: str, where: str, **counts: str) -> str:
    columns = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in counts.items())
    found = f"SELECT month({ts})::INTEGER AS month, {columns} FROM @{view} WHERE {where} GROUP BY 1"
    return f"SELECT month, {', '.join(f'coalesce({n}, 0) AS {n}' for n in counts)} FROM {MONTHS} LEFT JOIN ({found}) USING (month)"


IN_YEAR = f"year(followed_at) = {YEAR}"


# filters and projections


@query("friends", sql="SELECT * FROM @friends WHERE followed_at::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def filter_date_range(friends):
    return filters.filter_date_range(friends.withColumn("d", F.col("followed_at").cast("string")), "d", "2024-01-05", "2024/1/12").drop("d")


@query("friends", sql="SELECT * FROM @friends WHERE followed_at::DATE <= DATE '2024-01-03' OR is_blocked = 1")
def filter_blocked_or_range(friends):
    return filters.filter_blocked_or_range(friends.withColumn("d", F.col("followed_at").cast("string")), "x", "2024-01-03", followed="d").drop("d")


@query("leads", sql="SELECT * FROM @leads WHERE NOT contains(name, '#00000001') AND NOT contains(name, '7')")
def exclude_names(leads):
    return filters.exclude_names(leads, "name", ["#00000001", "7"])


@query("leads", sql=f"SELECT * FROM @leads WHERE {IN_YEAR} AND month(followed_at) >= 5")
def filter_year_month(leads):
    return filters.filter_year_month(leads, "followed_at", YEAR)


@query("friends", sql="SELECT * FROM (SELECT *, strftime(followed_at, '%Y-%m-%d') AS date FROM @friends) WHERE date >= '2024-01-2'")
def filter_since(friends):
    return filters.filter_since(friends.withColumn("date", F.date_format("followed_at", "yyyy-MM-dd")), "date", "2024-01-2")


@query("students", sql="SELECT * FROM @students WHERE NOT (coalesce(lower(trim(id)) = 's5', false) OR coalesce(trim(email) = 'm7@example.org', false)) AND coalesce(lower(trim(id)), '') <> 'id'")
def drop_header_echo(students):
    return filters.drop_header_echo(students, "id", {"email": "m7@example.org", "id": "s5"})


@query("mentions", sql="SELECT * FROM @mentions WHERE is_read IS FALSE AND nullif(channel, '') IS NOT NULL")
def unread_mentions(mentions):
    return filters.unread_mentions(mentions, F.nullif("channel", F.lit("")))


@query("videos", sql="SELECT * FROM @videos WHERE privacy_status = 'public'")
def public_only(videos):
    return filters.public_only(videos)


@query("videos", "orders", sql="""SELECT v.id::VARCHAR AS id, title, 'w=' || v.id AS watch_url, 'a=' || v.id AS analytics_url,
    coalesce(strftime(o.o_orderdate, '%Y-%m-%d'), '') AS published_on, coalesce(view_count, 0)::BIGINT AS view_count,
    coalesce(CASE WHEN v.id % 2 = 0 THEN view_count END, 0)::BIGINT AS like_count FROM @videos v LEFT JOIN orders o ON o.o_orderkey = v.id""")
def project_video(videos, orders):
    rows = videos.join(orders, F.col("id") == F.col("o_orderkey"), "left").withColumn("like_count", F.when(F.col("id") % 2 == 0, F.col("view_count")).cast("string"))
    return filters.project_video(rows.withColumn("id", F.col("id").cast("string")).withColumn("published_at", F.col("o_orderdate")), "w=", "a=")


@query("mentions", sql="SELECT * FROM @mentions WHERE created_at BETWEEN TIMESTAMP '2024-01-03 22:00:00' AND TIMESTAMP '2024-01-04 07:00:00'")
def filter_time_window(mentions):
    return filters.filter_time_window(mentions, "created_at", F.expr("timestamp_ntz '2024-01-03 22:00:00'"), F.expr("timestamp_ntz '2024-01-04 07:00:00'"))


@query("friends", sql="SELECT uid, followed_at, strftime(followed_at, '%Y-%m-%d') AS date, coalesce(CASE WHEN uid % 2 = 0 THEN true END, false) AS v1 FROM @friends")
def project_inflow(friends):
    return filters.project_inflow(friends.select("uid", "followed_at", F.when(F.col("uid") % 2 == 0, F.lit(True)).alias("v1")))


@query("students", sql="SELECT coalesce(id, user_id) AS id, name, email, 'c' || nation AS course_name, NULL::VARCHAR AS course_start_at, coalesce(nullif(trim(motivation), ''), '') AS motivation FROM @students")
def project_student(students):
    rows = students.withColumn("learning_course", F.struct(F.concat(F.lit("c"), "nation").alias("name"), F.lit("").alias("motivation")))
    return filters.project_student(rows)


@query("friends", sql="SELECT _seq, coalesce(nullif(landing, ''), nullif(trim(view_name), ''), nullif(name, ''), '') AS landing_name FROM @friends")
def coalesce_landing(friends):
    rows = friends.withColumnRenamed("landing", "landing_name")
    source = F.struct(F.col("view_name").alias("name"))
    utm = F.struct(F.struct(F.lit("x").alias("medium")).alias("campaign"), F.col("name").alias("source"))
    return filters.coalesce_landing(rows.withColumn("landing", source).withColumn("utm", utm)).select("_seq", "landing_name")


@query("mentions", sql="""SELECT sender_id, report_date = DATE '2024-01-20' AS report_today, a > 0 AS has_mention_a, b > 0 AS has_mention_b FROM (
    SELECT sender_id, max(created_at)::DATE AS report_date, count(*) FILTER (WHERE is_read) AS a, count(*) FILTER (WHERE channel = 'error') AS b FROM @mentions GROUP BY 1)""")
def highlight_flags(mentions):
    rows = mentions.groupBy("sender_id").agg(F.to_date(F.max("created_at")).alias("report_date"), F.count_if("is_read").alias("mentions_a"), agg.count_if(F.col("channel") == "error").alias("mentions_b"))
    return filters.highlight_flags(rows, F.to_date(F.lit("2024-01-20"))).select("sender_id", "report_today", "has_mention_a", "has_mention_b")


@query("mentions", sql="SELECT count(*) FILTER (WHERE d = DATE '2024-01-20') AS n FROM (SELECT max(created_at)::DATE AS d FROM @mentions GROUP BY sender_id)")
def highlight_count(mentions):
    rows = mentions.groupBy("sender_id").agg(F.to_date(F.max("created_at")).alias("report_date"), F.lit(0).alias("mentions_a"), F.lit(0).alias("mentions_b"))
    return filters.highlight_count(filters.highlight_flags(rows, F.to_date(F.lit("2024-01-20"))))


# joins

LATEST_BLOCKS = "(SELECT uid, arg_max(name, CASE WHEN name IS NOT NULL THEN _seq END) AS name, max(blocked_at) AS blocked_at FROM @blocks GROUP BY uid)"
MERGED_BLOCKS = f"""(WITH b AS (SELECT * FROM {LATEST_BLOCKS} WHERE blocked_at IS NOT NULL AND uid > 0),
    f AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY _seq) = 1 AS first FROM @friends)
    SELECT f._seq, f.uid, CASE WHEN first AND b.uid IS NOT NULL THEN coalesce(nullif(f.name, ''), b.name, f.name) ELSE f.name END AS name, followed_at,
      CASE WHEN first THEN coalesce(b.blocked_at, f.blocked_at) ELSE f.blocked_at END AS blocked_at, CASE WHEN first AND b.uid IS NOT NULL THEN 1 ELSE is_blocked END AS is_blocked, landing
    FROM f LEFT JOIN b USING (uid)
    UNION ALL SELECT NULL, uid, name, NULL, blocked_at, 1, '' FROM b WHERE uid NOT IN (SELECT uid FROM f))"""


@query("friends", "blocks", sql=f"SELECT * FROM {MERGED_BLOCKS}")
def merge_blocks(friends, blocks):
    return joins.merge_blocks(friends, agg.latest_per_key(blocks, "uid", ["blocked_at"]))


@query("students", "nation", sql="SELECT s.nation, s._seq, n.n_name FROM @students s LEFT JOIN nation n ON n.n_nationkey = s.nation AND n.n_regionkey > 1")
def enrich_left(students, nation):
    detail = nation.filter("n_regionkey > 1").select(F.col("n_nationkey").alias("nation"), "n_name")
    return joins.enrich_left(students.select("nation", "_seq"), detail, "nation")


@query("friends", sql="""SELECT _seq, CASE WHEN _seq % 2 = 0 THEN 'q' END AS qr_code, coalesce(CASE WHEN _seq % 3 > 0 THEN 'f' END, 'p') AS followed_at,
    coalesce(nullif(CASE WHEN _seq % 4 = 0 THEN '-' ELSE landing END, '-'), 'l') AS landing_name FROM @friends""")
def fill_from_profile(friends):
    rows = friends.select("_seq", F.lit(None).cast("string").alias("qr_code"), F.when(F.col("_seq") % 3 > 0, F.lit("f")).otherwise(F.lit(" ")).alias("followed_at"),
        F.when(F.col("_seq") % 4 == 0, F.lit("-")).otherwise(F.col("landing")).alias("landing_name"), F.when(F.col("_seq") % 2 == 0, F.lit("q")).otherwise(F.lit("")).alias("p_qr_code"), F.lit("p").alias("p_followed_at"), F.lit("l").alias("p_landing_name"))
    return joins.fill_from_profile(rows)


REPORTS = "(SELECT _seq, CASE WHEN _seq % 2 = 0 THEN email ELSE 'none' END AS email, CASE WHEN _seq % 3 = 0 THEN name || ' (x)' ELSE '?' || name END AS name, 'd' || _seq AS report_date FROM @students)"


@query("students", sql=f"""SELECT s._seq, coalesce(e.v, n.v) AS report_date FROM @students s
    LEFT JOIN (SELECT email AS k, arg_max(report_date, _seq) AS v FROM {REPORTS} WHERE email <> '' GROUP BY 1) e ON e.k = s.email
    LEFT JOIN (SELECT replace(replace(name, ' (x)', ''), ' ', '') AS k, arg_max(report_date, _seq) AS v FROM {REPORTS} GROUP BY 1) n ON n.k = replace(s.name, ' ', '')""")
def fallback_join(students):
    dim = students.select("_seq", F.when(F.col("_seq") % 2 == 0, F.col("email")).otherwise(F.lit("none")).alias("email"),
        F.when(F.col("_seq") % 3 == 0, F.concat("name", F.lit(" (x)"))).otherwise(F.concat(F.lit("?"), "name")).alias("name"), F.concat(F.lit("d"), "_seq").alias("report_date"))
    return joins.fallback_join(students.select("_seq", "email", "name"), dim).select("_seq", "report_date")


@query("mentions", sql="""SELECT id, coalesce(a.n, 0) + coalesce(b.n, 0) AS n_mentions FROM (SELECT DISTINCT sender_id AS id, 'u' || sender_id AS name FROM @mentions) s
    LEFT JOIN (SELECT sender_id AS id, count(*) AS n FROM @mentions WHERE is_read GROUP BY 1) a USING (id)
    LEFT JOIN (SELECT 'u' || sender_id AS name, count(*) AS n FROM @mentions WHERE NOT is_read GROUP BY 1) b USING (name)""")
def dual_key_sum_join(mentions):
    people = mentions.select(F.col("sender_id").alias("id"), F.col("user_name").alias("name")).distinct()
    by_id = mentions.filter("is_read").groupBy(F.col("sender_id").alias("id")).agg(F.count("*").alias("n"))
    by_name = mentions.filter("not is_read").groupBy(text.normalize_name("user_name").alias("name")).agg(F.count("*").alias("n"))
    return joins.dual_key_sum_join(people, by_id, by_name).select("id", "n_mentions")


@query("customer", sql="SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS segment FROM customer")
def map_dimension(customer):
    return joins.map_dimension(customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": "b", "MACHINERY": "m"}, "other", "segment").drop("c_mktsegment")


@query("videos", sql="SELECT channel_id, 'ch ' || channel_id AS name, id, title FROM @videos WHERE channel_id <> 'Brand#11'")
def videos_of_channels(videos):
    channels = videos.select(F.nullif("channel_id", F.lit("Brand#11")).alias("channel_id")).distinct().withColumn("name", F.concat(F.lit("ch "), "channel_id"))
    return joins.videos_of_channels(channels, videos.select("channel_id", "id", "title"))


@query("students", "customer", sql="""SELECT s._seq, CASE WHEN trim(motivation) = '' AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE motivation END AS motivation
    FROM @students s JOIN customer c ON c.c_custkey = s._seq""")
def backfill_motivation(students, customer):
    detail = customer.select(F.col("c_custkey").alias("_seq"), F.lit(None).cast("string").alias("motivation"), F.lit(" ").alias("course_motivation"), F.col("c_mktsegment").alias("class_motivation"))
    return joins.backfill_motivation(students.select("_seq", "motivation"), detail, "_seq", ["BUILDING", "MACHINERY"])


# aggregates


@query("blocks", sql=f"SELECT * FROM {LATEST_BLOCKS}")
def latest_per_key(blocks):
    return agg.latest_per_key(blocks, "uid", ["blocked_at"])


@query("friends", sql="""WITH p AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY _seq) AS place, count(*) OVER (PARTITION BY uid) AS n FROM @friends),
    c AS (SELECT uid, name AS value, CASE WHEN place <= 2 THEN place ELSE 2 * place - 1 END AS spot FROM p
      UNION ALL SELECT uid, view_name, CASE place WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 2 * place END FROM p)
    SELECT uid, CASE WHEN max(n) = 1 THEN arg_min(name, _seq) ELSE (SELECT arg_min(value, spot) FROM c WHERE c.uid = p.uid AND value <> '') END AS name,
      max(followed_at) AS followed_at, max(blocked_at) AS blocked_at, max(is_blocked) AS is_blocked, arg_min(landing, _seq) FILTER (WHERE landing <> '') AS landing, arg_min(link, _seq) AS link
    FROM p WHERE uid > 0 GROUP BY uid""")
def merge_by_user(friends):
    return agg.merge_by_user(friends)


@query("leads", sql=monthly_sql("leads", "followed_at", f"{IN_YEAR} AND month(followed_at) >= 5", n="true"))
def monthly_counts(leads):
    return agg.monthly_counts(leads, "followed_at", YEAR)


@query("leads", sql=f"SELECT count(*) AS n FROM @leads WHERE {IN_YEAR} AND NOT contains(name, '9')")
def year_total(leads):
    return agg.year_total(leads, "followed_at", YEAR, "name", ["9"], min_month=1)


@query("leads", sql="SELECT 'tag_a' AS tag, count(*) FILTER (WHERE contains(tag_a, '◯')) AS n, round(count(*) FILTER (WHERE contains(tag_a, '◯')) / count(*) * 100, 1) AS pct FROM @leads UNION ALL SELECT 'tag_b', count(*) FILTER (WHERE contains(tag_b, '◯')), round(count(*) FILTER (WHERE contains(tag_b, '◯')) / count(*) * 100, 1) FROM @leads")
def tag_totals(leads):
    return agg.tag_totals(leads, ["tag_a", "tag_b"])


@query("leads", sql=monthly_sql("leads", "followed_at", IN_YEAR, tag_a="contains(tag_a, '◯')", tag_b="contains(tag_b, '◯')"))
def tag_monthlies(leads):
    return agg.tag_monthlies(filters.filter_year_month(leads, "followed_at", YEAR, 1), "followed_at", ["tag_a", "tag_b"])


EVENT_LONG = "(SELECT o_orderkey, month(o_orderdate) || '/' || day(o_orderdate) || CASE WHEN o_orderkey % 3 > 0 THEN '参加' ELSE '参加希望' END AS header, CASE o_orderstatus WHEN 'F' THEN '◯' WHEN 'O' THEN ' ◯ ' ELSE '◯ x' END AS cell, month(o_orderdate) AS m FROM orders)"


@query("orders", sql=f"SELECT month, coalesce(n, 0) AS n FROM {MONTHS} LEFT JOIN (SELECT m::INTEGER AS month, count(*) AS n FROM {EVENT_LONG} WHERE trim(cell) = '◯' AND NOT contains(header, '希望') AND m >= 5 GROUP BY 1) USING (month)")
def attendance_by_event_month(orders):
    word = F.when(F.col("o_orderkey") % 3 > 0, F.lit("参加")).otherwise(F.lit("参加希望"))
    long = orders.select(F.concat(F.date_format("o_orderdate", "M/d"), word).alias("header"), F.when(F.col("o_orderstatus") == "F", F.lit("◯")).when(F.col("o_orderstatus") == "O", F.lit(" ◯ ")).otherwise(F.lit("◯ x")).alias("cell"))
    return agg.attendance_by_event_month(long)


@query("leads", sql=monthly_sql("leads", "followed_at", IN_YEAR, consult="trim(consult) <> ''", contract="trim(contract) <> ''"))
def nonblank_monthlies(leads):
    return agg.nonblank_monthlies(filters.filter_year_month(leads, "followed_at", YEAR, 1), "followed_at", ["consult", "contract"])


@query("leads", sql=monthly_sql("leads", "followed_at", IN_YEAR, high="contains(referrer, 'H')", urgent="contains(referrer, 'URGENT')", dash="contains(referrer, '-')"))
def keyword_counts(leads):
    return agg.keyword_counts(filters.filter_year_month(leads, "followed_at", YEAR, 1), "followed_at", "referrer", {"high": "H", "urgent": "URGENT", "dash": "-"})


ATTRIBUTION = dict(a="URGENT", b="HI", daily="GH", short="1", overview="4-NOT", top="SPECIFIED")


@query("leads", sql=monthly_sql("leads", "followed_at", f"{IN_YEAR} AND trim(contract) <> ''", from_a="contains(referrer, 'URGENT')", from_b="contains(referrer, 'HI')",
    from_b_long="contains(referrer, 'HIGH') OR (contains(referrer, 'HI') AND NOT contains(referrer, '1'))", from_top="contains(referrer, '4-NOT SPECIFIED')", from_overview="contains(referrer, '4-NOT') AND NOT contains(referrer, '4-NOT SPECIFIED')"))
def attributed_contracts(leads):
    return agg.attributed_contracts(filters.filter_year_month(leads, "followed_at", YEAR, 1), "followed_at", "referrer", "contract", **ATTRIBUTION)


@query("leads", sql=monthly_sql("leads", "followed_at", IN_YEAR, n="trim(consult) <> '' AND trim(contract) <> ''"))
def cooccurrence_monthlies(leads):
    return agg.cooccurrence_monthlies(filters.filter_year_month(leads, "followed_at", YEAR, 1), "followed_at", "consult", "contract")


@query("tags", sql="""WITH t AS (SELECT strftime(date, '%Y-%m-%d') AS d, v1, v2 FROM @tags), p AS (SELECT 'month' AS period, * FROM t WHERE d[:7] = '2024-01'
    UNION ALL SELECT 'since', * FROM t WHERE d >= '2024-01-10'), f AS (SELECT period, 'v1' AS flag, v1 AS hit FROM p UNION ALL SELECT period, 'v2', v2 FROM p)
    SELECT period, flag, round(count(*) FILTER (WHERE hit) / count(*) * 100, 1) AS pct FROM f GROUP BY ALL UNION ALL SELECT 'previous', unnest(['v1', 'v2']), NULL""")
def conversion_rates(tags):
    return agg.conversion_rates(tags.withColumn("date", F.date_format("date", "yyyy-MM-dd")), "2024-01", "2024-01-10", ["v1", "v2"])


EVENTS_BY_USER = "(SELECT uid, date, bool_or(hope) AS hope, bool_or(attend) AS attend FROM @tags GROUP BY ALL)"


@query("tags", sql=f"""SELECT d.date, hoped, came, round(came / nullif(hoped, 0) * 100, 1) AS pct FROM (SELECT DISTINCT date FROM @tags) d LEFT JOIN (
    SELECT date, count(*) FILTER (WHERE hope) AS hoped, count(*) FILTER (WHERE hope AND attend) AS came FROM {EVENTS_BY_USER} WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1) USING (date)""")
def event_conversion(tags):
    events = tags.groupBy("uid", "date").agg(F.bool_or("hope").alias("hope"), F.bool_or("attend").alias("attend"))
    return agg.event_conversion(events, agg.distinct_sorted(tags, "date"), "2024-01-05", "2024-01-25")


@query("mentions", sql="SELECT sender_id AS id, coalesce(nullif(channel, ''), 'チャンネル不明') AS channel, count(*) AS n, min(_seq) AS _seq FROM @mentions WHERE NOT is_read GROUP BY 1, 2")
def mention_counts(mentions):
    return agg.mention_counts(filters.unread_mentions(mentions), F.col("sender_id"), "id")


@query("mentions", sql="""SELECT name, string_agg(channel || 'より' || n || '件', ' / ' ORDER BY _seq) AS label FROM (
    SELECT 'u' || sender_id AS name, coalesce(nullif(channel, ''), 'チャンネル不明') AS channel, count(*) AS n, min(_seq) AS _seq FROM @mentions WHERE NOT is_read GROUP BY 1, 2) GROUP BY 1""")
def channel_label(mentions):
    return agg.channel_label(agg.mention_counts_by_name(filters.unread_mentions(mentions)), "name")


@query("students", sql="""SELECT place::INTEGER AS place, status, coalesce(n, 0) AS n FROM (VALUES (0, 'building'), (1, 'machinery'), (2, 'none'), (3, 'unknown')) s(place, status)
    LEFT JOIN (SELECT CASE WHEN lower(trim(motivation)) IN ('building', 'machinery') THEN lower(trim(motivation)) ELSE 'unknown' END AS status, count(*) AS n FROM @students GROUP BY 1) USING (status)""")
def group_by_status(students):
    return agg.group_by_status(students, "motivation", ["building", "machinery", "none"])


@query("tags", sql="SELECT DISTINCT date FROM @tags WHERE date IS NOT NULL")
def distinct_sorted(tags):
    return agg.distinct_sorted(tags, "date")


@query("categories", sql="SELECT name, min(_seq) AS first_seq FROM @categories WHERE trim(name) <> '' GROUP BY 1")
def first_seen_order(categories):
    return agg.first_seen_order(categories, "name")


@query("categories", sql="SELECT id, arg_max(name, _seq) AS name FROM @categories GROUP BY 1")
def last_wins_dim(categories):
    return agg.last_wins_dim(categories, "id", "name")


@query("leads", sql="SELECT *, high + urgent AS total FROM (" + monthly_sql("leads", "followed_at", IN_YEAR, high="contains(referrer, 'H')", urgent="contains(referrer, 'URGENT')") + ")")
def row_totals(leads):
    counts = agg.keyword_counts(filters.filter_year_month(leads, "followed_at", YEAR, 1), "followed_at", "referrer", {"high": "H", "urgent": "URGENT"})
    return agg.row_totals(counts, ["high", "urgent", "absent"])


@query("leads", sql="SELECT coalesce(sum(consult), 0)::BIGINT AS consult, coalesce(sum(contract), 0)::BIGINT AS contract FROM (" + ORACLES["nonblank_monthlies"].replace("followed_at) = 2001", "followed_at) = 2000") + ")")
def column_totals(leads):
    counts = agg.nonblank_monthlies(filters.filter_year_month(leads, "followed_at", 2000, 1), "followed_at", ["consult", "contract"])
    return agg.column_totals(counts, ["consult", "contract"])


def _dashboard(leads: DataFrame) -> DataFrame:
    rows = filters.filter_year_month(leads, "followed_at", YEAR, 1)
    return agg.by_month(rows, "followed_at", leads=F.count("*"), consult=agg.count_if(agg.filled("consult")), contract=agg.count_if(agg.filled("contract")))


DASHBOARD = "(" + monthly_sql("leads", "followed_at", IN_YEAR, leads="true", consult="trim(consult) <> ''", contract="trim(contract) <> ''") + ")"


@query("leads", sql=f"SELECT *, coalesce(contract / nullif(leads, 0), 0.0)::DOUBLE AS share FROM {DASHBOARD}")
def month_share(leads):
    return agg.month_share(_dashboard(leads), "contract", "leads")


@query("leads", sql=f"SELECT *, leads / CASE WHEN month = 6 THEN 3 ELSE day(last_day(make_date({YEAR}, month, 1))) END AS per_day FROM {DASHBOARD}")
def daily_average(leads):
    return agg.daily_average(_dashboard(leads), YEAR, F.to_date(F.lit(f"{YEAR}-06-03")), "leads")


@query("leads", sql=f"""SELECT consult / nullif(leads, 0) AS consult_of_leads, contract / nullif(consult, 0) AS contract_of_consult, coalesce(contract / nullif(contract, 0), 0.0)::DOUBLE AS attend_of_contract,
    leads / nullif(leads, 0) AS leads_of_total, consult / nullif(leads, 0) AS consult_of_total, contract / nullif(leads, 0) AS contract_of_total, contract / nullif(leads, 0) AS attend_of_total
    FROM (SELECT sum(leads)::BIGINT AS leads, sum(consult)::BIGINT AS consult, sum(contract)::BIGINT AS contract FROM {DASHBOARD})""")
def funnel(leads):
    totals = agg.column_totals(_dashboard(leads), STEPS)
    return agg.funnel(totals.withColumns({"attend": F.col("contract"), "total": F.col("leads")}), STEPS, "attend", "total")


@query("leads", sql="""SELECT year::INTEGER AS year, referrer, coalesce(n, 0) AS n FROM (SELECT year, referrer FROM (SELECT unnest(range(1990, 2003)) AS year) y CROSS JOIN (SELECT DISTINCT referrer FROM @leads) r) s
    LEFT JOIN (SELECT year(followed_at) AS year, referrer, count(*) AS n FROM @leads GROUP BY ALL) USING (year, referrer)""")
def dense_on_empty(leads):
    """Leads by year and referrer, with years that have none."""
    found = leads.groupBy(F.year("followed_at").alias("year"), "referrer").agg(F.count("*").alias("n"))
    years = F.explode(F.sequence(F.lit(1990), F.lit(2002))).alias("year")
    return agg.dense_on_empty(found, leads.select("referrer").distinct().select(years, "referrer"), ["year", "referrer"])


# ranks and orders


@query("videos", sql="SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY published DESC, id)::INTEGER AS rank FROM @videos WHERE privacy_status = 'public' QUALIFY rank <= 3")
def top_n_recent(videos):
    return ranking.top_n_recent(videos, "channel_id", "published", "id", 3)


FIRST_COMMENTS = """(WITH c AS (SELECT video_id, pos, coalesce(nullif(trim(text_display), ''), text_original) AS t0, CASE WHEN trim(text_display) <> '' THEN text_display ELSE text_original END AS comment FROM @comments),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS rank FROM c WHERE trim(comment) <> '')
    SELECT v.video_id, r.rank, r.comment FROM (SELECT DISTINCT id AS video_id FROM @videos) v LEFT JOIN r ON r.video_id = v.video_id AND r.rank <= 3)"""


@query("videos", "comments", sql=f"SELECT video_id, coalesce(string_agg(comment, '|' ORDER BY rank), '') AS comments FROM {FIRST_COMMENTS} GROUP BY 1")
def first_n_list(videos, comments):
    found = ranking.first_n_list(videos.select(F.col("id").alias("video_id")), comments, n=3)
    return found.select("video_id", F.array_join("comments", "|").alias("comments"))


@query("friends", sql="SELECT * FROM @friends QUALIFY row_number() OVER (PARTITION BY uid ORDER BY _seq) = 1")
def first_row_per_key(friends):
    return ranking.first_row_per_key(friends, "uid")


@query("friends", sql="SELECT uid, max(followed_at) AS latest_login_at FROM @friends GROUP BY 1")
def latest_login(friends):
    return ranking.latest_login(friends, "uid", "followed_at")


@query("friends", sql="SELECT uid, followed_at, _seq FROM @friends")
def sort_inflow(friends):
    return ranking.sort_inflow(friends.select("uid", "followed_at", "_seq"))


@query("categories", sql="SELECT _seq AS id, due::DATE AS course_join_date FROM @categories")
def sort_students(categories):
    return ranking.sort_students(categories.select(F.col("_seq").alias("id"), F.to_date("due").alias("course_join_date")))


@query("mentions", sql="SELECT id, created_at FROM @mentions WHERE NOT is_read")
def sort_unread(mentions):
    return ranking.sort_unread(filters.unread_mentions(mentions)).select("id", "created_at")


# reshaping


# all days of the tags, and all priorities
DAYS = [f"2024-01-{day:02}" for day in range(1, 32)]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DAY_COLUMNS = ", ".join(f"CASE WHEN bool_or({kind}) FILTER (WHERE date = DATE '{day}') THEN '◯' ELSE '' END AS \"1/{int(day[-2:])}{label}\"" for day in DAYS for kind, label in (("hope", "参加希望"), ("attend", "参加")))
DUE_COLUMNS = ", ".join(f"max(due) FILTER (WHERE name = '{p}') AS \"{p}\"" for p in PRIORITIES)


@query("tags", sql=f"SELECT uid, {DAY_COLUMNS} FROM {EVENTS_BY_USER} GROUP BY 1")
def pivot_events(tags):
    return reshape.pivot_events(tags.withColumn("date", F.col("date").cast("string")), DAYS)


@query("categories", sql=f"SELECT id, {DUE_COLUMNS} FROM @categories GROUP BY 1")
def pivot_schedule(categories):
    """The columns are the names that are found, in the order they come first in the report by due date."""
    report = ranking.numbered(categories.select("id", F.col("name").alias("category"), "due", "_seq").withColumnRenamed("_seq", "order"), F.asc("due"), F.asc("order"))
    return reshape.pivot_schedule(report.drop("order"))


@query("videos", "comments", sql=f"SELECT video_id, max(comment) FILTER (WHERE rank = 1) AS comment1, max(comment) FILTER (WHERE rank = 2) AS comment2, max(comment) FILTER (WHERE rank = 3) AS comment3 FROM {FIRST_COMMENTS} GROUP BY 1")
def spread_list(videos, comments):
    return reshape.spread_list(ranking.first_n_list(videos.select(F.col("id").alias("video_id")), comments, n=3), "comments", 3, "comment")


@query("leads", sql="SELECT _seq, 'tag_a' AS header, tag_a AS cell FROM @leads UNION ALL SELECT _seq, 'tag_b', tag_b FROM @leads")
def unpivot_report(leads):
    return reshape.unpivot_report(leads, ["_seq"], ["tag_a", "tag_b"])


@query("friends", "blocks", sql="SELECT _seq, uid, name FROM @friends UNION ALL SELECT _seq, uid, name FROM @blocks WHERE uid NOT IN (SELECT uid FROM @friends)")
def append_unmatched(friends, blocks):
    return joins.append_unmatched(friends.select("_seq", "uid", "name"), blocks.select("_seq", "uid", "name"))


@query("categories", sql="SELECT id, string_agg(name, '|' ORDER BY first) AS names FROM (SELECT id, name, min(_seq) AS first FROM @categories GROUP BY ALL) GROUP BY 1")
def distinct_values(categories):
    lists = categories.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "name"))), lambda c: c["name"]).alias("names"))
    return reshape.distinct_values(lists, "names").withColumn("names", F.array_join("names", "|"))


# strings and dates

NAMES = """(SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '　' WHEN 1 THEN '-' WHEN 2 THEN concat('山 田（', c_name, '）') WHEN 3 THEN concat(' 12', c_name) WHEN 4 THEN NULL ELSE concat('Ab　(x)c ', c_custkey) END AS raw FROM customer)"""


def _names(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, F.lit("　")).when(k == 1, F.lit("-")).when(k == 2, F.concat(F.lit("山 田（"), "c_name", F.lit("）"))).when(k == 3, F.concat(F.lit(" 12"), "c_name"))
    return customer.select(F.col("c_custkey").alias("id"), raw.when(k == 4, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Ab　(x)c "), F.col("c_custkey").cast("string"))).alias("raw"))


def column(name: str, sql: str, value, *views: str, key: str = "id", source: str | None = None, prepare=lambda df: df):
    """Register a column function as key and value over a view."""

    @query(*views, sql=f"SELECT {key}, {sql} AS value FROM {source or '@' + views[0]}")
    def run(df):
        return prepare(df).select(key, value().alias("value"))

    QUERIES[name] = QUERIES.pop("run")
    ORACLES[name] = ORACLES.pop("run")


def on_names(name: str, sql: str, value):
    column(name, sql, value, "customer", source=NAMES, prepare=_names)


on_names("prefix_int", r"coalesce(try_cast(nullif(regexp_extract(raw, '^\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0)", lambda: text.prefix_int("raw"))
on_names("null_if_blank", "CASE WHEN trim(replace(raw, '　', ' ')) <> '' THEN raw END", lambda: text.null_if_blank("raw"))
on_names("null_if_blankish", "CASE WHEN trim(raw, ' ') NOT IN ('', '-') THEN raw END", lambda: text.null_if_blankish("raw"))
on_names("pick_landing", "coalesce(CASE WHEN trim(raw, ' ') NOT IN ('', '-') THEN raw END, 'q' || id)", lambda: text.pick_landing("raw", F.concat(F.lit("q"), "id")))
on_names("normalize_name", r"regexp_replace(regexp_replace(coalesce(raw, ''), '（.*?）|\(.*?\)', '', 'g'), '[\s　]+', '', 'g')", lambda: text.normalize_name("raw"))
on_names("normalize_code", "lower(trim(coalesce(raw, ''), ' '))", lambda: text.normalize_code("raw"))
on_names("mask", "CASE WHEN length(raw) < 8 THEN raw ELSE left(raw, 4) || '...' || right(raw, 4) END", lambda: text.mask("raw"))
on_names("category_due_text", "CASE WHEN coalesce(raw, '') <> '' THEN raw || ' / ' || id ELSE '' END", lambda: text.category_due_text("raw", F.col("id").cast("string")))
on_names("link_cell", """CASE WHEN trim(replace(coalesce(raw, ''), '　', ' ')) = '' THEN 'pdca_' || id ELSE '=HYPERLINK("' || raw || '","pdca_' || id || '")' END""", lambda: text.link_cell("raw", F.concat(F.lit("pdca_"), "id")))
on_names("image_cell", """CASE WHEN trim(replace(coalesce(raw, ''), '　', ' ')) = '' THEN '' ELSE '=IMAGE("' || raw || '", 1)' END""", lambda: text.image_cell("raw"))
on_names("sheet_url", "CASE WHEN id % 6 = 3 THEN 'https://docs.google.com/spreadsheets/d/' || id END", lambda: text.sheet_url(F.concat("raw", F.lit(" docs.google.com/spreadsheets/d/"), F.when(F.col("id") % 6 == 3, F.col("id").cast("string")).otherwise(F.lit("")), F.lit(" x"))))
on_names("goal_url", "'https://p.example.org/weekly_goals?user_id=' || id", lambda: text.goal_url(F.concat(F.lit("see HTTPS://p.example.orgweekly_goals?user_id="), "id", F.lit(" x")), "https://p.example.org"))
on_names("profile_url", "'https://h.example.org/basic/friendlist/my_page/' || id", lambda: text.profile_url(F.concat(F.lit("x https://h.example.org/basic/friendlist/my_page/"), "id", F.lit(" y")), "h.example.org"))
on_names("doc_id_from_url", "CASE WHEN id % 2 = 0 THEN 'k' || id ELSE 'plain' END", lambda: text.doc_id_from_url(F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://x/spreadsheets/d/k"), "id", F.lit("/edit"))).otherwise(F.lit("plain"))))
on_names("handle_from_url", "CASE WHEN id % 2 = 0 THEN 'h' || id END", lambda: text.handle_from_url(F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://x/@h"), "id", F.lit("?a=b"))).otherwise(F.lit("https://x/c/1"))))
on_names("first_url", "CASE WHEN id % 6 <> 4 THEN 'https://u/' || id END", lambda: text.first_url(F.concat("raw", F.lit(" https://u/"), "id", F.lit(" http://v"))))
on_names("performer", "CASE WHEN id % 2 = 0 AND id % 6 <> 4 THEN 'Ann' ELSE 'nobody' END", lambda: text.performer(F.when(F.col("id") % 2 == 0, F.concat("raw", F.lit(" https://u?uLand=a1&b http://v?uLand=b2"))).otherwise(F.lit("https://u http://v?uLand=a1")), {"a1": "Ann", "b2": "Bo"}, "nobody"))
on_names("percent_text", "CASE WHEN id % 3 > 0 THEN (id % 3) || '%' ELSE '' END", lambda: text.percent_text(F.when(F.col("id") % 3 > 0, F.col("id") % 3)))
on_names("flag_mark", "CASE WHEN id % 2 = 0 THEN '◯' ELSE '' END", lambda: text.flag_mark(F.col("id") % 2 == 0))


@query("customer", sql=f"SELECT id, replace(replace(replace(replace(trim(replace(raw, '　', ' ')), '（', '('), '）', ')'), '＃', '#'), '１', '1') AS value FROM {NAMES}")
def nfkc(customer):
    return text.with_nfkc(_names(customer), "raw", "value").select("id", "value")


column("uid_from_link", "uid", lambda: text.uid_from_link("link"), "friends", key="_seq")
column("format_comment", r"rtrim(replace(replace(replace(replace(text_original || '。b、c ' || chr(10), chr(13), ''), chr(10), ' '), '。', '。' || chr(10)), '、', '、' || chr(10)))", lambda: text.format_comment(F.concat("text_original", F.lit("。b、c \n"))), "comments", key="video_id")
column("chunk_text", "array_to_string(list_transform(range(0, CAST(ceil(length(coalesce(text, '')) / 2000) AS BIGINT)), lambda k: substr(text, k * 2000 + 1, 2000)), '|')", lambda: F.array_join(text.chunk_text("text"), "|"), "documents", key="doc_id", source="documents")
column("thumbnail", "CASE WHEN _seq % 2 = 0 THEN 'h' || _seq ELSE 'd' END", lambda: text.thumbnail("t"), "students", key="_seq",
    prepare=lambda df: df.withColumn("t", F.struct(F.struct(F.when(F.col("_seq") % 2 == 0, F.concat(F.lit("h"), "_seq")).alias("url")).alias("high"), F.struct(F.lit(None).cast("string").alias("url")).alias("medium"), F.struct(F.lit("d").alias("url")).alias("default"))))
# of the view dates: written times, no time, and times with an offset, in Tokyo
TOKYO_TIME = "CASE o_orderkey % 8 WHEN 6 THEN date_trunc('day', o_orderdate) + INTERVAL '10 hours' WHEN 7 THEN date_trunc('day', o_orderdate) + INTERVAL '19 hours 11 minutes 12 seconds' WHEN 0 THEN date_trunc('day', o_orderdate) + INTERVAL '8 hours 5 minutes' WHEN 3 THEN NULL WHEN 4 THEN date_trunc('day', o_orderdate) + INTERVAL '9 hours 30 minutes' WHEN 5 THEN date_trunc('day', o_orderdate) + INTERVAL '37 hours 30 minutes' ELSE date_trunc('day', o_orderdate) END"
column("parse_follow_time", TOKYO_TIME, lambda: dates.parse_follow_time("raw"), "dates", key="o_orderkey")
column("parse_lenient", TOKYO_TIME, lambda: dates.parse_lenient("raw"), "dates", key="o_orderkey")
column("parse_report_date", "CASE WHEN o_orderkey % 4 = 2 THEN year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' END", lambda: dates.parse_report_date("raw"), "dates", key="o_orderkey",
    prepare=lambda df: df.withColumn("raw", F.when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yy/MM/dd")).otherwise(F.lit("3/10"))))
JP_DATE = f"year({TOKYO_TIME}) || '年' || month({TOKYO_TIME}) || '月' || day({TOKYO_TIME}) || '日'"
column("month_key", "CASE WHEN o_orderkey % 8 <> 3 THEN strftime(o_orderdate, '%Y-%m') END", lambda: dates.month_key("raw"), "dates", key="o_orderkey")
column("jp_date", f"coalesce({JP_DATE}, '')", lambda: dates.jp_date("raw"), "dates", key="o_orderkey")
column("jp_datetime", f"coalesce({JP_DATE} || strftime({TOKYO_TIME}, ' %H時%M分'), '')", lambda: dates.jp_datetime("raw"), "dates", key="o_orderkey")
column("publish_date", "CASE WHEN o_orderkey % 8 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END", lambda: dates.publish_date("raw"), "dates", key="o_orderkey")
column("event_header", "CASE o_orderkey % 8 WHEN 3 THEN raw ELSE month(o_orderdate) || '/' || day(o_orderdate) END", lambda: dates.event_header("raw"), "dates", key="o_orderkey")


@query("mentions", sql="""SELECT id, CASE WHEN hour(created_at) = 7 THEN date_trunc('day', created_at) - INTERVAL 2 HOURS ELSE created_at - INTERVAL 2 HOURS END AS start,
    CASE WHEN hour(created_at) = 7 THEN date_trunc('day', created_at) + INTERVAL 7 HOURS ELSE created_at END AS stop FROM @mentions""")
def poll_window(mentions):
    return mentions.withColumn("w", dates.poll_window("created_at")).select("id", F.col("w.from").alias("start"), F.col("w.to").alias("stop"))


@query("mentions", sql="""SELECT id, '【チャンネル名: ' || channel || '】投稿者: ' || user_name || chr(10) || '投稿日時: ' || strftime(created_at, '%Y-%m-%d %H:%M') ||
    CASE WHEN id % 2 = 0 THEN chr(10) || 'メンション: a, b' ELSE '' END || chr(10) || 'URL: https://m' || chr(10) || chr(10) || 't' || id || chr(10) AS message FROM @mentions WHERE NOT is_read""")
def mention_message(mentions):
    names = F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return filters.unread_mentions(mentions).select("id", text.mention_message("channel", "user_name", "created_at", names, F.concat(F.lit("t"), "id"), "https://m").alias("message"))


@query("mentions", sql="""SELECT id, '【チャンネル名: ' || channel || '】投稿者: ' || sender_id || chr(10) || '投稿日時: ' || strftime(created_at, '%Y-%m-%d %H:%M') ||
    chr(10) || 'URL: https://m?channel_id=c0' || chr(10) || chr(10) || 't' || id || chr(10) AS message FROM @mentions""")
def chat_message(mentions):
    nothing = F.lit(None).cast("string")
    return mentions.select("id", text.chat_message("channel", nothing, nothing, "sender_id", "created_at", F.concat(F.lit("t"), "id"), "https://m", "c0").alias("message"))


# tags, categories and JSON

TAG_NAMES = "(SELECT o_orderkey AS id, o_orderdate AS d, CASE o_orderkey % 5 WHEN 0 THEN '参加希望 ' || strftime(o_orderdate, '%Y/%m/%d') WHEN 1 THEN '参加' || year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日（木）' WHEN 2 THEN '参加 2025/2/30' WHEN 3 THEN '参加' ELSE '入会 ' || strftime(o_orderdate, '%Y-%m') END AS name FROM orders)"


def _tag_names(orders: DataFrame) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    name = F.when(k == 0, F.concat(F.lit("参加希望 "), F.date_format(d, "yyyy/MM/dd"))).when(k == 1, F.concat(F.lit("参加"), F.date_format(d, "yyyy年M月d日"), F.lit("（木）"))).when(k == 2, F.lit("参加 2025/2/30")).when(k == 3, F.lit("参加"))
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uid"), name.otherwise(F.concat(F.lit("入会 "), F.date_format(d, "yyyy-MM"))).alias("name"))


@query("orders", sql=f"SELECT id, CASE id % 5 WHEN 0 THEN 'hope' WHEN 1 THEN 'attend' END AS kind, CASE WHEN id % 5 < 2 THEN d::DATE END AS date FROM {TAG_NAMES}")
def event_tag(orders):
    return _tag_names(orders).withColumn("t", nested.event_tag("name")).select("id", "t.kind", "t.date")


@query("orders", sql="""SELECT o_custkey AS uid, coalesce(string_agg(DISTINCT strftime(o_orderdate, '%Y年 %m月入会'), '/' ORDER BY strftime(o_orderdate, '%Y年 %m月入会')) FILTER (WHERE o_orderkey % 5 = 4), '') AS months FROM orders GROUP BY 1""")
def join_months(orders):
    lists = _tag_names(orders).groupBy("uid").agg(F.collect_list("name").alias("names"))
    return lists.select("uid", F.array_join(nested.join_months("names"), "/").alias("months"))


@query("orders", sql="""SELECT o_custkey AS uid, o_orderdate::DATE AS date, bool_or(o_orderkey % 5 = 0) AS hope, bool_or(o_orderkey % 5 = 1) AS attend FROM orders WHERE o_orderkey % 5 < 2 GROUP BY 1, 2""")
def event_map(orders):
    lists = _tag_names(orders).groupBy("uid").agg(F.array(F.struct(F.lit(1).alias("id"), F.collect_list(F.struct("name")).alias("tags"))).alias("categories"))
    return lists.select("uid", F.explode(nested.event_map("categories", 1)).alias("date", "found")).select("uid", "date", "found.hope", "found.attend")


def _tagged(orders: DataFrame) -> DataFrame:
    """Each customer's orders as the tags of category 1 (or 2): tag_id the last digit of the key, name the priority."""
    tag = F.struct((F.col("o_orderkey") % 10).alias("tag_id"), F.col("o_orderpriority").alias("name"))
    lists = orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", tag.alias("t")))), lambda x: x["t"]).alias("tags"))
    category = F.struct((F.when(F.col("o_custkey") % 5 > 0, F.lit(1)).otherwise(F.lit(2))).alias("id"), "tags")
    return lists.select(F.col("o_custkey").alias("uid"), F.array(category).alias("categories"))


@query("orders", sql="""SELECT o_custkey AS uid, bool_or(o_orderkey % 10 = 3) AND o_custkey % 5 > 0 AS v1, bool_or(o_orderkey % 10 = 7) AND o_custkey % 5 > 0 AS v2, bool_or(o_orderpriority = '1-URGENT') AND o_custkey % 5 > 0 AS dv1,
    CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN bool_or(o_orderpriority = '5-LOW') THEN '5-LOW' WHEN bool_or(o_orderpriority = '2-HIGH') THEN '2-HIGH' END AS choice FROM orders GROUP BY 1""")
def tag_flags(orders):
    flags = nested.tag_flags("categories", 1, {"v1": 3, "v2": 7}, {"dv1": "1-URGENT"}, ["5-LOW", "2-HIGH"])
    return _tagged(orders).withColumn("f", flags).select("uid", "f.v1", "f.v2", "f.dv1", F.col("f.select").alias("choice"))


@query("orders", sql="""SELECT o_custkey AS uid, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat_ws('/', CASE WHEN bool_or(contains(o_orderpriority, 'LOW')) THEN 'LOW' END, CASE WHEN bool_or(contains(o_orderpriority, 'HIGH')) THEN 'HIGH' END) END AS label FROM orders GROUP BY 1""")
def contract_label(orders):
    return _tagged(orders).select("uid", nested.contract_label("categories", 1, ["LOW", "HIGH"]).alias("label"))


@query("orders", sql="SELECT o_custkey AS uid, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE coalesce(arg_min(o_orderpriority, o_orderkey) FILTER (WHERE contains(o_orderpriority, 'E')), '') END AS tag FROM orders GROUP BY 1")
def consult_tag(orders):
    return _tagged(orders).select("uid", nested.consult_tag("categories", 1, "E").alias("tag"))


@query("events", sql="SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS value FROM events")
def find_key(events):
    """Of some rows the key lies deeper than built-in functions look."""
    shallow = F.concat(F.lit('{"a": [{"k": null, "z": {"k": "deeper"}}, {"b": '), "props", F.lit("}]}"))
    body = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"a": {"b": '), shallow, F.lit("}}"))).otherwise(F.concat(F.lit('[{"z": '), "props", F.lit(', "a": {"k": 0}}]')))
    return nested.with_key(events.withColumn("body", body), "body", "k", "value").select("event_id", "value")


column("inflow_field", "CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END", lambda: nested.inflow_field(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"data": {"route": "'), "event_type", F.lit('"}}'))).otherwise(F.lit("{bad"))), "events", key="event_id", source="events")


def _courses(categories: DataFrame) -> DataFrame:
    block = F.array(F.struct(F.lit("b1").alias("name"), F.lit(True).alias("is_completed")), F.struct(F.concat(F.lit("b"), "_seq").alias("name"), F.lit(None).cast("boolean").alias("is_completed")))
    one = F.struct("_seq", "name", "is_completed", F.col("due").alias("started_at"), F.col("due").alias("scheduled_completed_at"), block.alias("category_blocks"))
    return categories.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("c"))


CURRENT = """(SELECT id, arg_min(name, _seq) FILTER (WHERE _seq > last) AS name, arg_min(due, _seq) FILTER (WHERE _seq > last) AS due, min(_seq) FILTER (WHERE _seq > last) AS seq
    FROM (SELECT *, coalesce(max(_seq) FILTER (WHERE is_completed) OVER (PARTITION BY id), -1) AS last FROM @categories) GROUP BY 1)"""


@query("categories", sql=f"SELECT id, name FROM {CURRENT}")
def current_category(categories):
    return _courses(categories).select("id", nested.current_category("c")["name"].alias("name"))


@query("categories", sql=f"SELECT id, coalesce(name, '全て完了') AS name FROM {CURRENT}")
def current_category_name(categories):
    return _courses(categories).select("id", nested.current_category_name("c").alias("name"))


@query("categories", sql=f"SELECT id, coalesce('b' || seq, '') AS block FROM {CURRENT}")
def current_block_name(categories):
    return _courses(categories).select("id", nested.current_block_name("c").alias("block"))


@query("categories", sql=f"SELECT id, due FROM {CURRENT}")
def current_due(categories):
    return _courses(categories).select("id", nested.current_due("c").alias("due"))


@query("categories", sql=f"SELECT id, due AS started FROM {CURRENT}")
def current_started(categories):
    return _courses(categories).select("id", nested.current_started("c").alias("started"))


@query("categories", sql="SELECT id, name, arg_max(due, _seq) AS due FROM @categories GROUP BY ALL")
def schedule_map(categories):
    return _courses(categories).select("id", F.explode(nested.schedule_map("c")).alias("name", "due"))


def now():
    return F.expr("timestamp_ntz '2001-07-01 00:00:00'")



@query("categories", sql=f"SELECT id, max(due) IS NULL OR max(due) <= TIMESTAMP '2001-06-27' AS stale FROM @categories GROUP BY 1")
def stale_login(categories):
    return categories.groupBy("id").agg(F.max("due").alias("at")).select("id", nested.stale_login("at", now()).alias("stale"))


@query("categories", sql=f"SELECT id, coalesce(name IS NOT NULL AND due <= TIMESTAMP '2001-06-19', false) AS slow FROM {CURRENT}")
def slow_progress(categories):
    rows = _courses(categories).select("id", nested.current_category_name("c").alias("name"), nested.current_started("c").alias("started"), nested.current_due("c").alias("due"))
    return rows.select("id", nested.slow_progress("name", "started", "due", now()).alias("slow"))


@query("categories", sql=f"SELECT id, CASE WHEN name IS NOT NULL AND due <= TIMESTAMP '2001-06-19' AND id % 2 = 0 THEN '声かけ必須' ELSE '' END AS flag FROM {CURRENT}")
def risk_flag(categories):
    rows = _courses(categories).select("id", nested.current_category_name("c").alias("name"), nested.current_started("c").alias("started"), nested.current_due("c").alias("due"))
    status = F.when(F.col("id") % 2 == 0, F.lit("離脱")).otherwise(F.lit("順調"))
    return rows.withColumn("status", status).select("id", nested.risk_flag("status", "due", "name", "started", "due", now()).alias("flag"))


# sources, sinks and streams: written into the shared folder and read back


@query("events", sql="SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 < 2")
def read_envelope(events):
    """Events as JSON answers: wrapped in data, as a bare list, and broken ones, which have no rows."""
    spark, path = events.sparkSession, new_path(events.sparkSession, "pages")
    row = F.struct("event_id", "user_id", "event_type")
    pages = events.groupBy((F.col("event_id") % 3).alias("kind"), F.floor(F.col("event_id") / 300).alias("page")).agg(F.collect_list(row).alias("rows"))
    body = F.when(F.col("kind") == 0, F.to_json(F.struct(F.col("rows").alias("data")))).when(F.col("kind") == 1, F.to_json("rows")).otherwise(F.lit("{bad"))
    pages.select(body.alias("value"), F.concat_ws("-", "kind", "page").alias("part")).repartition("part").write.partitionBy("part").text(path)
    found = ingest.read_envelope(spark, path, [*ingest.LIST_PATHS, *ingest.MEMBER_PATHS, *ingest.LOGIN_PATHS, *ingest.NESTED_PATHS])
    field = lambda name, kind: F.try_variant_get("row", f"$.{name}", kind).alias(name)
    return found.select(field("event_id", "bigint"), field("user_id", "bigint"), field("event_type", "string"))


PAGED = """(SELECT event_id, user_id, k // 2 + 1 AS page, k % 2 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k
    FROM (SELECT event_id, CASE WHEN user_id % 50 <> 7 THEN user_id END AS user_id FROM events)))"""


@query("events", sql=f"SELECT event_id, page * 4294967296 + pos AS _seq FROM {PAGED} WHERE page < CASE WHEN user_id % 3 = 0 THEN 2 ELSE 6 END")
def concat_pages(events):
    """Each user's feed in pages of two, the second of some feeds without rows, five pages a poll at most; some rows tell no user."""
    events = events.withColumn("user_id", F.when(F.col("user_id") % 50 != 7, F.col("user_id")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    pages = events.select("event_id", "user_id", (F.floor(place / 2) + 1).alias("page"), (place % 2).alias("pos"))
    return ingest.concat_pages(pages.filter("coalesce(user_id % 3 > 0, true) or page <> 2"), "page", F.lit(5), feed="user_id").select("event_id", "_seq")


REPORT = "SELECT c_custkey::VARCHAR AS followed_at, c_name AS name, NULL::VARCHAR AS consult, c_nationkey::VARCHAR AS region, c_mktsegment AS path FROM customer"


def _report(customer: DataFrame) -> DataFrame:
    path = new_path(customer.sparkSession, "report") + ".csv"
    # in one column, since a label comes twice, which a writer of tables does not let through
    line = F.concat_ws(",", "c_custkey", "c_name", "c_nationkey", F.lit("first"), "c_mktsegment").alias(" 友達追加時刻 ,名前,third,流入経路,流入経路")
    customer.select(line).write.option("header", True).option("sep", "\u0001").csv(path)
    return ingest.read_report(customer.sparkSession, path)


@query("customer", sql="SELECT c_custkey::VARCHAR AS key, c_name AS name, c_nationkey::VARCHAR AS region FROM customer")
def read_report(customer):
    return _report(customer).toDF("key", "name", "region", "first", "path").drop("first", "path")


@query("customer", sql=REPORT)
def resolve_headers(customer):
    names = {"followed_at": ["追加日", "友達追加時刻"], "name": ["名前"], "consult": ["個別相談"], "region": ["none"], "path": ["流入経路"]}
    return ingest.resolve_headers(_report(customer), names, positional={"region": 2})


@query("pages", "orders", sql="SELECT page_id, 'p' || page_id AS name, 'm' || page_id AS email, coalesce(year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日', '2020年1月2日') AS report_date FROM pages LEFT JOIN orders ON o_orderkey = page_id")
def extract_html_rows(pages, orders):
    """The driver's pages have no tables, so each gets one, with a row that has a date, one without and one too short."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    day = F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("2020-01-02"))
    row = lambda last: F.concat(F.lit("<tr>"), cell(F.concat(F.lit("p"), "page_id")), cell(F.concat(F.lit("<b>m</b>"), "page_id")), *[cell(F.lit("x"))] * 4, cell(last), F.lit("</tr>"))
    table = F.concat("html", F.lit("<table><tbody>"), row(day), row(F.lit("-")), F.lit("<tr>"), cell(day), F.lit("</tr></tbody></table>"))
    rows = pages.join(orders, F.col("page_id") == F.col("o_orderkey"), "left").select("page_id", table.alias("html"))
    return ingest.extract_html_rows(rows).drop("pos")


@query("pages", sql="SELECT page_id, len(regexp_extract_all(html, '<li>\\s*<a ')) AS n FROM pages WHERE n > 0")
def html_links(pages):
    return ingest.html_cells(pages, "html", "page_id", "li", ("a",)).filter(F.size("cells") >= 2).groupBy("page_id").agg(F.count("*").alias("n"))


@query("customer", sql="SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'https://x/' || c_custkey END AS name, 'https://x/' || c_custkey AS url FROM customer")
def read_channel_list(customer):
    path, url = new_path(customer.sparkSession, "channels"), F.concat(F.lit("https://x/"), F.col("c_custkey").cast("string"))
    line = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" , "), url)).when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" ,"), url)).otherwise(url)
    customer.select(line).union(customer.select(F.lit("  "))).write.text(path)
    return ingest.read_channel_list(customer.sparkSession, path)


@query("students", sql="SELECT _seq, name FROM @students")
def write_snapshot(students):
    path = new_path(students.sparkSession, "snapshot")
    publish.write_snapshot(students.limit(3), path)
    publish.write_snapshot(students.select("_seq", "name"), path)
    return students.sparkSession.read.parquet(path)


@query("students", sql="""SELECT CASE WHEN trim(motivation) IN ('BUILDING', 'MACHINERY') THEN trim(motivation) ELSE 'unknown' END AS motivation, count(*) AS n, count(id) AS n_id, 0::BIGINT AS n_status FROM @students GROUP BY 1
    UNION ALL SELECT 'all', count(*), count(id), 0 FROM @students""")
def write_partitioned_csv(students):
    spark, path = students.sparkSession, new_path(students.sparkSession, "csv")
    publish.write_partitioned_csv(students, path, order=["BUILDING", "none", "MACHINERY"])
    counts = [F.count("*").alias("n"), F.count("id").alias("n_id"), F.count("status").alias("n_status")]
    by = spark.read.option("header", True).csv(f"{path}/by_motivation").groupBy(F.col("group").alias("motivation")).agg(*counts)
    return by.union(spark.read.option("header", True).csv(f"{path}/all").agg(F.lit("all"), *counts))


@query("students", sql="SELECT _seq, name FROM @students")
def copy_table(students):
    spark = students.sparkSession
    source, target, nothing = (new_path(spark, n) for n in ("source", "target", "empty"))
    publish.write_snapshot(students.select("_seq", "name"), source)
    publish.write_snapshot(students.select("_seq", "name").filter("false"), nothing)
    publish.copy_table(spark, source, target)
    publish.copy_table(spark, nothing, target)
    return spark.read.parquet(target)


@query("mentions", sql="SELECT CASE WHEN id % 2 = 0 THEN sender_id ELSE '' END AS recipient, CASE WHEN id % 2 = 0 THEN 'push' ELSE 'broadcast' END AS mode, id AS seq, 't' || id AS text FROM @mentions WHERE NOT is_read")
def write_outbox(mentions):
    path = new_path(mentions.sparkSession, "outbox")
    publish.write_outbox(_messages(filters.unread_mentions(mentions)), path)
    return mentions.sparkSession.read.parquet(path)


def _messages(mentions: DataFrame) -> DataFrame:
    recipient = F.when(F.col("id") % 2 == 0, F.col("sender_id")).otherwise(F.lit(""))
    return mentions.select(recipient.alias("recipient"), F.col("id").alias("seq"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))


def _polled(df: DataFrame, polls: list[Column], start: Callable[[DataFrame, str], StreamingQuery]) -> None:
    """Land the rows of one poll after the other, and run a streaming query over what is new after each, with one checkpoint."""
    landed, checkpoint = new_path(df.sparkSession, "landed"), new_path(df.sparkSession, "progress")
    for poll in polls:
        df.filter(poll).write.mode("append").parquet(landed)
        start(df.sparkSession.readStream.schema(df.schema).parquet(landed), checkpoint).awaitTermination()


# polls every two hours from 7 to 23, each of which sees what the ten hours before it brought, twenty chats a page
SEEN = """SELECT id, channel, sender_id, created_at, polled_at, row_number() OVER (PARTITION BY polled_at ORDER BY created_at DESC, id) - 1 AS k FROM @mentions
    JOIN (SELECT unnest(generate_series((SELECT date_trunc('day', min(created_at)) FROM @mentions), (SELECT max(created_at) + INTERVAL 2 DAY FROM @mentions), INTERVAL 1 HOUR)) AS polled_at)
    ON created_at BETWEEN polled_at - INTERVAL 10 HOUR AND polled_at WHERE hour(polled_at) % 2 = 1 AND hour(polled_at) >= 7 AND channel = 'click'"""
WINDOW_START = "CASE WHEN hour(polled_at) = 7 THEN date_trunc('day', polled_at) - INTERVAL 2 HOUR ELSE polled_at - INTERVAL 2 HOUR END"
WINDOW_STOP = "CASE WHEN hour(polled_at) = 7 THEN date_trunc('day', polled_at) + INTERVAL 7 HOUR ELSE polled_at END"


def _polls(mentions: DataFrame) -> DataFrame:
    """Times of the polls over all days that have mentions."""
    ends = mentions.agg(F.date_trunc("DAY", F.min("created_at")).cast("timestamp_ntz").alias("a"), (F.max("created_at") + F.expr("interval 2 days")).alias("b"))
    times = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("polled_at"))
    return times.filter("hour(polled_at) % 2 = 1 and hour(polled_at) >= 7")


def _pages(mentions: DataFrame) -> DataFrame:
    """What each poll sees, page by page."""
    seen = _polls(mentions).select("polled_at", (F.col("polled_at") - F.expr("interval 10 hours")).alias("from"), F.col("polled_at").alias("to"))
    rows = joins.in_windows(mentions.filter("channel = 'click'"), seen, "created_at")
    k = F.row_number().over(Window.partitionBy("polled_at").orderBy(F.desc("created_at"), "id")) - 1
    return rows.select("id", "channel", "sender_id", "created_at", "polled_at", (F.floor(k / 20) + 1).alias("page"), (k % 20).alias("pos"))


@query("mentions", sql=f"""WITH seen AS (SELECT *, k // 20 + 1 AS page, {WINDOW_START} AS start, {WINDOW_STOP} AS stop FROM ({SEEN})),
    ends AS (SELECT polled_at, min(page) AS last FROM (SELECT polled_at, page FROM seen GROUP BY ALL HAVING min(created_at) < min(start)) GROUP BY 1)
    SELECT id, polled_at, page, page * 4294967296 + k % 20 AS _seq FROM seen LEFT JOIN ends USING (polled_at) WHERE page <= 5 AND page <= coalesce(last, page)""")
def polled_pages(mentions):
    return ingest.polled_pages(_pages(mentions), ts="created_at").select("id", "polled_at", "page", "_seq")


@query("mentions", sql=f"""SELECT id, polled_at FROM @mentions JOIN (SELECT unnest(generate_series((SELECT date_trunc('day', min(created_at)) FROM @mentions), (SELECT max(created_at) + INTERVAL 2 DAY FROM @mentions), INTERVAL 1 HOUR)) AS polled_at)
    ON created_at BETWEEN {WINDOW_START} AND {WINDOW_STOP} WHERE hour(polled_at) % 2 = 1 AND hour(polled_at) >= 7""")
def in_windows(mentions):
    """Which polls see a mention in their window: a range join."""
    polls = _polls(mentions)
    windows = polls.select("polled_at", dates.poll_window("polled_at").alias("w")).select("polled_at", "w.from", "w.to")
    return joins.in_windows(mentions, windows, "created_at").select("id", "polled_at")


@query("mentions", sql=f"""WITH seen AS (SELECT *, k // 20 + 1 AS page, {WINDOW_START} AS start, {WINDOW_STOP} AS stop FROM ({SEEN})),
    ends AS (SELECT polled_at, min(page) AS last FROM (SELECT polled_at, page FROM seen GROUP BY ALL HAVING min(created_at) < min(start)) GROUP BY 1),
    kept AS (SELECT id, sender_id FROM seen LEFT JOIN ends USING (polled_at) WHERE page <= 5 AND page <= coalesce(last, page) AND created_at BETWEEN start AND stop GROUP BY ALL)
    SELECT CASE WHEN id % 2 = 0 THEN sender_id ELSE '' END AS recipient, CASE WHEN id % 2 = 0 THEN 'push' ELSE 'broadcast' END AS mode, id AS seq, 't' || id AS text FROM kept""")
def stream_chats(mentions):
    """Three runs: the polls of every third hour of the day come in one, all that came before come again in the next."""
    spark, path = mentions.sparkSession, new_path(mentions.sparkSession, "outbox")
    pages, part = ingest.polled_pages(_pages(mentions), ts="created_at"), F.hour("polled_at") % 3
    start = lambda df, checkpoint: feeds.to_outbox(feeds.stream_chats(df, "click", ts="created_at"), path, checkpoint, messages=_messages)
    _polled(pages, [part == 0, part <= 1, F.lit(True)], start)
    return publish.read_outbox(spark, path)


@query("mentions", sql="""SELECT id, 'a' || (id % 2) AS account, created_at, row_number() OVER (PARTITION BY id % 3 ORDER BY id % 2, created_at NULLS FIRST, id) - 1 AS seq FROM @mentions WHERE NOT is_read""")
def stream_unread(mentions):
    """Three runs, mentions of all days in each: what a run has seen comes again in the next, and is sent once, oldest first by account."""
    spark, path = mentions.sparkSession, new_path(mentions.sparkSession, "unread")
    rows = mentions.select("id", F.concat(F.lit("a"), (F.col("id") % 2).cast("string")).alias("account"), "created_at", "is_read")
    order = [F.asc("account"), *ranking.unread_order()]
    as_message = lambda df: df.select(F.col("account").alias("recipient"), "seq", F.concat_ws("|", "id", F.col("created_at").cast("string")).alias("text"))
    start = lambda df, checkpoint: feeds.to_outbox(feeds.stream_unread(df, ts="created_at"), path, checkpoint, order, as_message)
    _polled(rows, [F.col("id") % 3 == 0, F.col("id") % 3 <= 1, F.lit(True)], start)
    field = lambda k, kind: F.get(F.split("text", r"\|"), F.lit(k)).cast(kind)
    return publish.read_outbox(spark, path).select(field(0, "bigint").alias("id"), F.col("recipient").alias("account"), field(1, "timestamp_ntz").alias("created_at"), "seq")


@query("leads", sql=monthly_sql("leads", "followed_at", IN_YEAR, n="true", consult="trim(coalesce(consult, '')) <> ''", contract="trim(coalesce(contract, '')) <> ''"))
def stream_monthly(leads):
    """Three runs that each change all months; what is out in the end is dense over one year."""
    spark, path = leads.sparkSession, new_path(leads.sparkSession, "monthly")
    start = lambda df, checkpoint: feeds.totals_to_table(feeds.stream_monthly(df, "followed_at", ["consult", "contract"]), path, checkpoint)
    _polled(leads.select("_seq", "followed_at", "consult", "contract"), [F.col("_seq") % 3 == k for k in range(3)], start)
    return feeds.read_totals(spark, path, YEAR, 1)
