"""Column functions on tags, course categories and nested JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import col

# Words of tag names and course states. The patterns of tag names in event_tag and join_months are fixed, too.
HOPE, ATTEND, JOINED = "参加希望", "参加", "入会"
ALL_DONE, INTERN, LEFT_STATUS, CALL_OUT = "全て完了", "人工インターン", "離脱", "声かけ必須"
STALE_DAYS, SLOW_DAYS = 4, 12


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def event_tag(c) -> Column:
    """struct(kind, date) of a tag name that nfkc() has cleaned: hope or attend, and a date.

    A name that ends in a date decides alone, also if there is no such day; else the first date after the word does. Null
    if there is neither.
    """
    name = col(c)
    strict = rf"({HOPE}|{ATTEND})\s*([0-9]{{4}})[/\-.\s年]([0-9]{{1,2}})[/\-.\s月]([0-9]{{1,2}})(?:日|[^0-9].*)?\s*$"
    loose = rf"({HOPE}|{ATTEND})\s*([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})"

    def read(pattern: str) -> Column:
        date = F.try_to_date(F.concat_ws("-", *(_part(name, pattern, k) for k in (2, 3, 4))), "yyyy-M-d")
        kind = F.when(_part(name, pattern, 1) == HOPE, F.lit("hope")).otherwise(F.lit("attend"))
        return F.when(date.isNotNull(), F.struct(kind.alias("kind"), date.alias("date")))

    return F.when(name.rlike(strict), read(strict)).when(name.rlike(loose), read(loose))


def join_months(names) -> Column:
    """Months of joining in an array of cleaned tag names, each once, in order, as '2025年 07月入会'."""
    digits = r"(\d{4})\s*[年/\-.]\s*(\d{1,2})"
    # pattern, group of the year, group of the month; the first that matches decides
    forms = [
        (r"(\d{4})\s*年\s*(\d{1,2})\s*月", 1, 2),
        (r"(\d{4})\s*[-/.]\s*(\d{1,2})", 1, 2),
        (r"(\d{1,2})\s*[-/.]\s*(\d{4})", 2, 1),
        (rf"{JOINED}.*?{digits}", 1, 2),
        (rf"{digits}.*?{JOINED}", 1, 2),
    ]

    def month(name: Column) -> Column:
        found = None
        for pattern, y, m in forms:
            year, mon = _part(name, pattern, y).cast("int"), _part(name, pattern, m).cast("int")
            value = F.when((year > 1900) & mon.between(1, 12), F.format_string(f"%04d年 %02d月{JOINED}", year, mon))
            found = F.when(name.rlike(pattern), value) if found is None else found.when(name.rlike(pattern), value)
        return F.when(F.contains(name, F.lit(JOINED)), found)

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(col(names), month))))


def tags_of(categories, category_id: int) -> Column:
    """The tags of the first category with an id; null if there is none."""
    return F.get(F.filter(col(categories), lambda c: c["id"] == category_id), F.lit(0))["tags"]


def contract_label(categories, category_id: int, paid: list[str]) -> Column:
    """Paid tags, found as parts of tag names and in the order of `paid`, then months of joining, joined by /; '' without the category."""
    names = F.transform(tags_of(categories, category_id), lambda t: t["name"])
    within = lambda word: F.exists(names, lambda n: F.contains(n, F.lit(word)))
    marks = F.array_compact(F.array(*(F.when(within(word), F.lit(word)) for word in paid)))
    return F.coalesce(F.array_join(F.array_distinct(F.concat(marks, join_months(names))), "/"), F.lit(""))


def event_map(categories, category_id: int) -> Column:
    """Map of date to struct(hope, attend) over the tags of a category, whose names nfkc() has cleaned; empty without the category."""
    tags = F.coalesce(tags_of(categories, category_id), F.filter(F.get(col(categories), F.lit(0))["tags"], lambda t: F.lit(False)))
    found = F.filter(F.transform(tags, lambda t: event_tag(t["name"])), lambda t: t.isNotNull())
    days = F.array_sort(F.array_distinct(F.transform(found, lambda t: t["date"])))
    has = lambda d, kind: F.exists(found, lambda t: (t["date"] == d) & (t["kind"] == kind)).alias(kind)
    pairs = F.transform(days, lambda d: F.struct(d.alias("key"), F.struct(has(d, "hope"), has(d, "attend")).alias("value")))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<date,struct<hope:boolean,attend:boolean>>"))


def consult_tag(categories, category_id: int, keyword: str) -> Column:
    hits = F.filter(tags_of(categories, category_id), lambda t: F.contains(t["name"], F.lit(keyword)))
    return F.coalesce(F.get(hits, F.lit(0))["name"], F.lit(""))


def tag_flags(categories, category_id: int, ids: dict[str, int], digests: dict[str, str], choices: list[str]) -> Column:
    """struct of a Boolean for each tag id and each digest name, and the first of the choices, in their order, that is a tag."""
    tags = tags_of(categories, category_id)
    has = lambda field, value: F.coalesce(F.exists(tags, lambda t: t[field] == value), F.lit(False))
    flags = [has("tag_id", v).alias(k) for k, v in ids.items()] + [has("name", v).alias(k) for k, v in digests.items()]
    return F.struct(*flags, F.coalesce(*(F.when(has("name", n), F.lit(n)) for n in choices)).alias("select"))


def _members(text: Column) -> Column:
    """(name, text, kind) of the members of a JSON object, or of a list, without names, in the order they stand in; null for all else."""
    names = F.map_entries(F.from_json(text, "map<string,string>"))
    items = F.transform(F.from_json(text, "array<string>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    kinds = F.coalesce(F.map_values(F.from_json(text, "map<string,variant>")), F.from_json(text, "array<variant>"))
    member = lambda e, v: F.struct(e["key"].alias("name"), e["value"].alias("text"), F.coalesce(F.schema_of_variant(v), F.lit("VOID")).alias("kind"))
    return F.zip_with(F.coalesce(names, items), kinds, member)


def _nested(kind: Column) -> Column:
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def near_key(c, key: str, levels: int = 3) -> Column:
    """(value, sure): what find_key() finds in a JSON string's first `levels` levels of objects and lists, by built-in functions alone.

    sure is false where find_key() may find something else: the search would come to objects or lists below these levels
    first, what is found is neither a string, a whole number nor true or false, or Spark can't read the string.
    """
    result = lambda done, value, sure: F.struct(done.alias("done"), value.cast("string").alias("value"), sure.alias("sure"))
    yes, no, null = F.lit(True), F.lit(False), F.lit(None)

    def look(text: Column, level: int) -> Column:
        def at(members: Column) -> Column:
            own = F.filter(members, lambda m: m["name"] == key)
            below = F.filter(members, lambda m: _nested(m["kind"]))
            hit = F.get(own, F.lit(0))
            plain = hit["kind"].isin("STRING", "BIGINT", "BOOLEAN")
            # null where the key is does not end the search, but that of its object
            found = F.when(hit["kind"] == "VOID", result(no, null, yes)).otherwise(result(yes, F.when(plain, hit["text"]), plain))
            if level == levels:
                deeper = result(F.size(below) > 0, null, F.size(below) == 0)
            else:
                ends = F.filter(F.transform(below, lambda m: look(m["text"], level + 1)), lambda r: r["done"])
                deeper = F.coalesce(F.get(ends, F.lit(0)), result(no, null, yes))
            return F.when(F.size(own) > 0, found).otherwise(deeper)

        # a list of one, so that the members are read once
        return F.get(F.transform(F.array(_members(text)), at), F.lit(0))

    kind = F.schema_of_variant(F.try_parse_json(col(c)))
    found = F.when(_nested(kind), look(col(c), 1))
    unread = kind.isNull() & (F.trim(F.coalesce(col(c), F.lit(""))) != "")
    return F.struct(found["value"].alias("value"), (~unread & F.coalesce(found["sure"], yes)).alias("sure"))


def with_key(df: DataFrame, column: str, key: str, out: str, levels: int = 3) -> DataFrame:
    """df with what find_key() finds in a column of JSON strings.

    Built-in functions look in the first `levels` levels; of the strings for which that is not enough the different ones go through Python, and are joined back."""
    rows = df.withColumn("_near", near_key(column, key, levels)).withColumn("_other", F.when(~F.col("_near.sure"), F.col(column)))
    known = rows.select("_other").filter("_other is not null").distinct().withColumn("_found", find_key("_other", key))
    return rows.join(known, "_other", "left").withColumn(out, F.when(F.col("_near.sure"), F.col("_near.value")).otherwise(F.col("_found"))).drop("_near", "_other", "_found")


def find_key(c, key: str) -> Column:
    """The first value of a key anywhere in a JSON string, depth first; what isn't a string is given as JSON.

    An object that has the key is not searched any deeper; if its value is null, the search goes on after the object.
    Null for null, for bad JSON and for JSON too deep to read. Runs in Python on each row; see with_key()."""

    def search(value):
        left = [value]
        while left:
            value = left.pop()
            if isinstance(value, dict) and key in value:
                if value[key] is not None:
                    return value[key]
            elif isinstance(value, (dict, list)):
                left += reversed(list(value.values()) if isinstance(value, dict) else value)
        return None

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                found = search(json.loads(text)) if text else None
                return found if isinstance(found, str) or found is None else json.dumps(found)
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return find(col(c))


# Where a page tells how a person came.
INFLOW_PATHS = ["$.inflow", "$.flow", "$.route", "$.entry_route", "$.data.inflow", "$.data.route", "$.infoBasic.inflow"]


def inflow_field(c) -> Column:
    """The first of INFLOW_PATHS that a JSON string has, else ''."""
    body = F.try_parse_json(col(c))
    return F.coalesce(*(F.try_variant_get(body, p, "string") for p in INFLOW_PATHS), F.lit(""))


def current_category(categories) -> Column:
    """The category after the last completed one; if none is completed, the first that isn't. Null after the last and for no categories."""
    done = F.transform(col(categories), lambda c, i: F.when(c["is_completed"].eqNullSafe(F.lit(True)), i).otherwise(F.lit(-1)))
    last = F.coalesce(F.array_max(done), F.lit(-1))
    return F.get(col(categories), last + 1)


def current_category_name(categories) -> Column:
    return F.coalesce(current_category(categories)["name"], F.lit(ALL_DONE))


def current_block_name(categories) -> Column:
    blocks = current_category(categories)["category_blocks"]
    open_blocks = F.filter(blocks, lambda b: ~b["is_completed"].eqNullSafe(F.lit(True)))
    return F.coalesce(F.get(open_blocks, F.lit(0))["name"], F.get(blocks, F.lit(0))["name"], F.lit(""))


def current_due(categories) -> Column:
    return current_category(categories)["scheduled_completed_at"]


def current_started(categories) -> Column:
    return current_category(categories)["started_at"]


def schedule_map(categories) -> Column:
    """Map of category name to due date; blank names are left out, of equal names the last one counts."""
    named = F.filter(col(categories), lambda c: F.coalesce(F.trim(c["name"]), F.lit("")) != "")
    names = F.array_distinct(F.transform(named, lambda c: c["name"]))
    due = lambda n: F.element_at(F.filter(named, lambda c: c["name"] == n), -1)["scheduled_completed_at"]
    return F.map_from_arrays(names, F.transform(names, due))


def stale_login(ts, now: Column) -> Column:
    return col(ts).isNull() | (col(ts) <= now - F.expr(f"interval {STALE_DAYS} days"))


def slow_progress(category, started, due, now: Column) -> Column:
    """So many days since the start of a category, or since its due date if it has no start."""
    name = F.coalesce(col(category), F.lit(""))
    since = F.coalesce(col(started), col(due))
    late = F.coalesce(since <= now - F.expr(f"interval {SLOW_DAYS} days"), F.lit(False))
    return ~name.isin("", INTERN, ALL_DONE) & late


def risk_flag(status, latest_login, category, started, due, now: Column) -> Column:
    risky = stale_login(latest_login, now) & (col(status) == LEFT_STATUS) & slow_progress(category, started, due, now)
    return F.when(risky, F.lit(CALL_OUT)).otherwise(F.lit(""))
