"""Merges and look-ups. All are equi-joins; Spark chooses how to run them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_name, null_if_blank, null_if_blankish
from ledgerloom.operators.ranking import first_row_per_key


def append_unmatched(friends: DataFrame, blocks: DataFrame) -> DataFrame:
    """Friends and, after them, the blocks of people who are no friends."""
    return friends.unionByName(blocks.join(friends, "uid", "left_anti"), allowMissingColumns=True)


def merge_blocks(friends: DataFrame, blocks: DataFrame) -> DataFrame:
    """Friends (_seq, uid, name, followed_at, blocked_at, is_blocked, landing) with blocks (uid, name, blocked_at) put in.

    blocks has one row a uid (see latest_per_key); those without a time or with a uid of 0 or less are left out. The first
    friend row of a uid gets the time and the flag, and the name if it has none. People who are no friends are added.
    """
    known = blocks.filter(F.col("blocked_at").isNotNull() & (F.col("uid") > 0))
    first = first_row_per_key(friends, "uid").join(known.select("uid", F.col("name").alias("b_name"), F.col("blocked_at").alias("b_at")), "uid", "left")
    hit = F.col("b_at").isNotNull()
    first = first.select(
        "_seq", "uid",
        F.when(hit, F.coalesce(null_if_blank("name"), "b_name", "name")).otherwise(F.col("name")).alias("name"),
        "followed_at", F.coalesce("b_at", "blocked_at").alias("blocked_at"),
        F.when(hit, F.lit(1)).otherwise(F.col("is_blocked")).alias("is_blocked"), "landing",
    )
    rest = friends.join(first.select("uid", "_seq"), ["uid", "_seq"], "left_anti").select(first.columns)
    new = known.select("uid", "name", "blocked_at", F.lit(1).alias("is_blocked"), F.lit("").alias("landing"))
    return append_unmatched(first.unionByName(rest), new)


def enrich_left(df: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """df with the columns of detail, one row a key, null where it has none."""
    return df.join(detail, key, "left")


def fill_from_profile(df: DataFrame) -> DataFrame:
    """qr_code, followed_at and landing_name from the profile columns p_qr_code, p_followed_at and p_landing_name: the first where given, the others where missing."""
    return df.withColumns({
        "qr_code": F.coalesce(null_if_blank("p_qr_code"), "qr_code"),
        "followed_at": F.coalesce(null_if_blank("followed_at"), "p_followed_at", "followed_at"),
        "landing_name": F.coalesce(null_if_blankish("landing_name"), null_if_blankish("p_landing_name"), "landing_name"),
    }).drop("p_qr_code", "p_followed_at", "p_landing_name")


def fallback_join(df: DataFrame, dim: DataFrame, value: str = "report_date") -> DataFrame:
    """df (name, email, ...) with a value of dim (_seq, name, email, value): by e-mail, else by cleaned name, else by name; of equal keys the last row counts."""
    last = lambda key: dim.filter(key.isNotNull() & (key != "")).groupBy(key.alias("k")).agg(F.max_by(value, "_seq").alias("v"))
    out = df
    for tag, key in (("e", F.col("email")), ("n", normalize_name("name")), ("r", F.col("name"))):
        side = last(key).select(F.col("k").alias(f"_k{tag}"), F.col("v").alias(f"_v{tag}"))
        own = normalize_name("name") if tag == "n" else F.col("email" if tag == "e" else "name")
        out = out.join(side, own == F.col(f"_k{tag}"), "left").drop(f"_k{tag}")
    return out.withColumn(value, F.coalesce("_ve", "_vn", "_vr")).drop("_ve", "_vn", "_vr")


def dual_key_sum_join(df: DataFrame, by_id: DataFrame, by_name: DataFrame, dedupe: bool = False) -> DataFrame:
    """df (id, name, ...) with n_mentions: the count of its id plus that of its cleaned name; with dedupe, the larger of the two."""
    out = df.withColumn("_name", normalize_name("name"))
    out = out.join(by_id.select("id", F.col("n").alias("_a")), "id", "left").join(by_name.select(F.col("name").alias("_name"), F.col("n").alias("_b")), "_name", "left")
    a, b = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    return out.withColumn("n_mentions", F.greatest(a, b) if dedupe else a + b).drop("_a", "_b", "_name")


def map_dimension(df: DataFrame, key: str, mapping: dict[str, str], default: str, out: str) -> DataFrame:
    """df with the value that a small, given mapping has for a key, else the default.

    The mapping becomes literals of the plan: for some dozens of codes. ValueError beyond 1,000, which are a table to join.
    """
    if len(mapping) > 1000:
        raise ValueError("a mapping of so many keys is a table: join it")
    pairs = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return df.withColumn(out, F.coalesce(F.try_element_at(pairs, F.col(key)), F.lit(default)))


def videos_of_channels(channels: DataFrame, videos: DataFrame) -> DataFrame:
    """Videos with their channel's name; channels that weren't resolved have none."""
    return channels.filter("channel_id is not null").join(videos, "channel_id")


def backfill_motivation(df: DataFrame, detail: DataFrame, key: str, codes: list[str]) -> DataFrame:
    """motivation, where blank, from the first filled of detail's motivation, course_motivation and class_motivation, if it is one of the codes."""
    fields = ["motivation", "course_motivation", "class_motivation"]
    found = F.coalesce(*(null_if_blank(f"d_{f}") for f in fields))
    side = detail.select(key, *(F.col(f).alias(f"d_{f}") for f in fields))
    blank: Column = null_if_blank("motivation").isNull()
    out = df.join(side, key, "left")
    return out.withColumn("motivation", F.when(blank & found.isin(codes), found).otherwise(F.col("motivation"))).drop(*(f"d_{f}" for f in fields))


def in_windows(df: DataFrame, windows: DataFrame, ts: str, start: str = "from", stop: str = "to", every: str = "HOUR") -> DataFrame:
    """Each row of df with each of the windows (start, stop, ...) that it lies in, both ends in.

    An equi-join by the hours (or days) that a window covers, then exactly; rows without a time, and windows with a null end
    or the ends the wrong way round, match nothing. A window costs a row for each hour it covers.
    """
    step = F.expr(f"interval 1 {every.lower()}")
    hours = F.sequence(F.date_trunc(every, start), F.date_trunc(every, stop), step)
    covered = windows.filter(F.col(start) <= F.col(stop)).withColumn("_hour", F.explode(hours))
    found = df.withColumn("_hour", F.date_trunc(every, ts)).join(covered, "_hour")
    return found.filter(F.col(ts).between(F.col(start), F.col(stop))).drop("_hour")
