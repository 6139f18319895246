"""Column functions on strings: cleaning, ids, links, cells and messages."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that count as no value, and marks of the reports.
NO_VALUE_WORDS = ["", "-", "—", "――", "null", "NULL", "Null", "未設定"]
MARK = "◯"
MESSAGE_SIZE = 2000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_int(c) -> Column:
    """The integer that a string starts with after white space, else 0; also 0 for null and beyond 64 bits."""
    return F.coalesce(F.regexp_extract(col(c), r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def uid_from_link(c) -> Column:
    """The last part of a path that isn't empty, as an integer; 0 for anything else."""
    return prefix_int(F.regexp_extract(col(c), "([^/]+)/*$", 1))


def null_if_blank(c) -> Column:
    """Null for empty strings and those of Unicode white space."""
    return F.when(~col(c).rlike(r"(?U)^\s*$"), col(c))


def null_if_blankish(c) -> Column:
    """Null for strings that stand for no value, with ASCII white space around them or not."""
    return F.when(~F.regexp_replace(col(c), r"^[\s\x00]+|[\s\x00]+$", "").isin(NO_VALUE_WORDS), col(c))


def pick_landing(landing, qr_code) -> Column:
    return F.coalesce(null_if_blankish(landing), null_if_blankish(qr_code))


def nfkc(c) -> Column:
    """Unicode NFKC without white space at the ends. Spark has no such function, so this runs in Python on each row; see with_nfkc()."""

    @F.pandas_udf("string")
    def normalize(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKC").str.strip()

    return normalize(col(c))


# Characters of full width that become ASCII one by one, and those that are ASCII already.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + " "
PLAIN = "^[\\x00-\\x7f\\uff01-\\uff5e\\u3000]*$"


def with_nfkc(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with a column of the NFKC of another, without white space at the ends; nulls stay.

    ASCII text, with characters of full width or not, is translated by built-in functions. Of all else the different values go
    through Python once each, and are joined back; a value that very many rows have is sent there from each task once.
    """
    plain = F.col(column).rlike(PLAIN)
    ascii_ = F.regexp_replace(F.translate(F.col(column), FULL_WIDTH, HALF_WIDTH), r"^[\x09-\x0d\x1c-\x20]+|[\x09-\x0d\x1c-\x20]+$", "")
    rows = df.withColumn("_other", F.when(~plain, F.col(column)))
    known = rows.select("_other").filter("_other is not null").distinct().withColumn("_nfkc", nfkc("_other"))
    return rows.join(known, "_other", "left").withColumn(out, F.when(plain, ascii_).otherwise(F.col("_nfkc"))).drop("_other", "_nfkc")


def normalize_name(c) -> Column:
    """Without what is in brackets of full or half width and without white space, U+3000 included; null is ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"（.*?）|\(.*?\)", ""), "[\\s　]+", "")


def normalize_code(c) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit(""))))


def sheet_url(c) -> Column:
    """The first spreadsheet address in a text, with https:// if it has no scheme; null if there is none."""
    found = F.regexp_extract(col(c), r"(?i)(?:https?://)?docs\.google\.com/spreadsheets/d/[^\s\"'>]+", 0)
    return F.when(found.startswith("http"), found).when(found != "", F.concat(F.lit("https://"), found))


def goal_url(c, base: str) -> Column:
    """The first `<base>/weekly_goals?user_id=<digits>` of a text, in any case, with one slash after the base as it is given."""
    tail = F.regexp_extract(col(c), rf"(?i){re.escape(base)}/?(weekly_goals\?user_id=\d+)", 1)
    return F.when(tail != "", F.concat(F.lit(base + "/"), tail))


def profile_url(c, host: str) -> Column:
    """The first my-page address of a host in a text, up to white space."""
    found = F.regexp_extract(col(c), rf"(?i)https?://{re.escape(host)}/basic/friendlist/my_page/\S+", 0)
    return F.when(found != "", found)


def doc_id_from_url(c, strict: bool = False) -> Column:
    """The id after /spreadsheets/d/, else the string itself. With strict, anything but a whole spreadsheet address raises an error."""
    if strict:
        found = F.regexp_extract(col(c), "^https?://docs[.]google[.]com/spreadsheets/d/([A-Za-z0-9_-]+)", 1)
        return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no spreadsheet address: "), F.coalesce(col(c), F.lit("null")))))
    found = F.regexp_extract(col(c), "/spreadsheets/d/([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", found).otherwise(col(c))


def handle_from_url(c) -> Column:
    found = F.regexp_extract(col(c), "/@([^/?]+)", 1)
    return F.when(found != "", found)


def first_url(c) -> Column:
    found = F.regexp_extract(col(c), r"https?://\S+", 0)
    return F.when(found != "", found)


def landing_code(c) -> Column:
    """The uLand code of the first address in a text, null if that one has none."""
    code = F.regexp_extract(first_url(c), "uLand=([A-Za-z0-9]+)", 1)
    return F.when(code != "", code)


def performer(c, names: dict[str, str], default: str) -> Column:
    """The name that stands for the landing code of a text, the default for none. For more codes than fit into a plan join map_dimension() instead."""
    if not names:
        return F.lit(default)
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(known, landing_code(c)), F.lit(default))


def thumbnail(c) -> Column:
    """The address of the largest picture in a struct of high, medium and default."""
    return F.coalesce(*(col(c)[size]["url"] for size in ("high", "medium", "default")))


def format_comment(c) -> Column:
    """One line, broken after Japanese full stops and commas, without white space at the end; null is ''."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "\r", ""), "\n", " ")
    return F.regexp_replace(F.regexp_replace(flat, "([。、])", "$1\n"), r"[\s\x00]+$", "")


def _quoted(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit('""'))


def link_cell(url, label) -> Column:
    """A link formula; without an address the label alone, '' if that is null."""
    text = F.coalesce(col(label), F.lit(""))
    cell = F.concat(F.lit('=HYPERLINK("'), _quoted(col(url)), F.lit('","'), _quoted(text), F.lit('")'))
    return F.when(null_if_blank(url).isNull(), text).otherwise(cell)


def image_cell(url) -> Column:
    return F.when(null_if_blank(url).isNull(), F.lit("")).otherwise(F.concat(F.lit('=IMAGE("'), _quoted(col(url)), F.lit('", 1)')))


def flag_mark(c, mark: str = MARK) -> Column:
    return F.when(col(c), F.lit(mark)).otherwise(F.lit(""))


def percent_text(c) -> Column:
    return F.when(col(c).isNull(), F.lit("")).otherwise(F.concat(col(c).cast("string"), F.lit("%")))


def chunk_text(c, size: int = MESSAGE_SIZE) -> Column:
    """Pieces of so many characters; an empty or null string has none."""
    text = F.coalesce(col(c), F.lit(""))
    pieces = F.ceil(F.char_length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1), lambda k: F.substring(text, k * size + 1, F.lit(size)))
    return F.when(pieces > 0, cut).otherwise(F.array().cast("array<string>"))


def _message(channel, author, sent: Column, targets: Column | None, url: Column, text) -> Column:
    # The labels of the messages.
    head = F.concat(F.lit("【チャンネル名: "), F.coalesce(col(channel), F.lit("")), F.lit("】投稿者: "), F.coalesce(author, F.lit("")))
    lines = [head, F.concat(F.lit("投稿日時: "), F.date_format(sent, "yyyy-MM-dd HH:mm"))]
    if targets is not None:
        lines.append(F.when(targets != "", F.concat(F.lit("メンション: "), targets)))
    body = F.concat_ws("\n", *lines, F.concat(F.lit("URL: "), url))
    return F.concat(body, F.lit("\n\n"), F.coalesce(col(text), F.lit("")), F.lit("\n"))


def mention_message(channel, author, sent, targets, text, url: str) -> Column:
    """A mention as a message; targets is an array of names, left out if it is empty."""
    return _message(channel, col(author), col(sent), F.coalesce(F.array_join(col(targets), ", "), F.lit("")), F.lit(url), text)


def chat_message(channel, channel_id, user_name, sender_id, sent, text, url: str, default_channel: str) -> Column:
    address = F.concat(F.lit(f"{url}?channel_id="), F.coalesce(col(channel_id), F.lit(default_channel)))
    return _message(channel, F.coalesce(col(user_name), col(sender_id)), col(sent), None, address, text)


def mask(c) -> Column:
    """First and last four characters; strings shorter than eight stay."""
    return F.when(F.char_length(col(c)) < 8, col(c)).otherwise(F.concat(F.left(col(c), F.lit(4)), F.lit("..."), F.right(col(c), F.lit(4))))


def category_due_text(category, due) -> Column:
    filled = lambda c: F.coalesce(col(c), F.lit("")) != ""
    return F.when(filled(category) & filled(due), F.concat(col(category), F.lit(" / "), col(due))).otherwise(F.lit(""))


def contains_any(c, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in terms), F.lit(False))
