"""Spelling variants: words of a corpus that differ by one code point, and the usual form of each.

Two words at a distance of one have a half in common: the first half of a word or the last is left as it is, and the error
lies in the other. So words meet by exact halves, and each task gets the words that share a range of hashed halves. It
lays them end to end, each closed by a delimiter, sorts the suffixes, and keeps of the text before each suffix what an
FM-index needs: a pattern's occurrences are an interval of suffix ranks, and a code point in front of it narrows the
interval by two look-ups. There is an index for each direction: over words, where a last half is matched exactly from the
delimiter on and then the first half is gone over with one error allowed, and over reversed words, where a first half is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch, shuffle_partitions

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a shard, and words with one half that a shard takes before they are dealt to several; cells of patterns matched at once.
SHARD_ROWS, HALF_ROWS, CELLS = 1 << 17, 1 << 15, 1 << 21


class SuffixRanks:
    """An FM-index of distinct words, each closed by a delimiter, which is symbol 0 and less than all others."""

    def __init__(self, words: list[str]):
        text = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), "<u4")
        self.alphabet, symbols = np.unique(text, return_inverse=True)
        size, closes = len(text), symbols == 0
        # each delimiter is a symbol of its own, so that suffixes are told apart within a word
        rank = np.where(closes, np.cumsum(closes) - 1, len(words) - 1 + symbols)
        reach = 1
        while True:
            key = rank * (size + len(self.alphabet)) + rank[np.minimum(np.arange(size) + reach, size - 1)]
            order = np.argsort(key, kind="stable")
            rank = np.empty(size, np.int64)
            rank[order] = np.cumsum(np.append(False, np.diff(key[order]) != 0))
            if rank[order[-1]] == size - 1:
                break
            reach *= 2
        self.size, self.n_words = size, len(words)
        self.before = symbols[order - 1]
        at = np.argsort(self.before, kind="stable")
        #: (symbol, suffix rank) of what stands before each suffix, in order: a look-up counts smaller symbols and earlier ranks at once.
        self.steps = self.before[at] * size + at
        self.word = np.searchsorted(np.flatnonzero(closes), order)

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text's code points, -1 for those that no word has."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, -1)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffix ranks once a symbol has been put in front; empty for a symbol of -1."""
        low, high = np.searchsorted(self.steps, symbol * self.size + low), np.searchsorted(self.steps, symbol * self.size + high)
        return low, np.where(symbol < 0, low, high)

    def fronts(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the interval, symbol) of the different symbols but delimiters that stand in front of each interval."""
        n = len(self.alphabet)
        width = high - low
        few, many = np.flatnonzero(width <= 2 * n), np.flatnonzero(width > 2 * n)
        begin = np.repeat(np.cumsum(width[few]) - width[few], width[few])
        ranks = np.arange(width[few].sum()) - begin + np.repeat(low[few], width[few])
        seen = np.unique(np.repeat(few, width[few]) * n + self.before[ranks])
        every = (many[:, None] * n + np.arange(1, n)).ravel()
        which, symbol = np.divmod(np.append(seen, every), n)
        keep = symbol > 0
        return which[keep], symbol[keep]

    def whole(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The word that an interval's pattern is as a whole, -1 if there is none."""
        rank = self.steps[np.minimum(np.searchsorted(self.steps[: self.n_words], low), self.n_words - 1)]
        return np.where((rank >= low) & (rank < high), self.word[rank], -1)


def one_error(index: SuffixRanks, patterns: list[str], exact: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, word) for the words one inserted, deleted or replaced code point away from a pattern, its last `exact` code points being left alone; each once.

    inside tells which patterns are words of the index. Their intervals of one rank are dropped: it is their own."""
    found, order = [], np.argsort([len(p) for p in patterns], kind="stable")
    sizes = np.array([len(p) for p in patterns])[order]
    at = 0
    while at < len(order):
        # patterns in order of length, so many that padded to the longest they take CELLS at most
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * sizes[stop] <= CELLS:
            stop += 1
        part = order[at:stop]
        rows = np.full((len(part), sizes[stop - 1] + 1), -2)
        for k, p in enumerate(part):
            rows[k, : len(patterns[p])] = index.symbols(patterns[p])[::-1]
        q, word = _one_error(index, rows, sizes[at:stop], exact[part], inside[part])
        found.append((part[q], word))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2


def _one_error(index: SuffixRanks, rows: np.ndarray, sizes: np.ndarray, exact: np.ndarray, inside: np.ndarray):
    """rows: symbols of the patterns from the last one on, closed by -2."""
    q, low, high = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.full(len(rows), index.n_words)
    nothing = (q[:0], low[:0], high[:0])
    spent, hits = nothing, []  # states (pattern, interval) that have had their error
    join = lambda *states: tuple(np.concatenate(x) for x in zip(*states))
    some = lambda state, keep: tuple(x[keep] for x in state)
    for j in range(rows.shape[1]):
        ahead = nothing
        free = exact[q] <= j
        if free.any():
            f, lo, hi = q[free], low[free], high[free]
            which, symbol = index.fronts(lo, hi)
            one = (f[which], *index.extend(symbol, lo[which], hi[which]))
            same = rows[one[0], j] == symbol
            # one and the same word comes of an insertion or deletion anywhere in a row of equal code points: the last place counts
            spent = join(spent, some(one, ~same))
            last = sizes[f] > j
            last[last] = rows[f[last], min(j + 1, rows.shape[1] - 1)] != rows[f[last], j]
            ahead = join(some(one, ~same & (sizes[one[0]] > j)), some((f, lo, hi), last))
        ends = sizes[spent[0]] == j
        word = index.whole(spent[1][ends], spent[2][ends])
        hits.append((spent[0][ends][word >= 0], word[word >= 0]))
        spent = some(spent, ~ends)
        moved = (spent[0], *index.extend(rows[spent[0], j], spent[1], spent[2]))
        spent = join(some(moved, moved[1] < moved[2]), ahead)
        on = sizes[q] > j
        q = q[on]
        low, high = index.extend(rows[q, j], low[on], high[on])
        on = high - low > (inside[q] & (exact[q] <= j + 1))
        q, low, high = q[on], low[on], high[on]
        if not len(q) and not len(spent[0]):
            break
    return tuple(np.concatenate(x) for x in zip(*hits))


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Near words of a shard's queries among its words; both as they stand in the index, reversed for side 0."""
    ours = rows[~rows["asks"]].drop_duplicates("turned")
    asks = rows[rows["asks"]]
    nothing = pd.DataFrame({"word": [], "near": [], "near_n": []}, dtype=object)
    if ours.empty or asks.empty:
        return nothing
    words, patterns = ours["turned"].to_list(), asks["turned"].to_list()
    half = asks["half"].to_numpy()
    q, word = one_error(SuffixRanks(words), patterns, half, asks["turned"].isin(set(words)).to_numpy())
    side, (deals, deal), n = int(rows["side"].iloc[0]), (asks[c].to_list() for c in ("deals", "deal")), ours["n"].to_list()
    out = []
    for a, b in zip(q.tolist(), word.tolist()):
        x, y = patterns[a], words[b]
        if deals[a] > 1 and zlib.crc32(y.encode()) % deals[a] != deal[a]:
            continue  # another deal of this half has it
        if side == 0:
            out.append((x[::-1], y[::-1], n[b]))
        elif x[: len(x) - half[a]] != y[: len(x) - half[a]]:  # else found by the first half
            out.append((x, y, n[b]))
    return pd.DataFrame(out, columns=nothing.columns, dtype=object)


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n): for each of distinct words (word, n) each other one that differs by one inserted, deleted or replaced code point.

    Null and empty words are near to none. Words without a near one have no rows. Each word goes to at most four places as
    one that is found and to two as one that asks; a half that more than HALF_ROWS words have is dealt out by their checksums,
    and those that ask for it ask each deal. A shard takes some SHARD_ROWS rows, the longest word of it some time for each code point.
    """
    spark = words.sparkSession
    words = words.filter("word <> ''").select("word", "n", F.char_length("word").alias("size"))
    shards = max(shuffle_partitions(spark), -(-6 * words.count() // SHARD_ROWS))
    sides = [(0, F.reverse("word"), lambda size: F.floor(size / 2).cast("int")), (1, F.col("word"), lambda size: F.ceil(size / 2).cast("int"))]
    key = lambda half: F.when(half > 0, F.expr("right(turned, half)")).otherwise("")
    found = asks = None
    for side, turned, half in sides:
        own = words.select(F.lit(side).alias("side"), turned.alias("turned"), "n", "size")
        ask = own.withColumn("half", half(F.col("size"))).withColumn("key", key(F.col("half")))
        halves = F.array_distinct(F.array(*(half(F.col("size") + d) for d in (-1, 0, 1))))
        give = own.withColumn("half", F.explode(halves)).withColumn("key", key(F.col("half")))
        found, asks = (give, ask) if found is None else (found.union(give), asks.union(ask))
    hot = found.groupBy("side", "key").agg(F.count("*").alias("rows")).filter(F.col("rows") > HALF_ROWS)
    hot = scratch.keep(hot.select("side", "key", F.ceil(F.col("rows") / HALF_ROWS).cast("int").alias("deals")), "halves")
    dealt = lambda df: df.join(hot, ["side", "key"], "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    found = dealt(found).withColumn("deal", F.pmod(F.crc32(F.encode("turned", "utf-8")), F.col("deals").cast("long")).cast("int")).withColumn("asks", F.lit(False))
    asks = dealt(asks).withColumn("deal", F.explode(F.expr("sequence(0, deals - 1)"))).withColumn("asks", F.lit(True))
    columns = ["side", "turned", "n", "half", "deals", "deal", "asks"]
    rows = found.select(*columns, "key").union(asks.select(*columns, "key"))
    rows = rows.select(*columns, F.pmod(F.xxhash64("side", "key", "deal"), F.lit(shards)).alias("shard"))
    return rows.groupBy("side", "shard").applyInPandas(_shard, "word string, near string, near_n long")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of distinct words (word, n; other columns are ignored).

    n_near counts the near words (see near_words()). form is the one with the largest n, of equal ones the first in order of
    code points, if its n is `times` the word's or more (times is over 1), else null; form_n is its n. root is where following
    forms ends, the word itself if it has none. Null and empty words have no rows. Since n grows by `times` with each form,
    the rounds that follow them double what they skip, and there are few.
    """
    if times <= 1:
        raise ValueError("a form has to be more frequent than its variants")
    scratch = Scratch(words.sparkSession)
    words = scratch.keep(words.filter("word <> ''").select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, scratch)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best.near"))
    named = words.join(best, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"))
    named = scratch.keep(named, "forms")
    roots = scratch.keep(named.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.keep(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        scratch.drop(roots)
        roots = moved
        if not moved.agg(F.max("moved")).first()[0]:
            break
    return named.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs_of_letters(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run) for each of the runs of `least` Latin letters or more in texts, A-Z in lower case. Null texts have none."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS + "{" + str(least) + ",}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    return runs.select("doc_id", lower.alias("run"))


def counted(runs: DataFrame, least: int, often: int) -> DataFrame:
    """(word, n) of the different runs of `least` code points or more that come `often` times or more."""
    return runs.filter(F.char_length("run") >= least).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= often)
