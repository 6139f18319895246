"""Runs of words that repeat with a period, found online on sparse diagonals, and texts with each run cut to one period.

A diagonal is a lag: its match length at a word counts how many words in a row equal the one so far before them. Words are
read from left to right, and the earlier occurrence of a word lets the diagonal of their distance grow by one; where a
diagonal that has grown ends, it is a run if it is long enough for its lag.

Of the earlier occurrences of a frequent word nearly all lie on diagonals that come to nothing. So a diagonal is kept for
blocks of L words, L = 1, 2, 4, ..., with lags over L / 2 and up to L: a run of period q that has three periods or more
repeats each of its blocks of L >= q words at a distance of q, and nowhere nearer, since its root is primitive. The latest
earlier occurrence of a block is then the only one that counts, each position is on one diagonal at most, and what is found
is each run, once, with its smallest period. Blocks of 2 L words are pairs of blocks of L that come again, so beyond the
first lengths only what repeats is looked at: n words take O(n log n) steps however often a word comes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts that are worked on at once, unless one text has more, and of a text that are split at once.
BYTES_AT_ONCE = 8 << 20
SLICE = 1 << 20
NEXT_SPACE = re.compile(rb"[\t-\r ]").search


def split(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those between ASCII white space, a slice at a time that ends where a word does."""
    at = 0
    while at < len(raw):
        space = NEXT_SPACE(raw, at + SLICE)
        stop = space.start() if space else len(raw)
        yield raw[at:stop].split()
        at = stop


def diagonals(blocks: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of `size` words at positions in ascending order: first position, number of matches and lag of each diagonal that ended, and for each block its class or -1 if it comes once."""
    order = np.argsort(blocks, kind="stable")
    again = blocks[order[1:]] == blocks[order[:-1]]
    lag = np.zeros(len(at), np.int64)
    lag[order[1:][again]] = (at[order[1:]] - at[order[:-1]])[again]
    known = np.full(len(at), -1)
    repeats = np.append(again, False) | np.append(False, again)
    known[order[repeats]] = np.cumsum(np.append(True, ~again))[repeats]
    on = np.flatnonzero((2 * lag > size) & (lag <= size))
    begins = np.flatnonzero(np.append(True, (np.diff(at[on]) != 1) | (np.diff(lag[on]) != 0))[: len(on)])
    return at[on][begins], np.diff(np.append(begins, len(on))), lag[on][begins], known


def periodic(words: np.ndarray, ends: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the runs in texts laid end to end.

    words are numbers, equal ones in one text for equal words, and none the same in two texts; ends tells of each position where its text ends."""
    found, at, blocks, size = [np.zeros((0, 3), np.int64)], np.arange(len(words)), words, 1
    longest = int((ends - at).max(initial=0))
    while len(at) and size < 2 * longest // times + 2:
        first, n, lag, known = diagonals(blocks, at, size)
        length = n + size - 1 + lag
        enough = length >= np.maximum(least, times * lag)
        found.append(np.stack([first - lag, length, lag], axis=1)[enough])
        classes = np.full(len(words) + 1, -1)
        classes[at] = known
        after = np.minimum(at + size, len(words))
        pair = (known >= 0) & (at + 2 * size <= ends[at]) & (classes[after] >= 0)
        blocks = known[pair] * (len(words) + 1) + classes[after[pair]]
        at, size = at[pair], 2 * size
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _numbered(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the words of texts laid end to end, and how many each text has."""
    numbers, sizes = [np.zeros(0, np.int64)], []
    for raw in raws:
        known: dict[bytes, int] = {}
        before = n = sum(sizes)
        for words in split(raw):
            numbers.append(np.fromiter(map(known.setdefault, words, count(n)), np.int64, len(words)))
            n += len(words)
        sizes.append(n - before)
    return np.concatenate(numbers), np.array(sizes, np.int64)


def _kept(raw: bytes, keep: np.ndarray) -> str:
    out, at = [], 0
    for words in split(raw):
        out.append(b" ".join(compress(words, keep[at : at + len(words)])))
        at += len(words)
    return b" ".join(x for x in out if x).decode()


def _found(raws: list[bytes], least: int, times: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    words, sizes = _numbered(raws)
    stops = np.cumsum(sizes)
    runs = periodic(words, np.repeat(stops, sizes), least, times)
    bounds = np.searchsorted(runs[:, 0], np.append(0, stops))
    for k, raw in enumerate(raws):
        own = runs[bounds[k] : bounds[k + 1]] - [stops[k] - sizes[k], 0, 0]
        open_ = np.zeros(sizes[k] + 1, np.int64)
        np.add.at(open_, own[:, 0] + own[:, 2], 1)
        np.add.at(open_, own[:, 0] + own[:, 1], -1)
        yield int(sizes[k]), [tuple(r) for r in own.tolist()], _kept(raw, np.cumsum(open_)[:-1] == 0)


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, n_words, runs array of (start, length, period), collapsed) of each row of docs (doc_id, text; other columns are ignored).

    A run is a stretch of words with smallest period q, of `least` words and `times` * q or more (times is 3 or more), that
    cannot be made longer. start counts words from 0; runs are in order of start and period. collapsed has the words that
    no run holds after its first period, joined by spaces. Words are what lies between ASCII white space.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows and null ids are worked
    on like all others. A text is read by one task, and takes some 80 bytes of memory a word. Nothing is shuffled.
    """
    if times < 3:
        raise ValueError("runs need three periods or more")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = [(t or "").encode() for t in batch["text"]]
            group = np.cumsum([len(r) for r in raws]) // BYTES_AT_ONCE
            for g in np.unique(group).tolist():
                own = np.flatnonzero(group == g)
                found = list(_found([raws[k] for k in own], least, times))
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[own], "n_words": [f[0] for f in found], "runs": [f[1] for f in found], "collapsed": [f[2] for f in found]})

    kind = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInPandas(run, T.StructType([docs.select("doc_id").schema[0], *T.StructType.fromDDL(kind)]))


def with_period(doc_id: str = "doc_id", text: str = "text"):
    """The text, a tenth of them by the checksum h of doc_id with a part that repeats: from word a on the p words from a over and over.

    a is floor(h / 10) mod n and p is 1 + floor((n - a) / (3 + floor(h / 10) mod 8)), n being the number of words. A null doc_id changes nothing."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w).cast("long")
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), F.slice(tail, 1, (n - a).cast("int"))), " ")).otherwise("")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.transform(F.array(words), planted)[0]).otherwise(F.col(text))
