"""Stupid-backoff scores of documents under word n-gram counts of a whole corpus.

Orders are counted one after the other. Blocks of documents count their own n-grams; the distinct ones go, sorted, to
count tables partitioned by hash, where those of all blocks are added up, and each block gets its counts back. An n-gram
that comes often enough is made of two of the order below that do, so others are not even sent: from the second order on
little more than what repeats is counted. At last each word takes the score of its longest n-gram that comes often enough,
and scores are summed by document.

The joins are of arrays: a row holds a block's n-grams of one bucket. One row for each n-gram, with its document, would
take 14 bytes and more in a shuffle for each word and order, where here a distinct n-gram of a block takes some 5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.scratch import Scratch, shuffle_partitions

BACKOFF = 0.4
BLOCK_ROWS = 8192
BLOCK_CHARS = 12 << 20
SLICE = 1 << 20
MICRO = 1_000_000
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NEXT_SPACE = re.compile(rb"[\t-\r ]").search


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, words being what lies between ASCII white space, and how many each text has. Up to SLICE bytes or one word are worked on at once."""
    joined, hashes, starts, at = b"\n".join(raws), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(joined):
        stop = at + SLICE
        if stop < len(joined):
            found = NEXT_SPACE(joined, stop)
            stop = found.start() if found else len(joined)
        part = joined[at:stop]
        n, v = len(part), np.frombuffer(part + bytes(16), np.uint8)
        edge = np.diff(np.concatenate([[True], SPACE[v[:n]], [True]]).astype(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        size = e - s
        eight = np.ndarray(n + 9, "<u8", v.tobytes(), strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        low, high = eight[s] & mask[np.minimum(size, 8)], eight[np.minimum(s + 8, n + 8)] & mask[np.clip(size - 8, 0, 8)]
        h = mixed(low * np.uint64(0x9E3779B97F4A7C15) ^ mixed(high + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        long = np.flatnonzero(size > 16)
        h[long] = [xxhash.xxh64_intdigest(part[a:b]) for a, b in zip(s[long].tolist(), e[long].tolist())]
        hashes.append(h)
        starts.append(s + at)
        at = stop
    begin = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), begin)) if raws else np.zeros(0, np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of their bytes, the lowest first, without planes of zeros at the end; what is regular in them compresses."""
    n = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8")


def _sorted_planes(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


class Block:
    """The words of some texts, and for each position and order the count of the n-gram that ends there: 0 where it isn't worth counting."""

    def __init__(self, texts: list[str | None], least: int):
        self.least = least
        self.gram, self.n_words = words([(t or "").encode() for t in texts])
        self.words, self.counts = self.gram, []
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the next order: positions, distinct hashes in order, which of them each position has, and how often each comes."""
        order = len(self.counts) + 1
        if order == 1:
            at = np.arange(len(self.words))
        else:
            often = self.counts[-1] >= self.least
            at = np.flatnonzero((self.place >= order - 1) & often & np.append(False, often[:-1]))
            grams = np.zeros_like(self.words)
            grams[at] = mixed((self.gram[at - 1] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) ^ self.words[at])
            self.gram = grams
        return at, *np.unique(self.gram[at], return_inverse=True, return_counts=True)

    def learn(self, counts: np.ndarray) -> None:
        """Take the corpus counts of the next order's distinct n-grams."""
        at, _, which, _ = self.distinct()
        out = np.zeros(len(self.words), np.int64)
        out[at] = counts[which]
        self.counts.append(out)

    def scores(self, total: int) -> tuple[np.ndarray, np.ndarray]:
        """By text: the sum of log scores in millionths, and how many words their longest history doesn't score."""
        ratio, used = self.counts[0] / total, np.ones(len(self.words), np.int64)
        for k in range(2, len(self.counts) + 1):
            often, there = self.counts[k - 1] >= self.least, self.place >= k - 1
            before = np.append(1, self.counts[k - 2][:-1])
            ratio = np.where(there, np.where(often, self.counts[k - 1] / np.maximum(before, 1), BACKOFF * ratio), ratio)
            used = np.where(often, k, used)
        micro = np.rint(np.log(ratio) * MICRO).astype(np.int64)
        backed = used < np.minimum(self.place + 1, len(self.counts))
        edges = np.append(0, np.cumsum(self.n_words))
        summed = lambda x: np.diff(np.append(0, np.cumsum(x))[edges])
        return summed(micro), summed(backed.astype(np.int64))


def _blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers rows by block: BLOCK_ROWS rows or BLOCK_CHARS code points at most, or one row."""
    block, rows, size = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        part = []
        for n in batch["text"].map(lambda t: len(t or "")):
            if rows and (rows >= BLOCK_ROWS or size + n > BLOCK_CHARS):
                block, rows, size = block + 1, 0, 0
            part.append(block)
            rows, size = rows + 1, size + n
        yield batch.assign(part=part)


def _counted(texts: pd.DataFrame, known: pd.DataFrame, order: int, least: int) -> Block:
    block = Block(texts["text"].tolist(), least)
    for k in range(1, order):
        own = known[known["k"] == k].sort_values("bucket")
        counts = [_from_planes(data, n).astype(np.int64) for data, n in zip(own["counts"], own["n"])]
        block.learn(np.concatenate(counts) if counts else np.zeros(0, np.int64))
    return block


GRAMS = "bucket long, part long, n int, grams binary, counts binary"
COUNTS = "part long, k int, bucket long, n int, counts binary"


def _sent(order: int, least: int, bits: int):
    """A block's distinct n-grams of an order, a row for each bucket: the highest bits of the hash."""

    def run(known: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        _, grams, _, counts = _counted(texts, known, order, least).distinct()
        bucket = (grams >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]])) if len(grams) else np.zeros(1, int)
        rows = [(int(bucket[a]), int(texts["part"].iloc[0]), b - a, _sorted_planes(grams[a:b]), _planes(counts[a:b])) for a, b in zip(edges, edges[1:])]
        return pd.DataFrame(rows, columns=["bucket", "part", "n", "grams", "counts"])

    return run


def _added(order: int):
    """Counts over all blocks of the n-grams in a bucket, for each block those of its own in their order."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        own = [np.cumsum(_from_planes(data, n), dtype=np.uint64) for data, n in zip(bucket["grams"], bucket["n"])]
        kinds, which = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(which, np.concatenate([_from_planes(data, n) for data, n in zip(bucket["counts"], bucket["n"])]).astype(float), len(kinds)).astype(np.uint64)
        stops = np.cumsum(bucket["n"])
        counts = [_planes(total[which[b - n : b]]) for n, b in zip(bucket["n"], stops)]
        return pd.DataFrame({"part": bucket["part"], "k": order, "bucket": bucket["bucket"], "n": bucket["n"], "counts": counts})

    return run


def _scored(order: int, total: int, least: int):
    def run(known: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        block = _counted(texts, known, order + 1, least)
        micro, backed = block.scores(total)
        mean = np.where(block.n_words > 0, micro / np.maximum(block.n_words, 1) / MICRO, np.nan)
        out = pd.DataFrame({"doc_id": texts["doc_id"], "n_words": block.n_words, "n_backed_off": backed, "log_score_micro": micro})
        return out.assign(score=pd.Series(mean, out.index).astype(object).where(block.n_words > 0, None))

    return run


def scores(docs: DataFrame, order: int = 3, least: int = 2) -> DataFrame:
    """(doc_id, n_words, n_backed_off, log_score_micro, score) of docs (doc_id, text; other columns are ignored).

    The counts are those of all of docs. The score of a word w after the `order` - 1 before it (fewer at the start) is
    count(history w) / count(history) if history w comes at least `least` times, or else BACKOFF times its score after a
    history shorter by one; without a history it is count(w) / count of all. log_score_micro is the sum of the natural
    logarithms in millionths, each rounded, and score their mean; n_backed_off counts words that were not scored by their
    longest history. Null, empty and blank texts have no words, the sum 0 and no score. Repeated rows count and are scored
    each; an empty table gives none.

    N-grams are known by a 64-bit hash: of n different ones some n^2 / 2^65 pairs share a count, 0.03 pairs of 10^9. A block
    is held in one task, so a single text has to fit there, with some 60 bytes for each of its words. Blocks send a row for
    each bucket, of which there are two to four for each shuffle partition, as a shuffle has a segment for each task and
    partition: with very many of both, larger blocks (BLOCK_CHARS) keep rows few.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    key = docs.select("doc_id").schema[0]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = scratch.bucketed(rows.mapInPandas(_blocked, T.StructType([key, *T.StructType.fromDDL("text string, part long")])), "texts", "part")
    bits = (2 * shuffle_partitions(spark) - 1).bit_length()
    known, total = spark.createDataFrame([], COUNTS), 0
    blocks = texts.groupBy("part")
    for k in range(1, order + 1):
        sent = known.groupBy("part").cogroup(blocks).applyInPandas(_sent(k, least, bits), GRAMS)
        counts = scratch.keep(sent.groupBy("bucket").applyInPandas(_added(k), COUNTS), "counts")
        known = counts if k == 1 else known.union(counts)
    total = int(texts.select(F.regexp_count("text", F.lit("[^\\t-\\r ]+")).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0)
    schema = T.StructType([key, *T.StructType.fromDDL("n_words long, n_backed_off long, log_score_micro long, score double")])
    return known.groupBy("part").cogroup(blocks).applyInPandas(_scored(order, total, least), schema)
