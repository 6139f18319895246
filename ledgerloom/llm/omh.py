"""Order MinHash: fingerprints whose likeness follows the edit distance.

A k-mer of code points is numbered by how many equal ones came before it. The hash of k-mer and number deals it into one
of BINS bins and ranks it there (one permutation instead of one for each bin). A bin takes its SMALLEST minimal k-mers,
puts them back into text order and hashes the tuple. Bins with no k-mer take over the next filled bin's tuple, mixed with
the distance, so that short texts have full fingerprints too. Likeness is the share of equal bins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.scratch import shuffle_partitions

GRAM = 9
BINS = 64
SMALLEST = 2
RANGE_ROWS = 4096
MAX_RANGES = 20_000
SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(32)


def points_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), "<u4")


def text_of(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


def fingerprint(points: np.ndarray) -> np.ndarray:
    """BINS unsigned 16-bit numbers for code points, with some 70 bytes of memory for each while it works; a text shorter than a k-mer is one k-mer itself, an empty one all zeros."""
    if not len(points):
        return np.zeros(BINS, np.uint16)
    gram = min(GRAM, len(points))
    p = points.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(p) - gram + 1, np.uint64)
    for k in range(gram):
        h += p[k : k + len(h)] * np.uint64(pow(int(SEED), k + 1, 1 << 64))
    h = _mix(h)
    # number equal k-mers in text order; most come once
    number = np.zeros(len(h), np.uint64)
    order = np.argsort(h)
    ranked = h[order]
    same = np.append(False, ranked[1:] == ranked[:-1])
    if same.any():
        again = np.sort(order[same | np.append(same[1:], False)])
        again = again[np.argsort(h[again], kind="stable")]
        ranked = h[again]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        number[again] = np.arange(len(again)) - np.repeat(first, np.diff(np.append(first, len(again))))
    key = _mix(h + number * SEED)
    by_key = np.argsort(key)
    width = np.uint64(1 << 64 - (BINS - 1).bit_length())
    edges = np.searchsorted(key[by_key], np.arange(BINS, dtype=np.uint64) * width)
    sizes = np.minimum(np.diff(np.append(edges, len(key))), SMALLEST)
    out = np.zeros(BINS, np.uint64)
    taken = np.full((BINS, SMALLEST), len(h))
    for k in range(SMALLEST):
        has = sizes > k
        taken[has, k] = by_key[edges[has] + k]
    taken.sort(axis=1)
    grams = np.append(h, np.uint64(0))
    for k in range(SMALLEST):
        out = _mix(out * SEED + grams[taken[:, k]] + np.uint64(k + 1))
    filled = np.flatnonzero(sizes)
    source = filled[np.searchsorted(filled, np.arange(BINS)) % len(filled)]
    distance = (source - np.arange(BINS)) % BINS
    return (np.where(distance == 0, out[source], _mix(out[source] + distance.astype(np.uint64))) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written(print_: np.ndarray) -> str:
    return print_.astype(">u2").tobytes().hex()


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last third of the code points (rounded down) replaced by the first as many of those that follow, or all of them."""
    third = len(points) // 3
    return np.concatenate([points[: len(points) - third], following[:third]])


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ranges, in order; each range ends with the first row of the next one, marked as its tail."""
    held = None
    for batch in batches:
        rows = []
        for part, tail, key, text in zip(batch["part"], batch["tail"], batch["doc_id"], batch["text"]):
            points = points_of(text)
            now = (part, key, text, points, fingerprint(points))
            if held is not None and held[0] == part:
                _, own_key, own_text, own, print_ = held
                other = edited(own, points)
                other_text, other_print = text_of(other), fingerprint(other)
                rows.append((own_key, len(own), hashlib.sha256(other_text.encode()).hexdigest(), written(print_), written(other_print), likeness(print_, other_print), likeness(print_, now[4])))
            held = None if tail else now
        yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _splits(ids: DataFrame) -> list[int]:
    """Descending ends of ranges of `at`, with about RANGE_ROWS rows each."""
    n = min(-(-ids.count() // RANGE_ROWS), MAX_RANGES)
    found = ids.approxQuantile("at", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    return sorted({int(x) for x in found}, reverse=True)


def _range(splits: list[int]):
    """How many splits are not below `at`: found among every so many first, then among those that follow."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits)) + 1
    blocks = F.array(*(F.array(*map(F.lit, splits[k : k + step])) for k in range(0, len(splits), step)))
    reached = lambda b: b >= F.col("at")
    block = F.greatest(F.size(F.filter(blocks, lambda b: reached(b[0]))), F.lit(1)) - 1
    return block * step + F.size(F.filter(F.get(blocks, block), reached))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text; other columns are ignored) and of its edited text, and their likeness.

    doc_id is an integer, else TypeError. The next document is the one with the next smaller doc_id; after the last comes the first, and a single row is its own
    next. The edited text is edited() with the next one. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. Null texts count as empty. Rows with equal doc_id follow each other by
    text, those without one come last; an empty table gives none.

    Documents are dealt into ranges of doc_id, of about RANGE_ROWS rows if they are spread evenly, by ids alone; the first
    of a range is also sent to the range before, so each range is read once, in order, with one row in memory besides the
    batch. Only the ends of ranges, a number for each, come to the driver.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id has to be an integer, whose order tells the next document")
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", "text", at.alias("at"))
    rows = rows.withColumn("part", _range(_splits(rows.select("at"))))
    firsts = rows.groupBy("part").agg(F.max("at").alias("at"))
    ends = sorted(r[0] for r in firsts.select("part").collect())
    before = F.create_map(*(F.lit(x) for k, part in enumerate(ends) for x in (part, ends[k - 1]))) if ends else F.create_map(F.lit(0), F.lit(0))
    # a row for each range: their number is bounded by MAX_RANGES
    heads = rows.join(F.broadcast(firsts), ["part", "at"]).groupBy("part").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "doc_id", "at")).alias("head"))
    heads = heads.select("head.doc_id", "head.text", "head.at", before[F.col("part")].alias("part"), F.lit(True).alias("tail"))
    dealt = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tail", F.lit(False)).unionByName(heads)
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "part").sortWithinPartitions("part", "tail", F.desc("at"), "text", "doc_id")
    more = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.drop("at").mapInPandas(_compared, T.StructType([docs.select("doc_id").schema[0], *T.StructType.fromDDL(more)]))
