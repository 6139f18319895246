"""Approximate nearest neighbours by inner product, in a forest of sorted hash strings.

Each tree gives a vector a string of 64 bits, the sides of random hyperplanes it lies on. Vectors are shortened by one
factor to a length of one at most and get a component that fills them up to one, so that the nearest by inner product are
the nearest by angle. The strings of a tree, sorted, are kept in cells: all that begin with the same few bits, so many that
a cell has some thousand rows, and vectors rounded to two bytes a component, with the length of what that takes off.

A query goes down to the longest beginning that `least` strings of a cell share with its own in each tree, scores what is there,
and then goes up in all trees at once, to shorter beginnings that more strings share, until it can stop: two vectors at an
angle of a share a bit with a chance of p = 1 - a / pi, so that one as near as the worst of those found so far has been
missed in all trees at a beginning of x bits with a chance of (1 - p^x)^trees, and nearer ones with less. A beginning of no bits is
the whole table. Where neighbours stand out few strings are looked at; where all vectors are equally far, nearly all are.

Only cells and queries meet. A query keeps what may be among its nearest by what the rounding leaves open, and those are scored
again from the vectors. One byte would leave all of a large group of near copies open to each query in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch

BITS = 64
#: Rows that a cell has on the average, rows of a beginning after which it is dealt to several cells, and queries that meet a cell at once.
CELL_ROWS, MOST_ROWS, MOST_QUERIES = 4096, 1 << 14, 1024
#: Steps to each side of 0 that a component is rounded to, which two bytes hold, and room for products in single precision.
STEPS, SLACK = 32767, 1e-6
CODED = "key long, d int, hashes array<long>, fine binary, unit double, rest double"
ASKED = "q long, hashes array<long>, vec array<float>"
HITS = "q long, key long, low double, up double, level int"


@lru_cache(maxsize=4)
def planes(size: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, trees * BITS))


def strings(vectors: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(n, trees) hash strings as signed integers, the first bit highest."""
    sides = vectors @ planes(vectors.shape[1], trees, seed) > 0
    return np.packbits(sides, axis=1).view(">u8").astype("<u8").view(np.int64)


def _coded(trees: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby("d"):
                v = np.stack(part["vec"].to_list()).astype(float) / part["top"].to_numpy()[:, None] / part["longest"].to_numpy()[:, None]
                rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", v, v)))
                unit = np.maximum(np.abs(v).max(axis=1, keepdims=True) / STEPS, 1e-300)
                fine = np.rint(v / unit).astype(np.int16)
                hashes = strings(np.column_stack([v, rest]), trees, seed)
                yield pd.DataFrame({"key": part["key"], "d": d, "hashes": list(hashes), "fine": [x.tobytes() for x in fine], "unit": unit[:, 0], "rest": np.linalg.norm(v - fine * unit, axis=1)})

    return run


def _asked(trees: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("d"):
                v = np.stack(part["vec"].to_list()).astype(float)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                hashes = strings(np.column_stack([v, np.zeros(len(v))]), trees, seed)
                yield pd.DataFrame({"q": part["key"], "hashes": list(hashes), "vec": list(v.astype(np.float32))})

    return run


def sharing(strings_: np.ndarray, own: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array the ranges of strings that share the first `level` bits with each of some others."""
    shift = (BITS - np.clip(level, 1, BITS)).astype(np.int64)
    first = own >> shift << shift
    last = first + ((np.int64(1) << shift) - 1)
    low, high = np.searchsorted(strings_, first), np.searchsorted(strings_, last, "right")
    return np.where(level > 0, low, 0), np.where(level > 0, high, len(strings_))


def longest(strings_: np.ndarray, own: np.ndarray, least: int, floor: int) -> np.ndarray:
    """For each of some strings the most first bits, and `floor` at least, that `least` of a sorted array share with it."""
    level = np.full(len(own), floor)
    for x in range(BITS, floor, -1):
        low, high = sharing(strings_, own, np.full(len(own), x))
        level = np.where((level == floor) & (high - low >= least), x, level)
    return level


def scored(vectors: np.ndarray, queries: np.ndarray, rest: np.ndarray, floors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, low, up) of the rows that may be among a query's n nearest: its inner product is between low and up."""
    near = queries @ vectors.T
    low = near - rest
    if low.shape[1] > n:
        floors = np.maximum(floors, np.partition(low, low.shape[1] - n, axis=1)[:, -n])
    q, row = np.nonzero(near + rest >= floors[:, None])
    return q, row, low[q, row], near[q, row] + rest[row]


def _visited(n: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = np.asarray(row.strings)
                fine = np.frombuffer(b"".join(row.fine), np.int16).reshape(len(own), -1)
                vectors = fine * np.asarray(row.unit, np.float32)[:, None]
                rest = (np.asarray(row.rest) + SLACK).astype(np.float32)
                keys, q, hashes, level = np.asarray(row.keys), np.asarray(row.q), np.asarray(row.own), np.array(row.level)
                queries = np.asarray(row.vec, np.float32).reshape(len(q), -1)
                floors = np.asarray(row.floors, np.float32)
                down = level < 0
                level[down] = longest(own, hashes[down], least, int(row.bits))
                low, high = sharing(own, hashes, level)
                ranges, which = np.unique(low * (len(own) + 1) + high, return_inverse=True)
                found = []
                for k, (a, b) in enumerate(zip(*np.divmod(ranges, len(own) + 1))):
                    asks = np.flatnonzero(which == k)
                    i, j, lo, up = scored(vectors[a:b], queries[asks], rest[a:b], floors[asks], n)
                    found.append((q[asks[i]], keys[a + j], lo, up, level[asks[i]]))
                # a query without any hit has reached its level, too
                found.append((q, np.full(len(q), -1), np.full(len(q), -9.0), np.full(len(q), -9.0), level))
                yield pd.DataFrame(dict(zip(("q", "key", "low", "up", "level"), map(np.concatenate, zip(*found)))))

    return run


def _beginning(column: str) -> Column:
    """The first `bits` bits of a string, as a number."""
    return F.when(F.col("bits") > 0, F.expr(f"shiftright({column}, {BITS} - bits)")).otherwise(F.lit(0)).cast("long")


def _cells(coded: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(d, bits, tree, beginning, deals) of all cells, and the cells: (d, tree, beginning, deal, strings in order, keys, fine, unit, rest)."""
    rows = coded.select("d", "bits", "key", "fine", "unit", "rest", F.posexplode("hashes").alias("tree", "string")).withColumn("beginning", _beginning("string"))
    place = ["d", "tree", "beginning"]
    sizes = rows.groupBy("bits", *place).agg(F.count("*").alias("rows"))
    sizes = scratch.keep(sizes.select("bits", *place, F.ceil(F.col("rows") / MOST_ROWS).cast("int").alias("deals")), "sizes")
    # the usual cell is not dealt, so that only rows of large ones have to be looked up
    large = sizes.filter("deals > 1").select(*place, "deals")
    deal = F.pmod(F.xxhash64("key"), F.coalesce("deals", F.lit(1))).cast("int")
    rows = rows.join(large, place, "left").withColumn("deal", deal)
    lists = rows.groupBy(*place, "deal").agg(F.sort_array(F.collect_list(F.struct("string", "key", "fine", "unit", "rest"))).alias("r"))
    return sizes, lists.select(*place, "deal", F.col("r.string").alias("strings"), F.col("r.key").alias("keys"), *(F.col(f"r.{c}").alias(c) for c in ("fine", "unit", "rest")))


def _visits(asked: DataFrame, sizes: DataFrame, cells: DataFrame, scratch: Scratch) -> DataFrame:
    """Cells with the queries (q, d, bits, hashes, vec, level, floor) that go there; a level of -1 is the longest that its cell has."""
    rows = asked.select("d", "bits", "q", "level", F.posexplode("hashes").alias("tree", "string")).withColumn("beginning", _beginning("string"))
    rows = rows.withColumn("up", F.when(F.col("level") < 0, 0).otherwise(F.greatest(F.lit(0), F.col("bits") - F.col("level"))).cast("int"))
    # beginnings are signed numbers: all of them start with the lowest
    first = F.when(F.col("up") == 0, F.col("beginning")).when(F.col("up") == F.col("bits"), F.expr("-shiftleft(1L, bits - 1)")).otherwise(F.expr("shiftleft(shiftright(beginning, up), up)"))
    rows = rows.withColumn("first", first).withColumn("beginning", F.explode(F.expr("sequence(first, first + shiftleft(1L, up) - 1)")))
    rows = rows.join(sizes.drop("bits"), ["d", "tree", "beginning"]).withColumn("deal", F.explode(F.expr("sequence(0, deals - 1)")))
    place = ["d", "tree", "beginning", "deal"]
    rows = rows.select(*place, "bits", "q", "string", "level")
    sets = rows.groupBy(*place).agg(F.ceil(F.count("*") / MOST_QUERIES).cast("int").alias("sets"))
    rows = rows.join(sets, place).withColumn("set", F.pmod(F.xxhash64("q"), F.col("sets")))
    rows = rows.join(asked.select("q", "vec", "floor"), "q")
    lists = rows.groupBy(*place, "bits", "set").agg(F.collect_list(F.struct("q", "string", "level", "floor", "vec")).alias("a"))
    lists = lists.select(*place, "bits", F.col("a.q").alias("q"), F.col("a.string").alias("own"), F.col("a.level").alias("level"), F.col("a.floor").alias("floors"), F.flatten("a.vec").alias("vec"))
    return lists.join(cells, place)


def needed(floor: Column, trees: int, miss: float) -> Column:
    """The most first bits that a vector at least as near as the floor shares with a query in one of the trees, but for a chance of `miss`."""
    share = 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), floor))) / math.pi
    bits = F.floor(math.log(-math.expm1(math.log(miss) / trees)) / F.ln(share)).cast("int")
    return F.when(share <= 0, 0).when(share >= 1, BITS).otherwise(F.least(F.lit(BITS), bits))


def nearest(vectors: DataFrame, asks: Column, n: int = 20, trees: int = 24, miss: float = 0.1, least: int = 16, seed: int = 0) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row of vectors (vec_id, embedding) for which `asks` is true its n nearest other rows.

    Nearest is the largest inner product, in double precision; ties go to the smaller vec_id. Each neighbour is found with
    a chance of 1 - `miss` or more, over random hyperplanes, and those nearer than the last of the n with a larger one;
    scores are exact. Fewer than n other rows are all returned, and so is all of a table of so few different vectors.

    Vectors that are null, empty, zero or hold a null, NaN or infinity, and rows without a vec_id, take no part. Vectors of
    different lengths do not meet. Equal vectors are one, with their n + 1 smallest ids, and rows of one id are rows like all others
    but that a row never finds its own id. Other columns are ignored, unless `asks` reads them. An empty table has no rows.

    Each vector is written once a tree, with some 30 bytes and two for each component. The vectors of one length have a
    factor of their own; one very long vector among short ones makes all the others look alike, and more is looked at.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    vec = F.col("embedding").cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0) & F.col("vec_id").isNotNull()
    # -0.0 and 0.0 are one
    rows = vectors.filter(fine).select("vec_id", F.transform(vec, lambda x: x + F.lit(0.0)).alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks"))
    alike = rows.groupBy("vec").agg(F.count("*").alias("rows"), F.min("vec_id").alias("id"), F.max("asks").alias("asks"))
    alike = alike.withColumn("key", F.monotonically_increasing_id()).withColumn("d", F.size("vec")).withColumn("most", F.array_max(F.transform("vec", F.abs)))
    alike = scratch.keep(alike, "alike")

    per_length = alike.groupBy("d").agg(F.max("most").alias("top"), F.count("*").alias("of"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top"))))
    lengths = alike.join(per_length, "d").groupBy("d", "top", "of").agg(F.max(length).alias("longest"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("of") / CELL_ROWS))).cast("int")
    lengths = scratch.keep(lengths.select("d", "top", "longest", bits.alias("bits")), "lengths")
    coded = alike.select("key", "d", "vec").join(lengths, "d").select("key", "d", "vec", "top", "longest").mapInPandas(_coded(trees, seed), CODED)
    sizes, cells = _cells(coded.join(lengths.select("d", "bits"), "d"), scratch)
    cells = scratch.keep(cells, "cells")

    queries = alike.filter("asks").select("key", "d", "vec").mapInPandas(_asked(trees, seed), ASKED)
    queries = scratch.keep(queries.join(alike.select(F.col("key").alias("q"), "d"), "q").join(lengths.select("d", "bits"), "d"), "queries")
    active = queries.withColumn("level", F.lit(-1)).withColumn("floor", F.lit(-9.0))
    before, done = None, []
    while True:
        hits = _visits(active, sizes, cells, scratch).mapInPandas(_visited(n + 1, least), HITS)
        if before is not None:
            old = active.select("q").join(before, "q").select("q", F.explode("hits").alias("h"))
            hits = hits.union(old.select("q", "h.key", "h.low", "h.up", F.lit(0)))
        hits = hits.groupBy("q", "key").agg(F.max("low").alias("low"), F.min("up").alias("up"), F.max("level").alias("level"))
        best = hits.groupBy("q").agg(F.sort_array(F.collect_list(F.when(F.col("key") >= 0, F.struct("low", "up", "key"))), False).alias("hits"), F.max("level").alias("level"))
        best = best.withColumn("floor", F.coalesce(F.get("hits", F.lit(n))["low"], F.lit(-9.0)))
        best = best.withColumn("hits", F.filter("hits", lambda h: h["up"] >= F.col("floor"))).withColumn("need", needed(F.col("floor"), trees, miss))
        before = scratch.keep(best, "best")
        done.append(before.filter("level <= need").select("q", "hits"))
        active = before.filter("level > need").select("q", F.greatest("need", F.floor(F.col("level") / 2)).cast("int").alias("level"), "floor").join(queries, "q")
        if active.isEmpty():
            break

    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    found = found.select("q", F.explode("hits.key").alias("key"))
    found = found.join(alike.select(F.col("key").alias("q"), F.col("vec").alias("own")), "q").join(alike.select("key", "vec", "id", "rows"), "key")
    score = F.aggregate(F.zip_with("own", "vec", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    found = scratch.keep(found.select("q", "key", "id", "rows", score.alias("score")), "found")
    # of equal vectors the smallest ids, cut down within tasks before they are shuffled
    copies = rows.join(alike.filter("rows > 1").select("vec", "key"), "vec").select("key", "vec_id")
    copies = copies.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("k") <= n + 1)
    copies = copies.groupBy("key").agg(F.collect_list("vec_id").alias("ids"))
    found = found.join(copies, "key", "left").select("q", "score", F.explode(F.coalesce("ids", F.array("id"))).alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("k", best).filter(F.col("k") <= n + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("nearest"))
    found = scratch.keep(found, "nearest")
    asking = rows.filter("asks").join(alike.filter("asks").select("vec", F.col("key").alias("q")), "vec").select(F.col("vec_id").alias("query_id"), "q")
    out = asking.join(found, "q").select("query_id", F.slice(F.filter("nearest", lambda x: x["vec_id"] != F.col("query_id")), 1, n).alias("nearest"))
    return out.select("query_id", F.posexplode("nearest").alias("k", "x")).select("query_id", (F.col("k") + 1).alias("rank"), "x.vec_id", "x.score")
