"""Near copies among embeddings, by binary codes of randomly rotated vectors.

A unit vector is rotated by a random orthogonal matrix; the signs of its components are its code, which stands for the
vector of components +-1/sqrt(D) nearest to it. Stored with the code: the inner product of the two (the correction
factor), and the rotated vector itself in LEVELS steps a component, and in bytes, with the length of what each rounds off. Ands and bit
counts of one vector's code and the other's steps give the inner product of code and vector; divided by the correction
factor it is an unbiased estimate of the cosine. At a cosine of t it lies within sqrt(1 - t^2) sqrt(1 - c^2) / c of t,
c being the correction factor, and within that times eps / sqrt(D - 1) of t but for a chance that falls as exp(-eps^2 / 2).
Estimates outside of the confidence bound of the threshold decide a pair at once. The others are held against what the
bytes of both leave open, which is some hundredths, and what is still undecided is computed again from the vectors.

Vectors are dealt to cells by the nearest of PIVOTS vectors, so those that are near each other often share a cell. A cell
knows between which angles to each pivot its vectors lie. By the triangle inequality two vectors at an angle of a or less
are at angles to a pivot that differ by a or less, so pairs of cells that lie further apart for some pivot are left out,
for certain: what falls into groups is compared within groups and with what is near them, what is spread evenly, with everything.
Codes, bytes and factors travel to the comparison of cells. What they cannot decide goes on as pairs of
ids, to which the vectors are joined, or as a pair of cells where so many pairs are left that moving vectors is cheaper.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.scratch import Scratch, shuffle_partitions
from ledgerloom.llm.simhash import spanning

LEAST_ROWS, MOST_ROWS = 1024, 16384
SLICE = 1 << 17
#: A pair of cells with more undecided pairs than so many times its rows is computed again as a whole.
DENSE = 4
#: Vectors, the first ones by a hash, that cells are arranged by. The driver gets them; which they are changes no result.
PIVOTS = 64
PLANES = 4
LEVELS = 1 << PLANES
SLACK = 1e-5
CODED = "key long, d int, side int, code array<long>, steps array<long>, fine binary, factors array<double>"
FACTORS = 7


@lru_cache(maxsize=4)
def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=-1, bitorder="little").view(np.int64)


def turned(vectors: np.ndarray, seed: int = 0) -> np.ndarray:
    """Unit vectors, filled up to whole words of components, rotated."""
    size = -(-vectors.shape[1] // 64) * 64
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    return np.pad(unit, ((0, 0), (0, size - vectors.shape[1]))) @ rotation(size, seed)


def encode(vectors: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, words), steps (n, PLANES, words), bytes (n, size) and factors (n, FACTORS) of finite vectors that aren't zero.

    The factors: correction factor; lowest step, step, length of the rounding and sum of the rounded components of the
    steps; unit and length of the rounding of the bytes."""
    v = turned(vectors, seed)
    low = v.min(axis=1, keepdims=True)
    step = np.maximum((v.max(axis=1, keepdims=True) - low) / (LEVELS - 1), 1e-300)
    level = np.rint((v - low) / step).astype(np.uint8)
    rounded = low + step * level
    unit = np.abs(v).max(axis=1, keepdims=True) / 127
    fine = np.rint(v / unit).astype(np.int8)
    factors = [np.abs(v).sum(1) / np.sqrt(v.shape[1]), low[:, 0], step[:, 0], np.linalg.norm(v - rounded, axis=1), rounded.sum(1), unit[:, 0], np.linalg.norm(v - fine * unit, axis=1)]
    return _bits(v > 0), np.stack([_bits(level >> k & 1) for k in range(PLANES)], axis=1), fine, np.stack(factors, axis=1)


def code_products(code: np.ndarray, steps: np.ndarray, factors: np.ndarray, size: int) -> np.ndarray:
    """Inner products of each coded unit vector (rows) with each rounded vector (columns)."""
    # numpy counts the bits of signed integers without their sign
    code, steps = code.view(np.uint64), steps.view(np.uint64)
    ones = np.bitwise_count(code).sum(1, dtype=np.int64).astype(np.float32)
    level = np.zeros((len(code), len(steps)), np.uint16 if size * (LEVELS - 1) < 1 << 16 else np.uint32)
    for word in range(code.shape[1]):
        for k in range(PLANES):
            level += np.bitwise_count(code[:, None, word] & steps[None, :, k, word]).astype(level.dtype) << level.dtype.type(k)
    total = level * (2 * factors[:, 2] / np.sqrt(size)).astype(np.float32)
    total += ones[:, None] * (2 * factors[:, 1] / np.sqrt(size)).astype(np.float32)
    total -= (factors[:, 4] / np.sqrt(size)).astype(np.float32)
    return total


def estimate(code: np.ndarray, correction: np.ndarray, steps: np.ndarray, factors: np.ndarray, size: int) -> np.ndarray:
    """Unbiased estimates of the cosines, over random rotations."""
    return code_products(code, steps, factors, size) / correction[:, None].astype(np.float32)


def confidence(correction: np.ndarray, t: float, size: int, eps: float | None) -> np.ndarray:
    """How far below t estimates can lie for pairs with a cosine of t or more: for certain, or with eps standard deviations if that is less."""
    width = 1.0 if eps is None else min(1.0, eps / np.sqrt(size - 1))
    return width * np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0, 1 - correction**2)) / correction


def pivots_of(alike: DataFrame) -> dict[int, np.ndarray]:
    """By length the rotated pivots: of all different vectors (key, vec) the PIVOTS with the smallest hashes of their keys, each followed by the nearest of those left."""
    by: dict[int, list] = {}
    for r in alike.select("vec", F.xxhash64("key").alias("h")).orderBy("h").limit(PIVOTS).collect():
        by.setdefault(len(r.vec), []).append(r.vec)
    return {d: _chained(turned(np.array(v, float))) for d, v in by.items()}


def _chained(vectors: np.ndarray) -> np.ndarray:
    order, near = [0], vectors @ vectors.T
    while len(order) < len(vectors):
        near[:, order[-1]] = -np.inf
        order.append(int(near[order[-1]].argmax()))
    return vectors[order]


def _coded(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["vec"].map(len)):
                code, steps, fine, factors = encode(np.stack(part["vec"].to_list()).astype(float))
                side = (fine.astype(np.float32) @ pivots[d].T).argmax(1) if d in pivots else 0
                yield pd.DataFrame({"key": part["key"], "d": d, "side": side, "code": list(code), "steps": list(steps.reshape(len(part), -1)), "fine": [x.tobytes() for x in fine], "factors": list(factors)})

    return run


def _between(pivots: dict[int, np.ndarray]):
    """(d, cell, low, high): the least and the largest angle to each pivot that vectors of a cell can have, by their bytes and what these round off."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                cell = _Cell(row.keys, row.code, row.steps, row.fine, row.factors)
                if row.d in pivots:
                    near, off = cell.near.astype(float) @ pivots[row.d].T, cell.factors[:, 6:7] + SLACK
                    low, high = (np.arccos(np.clip(near + s * off, -1, 1)) for s in (1, -1))
                    rows.append((row.d, row.cell, low.min(0), high.max(0)))
                else:
                    rows.append((row.d, row.cell, [], []))
            yield pd.DataFrame(rows, columns=["d", "cell", "low", "high"])

    return run


class _Cell:
    def __init__(self, keys, code, steps, fine, factors):
        self.keys = np.asarray(keys)
        self.code = np.asarray(code).reshape(len(self.keys), -1)
        self.steps = np.asarray(steps).reshape(len(self.keys), PLANES, -1)
        self.factors = np.asarray(factors).reshape(len(self.keys), FACTORS)
        fine = fine if isinstance(fine, np.ndarray) and fine.dtype == np.int8 else np.frombuffer(b"".join(fine), np.int8)
        self.near = fine.reshape(len(self.keys), -1) * self.factors[:, 5:6].astype(np.float32)


def undecided(a: _Cell, b: _Cell, least: float, same: bool, eps: float | None, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Index pairs that may have a cosine of at least `least`, of a cell with itself each pair once; None if there are more than `most`."""
    size, found, n = 64 * a.code.shape[1], [], 0
    # the estimate is of code and rounded vector: the rounding adds to what it may be off
    floor = (least - confidence(a.factors[:, 0], least, size, eps) - SLACK).astype(np.float32)[:, None]
    off = b.factors[:, 3].astype(np.float32)
    # the vectors that the bytes give are as far from the cosine as their roundings can make them
    ea, eb = a.factors[:, 6:7], b.factors[:, 6]
    step = max(1, SLICE // len(b.keys))
    for at in range(0, len(a.keys), step):
        part = slice(at, at + step)
        left = estimate(a.code[part], a.factors[part, 0], b.steps, b.factors, size) >= floor[part] - off / a.factors[part, :1].astype(np.float32)
        if same:
            left &= np.arange(len(b.keys)) > at + np.arange(len(left))[:, None]
        if np.count_nonzero(left) > left.size >> 8:
            i, j = np.nonzero(left & (a.near[part] @ b.near.T >= (least - ea[part] - eb - ea[part] * eb - SLACK).astype(np.float32)))
        else:
            i, j = np.nonzero(left)
            near = np.einsum("ij,ij->i", a.near[i + at], b.near[j])
            keep = near >= least - ea[i + at, 0] - eb[j] - ea[i + at, 0] * eb[j] - SLACK
            i, j = i[keep], j[keep]
        if len(i):
            found.append((i + at, j))
            n += len(i)
            if n > most:
                return None
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*found))


FOUND = "d int, cell_a long, cell_b long, a long, b long"


def _compared(least: float, eps: float | None):
    """(d, cell_a, cell_b, a, b): undecided pairs of ids, or a row without ids for a dense pair of cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a = _Cell(row.keys_a, row.code_a, row.steps_a, row.fine_a, row.factors_a)
                same = row.cell_a == row.cell_b
                b = a if same else _Cell(row.keys_b, row.code_b, row.steps_b, row.fine_b, row.factors_b)
                pairs = undecided(a, b, least, same, eps, DENSE * (len(a.keys) + len(b.keys)))
                if pairs is None:
                    yield pd.DataFrame({"d": [row.d], "cell_a": [row.cell_a], "cell_b": [row.cell_b], "a": pd.array([None], "Int64"), "b": pd.array([None], "Int64")})
                elif len(pairs[0]):
                    yield pd.DataFrame({"d": row.d, "cell_a": row.cell_a, "cell_b": row.cell_b, "a": a.keys[pairs[0]], "b": b.keys[pairs[1]]})

    return run


def _unit(vectors) -> np.ndarray:
    vectors = np.stack(list(vectors)).astype(float)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _exact(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vec_a"].map(len)):
                hit = part[np.einsum("ij,ij->i", _unit(part["vec_a"]), _unit(part["vec_b"])) >= least]
                yield pd.DataFrame({"a": np.append(hit["a"], hit["b"]), "b": np.append(hit["b"], hit["a"]), "links": np.append(hit["n_b"], hit["n_a"])}).astype(np.int64)

    return run


def _exact_cells(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                same = row.cell_a == row.cell_b
                keys = [np.asarray(row.keys_a), np.asarray(row.keys_b)]
                units = [_unit(np.asarray(v).reshape(len(k), -1)) for v, k in zip((row.vec_a, row.vec_b), keys)]
                shift = 0 if same else len(keys[0])
                keys, n = (keys[0], np.asarray(row.n_a)) if same else (np.concatenate(keys), np.concatenate([row.n_a, row.n_b]))
                links, step = np.zeros(len(keys), np.int64), max(1, (1 << 20) // len(units[1]))

                def hits():
                    for at in range(0, len(units[0]), step):
                        i, j = np.nonzero(units[0][at : at + step] @ units[1].T >= least)
                        i += at
                        if same:
                            i, j = i[i < j], j[i < j]
                        np.add.at(links, i, n[j + shift])
                        np.add.at(links, j + shift, n[i])
                        yield i, j + shift

                root = spanning(len(keys), hits())
                used = np.flatnonzero(links)
                yield pd.DataFrame({"a": keys[used], "b": keys[root[used]], "links": links[used]})

    return run


def near_cells(cells: DataFrame, between: DataFrame, least: float) -> DataFrame:
    """Pairs (d, cell_a, cell_b), a cell with itself too, but those whose vectors are all further apart than a cosine of `least` allows."""
    gap = float(np.arccos(least)) + SLACK
    side = lambda s: between.select("d", *(F.col(c).alias(f"{c}_{s}") for c in ("cell", "low", "high")))
    pairs = cells.select("d", F.col("cell").alias("cell_a"), F.explode(F.sequence(F.col("cell"), F.col("n_cells") - 1)).alias("cell_b"))
    pairs = pairs.join(side("a"), ["d", "cell_a"]).join(side("b"), ["d", "cell_b"])
    apart = lambda x, y: F.exists(F.zip_with(f"low_{x}", f"high_{y}", lambda lo, hi: lo - hi > gap), lambda far: far)
    return pairs.filter(~(apart("a", "b") | apart("b", "a"))).select("d", "cell_a", "cell_b")


def _dealt(coded: DataFrame, tasks: int) -> DataFrame:
    """coded with cell and n_cells: of vectors of one length in order of their sides, cells of about as many rows as make twice as many pairs of cells as tasks, within bounds."""
    per_side = coded.groupBy("d", "side").agg(F.count("*").alias("n_side"))
    order = Window.partitionBy("d").orderBy("side")  # of one length, a row for each pivot
    per_side = per_side.withColumn("before", F.sum("n_side").over(order) - F.col("n_side")).withColumn("of", F.sum("n_side").over(Window.partitionBy("d")))
    rows = F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(MOST_ROWS), F.ceil(F.col("of") / F.ceil(F.sqrt(F.lit(4.0 * tasks))))))
    per_side = per_side.withColumn("rows", rows).withColumn("n_cells", F.ceil(F.col("of") / F.col("rows")))
    at = F.col("before") + F.pmod(F.xxhash64("key"), F.col("n_side"))
    return coded.join(per_side, ["d", "side"]).withColumn("cell", F.floor(at / F.col("rows"))).drop("side", "n_side", "before", "of", "rows")


def _sides(pairs: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    side = lambda s: cells.select("d", *(F.col(c).alias(f"{c}_{s}") for c in ["cell", *columns]))
    return pairs.join(side("a"), ["d", "cell_a"]).join(side("b"), ["d", "cell_b"]).repartition(shuffle_partitions(cells.sparkSession))


def near_copies(vectors: DataFrame, least: float = 0.9, eps: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding; other columns are ignored).

    Two rows link if their cosine in double precision is `least`, from 0 to 1, or more. n_links counts the rows a row links with;
    vec_id is of any type that has an order; component_id is the smallest vec_id reachable, kept is true for that one. Vectors that are null, empty, zero or hold a
    null, NaN or infinity link with nothing; so do rows without a vec_id, which get a null component_id and are not kept.
    Vectors of different lengths do not link. An empty table gives none. Equal vectors are one, with their number.

    Without eps the confidence bound is the certain one, and no link is lost. With it, each link is lost with a chance of
    about exp(-eps^2 / 2), and fewer pairs are computed again. Pairs of cells that are too far apart for a
    link do not meet. A vector's code, bytes and factors, some 160 bytes at 64 components, travel once for each cell that its own meets, and pairs of ids are sent on for at most DENSE times a cell's rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    vec = F.col("embedding").cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(fine & F.col("vec_id").isNotNull(), vec).alias("vec"))
    alike = rows.filter("vec is not null").groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("id"))
    alike = scratch.keep(alike.withColumn("key", F.monotonically_increasing_id()), "alike")
    pivots = pivots_of(alike)
    coded = scratch.keep(alike.select("key", "vec").mapInPandas(_coded(pivots), CODED), "coded")
    dealt = scratch.keep(_dealt(coded, shuffle_partitions(spark)), "dealt")
    cells = dealt.groupBy("d", "cell").agg(F.first("n_cells").alias("n_cells"), F.collect_list(F.struct("key", "code", "steps", "fine", "factors")).alias("rows"))
    cells = cells.select("d", "cell", "n_cells", F.col("rows.key").alias("keys"), F.col("rows.fine").alias("fine"), *(F.flatten(f"rows.{c}").alias(c) for c in ("code", "steps", "factors")))
    cells = scratch.keep(cells, "cells")

    between = scratch.keep(cells.mapInPandas(_between(pivots), "d int, cell long, low array<double>, high array<double>"), "between")
    pairs = scratch.keep(near_cells(cells, between, least), "pairs")
    work = _sides(pairs, cells, ["keys", "code", "steps", "fine", "factors"])
    undecided_ = scratch.keep(work.mapInPandas(_compared(least, eps), FOUND), "undecided")

    side = lambda s: alike.select(F.col("key").alias(s), F.col("vec").alias(f"vec_{s}"), F.col("n").alias(f"n_{s}"))
    exact = undecided_.filter("a is not null").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    found = exact.mapInPandas(_exact(least), "a long, b long, links long")
    dense = undecided_.filter("a is null").select("d", "cell_a", "cell_b")
    wanted = dense.select("d", F.explode(F.array("cell_a", "cell_b")).alias("cell")).distinct()
    whole = dealt.select("d", "cell", "key").join(wanted, ["d", "cell"], "left_semi").join(alike.select("key", "vec", "n"), "key")
    whole = whole.groupBy("d", "cell").agg(F.collect_list(F.struct("key", "vec", "n")).alias("rows"))
    whole = scratch.keep(whole.select("d", "cell", F.col("rows.key").alias("keys"), F.col("rows.n").alias("n"), F.flatten("rows.vec").alias("vec")), "whole")
    links = _sides(dense, whole, ["keys", "n", "vec"]).mapInPandas(_exact_cells(least), "a long, b long, links long")
    found = scratch.keep(found.union(links), "found")
    scratch.drop(coded, dealt, cells, between, pairs, undecided_, whole)

    links = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    parts = components(found.select("a", "b"), scratch).withColumnRenamed("id", "key")
    named = alike.join(links, "key", "left").join(parts, "key", "left")
    named = named.select("vec", "n", "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component"))
    named = scratch.keep(named, "named")
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(lowest, "component").select("vec", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(named, "vec", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
