"""SimHash near copies: fingerprints, tiled exact comparison and groups."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import lm
from ledgerloom.llm.components import components
from ledgerloom.llm.scratch import Scratch, shuffle_partitions

TILE_ROWS = 4096
#: Sets and their hashes in a tile that is compared exactly, and hashes that its tables of ones hold at once.
SET_ROWS, SET_HASHES, SET_WIDTH = 1024, 1 << 18, 2048
#: Keys of a set of runs: sets that share none are not compared, which sets of a similarity of 0.8 do with a chance of 0.2^KEYS.
KEYS = 8
TEXTS_AT_ONCE = 256
PAIRS_HELD = 1 << 16
SLICE = 1 << 20
NEXT_SPACE = re.compile(rb"[\t-\r ]").search
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _runs(found: list[bytes], words: int) -> list[bytes]:
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [joined[s:e] for s, e in zip(starts, ends[words - 1 :].tolist())]


def shingles(text: str | None, words: int) -> Iterator[list[bytes]]:
    """Runs of so many words of a text, A-Z lower-cased, words being what lies between ASCII white space; a shorter text is one run, no words none.

    A text is split a slice at a time, which ends where a word does, and gives a list of runs for each."""
    raw, at, before, any_ = (text or "").encode().translate(LOWER), 0, [], False
    while at < len(raw):
        space = NEXT_SPACE(raw, at + SLICE)
        stop = space.start() if space else len(raw)
        found = before + raw[at:stop].split()
        if len(found) >= words:
            yield _runs(found, words)
            any_, found = True, found[len(found) - words + 1 :]
        before, at = found, stop
    if before and not any_:
        yield [b" ".join(before)]


def hashes(text: str | None, words: int) -> np.ndarray:
    """Of each run: XXH64 with seed 42."""
    found, digest = [np.zeros(0, "<u8")], xxhash.xxh64_intdigest
    found += [np.array([digest(r, 42) for r in runs], "<u8") for runs in shingles(text, words)]
    return np.concatenate(found)


def run_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Of each text the distinct runs of words, as hashes of the hashes of their words; runs as in shingles()."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        own, n = lm.words([(t or "").encode().translate(LOWER) for t in texts[at : at + TEXTS_AT_ONCE]])
        chain = lambda parts: reduce(lambda h, w: lm.mixed(h * np.uint64(0x9E3779B97F4A7C15) ^ w), parts, np.full(len(parts[0]), len(parts), np.uint64))
        runs = chain([own[k : max(k, len(own) - words + 1 + k)] for k in range(words)])
        for a, b in zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist()):
            yield np.unique(runs[a : b - words + 1]) if b - a >= words else chain([own[k : k + 1] for k in range(a, b)]) if b > a else own[:0]


def fingerprint(first: np.ndarray, lanes: int) -> np.ndarray:
    """So many unsigned 64-bit lanes; a bit is set if it is set in over half of the runs' hashes, mixed anew for each lane after the first."""
    ones = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(first), 1 << 14):
        h = first[at : at + (1 << 14)]
        mixed = [h]
        for lane in range(1, lanes):
            m = (h ^ np.uint64(lane)) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ m >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            mixed.append(m ^ m >> np.uint64(29))
        # the bits of a word are dealt to its bytes, which 255 words at a time cannot overflow
        n = -(-len(h) // 255)
        spread = np.zeros((lanes, 8, 255 * n), np.uint64)
        spread[:, :, : len(h)] = np.stack(mixed)[:, None, :] >> np.arange(8, dtype=np.uint64)[:, None] & np.uint64(0x0101010101010101)
        counts = spread.reshape(lanes, 8, n, 255).sum(3).view(np.uint8).reshape(lanes, 8, n, 8).sum(2, dtype=np.int64)
        ones += counts.transpose(0, 2, 1).reshape(lanes, 64)
    return np.packbits(2 * ones > len(first), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, words: int, lanes: int, distinct: bool) -> DataFrame:
    """(doc_id, fp array<long>, n_shingles) of each row of docs (doc_id, text).

    distinct counts a run of words once however often it comes. A text takes some 30 bytes of memory for each word. Null and empty texts, and those of white space, get zeros.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = hashes(text, words)
                found = np.unique(found) if distinct else found
                rows.append((fingerprint(found, lanes).view(np.int64), len(found)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": [r[0] for r in rows], "n_shingles": [r[1] for r in rows]})

    schema = T.StructType([docs.select("doc_id").schema[0], *T.StructType.fromDDL("fp array<long>, n_shingles long")])
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def _offsets(segments: int, radius: int) -> list[list[int]]:
    """Differences of segment counts that add up to the radius at most, one of each pair of opposites."""
    found = (d for d in itertools.product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, d)) <= radius)
    return [list(d) for d in found if d >= (0,) * segments]


def _compare(a: np.ndarray, b: np.ndarray, radius: int, half_radius: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows at most radius bits apart, a slice of a at a time. Half of the lanes go first; the rest only where that half leaves room.

    half_radius leaves out pairs that differ by more bits than that in the first half of the lanes.
    """
    half = max(1, a.shape[1] // 2)
    room = radius if half_radius is None or half == a.shape[1] else min(radius, half_radius)
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        off = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
        for lane in range(1, half):
            off += np.bitwise_count(part[:, None, lane] ^ b[None, :, lane])
        i, j = np.nonzero(off <= room)
        if half < a.shape[1] and len(i):
            full = np.bitwise_count(part[i] ^ b[j]).sum(1, dtype=np.int64)
            i, j = i[full <= radius], j[full <= radius]
        if len(i):
            yield i + at, j


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For n rows and linked index pairs, each row's smallest reachable row, so that links to it stand for all pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while not np.array_equal(root, up := root[root]):
                root = up
            if np.array_equal(before, root):
                break
    return root


def _link_tiles(lanes: int, radius: int, half_radius: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for ids_a, fps_a, ids_b, fps_b in zip(*(batch[c] for c in ("ids_a", "fps_a", "ids_b", "fps_b"))):
                a, b = fps_a.view(np.uint64).reshape(-1, lanes), fps_b.view(np.uint64).reshape(-1, lanes)
                hits = list(_compare(a, b, radius, half_radius)) if len(a) * len(b) <= PAIRS_HELD else _compare(a, b, radius, half_radius)
                if hits:
                    ids = np.concatenate([ids_a, ids_b])
                    root = spanning(len(ids), ((i, j + len(a)) for i, j in hits))
                    moved = np.flatnonzero(root != np.arange(len(ids)))
                    found.append((ids[moved], ids[root[moved]]))
            a, b = map(np.concatenate, zip(*found))
            yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    return run


def linked(prints: DataFrame, lanes: int, radius: int, segments: int, scratch: Scratch, half_radius: int | None = None, reach: int = 0) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at most radius bits apart (and half_radius in half of the lanes).

    prints: (id long, fp array<long>, band), one row for each fingerprint and band. Fingerprints whose bands differ by
    more than the reach are not compared. Tiles hold fingerprints of one band whose bits, counted in so many equal segments, agree
    (or, in one segment, lie in the same range as wide as the radius). A pair of tiles is skipped if those counts differ by
    more than the radius in all, since each bit changes one count by one. Each pair of tiles that is left is compared exactly and gives a spanning forest of its links, never all pairs.
    Tiles are salted to about TILE_ROWS rows, so a count that very many fingerprints share is many tiles.
    """
    width = 64 * lanes // segments
    bits = [
        sum((F.bit_count(F.expr(f"shiftrightunsigned(fp[{at // 64}], {at % 64})").bitwiseAND(F.lit((1 << min(width, 64)) - 1 if width < 64 else -1))) for at in range(s * width, (s + 1) * width, min(width, 64))), F.lit(0))
        for s in range(segments)
    ]
    grain = max(radius, 1) if segments == 1 else 1
    keyed = prints.select("id", "fp", "band", F.array(*(F.floor(b / grain).cast("int") for b in bits)).alias("counts"))
    keyed = scratch.keep(keyed, "prints")
    sizes = keyed.groupBy("band", "counts").count().select("band", "counts", "count", F.ceil(F.col("count") / TILE_ROWS).cast("int").alias("salts"))
    sizes = scratch.keep(sizes, "sizes")

    tiles = keyed.join(sizes, ["band", "counts"]).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    tiles = tiles.groupBy("band", "counts", "salt").agg(F.collect_list(F.struct("id", "fp")).alias("rows"))
    tiles = tiles.select(
        F.xxhash64("band", "counts", "salt").alias("tile"),
        F.col("rows.id").alias("ids"),
        F.flatten("rows.fp").alias("fps"),
    )
    tiles = scratch.keep(tiles, "tiles")

    steps = F.array(*(F.array(*map(F.lit, d)) for d in _offsets(segments, -(-radius // grain))))
    left = sizes.withColumn("step", F.explode(steps)).withColumn("up", F.explode(F.array(*map(F.lit, range(-reach, reach + 1)))))
    # a single fingerprint isn't compared with itself
    left = left.filter((F.col("count") > 1) | (F.col("up") != 0) | F.exists("step", lambda d: d != 0))
    left = left.select(
        F.col("band").alias("band_a"), F.col("counts").alias("counts_a"), F.col("salts").alias("salts_a"), "up", "step",
        (F.col("band") + F.col("up")).alias("band"),
        F.zip_with("counts", "step", lambda c, d: c + d).alias("counts"),
    )
    # where the counts are the same, a step up in the band stands for both directions
    left = left.filter((F.col("up") >= 0) | F.exists("step", lambda d: d != 0))
    pairs = left.join(sizes, ["band", "counts"])
    pairs = pairs.withColumn("salt_a", F.explode(F.sequence(F.lit(0), F.col("salts_a") - 1)))
    pairs = pairs.withColumn("salt_b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    same = (F.col("band_a") == F.col("band")) & (F.col("counts_a") == F.col("counts"))
    pairs = pairs.filter(~same | (F.col("salt_a") <= F.col("salt_b")))
    pairs = pairs.select(
        F.xxhash64("band_a", "counts_a", F.col("salt_a").cast("int")).alias("tile_a"),
        F.xxhash64("band", "counts", F.col("salt_b").cast("int")).alias("tile_b"),
    )
    side = lambda s: tiles.select(F.col("tile").alias(f"tile_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("fps").alias(f"fps_{s}"))
    work = pairs.join(side("a"), "tile_a").join(side("b"), "tile_b").select("ids_a", "fps_a", "ids_b", "fps_b")
    found = scratch.keep(work.repartition(shuffle_partitions(prints.sparkSession)).mapInPandas(_link_tiles(lanes, radius, half_radius), "a long, b long").distinct(), "links")
    scratch.drop(keyed, sizes, tiles)
    return found


def _first_of_each(alike: DataFrame, found: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """Of alike (id, first doc_id, ...) and components (id, component): what `by` names, with the smallest doc_id of the component."""
    named = scratch.keep(alike.join(found, "id", "left").select(*by, "first", F.coalesce("component", "id").alias("component")), "components")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return scratch.keep(named.join(lowest, "component").select(*by, "component_id"), "named")


def groups(docs: DataFrame, words: int = 3, lanes: int = 1, radius: int = 2, distinct: bool = False, segments: int | None = None, banded: bool = False) -> DataFrame:
    """(doc_id, fp, n_shingles, component_id) of each row of docs (doc_id, text; other columns are ignored).

    doc_id is of any type that has an order, and component_id of the same: the smallest doc_id reachable over links of at most radius bits. banded leaves out links between
    documents whose numbers of shingles differ by more than a factor of 1.25 to 1.5625, which similarities of 0.8 exclude.
    Null and empty texts have the fingerprint zero and link with each other. Rows with a null doc_id get a null
    component_id and link nothing; repeated rows are one document; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, words, lanes, distinct), "fingerprints")
    band = F.floor(F.log(F.greatest("n_shingles", F.lit(1))) / F.log(F.lit(1.25))).cast("int") if banded else F.lit(0)
    prints = prints.withColumn("band", band)
    alike = prints.filter("doc_id is not null").groupBy("fp", "band").agg(F.min("doc_id").alias("first"))
    alike = scratch.keep(alike.withColumn("id", F.monotonically_increasing_id()), "alike")
    segments = segments or (4 if radius <= 3 else 1)
    found = components(linked(alike.drop("first"), lanes, radius, segments, scratch, reach=int(banded)), scratch)
    named = _first_of_each(alike, found, ["fp", "band"], scratch)
    out = prints.join(named, ["fp", "band"], "left")
    return out.select("doc_id", "fp", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def least_runs(hashes: np.ndarray) -> np.ndarray:
    """For each of KEYS orders of runs, dealt by chance, the first of the given ones: two sets share it with a chance of their Jaccard similarity."""
    out = np.zeros(KEYS, np.uint64)
    for k in range(KEYS if len(hashes) else 0):
        h = (hashes ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out[k] = (h ^ h >> np.uint64(29)).min()
    return out


def sets(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """(doc_id, fp array<long>, set binary, n_shingles, least array<long>) of each row of docs (doc_id, text): set is a 128-bit digest of the distinct runs' hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for found in run_sets(batch["text"].tolist(), words):
                rows.append((fingerprint(found, lanes).view(np.int64), xxhash.xxh3_128_digest(found.tobytes()), len(found), least_runs(found).view(np.int64)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": [r[0] for r in rows], "set": [r[1] for r in rows], "n_shingles": [r[2] for r in rows], "least": [r[3] for r in rows]})

    schema = T.StructType([docs.select("doc_id").schema[0], *T.StructType.fromDDL("fp array<long>, set binary, n_shingles long, least array<long>")])
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def _hash_sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x.view(np.int64) for x in run_sets(batch["text"].tolist(), words)]
            yield pd.DataFrame({"id": batch["id"], "grp": batch["grp"], "hashes": found})

    return run


def similar(hashes_a: np.ndarray, sizes_a: np.ndarray, hashes_b: np.ndarray, sizes_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets, each so many hashes of a flat array, whose Jaccard similarity is the least or more."""
    both = np.intersect1d(hashes_a, hashes_b)
    sides = []
    for hashes, sizes in ((hashes_a, sizes_a), (hashes_b, sizes_b)):
        code = np.minimum(np.searchsorted(both, hashes), max(0, len(both) - 1))
        known = both[code] == hashes if len(both) else np.zeros(len(hashes), bool)
        code, row = code[known], np.repeat(np.arange(len(sizes)), sizes)[known]
        order = np.argsort(code, kind="stable")
        sides.append((code[order], row[order], len(sizes)))
    common = np.zeros((len(sizes_a), len(sizes_b)), np.float32)
    for at in range(0, len(both), SET_WIDTH):
        ones = []
        for code, row, n in sides:
            lo, hi = np.searchsorted(code, [at, at + SET_WIDTH])
            table = np.zeros((n, SET_WIDTH), np.float32)
            table[row[lo:hi], code[lo:hi] - at] = 1
            ones.append(table)
        common += ones[0] @ ones[1].T
    union = np.asarray(sizes_a)[:, None] + np.asarray(sizes_b)[None, :] - common.astype(np.float64)
    return np.nonzero(common / np.maximum(union, 1) >= least)


def _link_sets(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.concatenate([row.ids_a, row.ids_b])
                i, j = similar(row.hashes_a, row.sizes_a, row.hashes_b, row.sizes_b, least)
                root = spanning(len(ids), iter([(i, j + len(row.ids_a))]))
                moved = np.flatnonzero(root != np.arange(len(ids)))
                out = pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})
                yield out[out["a"] != out["b"]]

    return run


def _band(n: str) -> Column:
    """Sizes whose bands differ by more than 1 differ by more than a factor of 1.25, which similarities of 0.8 exclude."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / F.log(F.lit(1.25))).cast("int")


def exact_links(rows: DataFrame, words: int, least: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect all sets of runs of one group whose Jaccard similarity is the least, 0.8 at the lowest, or more.

    rows: (id long, grp long, text). Sets are tiles by group and band, salted to about SET_ROWS sets and SET_HASHES
    hashes, and each pair of tiles of a group in the same or neighbouring bands gives a spanning forest of its links, so
    a large group is many tiles and never all its pairs. A run stands as its 64-bit hash.
    """
    found = scratch.keep(rows.select("id", "grp", "text").mapInPandas(_hash_sets(words), "id long, grp long, hashes array<long>"), "sets")
    found = found.withColumn("n", F.size("hashes")).withColumn("band", _band("n"))
    fill = F.greatest(F.sum("n") / SET_HASHES, F.count("*") / SET_ROWS)
    sizes = scratch.keep(found.groupBy("grp", "band").agg(F.ceil(fill).cast("int").alias("salts")), "sizes")
    tiles = found.join(sizes, ["grp", "band"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    tiles = tiles.groupBy("grp", "band", "salt").agg(F.collect_list(F.struct("id", "n", "hashes")).alias("rows"))
    tiles = tiles.select("grp", "band", "salt", F.col("rows.id").alias("ids"), F.col("rows.n").alias("sizes"), F.flatten("rows.hashes").alias("hashes"))
    tiles = scratch.keep(tiles, "tiles")

    left = sizes.select("grp", F.col("band").alias("band_a"), F.col("salts").alias("salts_a"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up"))
    pairs = left.withColumn("band", F.col("band_a") + F.col("up")).join(sizes, ["grp", "band"]).withColumnRenamed("band", "band_b")
    pairs = pairs.withColumn("salt_a", F.explode(F.sequence(F.lit(0), F.col("salts_a") - 1)))
    pairs = pairs.withColumn("salt_b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    pairs = pairs.filter("up = 1 or salt_a <= salt_b").select("grp", "band_a", "salt_a", "band_b", "salt_b")
    side = lambda s: tiles.select("grp", *(F.col(c).alias(f"{c}_{s}") for c in ("band", "salt", "ids", "sizes", "hashes")))
    work = pairs.join(side("a"), ["grp", "band_a", "salt_a"]).join(side("b"), ["grp", "band_b", "salt_b"])
    work = work.select(*(f"{c}_{s}" for s in "ab" for c in ("ids", "sizes", "hashes"))).repartition(shuffle_partitions(rows.sparkSession))
    return scratch.keep(work.mapInPandas(_link_sets(least), "a long, b long").distinct(), "links")


def near_copies_out(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of docs, all columns, without those that links lead to from a document with a smaller doc_id.

    Links are pairs whose sets of distinct shingles have a Jaccard similarity of the least, 0.8 at the lowest, or more.
    Fingerprints of 256 bits only find candidates, among sets that share one of KEYS keys, so that work grows with the
    number of documents; of pairs at 0.8 three in a million share none. At 0.8, 39 bits differ in large sets, with a
    deviation of 6, and 48, with one of 6.4, where 4 shingles stand against 5; 76 bits, 50 of them in one half, leave more
    than four deviations. Candidates that hang together are then compared exactly. Different sets of fewer than 4 shingles
    are never that similar, equal sets always are (those without shingles, of null, empty and blank texts, too). Of repeated
    rows with the doc_id that stays, all stay, and so do rows without one. doc_id is of any type that has an order. An empty
    table gives none. Columns named id or grp may be there and stay.
    """
    lanes, radius, half_radius = 4, 76, 50
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(sets(docs, words, lanes).filter("doc_id is not null"), "fingerprints")
    alike = prints.groupBy("set").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("n_shingles").alias("n_shingles"), F.first("least").alias("least"))
    alike = scratch.keep(alike.withColumn("id", F.monotonically_increasing_id()), "alike")
    keyed = alike.filter("n_shingles >= 4").select("id", "fp", F.posexplode("least").alias("k", "key")).select("id", "fp", F.xxhash64("k", "key").alias("band"))
    shared = keyed.groupBy("band").count().filter("count > 1").select("band")
    near = components(linked(keyed.join(shared, "band", "left_semi"), lanes, radius, 1, scratch, half_radius), scratch)
    near = near.union(near.select("component", "component").distinct())
    # of each set the text of its first document
    wanted = scratch.keep(alike.select("id", F.col("first").alias("doc_id")).join(near.withColumnRenamed("component", "grp"), "id"), "wanted")
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")
    found = components(exact_links(texts, words, least, scratch), scratch)
    named = _first_of_each(alike, found, ["set"], scratch)
    gone = prints.select("doc_id", "set").join(named, "set").filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
