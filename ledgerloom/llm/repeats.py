"""Removal of long repeated byte strings, by refining the buckets of sampled suffixes.

A full suffix array of a corpus needs many times its bytes. Here suffixes are sampled by content: each string of LENGTH
bytes picks, among the first REACH positions in it, the one whose 16 bytes have the smallest hash (the leftmost of
ties). Equal strings pick equal places, so comparing the suffixes at picked positions ("anchors") compares all strings.

Bucket-pointer refinement then runs on anchors. The initial bucket of an anchor is the q-gram that all strings with that
anchor contain. Strings are told apart by how far before the anchor they start, 0 to REACH - 1. A bucket covers a
range of those offsets: all of its strings contain its core and lie in its hull.
- A core that comes once: none of these strings repeats, and the bucket is done.
- Equal hulls: all of these strings repeat; the bucket is done, and one member stands for it from now on.
- Otherwise the bucket is split into FAN ranges of later offsets, each of which has a longer core. Members are sorted into
  its buckets by their bucket's identifier and those of the grams at the offsets next to the core, so no core is read
  again. The new identifiers serve the next level in the same way, and so on down to single offsets, where the core is the
  string itself.
Each level reads the members that the one before left open, which are those near the edges of repeats.

Identifiers are 64-bit hashes and strings count as equal if those of core and hull are. Of n different cores, some
n^2 / 2^65 pairs would share an identifier, 0.03 pairs of 10^9, and matter where their hulls do, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.scratch import Scratch

FAN = 4
TILE = 1 << 18
PLACE = (1 << 20) - 1
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
MEMBERS_AT_ONCE = 4096
TEXTS_AT_ONCE = 256


def _picked(buf: np.ndarray, reach: int) -> np.ndarray:
    """For each start in buf of a string, the place of the smallest hashed 16-gram among its first reach places."""
    v = buf.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | (v[step:] << np.uint64(8 * step))
    h = v[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ v[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h = (h & np.uint64(~PLACE & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < reach:
        step = min(span, reach - span)
        h = np.minimum(h[:-step], h[step:])
        span += step
    return (h & np.uint64(PLACE)).astype(np.int64)


def anchors(raws: list[bytes], length: int, reach: int) -> list[np.ndarray]:
    """Ascending anchor positions of each text; none in a text shorter than length."""
    found: list[list[np.ndarray]] = [[] for _ in raws]
    group: list[tuple[int, int, bytes]] = []

    def close() -> None:
        buf = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        places, at = _picked(buf, reach), 0
        for k, shift, piece in group:
            own = places[at : at + len(piece) - length + 1]
            own = own[np.append(True, own[1:] != own[:-1])]
            found[k].append(own - at + shift)
            at += len(piece)
        group.clear()

    size = 0
    for k, raw in enumerate(raws):
        for at in range(0, max(len(raw) - length + 1, 0), TILE):
            piece = raw[at : at + TILE + length - 1]
            if group and size + len(piece) > TILE:
                close()
                size = 0
            group.append((k, at, piece))
            size += len(piece)
    if group:
        close()
    return [np.unique(np.concatenate(x)) if len(x) > 1 else x[0] if x else np.zeros(0, np.int64) for x in found]


def _hash(text: bytes, seed: int = 0) -> int:
    return (xxhash.xxh3_64_intdigest(text, seed) ^ 1 << 63) - (1 << 63)


MEMBER = "part long, row int, pos int, node int, core long, hull long, whole boolean"
NAMES = [x.split()[0] for x in MEMBER.split(", ")]
HULL = 1  # seed


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """TEXTS_AT_ONCE rows at a time, so that what is worked out for them, and the frame that is sent back, don't follow the size of batches."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS_AT_ONCE):
            yield batch.iloc[at : at + TEXTS_AT_ONCE]


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in blocks (part) of BLOCK_ROWS rows or BLOCK_BYTES compressed bytes at most, or one row, numbered in them (row)."""
    squeeze, block, row, size = zstandard.ZstdCompressor(1), TaskContext.get().partitionId() << 32, 0, 0
    for batch in _sliced(batches):
        packed = [squeeze.compress((t or "").encode()) for t in batch["text"]]
        parts, rows = [], []
        for p in packed:
            if row and (row >= BLOCK_ROWS or size + len(p) > BLOCK_BYTES):
                block, row, size = block + 1, 0, 0
            parts.append(block)
            rows.append(row)
            row, size = row + 1, size + len(p)
        yield batch.drop(columns="text").assign(packed=packed, part=parts, row=rows)


def _members(length: int, reach: int):
    """The first level: a row for each anchor, with its core and hull."""
    q = length - reach + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _sliced(batches):
            raws = list(map(zstandard.decompress, batch["packed"]))
            places = anchors(raws, length, reach)
            n = list(map(len, places))
            cores = np.fromiter((_hash(r[a : a + q]) for r, p in zip(raws, places) for a in p.tolist()), np.int64, sum(n))
            part, row, pos = np.repeat(batch["part"].to_numpy(), n), np.repeat(batch["row"].to_numpy(), n), np.concatenate(places) if n else np.zeros(0, int)
            whole = (pos >= reach - 1) & (pos + length <= np.repeat(np.fromiter(map(len, raws), np.int64, len(raws)), n))
            texts = (r for r, k in zip(raws, n) for _ in range(k))
            hull = (_hash(r[a - reach + 1 : a + length], HULL) if w else _hash(b"%d %d %d" % (b, k, a)) for r, a, w, b, k in zip(texts, pos.tolist(), whole.tolist(), part.tolist(), row.tolist()))
            yield pd.DataFrame({"part": part, "row": row, "pos": pos, "node": 0, "core": cores, "hull": np.fromiter(hull, np.int64, len(pos)), "whole": whole})

    return run


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) ^ more
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _grams(blocks: np.ndarray) -> np.ndarray:
    """Identifiers of the bytes along the last axis."""
    size = blocks.shape[-1]
    padded = np.zeros((*blocks.shape[:-1], -(-size // 8) * 8), np.uint8)
    padded[..., :size] = blocks
    eight, h = padded.view(np.uint64), np.full(blocks.shape[:-1], size, np.uint64)
    for k in range(eight.shape[-1]):
        h = _mixed(h, eight[..., k])
    return h


def _parts(length: int, width: int, node_width: int):
    """A later level: from the open members and the texts of a block, a row for each range of node_width offsets in a member's width."""
    fan = width // node_width

    def refined(buf: np.ndarray, base: np.ndarray, size: np.ndarray, own: pd.DataFrame) -> Iterator[pd.DataFrame]:
        part, row, pos, first = (own[c].to_numpy().astype(np.int64) for c in ("part", "row", "pos", "node"))
        bucket, out = own["core"].to_numpy().view(np.uint64), np.arange(width)
        # the bytes outward from the core, on either side, in grams of node_width; places beyond the text are not used
        beside = lambda at, step: buf[np.clip(at[:, None] + step * out, 0, len(buf) - 1)].reshape(-1, fan, node_width)
        left, right = beside(base + pos - first - 1, -1), beside(base + pos - first - width + 1 + length, 1)
        grams = [_grams(x) for x in (left, right)]
        edges = [_grams(x[..., :-1]) for x in (left, right)]
        alone = _mixed(_mixed(part.view(np.uint64), row.view(np.uint64)), pos.view(np.uint64))
        for j in range(fan):
            lo = first + j * node_width
            hi = lo + node_width - 1
            core = bucket
            for k in range(j):
                core = _mixed(core, grams[0][:, k])
            core = _mixed(core, np.uint64(j))
            for k in range(fan - 1 - j):
                core = _mixed(core, grams[1][:, k])
            whole = (hi <= pos) & (pos - lo + length <= size)
            hull = np.where(whole, _mixed(edges[0][:, j], edges[1][:, fan - 1 - j]), alone)
            there = (lo <= pos) & (pos - hi + length <= size)
            yield pd.DataFrame({"part": part, "row": row.astype(np.int32), "pos": pos.astype(np.int32), "node": lo.astype(np.int32), "core": core.view(np.int64), "hull": hull.view(np.int64), "whole": whole})[there]

    def run(still: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        found, packed = [pd.DataFrame({c: [] for c in NAMES}).astype({c: "int64" for c in NAMES[:-1]} | {"whole": bool})], dict(zip(texts["row"], texts["packed"]))
        rows = np.unique(still["row"])
        for at in range(0, len(rows), TEXTS_AT_ONCE):
            some = rows[at : at + TEXTS_AT_ONCE]
            raws = [zstandard.decompress(packed[r]) for r in some.tolist()]
            sizes = np.fromiter(map(len, raws), np.int64, len(raws))
            base, buf = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(raws), np.uint8)
            own = still[(still["row"] >= some[0]) & (still["row"] <= some[-1])]
            for k in range(0, len(own), MEMBERS_AT_ONCE):
                few = own.iloc[k : k + MEMBERS_AT_ONCE]
                of = np.searchsorted(some, few["row"])
                found += refined(buf, base[of], sizes[of], few)
        return pd.concat(found[1:] or found, ignore_index=True)

    return run


def _resolve(members: DataFrame, width: int, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of a level: the strings that repeat, as (part, row, start, stop), and the members that stay open.

    Single cores go first, counted before they are shuffled. What comes back to the members are classes that are written
    by then, and to the classes cores that are, so that a core with very many of either is a skewed join, which Spark splits.
    """
    everything = scratch.keep(members, "everything")
    common = scratch.keep(everything.groupBy("node", "core").count().filter("count > 1").select("node", "core"), "common")
    members = scratch.keep(everything.join(common, ["node", "core"], "left_semi").select(NAMES), "members")
    scratch.drop(everything, common)
    kind = ["node", "core", "hull", "whole"]
    classes = members.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("part", "row", "pos")).alias("first"))
    classes = scratch.keep(classes, "classes")
    mixed = scratch.keep(classes.groupBy("node", "core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("node", "core"), "mixed")
    still = scratch.keep(classes.join(mixed, ["node", "core"], "left_semi").select("first.*", "node", "core"), "open")
    full = scratch.keep(classes.filter("n > 1 and whole").select(*kind), "full")
    hit = members.join(full, kind, "left_semi")
    spans = hit.select("part", "row", (F.col("pos") - F.col("node") - (width - 1)).alias("start"), (F.col("pos") - F.col("node") + length).alias("stop"))
    spans = scratch.keep(spans, "spans")
    scratch.drop(members, classes, mixed, full)
    return spans, still


def repeated(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Spans (part, row, start, stop) of texts (part, row, packed) that together cover each byte of a repeated string of so many bytes."""
    width = reach = 1 << (length * 2 // 3).bit_length() - 1
    first = texts.select("part", "row", "packed")
    spans, still = _resolve(first.mapInPandas(_members(length, reach), MEMBER), width, length, scratch)
    out = [spans]
    while width > 1:
        part = max(1, width // FAN)
        pairs = still.groupBy("part").cogroup(first.groupBy("part"))
        spans, narrower = _resolve(pairs.applyInPandas(_parts(length, width, part), MEMBER), part, length, scratch)
        scratch.drop(still)
        out.append(spans)
        width, still = part, narrower
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or touching (start, stop) rows."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    stops = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > stops[:-1])
    return np.stack([spans[new, 0], stops[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def _without(names: list[str]):
    def run(spans: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        of = {row: own[["start", "stop"]].to_numpy() for row, own in spans.groupby("row", sort=False)}
        rows = []
        for row, packed in zip(texts["row"], texts["packed"]):
            raw = zstandard.decompress(packed)
            runs = merged(of[row]).tolist() if row in of else []
            edges = [0, *(x for r in runs for x in r), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
        more = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"], index=texts.index)
        return pd.concat([texts[names], more], axis=1)

    return run


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Docs (doc_id, text, ...) with n_bytes, n_removed, n_spans, kept_sha256 and kept_text in place of text.

    Every byte that a string of length bytes covers goes if that string starts anywhere else in the input too, in the same
    text or another; matches never cross texts. n_spans counts maximal removed runs; kept_text leaves out characters that
    lost some of their bytes. Other columns stay, except those with the names given here, which are replaced. Null texts count as empty, and as kept_text ''. Repeated rows are copies of each other: what is long enough
    goes in all of them. Rows may share a doc_id or have none. An empty table gives none.

    Texts are compressed and written once, in blocks, as a table bucketed by block; all levels and the result read them
    there, and only positions are shuffled.
    """
    if length < 64:
        raise ValueError("strings of fewer than 64 bytes are not supported")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kept = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    others = [c for c in docs.columns if c != "text" and c not in kept.names]
    # by numbers meanwhile, clear of the names in use here
    docs = docs.select("text", *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    rest = [f for f in docs.schema if f.name != "text"]
    stored = docs.mapInPandas(_stored, T.StructType([*rest, *T.StructType.fromDDL("packed binary, part long, row int")]))
    texts = scratch.bucketed(stored, "texts", "part")
    spans = repeated(texts, length, scratch)
    found = spans.groupBy("part").cogroup(texts.groupBy("part")).applyInPandas(_without([f.name for f in rest]), T.StructType([*rest, *kept]))
    return found.toDF(*others, *kept.names)
