"""A content-addressed store of token ids, as Parquet tables under one folder that any Spark file system can hold.

chunks(address, n, width, data): each distinct chunk once. address is the SHA-256 of its ids as little-endian unsigned
32-bit integers; data holds them in width bytes each.
recipes(row, seq, address, n): the chunks of each document, in order.
manifest(row, doc_id, start, n_tokens, n_chunks, root): documents by ascending doc_id, in files whose ranges follow each
other; start counts the ids of all documents before, root is the Merkle root over the chunks' addresses.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bpe import encoder
from ledgerloom.llm.scratch import Scratch, shuffle_partitions

WINDOW = 8
DOCS_AT_ONCE = 512
SEEN = 1 << 18
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected


def cut_points(ids: np.ndarray, stops: np.ndarray, mean: int, most: int) -> np.ndarray:
    """Ends of the chunks of documents that lie one after the other and end at stops.

    A chunk ends where its document does, after each id where a rolling sum of the hashes of the document's last WINDOW ids
    has zeros in as many bits as mean, a power of two, asks for, and every `most` ids where that doesn't come.
    """
    mixed = ids * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    sums = np.append(np.uint32(0), np.cumsum(mixed, dtype=np.uint32))
    rolling = (sums[WINDOW:] - sums[:-WINDOW]) * np.uint32(0xC2B2AE3D)
    ends = np.flatnonzero(rolling < np.uint32((1 << 32) // mean)) + WINDOW if mean > 1 else np.arange(WINDOW, len(sums))
    begin = np.append(0, stops)[np.searchsorted(stops, ends - 1, side="right")]
    ends = np.union1d(ends[ends - begin >= WINDOW], stops)
    starts = np.append(0, ends[:-1])
    long = np.flatnonzero(ends - starts > most)
    return np.union1d(ends, np.concatenate([np.arange(a + most, b, most) for a, b in zip(starts[long], ends[long])])) if len(long) else ends


def merkle_root(addresses: list[bytes]) -> bytes:
    """Of at least one address: each level hashes pairs of the one below; a last one alone goes up as it is."""
    level = addresses
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def _chunked(path: str, end_id: int, mean: int, most: int):
    """A row for each document with arrays over its chunks; data is null for chunks that the task gave before, as far as it remembers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end, seen = np.uint32(end_id).tobytes(), set()
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.iloc[at : at + DOCS_AT_ONCE]
                datas = [x + end for x in encoder(path).encode(part["text"].tolist())]
                sizes = np.fromiter(map(len, datas), np.int64, len(datas)) // 4
                joined, stops = b"".join(datas), np.cumsum(sizes)
                ids = np.frombuffer(joined, "<u4")
                width = 2 if ids.max() < 1 << 16 else 4
                narrow = ids.astype(f"<u{width}").tobytes()
                ends = cut_points(ids, stops, mean, most)
                edges = [0, *ends.tolist()]
                addresses = [hashlib.sha256(joined[4 * a : 4 * b]).digest() for a, b in zip(edges, edges[1:])]
                data = []
                for a, b, address in zip(edges, edges[1:], addresses):
                    new = address not in seen
                    data.append(narrow[width * a : width * b] if new else None)
                    if new and len(seen) < SEEN:
                        seen.add(address)
                lengths, of = np.diff(edges), [0, *(np.searchsorted(ends, stops) + 1).tolist()]
                per = list(zip(of, of[1:]))
                yield pd.DataFrame({
                    "row": part["row"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "n_tokens": sizes, "root": [merkle_root(addresses[a:b]) for a, b in per], "width": width,
                    "addresses": [addresses[a:b] for a, b in per], "sizes": [lengths[a:b] for a, b in per], "data": [data[a:b] for a, b in per],
                })

    return run


def _with_starts(manifest: DataFrame, scratch: Scratch) -> DataFrame:
    """manifest with start: sums within ranges of doc_id, on top of the totals of the ranges before, as many as shuffle partitions."""
    order = ["doc_id", "root", "row"]
    ranged = manifest.repartitionByRange(shuffle_partitions(manifest.sparkSession), *order).withColumn("part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "ranged")
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    totals = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*order)) - F.col("n_tokens")
    return ranged.withColumn("own", own).join(F.broadcast(totals), "part").withColumn("start", F.col("before") + F.col("own"))


def write_store(docs: DataFrame, path: str, store: str, end_id: int = 0, mean: int = 512, most: int = 4096) -> None:
    """Write docs (doc_id, text; other columns are ignored) as a store into a new folder; mean, a power of two, is the chunks' usual length.

    Null and empty texts are the end id alone. Rows with equal doc_id are documents of their own, next to each other; those
    with none come first. An empty table gives a store without documents.
    """
    scratch = Scratch(docs.sparkSession)
    key = docs.select("doc_id").schema[0]
    schema = T.StructType([T.StructField("row", T.LongType()), key, *T.StructType.fromDDL("n_tokens long, root binary, width int, addresses array<binary>, sizes array<int>, data array<binary>")])
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    staged = scratch.keep(numbered.mapInPandas(_chunked(path, end_id, mean, most), schema), "staged")
    put = lambda df, name: df.write.option("compression", "zstd").parquet(f"{store}/{name}")
    chunks = staged.select("width", F.explode(F.arrays_zip("addresses", "sizes", "data")).alias("c")).filter("c.data is not null")
    chunks = chunks.select(F.col("c.addresses").alias("address"), F.col("c.sizes").alias("n"), "width", F.col("c.data").alias("data"))
    put(chunks.dropDuplicates(["address"]), "chunks")
    recipes = staged.select("row", F.posexplode(F.arrays_zip("addresses", "sizes")).alias("seq", "c"))
    put(recipes.select("row", "seq", F.col("c.addresses").alias("address"), F.col("c.sizes").alias("n")), "recipes")
    manifest = _with_starts(staged.select("row", "doc_id", "n_tokens", F.size("addresses").cast("long").alias("n_chunks"), "root"), scratch)
    columns = ["row", "doc_id", "start", "n_tokens", "n_chunks", "root"]
    put(manifest.repartitionByRange(shuffle_partitions(docs.sparkSession), "start").sortWithinPartitions("start").select(columns), "manifest")
    scratch.drop(staged)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reflected polynomials modulo CRC-32's."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(POLYNOMIAL), np.uint64(0))
    return out


def moved_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 contributes to that of a stream in which so many bytes follow: the exclusive or of all gives the stream's."""
    power = np.full(1, 1 << 30, np.uint64)  # x
    for _ in range(3):
        power = _times(power, power)  # x^8: a byte
    out, n = crc.astype(np.uint64), n_bytes.astype(np.uint64)
    while n.any():
        out = np.where(n & np.uint64(1), _times(out, np.broadcast_to(power, out.shape)), out)
        power, n = _times(power, power), n >> np.uint64(1)
    return out


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        crcs = []
        for address, width, data in zip(batch["address"], batch["width"], batch["data"]):
            plain = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
            if hashlib.sha256(plain).digest() != address:
                raise ValueError(f"chunk {address.hex()} does not have its address")
            crcs.append(zlib.crc32(plain))
        yield pd.DataFrame({"address": batch["address"], "crc": crcs})


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row, root, n_chunks, addresses, crcs in zip(batch["row"], batch["root"], batch["n_chunks"], batch["addresses"], batch["crcs"]):
            # a chunk that is missing has no checksum, and a null makes the array one of floats
            if len(addresses) != n_chunks or crcs.dtype.kind == "f" or merkle_root(list(addresses)) != root:
                raise ValueError(f"document {row} does not have its Merkle root")
        parts = np.fromiter(map(len, batch["sizes"]), np.int64, len(batch))
        if not len(batch):
            continue
        size, stops = 4 * np.concatenate(batch["sizes"].to_list()).astype(np.int64), np.cumsum(parts)
        total = np.cumsum(size)
        after = np.repeat(total[stops - 1], parts) - total
        moved = moved_crc(np.concatenate(batch["crcs"].to_list()).astype(np.uint64), after.astype(np.uint64))
        ids_crc32 = np.bitwise_xor.reduceat(moved, stops - parts).astype(np.int64)
        yield batch.drop(columns=["root", "n_chunks", "addresses", "sizes", "crcs"]).assign(ids_crc32=ids_crc32)


def digests(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store's documents, from its files, with every chunk and Merkle root checked.

    A document's checksum is put together from those of its chunks, so ids are read once and never moved. Damage raises
    ValueError. A null doc_id stays null; documents with equal ones have a row each; a store without documents gives none.
    """
    chunks, recipes, manifest = (spark.read.parquet(f"{store}/{t}") for t in ("chunks", "recipes", "manifest"))
    sums = chunks.mapInPandas(_checked, "address binary, crc long")
    used = recipes.join(sums, "address", "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "address", "n", "crc"))).alias("c"))
    used = used.select("row", F.col("c.address").alias("addresses"), F.col("c.n").alias("sizes"), F.col("c.crc").alias("crcs"))
    out = manifest.join(used, "row", "left").select(
        "row", "doc_id", "start", "n_tokens", "root", "n_chunks",
        F.coalesce("addresses", F.array().cast("array<binary>")).alias("addresses"), F.coalesce("sizes", F.array().cast("array<int>")).alias("sizes"), F.coalesce("crcs", F.array().cast("array<long>")).alias("crcs"),
    )
    schema = T.StructType([f for f in out.schema if f.name in ("row", "doc_id", "start", "n_tokens")] + [T.StructField("ids_crc32", T.LongType())])
    return out.mapInPandas(_summed, schema).drop("row")


def documents(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, ids) of a store, ids as little-endian unsigned 32-bit integers with the end id.

    Chunks go to the documents that use them, so a document has to fit into memory. Nulls, equal ids and an empty store as
    in digests(), whose checks this leaves out.
    """

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [b"".join(np.frombuffer(bytes(c["data"]), f"<u{c['width']}").astype("<u4").tobytes() for c in sorted(x, key=lambda c: c["seq"])) for x in batch["chunks"]]
            yield batch.drop(columns="chunks").assign(ids=ids)

    chunks, recipes, manifest = (spark.read.parquet(f"{store}/{t}") for t in ("chunks", "recipes", "manifest"))
    used = recipes.join(chunks.drop("n"), "address").groupBy("row").agg(F.collect_list(F.struct("seq", "width", "data")).alias("chunks"))
    out = manifest.join(used, "row").select("doc_id", "start", "chunks")
    return out.mapInPandas(joined, T.StructType([*[f for f in out.schema if f.name != "chunks"], T.StructField("ids", T.BinaryType())]))
