"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

A round sorts pieces and gaps together by size, over range partitions. The sweep goes up in size: a piece waits on a stack,
and a gap takes as many of those that came last, the longest that fit it, as it has slots. Pieces and slots are brackets
then, and the sweep is their matching: the height of the stack at each row is a running sum less its running minimum,
which partitions work out on their own but for two numbers for each partition before them. A piece and the slot that
takes it stand next to each other among the rows of one height. Ranks by id decide between equal sizes. Gaps are updated,
and the round is repeated with what is left until every piece has a place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bpe import encoder
from ledgerloom.llm.scratch import Scratch, shuffle_partitions

ROWS_AT_ONCE = 1 << 15
# of pieces longer than a quarter of the capacity a round takes those of at least so much of the longest one's length
NARROW = 0.6


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text, ...): ids and then end_id, in pieces of the capacity, of which the first may be shorter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            rows = []
            for key, data in zip(batch["doc_id"], encoder(path).encode(batch["text"].tolist())):
                data += end
                n = len(data) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((key, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([docs.select("doc_id").schema[0], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long")])
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def _depths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds to the rows of a partition its number, the sum of weights up to each row, and the lowest such sum before the row, 0 at most."""
    part, total, low = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        if len(batch):
            depth = total + np.cumsum(batch["weight"].to_numpy())
            lows = np.minimum.accumulate(np.append(low, depth))
            yield batch.assign(part=part, depth=depth, low=lows[:-1])
            total, low = int(depth[-1]), int(lows[-1])


def _swept(pieces: DataFrame, gaps: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Pieces (pid, length) with the sequence_id and slot that take each, null where none does.

    gaps: (sequence_id, gap, slots). n, the number of rows, only sets the number of partitions.
    """
    size = F.floor(F.col("gap") / F.col("slots")).cast("int")
    rows = pieces.select(F.col("length").cast("int").alias("size"), F.lit(0).alias("kind"), F.col("pid").alias("id"), F.lit(1).cast("long").alias("weight"))
    rows = rows.union(gaps.select(size, F.lit(1), "sequence_id", -F.col("slots")))
    parts = min(shuffle_partitions(pieces.sparkSession), 1 + n // ROWS_AT_ONCE)
    order = ["size", "kind", "id"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = scratch.keep(rows.mapInPandas(_depths, T.StructType([*rows.schema, *T.StructType.fromDDL("part int, depth long, low long")])), "sorted")

    # a row for each partition: the sum of weights before it, and the lowest sum of all before it
    ends = rows.groupBy("part").agg(F.sum("weight").alias("all"), F.min(F.least("depth", "low")).alias("lowest"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0)))
    ends = ends.select("part", "base", F.least(F.lit(0), F.coalesce(F.min(F.col("base") + F.col("lowest")).over(before), F.lit(0))).alias("floor"))
    rows = rows.join(F.broadcast(ends), "part")
    height = F.col("base") + F.col("depth") - F.col("weight") - F.least("floor", F.col("base") + F.col("low"))
    rows = rows.withColumn("height", height)

    # a piece lies one above the height it met; a gap takes from the height down as many as it has slots, if they are there
    taken = F.when(F.col("kind") == 0, F.lit(1)).otherwise(F.least(-F.col("weight"), F.col("height")))
    rows = rows.withColumn("taken", taken).filter("taken > 0").withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("taken") - 1).cast("int"))))
    rows = rows.withColumn("level", F.when(F.col("kind") == 0, F.col("height") + 1).otherwise(F.col("height") - F.col("slot")))
    # rows of one level are pieces and slots in turn, of different sizes, so they are few
    after = F.lead(F.struct("kind", "id", "slot")).over(Window.partitionBy("level").orderBy(*order))
    out = rows.withColumn("after", after).filter("kind = 0")
    matched = F.col("after.kind") == 1
    return out.select(F.col("id").alias("pid"), F.col("size").cast("long").alias("length"), F.when(matched, F.col("after.id")).alias("sequence_id"), F.when(matched, F.col("after.slot")).alias("slot"))


def packed(rows: DataFrame, capacity: int) -> DataFrame:
    """rows (..., length) with sequence_id and offset: no sequence is longer than the capacity, and offsets have no holes.

    Lengths must lie between 1 and the capacity. Repeated rows are packed each; an empty table gives none. The names
    pid, turn, slot and those of the result are taken; columns of these names are dropped. The driver gets the number of
    pieces that are left by length, as many as the capacity at most.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    rows = rows.drop("pid", "turn", "slot", "sequence_id", "offset")
    rows = scratch.keep(rows.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    large = F.col("length") * 2 > capacity
    placed = [rows.filter(large).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).alias("turn"), F.lit(0).alias("slot"))]
    left = rows.filter(~large).select("pid", F.col("length").cast("long").alias("length"))
    gaps = rows.filter(large).select(F.col("pid").alias("sequence_id"), (F.lit(capacity) - F.col("length")).cast("long").alias("gap"))
    opened, turn, tried, used = 0, 0, set(), []
    while counts := {r[0]: r[1] for r in left.groupBy("length").count().collect()}:
        gaps = scratch.keep(gaps.filter(F.col("gap") >= min(counts)), "gaps")
        scratch.drop(*used)
        n_gaps, widest = gaps.agg(F.count("*"), F.coalesce(F.max("gap"), F.lit(0))).first()
        homeless = {s: n for s, n in counts.items() if s > widest}
        if homeless:
            # at first no more sequences than these pieces fill, then as many as surely hold those of this length
            longest = max(homeless)
            kind = longest.bit_length()
            more = -(-sum(homeless.values()) // (capacity // longest)) if kind in tried else -(-sum(s * n for s, n in homeless.items()) // capacity)
            tried.add(kind)
            new = spark.range(opened, opened + more).select((-F.col("id") - 1).alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"))
            opened, n_gaps, gaps_now = opened + more, n_gaps + more, gaps.union(new)
        else:
            gaps_now = gaps
        turn += 1
        longest = max(counts)
        least = longest * NARROW if 4 * longest > capacity else 0
        now = left.filter(F.col("length") >= least)
        open_gaps = gaps_now.filter(F.col("gap") >= min(s for s in counts if s >= least))
        open_gaps = open_gaps.withColumn("slots", F.greatest(F.lit(1).cast("long"), F.floor(F.col("gap") / longest)))
        swept = _swept(now, open_gaps, sum(n for s, n in counts.items() if s >= least) + n_gaps, scratch)
        waiting = left.filter(F.col("length") < least).select("pid", "length", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("int").alias("slot"))
        swept = scratch.keep(swept.union(waiting), "swept")
        placed.append(swept.filter("sequence_id is not null").select("pid", "sequence_id", F.lit(turn).alias("turn"), "slot"))
        left = swept.filter("sequence_id is null").select("pid", "length")
        taken = swept.filter("sequence_id is not null").groupBy("sequence_id").agg(F.sum("length").alias("used"))
        used = [gaps]
        gaps = gaps_now.join(taken, "sequence_id", "left").select("sequence_id", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
    places = placed[0]
    for more in placed[1:]:
        places = places.union(more)
    order = Window.partitionBy("sequence_id").orderBy("turn", "slot", "pid")
    out = rows.join(places, "pid")
    return out.withColumn("offset", F.sum("length").over(order) - F.col("length")).drop("pid", "turn", "slot")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of docs (doc_id, text; other columns are ignored).

    Null and empty texts are a piece of the end id alone. Rows with equal or null doc_id are packed each.
    """
    return packed(pieces(docs, path, capacity, end_id), capacity)
