"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch


def _hang_on_smallest(pairs: DataFrame, scratch: Scratch, keep_larger_only: bool) -> DataFrame:
    """Each (u, v) becomes (v, m), m the smallest of u and its neighbours; with keep_larger_only, v > u alone moves."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    lowest = scratch.keep(lowest, "lowest")
    moved = pairs.join(lowest, "u")
    if keep_larger_only:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
    out = scratch.keep(out.filter("u <> v").distinct(), "links")
    scratch.drop(lowest)
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) of longs to (id, component): the smallest id reachable.

    Ids without a link to another id are not returned. Nulls, repeats and self links are ignored; no links give no rows.
    Every round writes its links, so lost executors cost one round at most; rounds grow with the logarithm of the diameter.
    """
    oriented = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = scratch.keep(oriented, "links")
    mark = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang_on_smallest(both, scratch, True)
        small = _hang_on_smallest(
            large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), scratch, False
        )
        scratch.drop(current, large)
        current = small
        # an order-free mark of the links: it stays when a round moves nothing
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = now
