"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.workspace import new_path

#: Of each session: the folders and the tables that are still there.
LEFT: WeakKeyDictionary[SparkSession, set[tuple[str, str | None]]] = WeakKeyDictionary()


#: The tables of whoever runs operators inside released(), in this thread.
OWNED: ContextVar[set[tuple[str, str | None]] | None] = ContextVar("owned", default=None)


class Scratch:
    """Tables of one job. keep() and bucketed() write one and reread it; drop() removes those that nothing reads any more.

    What a result is read from has to stay until it is; it belongs to the caller, who removes it with released().
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.owned = spark, OWNED.get()
        self.made: dict[int, tuple[str, str | None]] = {}

    def _note(self, out: DataFrame, path: str, table: str | None) -> DataFrame:
        self.made[id(out)] = (path, table)
        LEFT.setdefault(self.spark, set()).add((path, table))
        if self.owned is not None:
            self.owned.add((path, table))
        return out

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self._note(self.spark.read.schema(df.schema).parquet(path), path, None)

    def bucketed(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """Like keep(), as a table bucketed by a column: groups of that column are then read without a shuffle."""
        path = new_path(self.spark, name)
        table = "_".join(path.rsplit("/", 1)[1].split("-"))
        writer = df.write.bucketBy(shuffle_partitions(self.spark), by).option("compression", "zstd").option("path", path)
        writer.saveAsTable(table)
        return self._note(self.spark.table(table), path, table)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _remove(self.spark, *self.made.pop(id(table)))


def _remove(spark: SparkSession, path: str, table: str | None) -> None:
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    LEFT.get(spark, set()).discard((path, table))


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the scratch tables that were made inside, in this thread, and no others.

    For callers who read or write the result inside. Inner ones remove their own tables; those of other threads and callers stay.
    """
    own: set[tuple[str, str | None]] = set()
    mark = OWNED.set(own)
    try:
        yield
    finally:
        OWNED.reset(mark)
        for path, table in own & left(spark):
            _remove(spark, path, table)


def left(spark: SparkSession) -> set[tuple[str, str | None]]:
    """The scratch tables of a session that are still there."""
    return set(LEFT.get(spark, ()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
