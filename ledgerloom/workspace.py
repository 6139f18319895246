"""The folder that driver and executors share, for tables that are written and read again."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

#: Temporary folders of sessions that name none.
OWN: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a session in one local process gets a temporary one; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or OWN.get(spark)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = OWN[spark] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
