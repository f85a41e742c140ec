"""The folder that driver and executors share, and what is written there in between: tables and folders that can be dropped together."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


#: The local folders of sessions that run on one machine and have no setting, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one, but only if all of Spark runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the setting can't be made in a running session, so the folder is kept here
        app = spark.sparkContext.applicationId
        found = _local.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        _local[app] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Folder:
    """A new folder in the shared one, for whatever is written there; `scratch` drops it."""

    #: Those that are there: folders and tables.
    live: ClassVar[list[Folder]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_path(spark, name)
        Folder.live.append(self)

    def drop(self) -> None:
        """Delete the folder; nothing that is still to be computed may read it."""
        drop_path(self.spark, self.path)
        Folder.live.remove(self)


class Settled(Folder):
    """A DataFrame written to the shared folder and read back: its lineage ends there, and lost executors cost no recomputation."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        Folder.live.append(self)


@contextmanager
def scratch() -> Iterator[list[Folder]]:
    """Drop, at the end, the folders and tables that were made within, but for those put into the list that it gives."""
    before, kept = list(Folder.live), []
    yield kept
    for made in [t for t in Folder.live if t not in before and t not in kept]:
        made.drop()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return the table that was written."""
    return Settled(df, name).df
