"""Places to write: the shared folder, sinks that append, keep the first, add up or put anew, and a store of blobs by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import Folder, settle


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; `scratch` drops what is written there."""
    return Folder(spark, name).path


def settled(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written to the shared folder and read back, for what reads them more than once."""
    return settle(rows, name)


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Add rows to the table at `path`, in partitions by the columns `by`; nothing that is there is read or written."""
    rows.write.mode("append").partitionBy(*(by or [])).parquet(path)


def held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at `path`; one that nothing was written to yet is empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    # partition columns come last in the files' schema
    return spark.read.schema(schema).parquet(path).select(*StructType.fromDDL(schema).fieldNames()) if there else spark.createDataFrame([], schema)


def insert_absent(rows: DataFrame, path: str, schema: str, keys: list[str], by: list[str]) -> DataFrame:
    """Append the rows whose keys the table lacks and give them back; of rows with equal keys, any one goes in. Null keys equal each other.

    `by` are to be among the keys, so that only partitions that the rows may be in are read.
    """
    there = held(rows.sparkSession, path, schema).select(*[F.col(k).alias(f"_{k}") for k in keys])
    new = settled(rows.dropDuplicates(keys).join(there, _same(keys), "left_anti"), "inserted")
    append(new, path, by)
    return new


def put(rows: DataFrame, path: str, schema: str, keys: list[str], by: list[str], sums: list[str] | None = None) -> None:
    """Put rows in the place of those with equal keys or, where `sums` are named, add them to those.

    Only the partitions (by the columns `by`, which are to be among the keys) that the rows are in are read and written, so what is written grows with
    the change and not with the table. What they come to is settled first and then takes the place of the old partitions.
    """
    touched = rows.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    old = held(rows.sparkSession, path, schema).join(touched, _same(by), "left_semi")
    if sums:
        merged = old.select(*keys, *sums).unionByName(rows.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    else:
        merged = old.join(rows.select(*[F.col(k).alias(f"_{k}") for k in keys]), _same(keys), "left_anti").unionByName(rows)
    # a partition is one task's, so it is one file
    settled(merged, "merged").repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def blob_path(digest: Column) -> Column:
    """Where a blob lies in a store: two folders by the first bytes of its hash, then the whole hash."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def store_blobs(blobs: DataFrame, path: str) -> None:
    """Write blobs (hash, content) into a store that is laid out by the first bytes of their hashes."""
    append(blobs.withColumn("shard", F.substring("hash", 1, 2)).repartition("shard"), path, ["shard"])


def fetch_blobs(wanted: DataFrame, path: str) -> DataFrame:
    """hash and content of the blobs that are wanted (hash) and whose content still has that hash; only their shards are read."""
    spark = wanted.sparkSession
    asked = wanted.select("hash", F.substring("hash", 1, 2).alias("shard")).distinct()
    found = spark.read.schema("hash string, content binary, shard string").parquet(path).join(asked, ["shard", "hash"], "left_semi")
    return found.filter(F.sha2("content", 256) == F.col("hash")).select("hash", "content")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and time of every file under a folder, at any depth; contents aren't read, as nothing asks for them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("at"))
