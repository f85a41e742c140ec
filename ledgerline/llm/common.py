"""Helpers that the training-data operators share: words, bounded samples and deterministic hashes; scratch tables are those of the sources."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Folder, Settled, new_path, scratch, settle, shared_dir

__all__ = ["Folder", "Settled", "new_path", "scratch", "settle", "shared_dir"]

#: A word is a run of characters other than the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_text(rows: DataFrame, ids: list[str], text: str) -> DataFrame:
    """One row for each of the `ids`: that of the smallest hashed text. So a bound on ids is one on rows, however often an id comes."""
    return rows.groupBy(*ids).agg(F.min_by(text, F.struct(F.xxhash64(text), F.xxhash64(F.lit("text"), text))).alias(text))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` lacks, also when case is ignored."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows whose crc32 of the id as text leaves `remainder`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def n_words(text: Column) -> Column:
    """How many words a text has (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seed_of(*parts: object) -> int:
    """A 32-bit seed that depends on nothing but `parts`."""
    return zlib.crc32("|".join(map(str, parts)).encode())


Scorer = Callable[[list[str | None]], dict[str, np.ndarray | list | pa.Array]]


def map_texts(docs: DataFrame, keep: list[Column], text: Column, make: Callable[[], Scorer], fields: str) -> DataFrame:
    """The columns `keep`, untouched, and those that a function of the texts makes, batch by batch, without a shuffle.

    make() runs once a task and gives that function; `fields` are the names and types of what it makes.
    """
    picked = docs.select(*keep, text.cast("string").alias(free_name(docs.select(*keep), "_text")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            made = score(batch.column(batch.num_columns - 1).to_pylist())
            names = [*batch.schema.names[:-1], *made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(v if isinstance(v, pa.Array) else pa.array(v) for v in made.values())], names=names)

    return picked.mapInArrow(run, f"{kept}, {fields}")
