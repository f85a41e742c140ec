"""The corpus pipeline: documents of a data folder to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import language, lines, minhash, mixing, packing
from ledgerline.llm.common import WORD, Settled, free_name, scratch, settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay, with `lang` set to the prediction; those without a letter go.

    Null texts go. The other columns stay as they are. Repeated rows stay as often as they come.
    """
    languages = language.fit(docs)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    guess = free_name(docs, "lang_pred")
    found = language.identify(docs, languages, keep, "text", (guess, free_name(docs, "score")))
    return found.filter(F.col(guess) != language.UNKNOWN).withColumn("lang", F.col(guess)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over many sources go; documents left without a word go too. n_chars is that of the new text.

    So null and empty texts go. Repeated rows are treated alike; a null source counts as a source of its own.
    """
    cleaned = lines.dedup(docs).filter(F.col("text").rlike(WORD))
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[c for c in docs.columns if c in cleaned.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: of the smallest id and, where that has several texts, of the smallest hash.

    Of equal rows one stays. Texts without words are alike only if they and their ids are. A null id comes after all others.
    """
    found = minhash.classed(docs)
    at = F.struct(F.col("id").isNull().alias("last"), "id", "t1", "t2")
    kept = found.groupBy("root", F.when(F.col("root").isNull(), F.struct("id", "t1", "t2")).alias("alone")).agg(F.min(at).alias("at"), F.count("*").alias("_rows"))
    names = [free_name(docs, n) for n in ("_id", "_t1", "_t2")]
    kept = settle(kept.select(*[F.col(f"at.{c}").alias(n) for c, n in zip(("id", "t1", "t2"), names, strict=True)], "_rows"), "pipeline-kept")
    key = [F.col("doc_id"), *minhash.text_hashes(F.col("text"))]
    same = [a.eqNullSafe(F.col(n)) for a, n in zip(key, names, strict=True)]
    own = docs.join(kept.drop("_rows"), same[0] & same[1] & same[2], "left_semi")
    # a class of one row needs no more; only where there are classes of several are whole rows compared
    return own if kept.filter("_rows > 1").isEmpty() else own.dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice.

    Null texts have no words and add none. Rows that are equal in every column share what the mix takes of them; rows that differ in any, a null
    beside a text included, are documents of their own. Ties are settled by a hash of the row.
    """
    # the key tells all columns apart, and null from any text; of the text it has a digest
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    row = F.struct(*others, F.sha1(F.col("text").cast("binary")).alias(free_name(docs, "_text")))
    key = F.sha1(F.to_json(row, {"ignoreNullFields": "false"}).cast("binary"))
    mixed = mixing.mix(docs, key=key).filter("copies > 0").select("key", "copies")
    # rows that share the key are equal in all columns: they share what the mix takes of them
    share = mixed.groupBy("key").agg(F.sum("copies").alias("_copies"))
    own, more = free_name(docs, "_key"), free_name(docs, "_n")
    counted = docs.withColumn(own, key)
    first = counted.dropDuplicates([own]).join(share.withColumnRenamed("key", "_of"), F.col(own) == F.col("_of"))
    return first.withColumn(more, F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of balanced cost: a row for each piece, with the checksum of its ids.

    Null and empty texts are their closing id alone. A null id stays null; repeated rows are packed as often as they come. Ties in
    cost go to the sequence opened first. An empty table gives no rows.
    """
    return packing.digest(packing.pack(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near duplicates", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, projections and sampling can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again before the next."""
    docs, made = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        before = made
        with scratch() as kept:
            made = Settled(stage(spark, docs, sf_dir), f"pipeline-{k}")
            kept.append(made)
        docs = made.df
        if before:
            before.drop()
    return docs
