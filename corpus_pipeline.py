"""The corpus pipeline: stages over ``documents``, each one's rows written and reread by the next.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and empty tables (which stay empty); what it does with them is said at each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, langid, mixing, neardup, sharding
from larkspur.llm.queries import SHARDS
from larkspur.llm.runtime import Scratch, released, table, word_count


def _crc() -> Column:
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which replaces the stated one; those without a letter go, null and empty texts among them.

    Samples are drawn by the hash of ``doc_id`` from texts with a stated language; without any, no
    document has one.  Ties go to the first language by code point; repeated rows are alike.
    """
    samples = langid.draw_samples(docs, F.col("doc_id"))
    found = langid.identify(docs, samples, into="_lang", score="_score").where(F.col("_lang") != langid.UNDETERMINED)
    return found.withColumn("lang", F.col("_lang")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the smallest ``doc_id``, nulls last.

    Of repeated ids the first row read stays.  Null and empty texts and texts without words are
    no duplicates of each other: all stay.
    """
    return neardup.near_duplicates(docs).where(F.col("survivor")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``; null, empty and wordless texts on either side match nothing, and repeated rows are alike."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents up to each source's budget of words; one that is taken in two epochs is there twice.

    Null sources are one source, the last.  Documents without words cost nothing: they are taken with
    their source's whole epochs.  Rows alike in ``doc_id`` and text are interchangeable at the cut.
    """
    sized = docs.withColumn("_words", word_count(F.col("text")))
    mixed = mixing.mix(sized, mixing.random_key(F.col("doc_id"), _crc()), size="_words", whole=True)
    return mixed.where(F.col("copies") > 0).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ``shard`` and ``slot``, in Hilbert order of language, source and size.

    Nulls count as lowest, null texts as 0 bytes; rows alike in ``doc_id`` and text are
    interchangeable.  Columns of the documents named ``shard`` or ``slot`` are replaced.
    """
    rows = docs.withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    return sharding.shard_rows(rows, ["lang", "source", "_bytes"], [F.col("doc_id"), _crc()], SHARDS).drop("_bytes")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shard", shard),
]

#: The stages rest on a learned model, random keys and a space-filling curve that SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has made on its way goes when its rows are written, and those when the next one's are."""
    own = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with released():
            docs = own.keep(stage(spark, docs, sf_dir), name)
        if before:
            own.drop(before)
        before = name
    return docs
