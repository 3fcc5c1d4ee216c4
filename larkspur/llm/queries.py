"""The queries ``op1_*`` to ``op10_*``: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, htmlmain, langid, lm, mixing, neardup, quality, sharding, tokencount, vptree
from larkspur.llm.runtime import Scratch, crc32_mod, table, word_count

VOCABULARY = "byte_bpe_50k.json"
MAX_TOKENS = 512
SHARDS = 40
#: Least quality of a kept document.
KEEP = 0.5


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 4) == 2
    samples = langid.draw_samples(docs.where(~held_out), F.col("doc_id"))
    out = langid.identify(docs.select("doc_id", "text"), samples)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = quality.describe(table(spark, sf_dir, "documents"))
    model = quality.fit_described(described, table(spark, sf_dir, "labels"))
    out = quality.score_described(described, model)
    return out.select(F.col("id").alias("doc_id"), "score", (F.col("score") >= KEEP).alias("keep"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = neardup.near_duplicates(docs.select("doc_id", "text"), width=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    # Texts are read once; what is left of them is narrow.
    rows = Scratch(spark, "op4").keep(docs.select("doc_id", "lang", "source", bytes_.alias("size"), crc.alias("text_crc32"), F.md5("text").alias("_text")), "rows")
    out = sharding.shard_rows(rows, ["lang", "source", "size"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], SHARDS, together=[F.col("_text")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mixing.random_key(F.col("doc_id"), F.md5("text")).alias("_key"))
    out = mixing.mix(Scratch(spark, "op5").keep(rows, "rows"), F.col("_key"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 5) == 1
    out = lm.score_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), docs.where(~held_out))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = htmlmain.extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = tokencount.count_tokens(docs.select("doc_id", "text"), vocabulary_path())
    return out.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "similarity")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_shard": op4_shard,
    "op5_mix": op5_mix,
    "op6_lm_score": op6_lm_score,
    "op7_main_text": op7_main_text,
    "op8_tokens": op8_tokens,
    "op9_nearest": op9_nearest,
    "op10_decontaminate": op10_decontaminate,
}
