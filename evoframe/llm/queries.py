"""The queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, divergence, embedding_dedup, html_extract, language_id, lm_score, media_chunks, ngram_join, packing, sharding, structure_repair, suffix_dedup
from .common import Scratch
from .oracles import ORACLE as ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100, digest=True)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest_conversations(chat_format.format_conversations(rows))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 24 arrivals of different sizes, appended in three steps with a compaction after each."""
    docs = _table(spark, sf_dir, "documents")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(36))
    docs = docs.withColumn("arrival", F.when(place < 12, place).otherwise(F.lit(12) + F.floor((place - 12) / 2)).cast("int"))
    store = sharding.ShardStore(spark, Scratch(spark, "shards").root)
    for first in (0, 8, 16):
        store.append_arrivals(docs.where(F.col("arrival").between(first, first + 7)), "arrival")
        store.compact()
        store.vacuum()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "shard_run", "shard_part", "shard_tier", F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=5, percent=80)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, gram=5)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), max_length=2048, digest=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(language_id.learnable()))
    held = (~language_id.learnable()).alias("held_out")
    return language_id.predict(docs.select("doc_id", held, "text"), model, keep=["doc_id", "held_out"])


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", lm_score.held_out().alias("held_out"), "text")
    model, _ = lm_score.train(docs.where(~F.col("held_out")))
    return lm_score.score(docs, model, ["doc_id", "held_out"])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"), least=30, top=50)


def op12_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media_chunks.padded(F.col("text")).alias("payload"))
    root = Scratch(spark, "media").root
    media_chunks.write_media(docs, root)
    found = Scratch(spark, "features").save(media_chunks.describe(media_chunks.read_media(spark, root)), "found")
    return docs.select("doc_id", "n_bytes", F.sha2("payload", 256).alias("media")).join(found, "media", "left").drop("media")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure_repair.damaged(_table(spark, sf_dir, "conversations"))
    return structure_repair.report(structure_repair.repair_conversations(rows, copies="copies"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_dedup, op2_suffix_dedup, op3_chat_format, op4_html_extract, op5_sharding, op6_ngram_jaccard, op7_decontamination, op8_packing, op9_language_id, op10_lm_score, op11_source_divergence, op12_media_chunks, op13_structure_repair)}
