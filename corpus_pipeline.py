"""The corpus pipeline: language ID, near-duplicates, repeated strings, benchmark passages, packing.

Cases: a document with a null id meets no other one by id, so it is in no group, loses no string and is never
contaminated; it stays if its language is known. Rows that share an id are one document: of rows that share text too, one
stays. Null, empty and wordless texts go in the first stage, as their language is not known. An empty table gives an empty
result; further columns, of whatever names, do not go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.llm import decontaminate, language_id, ngram_join, packing, suffix_dedup
from evoframe.llm.common import Scratch, sized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: With no evidence at all each of n languages has the share 1 / n; a document whose best language has not so much of the
#: way from there to 1 is rejected.
LEAST_EVIDENCE = 1 / 15


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; null texts and texts without letters go."""
    model = language_id.train(docs.where(language_id.learnable()))
    found = language_id.predict(docs.select(*COLUMNS), model, keep=COLUMNS)
    even = 1 / max(1, len(model.languages))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= even + (1 - even) * LEAST_EVIDENCE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group; documents without words or id are not in any group and stay."""
    scratch = Scratch(spark, "groups")
    groups = ngram_join.jaccard_components(docs, k=5, percent=80)
    # what goes and what is repeated are few ids as a rule: then no text is shuffled
    groups = scratch.save(groups.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id <> component_id"), "changed")
    gone, repeated = groups.where("doc_id <> component_id").select("doc_id"), groups.where("doc_id = component_id").select("doc_id")
    kept = docs.select(*COLUMNS).join(sized(gone), "doc_id", "left_anti")
    once = kept.join(sized(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(sized(repeated), "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier text has; a text of which nothing is left goes."""
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), length=100)
    cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; those without an id are never hit."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, items, window=10, gram=5)
    hit = Scratch(spark, "contaminated").save(found.where("contaminated").select("doc_id").distinct(), "hit")
    return docs.select(*COLUMNS).join(sized(hit), "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence piece, with its token ids."""
    return packing.pack(docs, max_length=2048)


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("repeated_strings", cut_repeats), ("decontamination", drop_contaminated), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what its predecessor wrote."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
