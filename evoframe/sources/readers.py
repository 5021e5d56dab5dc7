"""Readers and writers: JSON sample files, API documents, graphs, results and saved states."""

from __future__ import annotations

import hashlib
import json
import textwrap
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evoframe.functions.code import chat, ended

from .folders import Numbered, whole
from .json_arrays import elements

_STR = T.StringType()


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _STR) for n in names.split()])


RUST = _strings("name module from_version to_version type change_type signature old_signature documentation source_code old_source_code query rephrased_query function_signature code test_program replacement_api crate examples")
PYTHON = T.StructType([*[f for f in RUST.fields if f.name not in ("examples", "crate")], T.StructField("description", _STR), T.StructField("examples", T.ArrayType(_STR))])
PAIRS = _strings("id language api_name api_module from_version to_version signature edit_query edit_function_signature edit_code edit_test_program gen_query gen_function_signature gen_code gen_test_program source_code old_source_code documentation change_type type examples pair_source")
QUESTIONS = T.StructType([T.StructField("id", T.LongType()), *_strings("question answer category para_question").fields, T.StructField("sub_question", T.ArrayType(_STR))])
RESULTS = T.StructType([T.StructField("id", _STR), T.StructField("passed", T.BooleanType()), *_strings("status error test_output generated_code model_response").fields, T.StructField("test_cases_passed", T.IntegerType()), T.StructField("test_cases_total", T.IntegerType())])


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of a JSON array file, read in parallel, with idx, their place in it; a missing file gives no rows."""
    try:
        found = elements(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], T.StructType([T.StructField("idx", T.LongType()), *schema.fields]))
    return found.select("idx", F.from_json("value", schema).alias("row")).select("idx", "row.*")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rust": lambda spark, path: json_array(spark, path, RUST),
    "python": lambda spark, path: json_array(spark, path, PYTHON),
    "pairs": lambda spark, path: json_array(spark, path, PAIRS),
    "questions": lambda spark, path: json_array(spark, path, QUESTIONS),
    "api_docs": lambda spark, path: json_array(spark, path, RUST),
    "results": lambda spark, path: json_array(spark, path, RESULTS),
}


def corpus(spark: SparkSession, path: str, text: str = "text", kind: str | None = None) -> DataFrame:
    """(idx, text) of a corpus: Parquet, JSON lines or plain lines by `kind`, else by the path's ending. idx follows the order
    of files and of rows in them; null and empty texts are left out."""
    kind = kind or ("json" if path.rstrip("/").endswith((".json", ".jsonl")) else "text" if path.rstrip("/").endswith(".txt") else "parquet")
    rows = spark.read.text(path) if kind == "text" else spark.read.format(kind).load(path)
    column = "value" if kind == "text" else text
    found = rows.select(F.col(column).cast("string").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    found = found.where("text <> ''")
    # a file's blocks in order, and rows in order inside a block, which one task reads
    blocks = found.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    at = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each block
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("row")) - 1
    return found.withColumn("place", place).join(at, ["file", "block"]).select((F.col("before") + F.col("place")).alias("idx"), "text")


#: Models whose questions are asked in their own template (fixed values).
TEMPLATED = ("Llama3-8B-Instruct", "Llama3.1-8B-Instruct", "Qwen2.5-7B-Instruct")


def questions(spark: SparkSession, path: str, model: str, size: int | None = None) -> DataFrame:
    """Questions, their paraphrases and parts in the chat template of the model, and answers with its end mark; as they stand
    for other models."""
    df = prefix(READERS["questions"](spark, path), size)
    if model not in TEMPLATED:
        return df
    ask = lambda c: chat(F.lit(model), c)
    return df.withColumns({"question": ask(F.col("question")), "para_question": ask(F.col("para_question")), "answer": ended(F.lit(model), F.col("answer")), "sub_question": F.transform("sub_question", ask)})


def prefix(df: DataFrame, size: int | None) -> DataFrame:
    """The first `size` samples; all if it is not given or 0."""
    return df.where(F.col("idx") < size) if size else df


def index_range(df: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Samples start..end, both included; without end, all from start."""
    return df.where(F.col("idx") >= start) if end is None else df.where(F.col("idx").between(start, end))


def page(df: DataFrame, start: int, limit: int | None = None) -> DataFrame:
    return df.where((F.col("idx") >= start) & (F.lit(True) if limit is None else F.col("idx") < start + limit))


def write_json_array(df: DataFrame, path: str, order: str = "idx") -> None:
    """One pretty-printed UTF-8 file, row by row; tables are written as Parquet or JSON lines."""
    with open(path, "w", encoding="utf-8") as f:
        mark = "["
        for row in df.orderBy(order).select(F.to_json(F.struct("*"))).toLocalIterator():
            f.write(f"{mark}\n" + textwrap.indent(json.dumps(json.loads(row[0]), ensure_ascii=False, indent=2), "  "))
            mark = ","
        f.write("[]" if mark == "[" else "\n]")


def metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """A metadata projection: lists and structs as JSON text, null as ''."""
    kinds = dict(df.dtypes)
    text = lambda c: F.to_json(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    return df.select(*[F.coalesce(text(c), F.lit("")).alias(c) for c in columns])


class StateStore:
    """Saved statistics as Parquet, keyed by a hash of all parameters."""

    def __init__(self, spark: SparkSession, root: str, use_cache: bool = True):
        self.spark, self.root, self.use_cache = spark, root.rstrip("/"), use_cache

    def path(self, **parameters) -> str:
        return f"{self.root}/{hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:32]}"

    def get(self, compute: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The stored state of these parameters, or the computed one, which is stored."""
        path = self.path(**parameters)
        if not (self.use_cache and whole(self.spark, path)):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


class ResultStore:
    """Evaluation results in numbered batches; each id counts once, whatever is run again, and a run goes on with the
    samples that have no result."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.batches = spark, Numbered(spark, path, "batch")

    def _read(self, without: int | None = None) -> DataFrame:
        paths = [p for i, p in self.batches.folders().items() if i != without]
        return self.spark.read.schema(RESULTS).parquet(*paths) if paths else self.spark.createDataFrame([], RESULTS)

    def read(self) -> DataFrame:
        return self._read()

    def remaining(self, samples: DataFrame, key: str = "id") -> DataFrame:
        return samples.join(self.read().select(F.col("id").alias(key)).distinct(), key, "left_anti")

    def commit(self, results: DataFrame, batch: int) -> None:
        """Store a batch, in place of an earlier try of it: of its rows those whose id no other batch has, the least of each
        id. A write that breaks off leaves a folder that is not read."""
        rows = results.select(*[F.col(f.name).cast(f.dataType) if f.name in results.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RESULTS.fields])
        least = rows.groupBy("id").agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
        known = self._read(batch).select("id").distinct()
        self.batches.write(least.join(known, "id", "left_anti"), batch)

    def append(self, results: DataFrame) -> None:
        """Store results as the next batch."""
        self.commit(results, max(self.batches.folders(), default=-1) + 1)

    def run(self, samples: DataFrame, evaluate: Callable[[DataFrame], DataFrame], batches: int = 10) -> DataFrame:
        """All results: the samples that have none are evaluated and stored in some batches, so a run that is broken off
        loses one of them at most."""
        for i in range(batches):
            part = self.remaining(samples.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i))
            if not part.isEmpty():
                self.append(evaluate(part))
        return self.read()
