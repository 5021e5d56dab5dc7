"""Samples as the evaluations read them: subjects, targets, answers and ids of the raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.functions import code
from evoframe.operators.windows import first_wins

DOC_KEY = ("name", "module", "to_version")
DOC_COLUMNS = ("name", "module", "type", "signature", "documentation", "source_code", "from_version", "to_version", "change_type")


def _or(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _full(*columns: Column) -> Column:
    """None of them is null or empty."""
    found = F.lit(True)
    for c in columns:
        found = found & code.truthy(c)
    return found


def _subject(info: Column, signature: Column, task: Column, function: Column, language: str) -> Column:
    """The parts of a task, line by line."""
    return F.concat_ws("\n", F.concat(F.lit("API Information: "), info), F.concat(F.lit("API Signature: "), signature), F.concat(F.lit("Task: "), task), F.lit("Function Signature:"), F.concat(F.lit(f"```{language}\n"), function, F.lit("\n```")))


def _id(name: str) -> Column:
    return F.when(code.truthy(F.col(name)), F.concat(F.col(name), F.lit("_"), _or("from_version", "unknown"), F.lit("_to_"), _or("to_version", "unknown"))).otherwise("unknown")


def _asked(model: str, subject: Column, answer: Column) -> dict[str, Column]:
    """What every projection adds once the subject and the answer are known."""
    question = code.chat(F.lit(model), subject)
    return {"subject": question, "question": question, "para_question": question, "sub_question": F.array(question), "answer": code.ended(F.lit(model), answer), "category": F.lit("code")}


def rust_samples(df: DataFrame, model: str = "") -> DataFrame:
    """Rust samples: the rephrased query, or else the query, in a subject with the API's path; the code, or else its source."""
    task = F.coalesce(F.nullif("rephrased_query", F.lit("")), "query", F.lit(""))
    info = F.concat(_or("module", "None"), F.lit("::"), _or("name", "None"))
    told = _subject(info, F.when(code.truthy(F.col("signature")), F.col("signature")).otherwise(info), task, code.stripped(_or("function_signature")), "rust")
    whole = _full(F.col("name"), F.col("module"), task)
    subject = F.when(whole, told).when(task != "", task).otherwise(F.concat(F.lit("Implement using "), info))
    target = F.when(whole, F.coalesce(F.nullif("code", F.lit("")), "source_code", F.concat(F.lit("// Implementation for "), F.col("name")))).otherwise(F.coalesce("code", "source_code", F.lit("")))
    return df.withColumns({"id": _id("name"), "target": target, **_asked(model, subject, _or("code")), "from_version": _or("from_version", "unknown"), "to_version": _or("to_version", "unknown"), "change_type": _or("change_type", "signature"), "type": _or("type", "fn")})


def python_samples(df: DataFrame, model: str = "") -> DataFrame:
    """Python samples: as rust_samples, with dotted paths and the code without its comments as target."""
    task = F.coalesce(F.nullif("rephrased_query", F.lit("")), "query", F.lit(""))
    function = code.stripped(_or("function_signature"))
    told = _subject(code.api_path(F.col("name"), F.col("module")), _or("signature"), task, function, "python")
    subject = F.when(_full(F.col("name"), F.col("module"), task), told).when(task != "", task).otherwise(F.concat(F.lit("Implement using "), _or("module"), F.lit("."), _or("name")))
    clean = code.strip_comments(_or("code"))
    made = df.withColumns({"id": _id("name"), "code": clean, "function_signature": function})
    return made.withColumns({"target": F.col("code"), **_asked(model, subject, F.col("code")), "from_version": _or("from_version", "unknown"), "to_version": _or("to_version", "unknown"), "change_type": _or("change_type", "signature"), "type": _or("type", "function")})


def pair_samples(df: DataFrame, model: str = "") -> DataFrame:
    """Pairs of an edit and a task that needs it, in either language."""
    python = _or("language", "rust") == "python"
    plain = lambda c: F.when(python, code.strip_comments(_or(c))).otherwise(_or(c))
    made = df.withColumns({"language": _or("language", "rust"), "edit_code": plain("edit_code"), "gen_code": plain("gen_code"), "edit_function_signature": code.stripped(_or("edit_function_signature")), "gen_function_signature": code.stripped(_or("gen_function_signature")), "name": _or("api_name"), "module": _or("api_module")})
    rust = F.col("language") == "rust"
    info = F.when(rust, F.concat("module", F.lit("::"), "name")).when(F.col("name").contains("."), F.col("name")).otherwise(F.concat("module", F.lit("."), "name"))
    parts = [_subject(info, _or("signature"), _or("edit_query"), F.col("edit_function_signature"), language) for language in ("rust", "python")]
    key = F.coalesce("id", F.concat("name", F.lit("_"), _or("from_version"), F.lit("_to_"), _or("to_version")))
    return made.withColumns({"id": key, "target": F.col("edit_code"), **_asked(model, F.when(rust, parts[0]).otherwise(parts[1]), F.col("edit_code")), "query": _or("edit_query"), "function_signature": F.col("edit_function_signature"), "code": F.col("edit_code"), "test_program": _or("edit_test_program"), "change_type": _or("change_type", "signature")})


def api_docs(df: DataFrame, order: str = "idx") -> DataFrame:
    """API documents without answers: the first of each (name, module, to_version); examples and old source only where there are any."""
    one = first_wins(df.withColumns({c: _or(c) for c in DOC_COLUMNS}), list(DOC_KEY), [order])
    rest = [F.nullif(c, F.lit("")).alias(c) if dict(df.dtypes)[c] == "string" else F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("examples", "old_source_code") if c in df.columns]
    return one.select(order, *DOC_COLUMNS, *rest, *[c for c in ("crate",) if c in df.columns])


def token_rows(df: DataFrame, tokens: str, most: int | None = None) -> DataFrame:
    """df with input_ids (cut to `most`), position_ids from 0 and an attention_mask of ones."""
    ids = F.slice(tokens, 1, most) if most else F.col(tokens)
    made = df.withColumn("input_ids", ids)
    n = F.size("input_ids")
    return made.withColumns({"position_ids": F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), "attention_mask": F.array_repeat(F.lit(1), F.greatest(n, F.lit(0)))})
