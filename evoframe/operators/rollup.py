"""Evaluation rollups over a result table (id, passed, status, error, test counts, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.code import pytest_counts


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - prod over i in n-c+1..n of (1 - k / i): 0 without samples or passes, 1 if fewer than k samples failed."""
    prod = F.aggregate(F.transform(F.sequence(n - c + 1, n), lambda i: 1 - k / i.cast("double")), F.lit(1.0), lambda p, x: p * x)
    return F.when((n == 0) | (c == 0), 0.0).when((c > n) | (n - c < k), 1.0).otherwise(1 - prod)


def pass_table(df: DataFrame, by: Sequence[str], passed: Column, ks: Sequence[int] = (1, 2, 5)) -> DataFrame:
    """(by..., k, samples, passes, pass_at_k) for each k up to the number of samples."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.count_if(passed).alias("passes"))
    rows = counts.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks]))).where("k <= samples")
    return rows.select(*by, "k", "samples", "passes", pass_at_k(F.col("samples"), F.col("passes"), F.col("k")).alias("pass_at_k"))


# Statuses that name their bucket as a whole, and words that name it as a part, in the order of asking.
STATUS_BUCKETS = {"NO_TEST": "no_test", "SIGNATURE_ERROR": "signature_error", "API_ERROR": "api_error", "EXTRACTION_FAILED": "extraction_error"}
STATUS_WORDS = {"COMPILE": "compilation_failed", "TIMEOUT": "timeout", "TEST": "test_failed"}


def bucket(passed: Column, status: Column) -> Column:
    """One exclusive bucket per result; what no rule names, and no status at all, is other_error."""
    found = F.when(F.coalesce(passed, F.lit(False)), "passed")
    for whole, name in STATUS_BUCKETS.items():
        found = found.when(status == whole, name)
    for word, name in STATUS_WORDS.items():
        found = found.when(F.upper(status).contains(word), name)
    return found.when(status == "FAILED", "test_failed").otherwise("other_error")


def legacy_buckets(df: DataFrame, error: Column, by: Sequence[str] = ()) -> DataFrame:
    """Overlapping buckets by words in the error text; a row may count several times."""
    low = F.lower(F.coalesce(error, F.lit("")))
    named = [F.count_if(low.contains(w)).alias(f"{w}_errors") for w in ("api", "signature", "compile", "timeout")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *named)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def summary(df: DataFrame, bucket_col: str = "bucket", cases_passed: str = "cases_passed", cases_total: str = "cases_total", by: Sequence[str] = (), denominator: str = "tested") -> DataFrame:
    """tested, pass rate, usage accuracy (neither signature nor usage error) and coverage of the test cases of what had a test."""
    b = F.col(bucket_col)
    cases = lambda c: F.coalesce(F.sum(F.when(b != "no_test", F.col(c))), F.lit(0))
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(b != "no_test").alias("tested"), F.count_if(b == "passed").alias("passed"),
        F.count_if(b.isin("signature_error", "api_error")).alias("misused"), cases(cases_passed).alias("cp"), cases(cases_total).alias("ct"),
    )
    whole = F.col(denominator)
    return counts.select(*by, "total", "tested", "passed", rate(F.col("passed"), whole).alias("pass_rate"), rate(whole - F.col("misused"), whole).alias("usage_accuracy"), rate(F.col("cp"), F.col("ct")).alias("coverage"))


def remaining(samples: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Samples without a stored result."""
    return samples.join(results.select(key).distinct(), key, "left_anti")


def running(df: DataFrame, order: str, measures: dict[str, Column], every: int = 10, span: int = 10_000) -> DataFrame:
    """(done, measures...) after each `every` rows in order and after the last one: how many rows there are by then, and the
    sums of the measures over them. Orders may have gaps.

    Rows are summed up in ranges of `span` orders first, and the ranges' running sums are joined back, so rows are only
    numbered inside their range.
    """
    names = ["done", *measures]
    rows = df.select(F.col(order).alias("o"), F.lit(1).alias("done"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in measures.items()]).withColumn("r", F.floor(F.col("o") / span))
    sums = rows.groupBy("r").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("r", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_0") for n in names], F.sum("done").over(whole).alias("all"))
    inside = Window.partitionBy("r").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.select("r", *[F.sum(n).over(inside).alias(n) for n in names]).join(sums, "r")
    found = numbered.select("all", *[(F.col(n) + F.col(f"{n}_0")).alias(n) for n in names])
    return found.where((F.col("done") % every == 0) | (F.col("done") == F.col("all"))).drop("all")


def snapshots(df: DataFrame, order: str, passed: Column, every: int = 10, span: int = 10_000) -> DataFrame:
    """(done, passes) after each `every` rows in order and after the last one."""
    return running(df, order, {"passes": F.when(passed, 1).otherwise(0)}, every, span)


def progress(df: DataFrame, order: str, bucket_col: str = "bucket", cases_passed: str = "cases_passed", cases_total: str = "cases_total", every: int = 10, span: int = 10_000) -> DataFrame:
    """(done, tested, passed, pass_rate, usage_accuracy, coverage) by then, after each `every` rows in order and the last."""
    b = F.coalesce(F.col(bucket_col), F.lit(""))
    tested = b != "no_test"
    one = lambda c: F.when(c, 1).otherwise(0)
    measures = {"tested": one(tested), "passed": one(b == "passed"), "misused": one(b.isin("signature_error", "api_error")), "cp": F.when(tested, F.col(cases_passed)), "ct": F.when(tested, F.col(cases_total))}
    n = F.col("tested")
    return running(df, order, measures, every, span).select("done", "tested", "passed", rate(F.col("passed"), n).alias("pass_rate"), rate(n - F.col("misused"), n).alias("usage_accuracy"), rate(F.col("cp"), F.col("ct")).alias("coverage"))


# How an error says that a signature is wrong or an API is not used.
WRONG_SIGNATURE, UNUSED = "Incorrect function signature", "API not used"


def baseline_summary(df: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = (1, 2, 5), passed: str = "passed", error: str = "error", output: str = "test_output", cases_passed: str = "test_cases_passed", cases_total: str = "test_cases_total") -> DataFrame:
    """total, passed, pass rate, usage accuracy by the errors' words and coverage, all of all results, and pass@k where there
    are k. Where no result has counted test cases, they are counted from the outputs."""
    said = F.coalesce(F.col(error), F.lit(""))
    told = pytest_counts(F.col(output))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(passed)).alias("passed"), (F.count_if(said.contains(WRONG_SIGNATURE)) + F.count_if(said.startswith(UNUSED))).alias("misused"),
        total(F.col(cases_passed)).alias("cp"), total(F.col(cases_total)).alias("ct"), total(told["passed"]).alias("told_p"), total(told["total"]).alias("told_t"),
    )
    n, ok = F.col("total"), F.col("passed")
    none = F.col("ct") == 0
    covered, cases = F.col("cp") + F.when(none, F.col("told_p")).otherwise(0), F.when(none, F.col("told_t")).otherwise(F.col("ct"))
    found = [F.when(n >= k, pass_at_k(n, ok, F.lit(k))).alias(f"pass_at_{k}") for k in ks]
    return counts.select(*by, "total", "passed", rate(ok, n).alias("pass_rate"), rate(n - F.col("misused"), n).alias("usage_accuracy"), covered.alias("cases_passed"), cases.alias("cases_total"), rate(covered, cases).alias("coverage"), *found)


def top_values(df: DataFrame, value: str, order: str, k: int = 10) -> DataFrame:
    """(value, n): the k most common, ties by where they are first seen."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).drop("first")


def validation(df: DataFrame, by: str, top: int = 10) -> DataFrame:
    """(by, passed, failed): by volume, the `top` largest."""
    counts = df.groupBy(by).agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return counts.orderBy(F.desc(F.col("passed") + F.col("failed")), by).limit(top)


def failure(no_query: Column, no_test: Column, code: Column, used: Column, signed: Column, output_ok: Column, code_first: bool = False) -> Column:
    """The status of a sample: the first check that fails, or PASSED.

    The evaluation chain asks query, test, extraction, signature, usage; the validation chain (code_first) test, code,
    usage, signature.
    """
    short = F.length(F.trim(F.coalesce(code, F.lit("")))) < 10
    if code_first:
        return F.when(no_test, "NO_TEST").when(short, "NO_CODE").when(~used, "API_ERROR").when(~signed, "SIGNATURE_ERROR").when(~output_ok, "FAILED").otherwise("PASSED")
    return F.when(no_query, "NO_QUERY").when(no_test, "NO_TEST").when(short, "EXTRACTION_FAILED").when(~signed, "SIGNATURE_ERROR").when(~used, "API_ERROR").when(~output_ok, "FAILED").otherwise("PASSED")


def coverage_of_changes(df: DataFrame) -> DataFrame:
    """(change_type, n, has_old_source, has_source_diff, has_replacement)"""
    old, new = F.coalesce("old_source_code", F.lit("")), F.coalesce("source_code", F.lit(""))
    return df.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(old != "").alias("has_old_source"), F.count_if((old != "") & (old != new)).alias("has_source_diff"), F.count_if(F.coalesce("replacement_api", F.lit("")) != "").alias("has_replacement"))


def built(df: DataFrame, by: str = "change_type", ok: str = "built", nodes: str = "nodes", edges: str = "edges") -> DataFrame:
    """(by, total, built, failed, mean_nodes, mean_edges): graphs that were built, and their mean sizes; 0 where none was."""
    n = F.count_if(ok)
    mean = lambda c: F.coalesce(F.sum(F.when(F.col(ok), F.col(c))), F.lit(0)) / F.greatest(n, F.lit(1))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), n.alias("built"), F.count_if(~F.col(ok)).alias("failed"), mean(nodes).alias("mean_nodes"), mean(edges).alias("mean_edges"))


def validation_report(df: DataFrame, version: str = "version", crates: str = "crates", status: str = "status", passed: str = "passed", top: int = 10) -> dict[str, DataFrame]:
    """The tables of a validation report: total, by_kind (third party or standard library), by_version, crates, errors."""
    ok = F.count_if(passed)
    rates = [F.count(F.lit(1)).alias("total"), ok.alias("passed"), rate(ok, F.count(F.lit(1))).alias("pass_rate")]
    return {
        "total": df.agg(*rates),
        "by_kind": df.groupBy(F.when(F.size(crates) > 0, "third_party").otherwise("stdlib").alias("kind")).agg(*rates),
        "by_version": validation(df.withColumn("passed", F.col(passed)), version, top),
        "crates": df.select(F.explode(crates).alias("crate")).groupBy("crate").agg(F.count(F.lit(1)).alias("n")),
        "errors": df.where(~F.col(passed)).groupBy(F.coalesce(status, F.lit("UNKNOWN")).alias("status")).agg(F.count(F.lit(1)).alias("n")),
    }


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as Parquet under its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def most_frequent(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., value, n): the most common value of each group, ties by the value itself."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x")
    return counts.groupBy(*by).agg(best).select(*by, F.col("x.v").alias(value), (-F.col("x.m")).alias("n"))


def docs_report(df: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """The tables of a report on API documents: by type, by top-level module (the `top` largest), and what is missing."""
    n = F.count(F.lit(1)).alias("n")
    missing = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(f"no_{c}")
    head = F.element_at(F.split(F.coalesce("module", F.lit("")), "::"), 1).alias("module")
    return {"by_type": df.groupBy("type").agg(n), "by_module": df.groupBy(head).agg(n).orderBy(F.desc("n"), "module").limit(top), "missing": df.agg(n, missing("documentation"), missing("source_code"))}


def with_evolution(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """(change_type, n, with_evolution): records, and those whose graph has a node of a change."""
    changed = nodes.where(F.col("node_id").startswith("evo_")).select("graph_id").distinct().withColumn("evo", F.lit(True))
    return records.join(changed, "graph_id", "left").groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("evo", F.lit(False))).alias("with_evolution"))
