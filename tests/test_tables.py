"""Queries on tables made for one rule, where the smallest tables do not show it."""

import os

from pyspark.sql import functions as F

from evoframe.operators import retrieval, stats
from evoframe.plans import derived, queries


def test_skipped_words_mark_nothing_in_the_python_query(spark, tmp_path):
    texts = {1: "int load rows from table quickly, int load", 2: "alpha int rows from table quickly int", 3: "alpha load int from table quickly int"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.pos): r.weight for r in derived.critical_tokens_python(spark, str(tmp_path)).collect()}
    for i, text in texts.items():
        for pos, word in enumerate(text.split(" ")):
            assert got[i, pos] == (1.0 if word == "int" or "quickly" in word else 4.0), (i, pos, word)


def test_lines_of_one_number_go_by_their_place(spark, tmp_path):
    """Of the smaller file, which comes first by name but is read last."""
    lines = "l_orderkey long, l_partkey long, l_linenumber int"
    for name, rows in (("a", [(i, 1, 1) for i in range(50)]), ("b", [(i, 2 + j, 1) for j in range(400) for i in range(50)])):
        spark.createDataFrame(rows, lines).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        os.makedirs(f"{tmp_path}/lineitem.parquet", exist_ok=True)
        for f in os.listdir(f"{tmp_path}/{name}"):
            if f.endswith(".parquet"):
                os.rename(f"{tmp_path}/{name}/{f}", f"{tmp_path}/lineitem.parquet/{name}.parquet")
    spark.range(60).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.first_match(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, 1, 1) for i in range(50)]


def test_cut_points_are_taken_once(spark, monkeypatch):
    """Ranks are exact though the cut points come out otherwise each time that they are asked for."""
    plain = F.percentile_approx
    drift = lambda c: c + F.expr("pmod(hash(java_method('java.util.UUID', 'randomUUID')), 1000)")
    monkeypatch.setattr(F, "percentile_approx", lambda *a: F.transform(plain(*a), drift))
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    got = stats.hazen_quantile(df, "v", [0.1, 0.5, 0.9], ["g"]).collect()
    assert sorted((r.g, r.q, r.value) for r in got) == [(g, q, 2 * (q * 10_000 - 0.5) + g) for g in (0, 1) for q in (0.1, 0.5, 0.9)]


def _most_rows(df):
    """The largest number of rows that a step of the plan gave out."""
    df.collect()

    def walk(p):
        yield p
        for name in ("executedPlan", "plan"):
            if p.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec") and any(m.getName() == name for m in p.getClass().getMethods()):
                yield from walk(getattr(p, name)())
        for i in range(p.children().size()):
            yield from walk(p.children().apply(i))

    plans = walk(df._jdf.queryExecution().executedPlan())
    return max(p.metrics().apply("numOutputRows").value() for p in plans if p.metrics().contains("numOutputRows"))


def test_frequent_names_and_questions_make_no_pairs_of_all(spark):
    docs = spark.range(2_000).selectExpr("id as idx", "'f' as name", "if(id % 2 = 0, 'a::b', 'a::c') as module", "'red ring' as said")
    asked = spark.range(2_000).selectExpr("id as query_id", "if(id % 3 = 0, 'f', 'none') as name", "if(id % 2 = 0, 'a::c', 'a::z') as module")
    found = retrieval.tiered(docs, asked)
    assert _most_rows(found) < 20_000
    tier = lambda q: (1 if q % 2 == 0 else 2) if q % 3 == 0 else 3
    assert sorted(map(tuple, found.collect())) == [(q, i, tier(q), p) for q in range(2_000) for p, i in enumerate((1, 3, 5) if tier(q) == 1 else (0, 1, 2), 1)]
    words = retrieval.keyword_top(docs, asked.withColumn("ask", F.lit("Ring RED")), "idx", "said", "query_id", "ask")
    assert _most_rows(words) < 20_000
    assert sorted(map(tuple, words.collect())) == [(q, i, 2, i + 1) for q in range(2_000) for i in range(3)]
