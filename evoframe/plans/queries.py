"""Registered queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.functions import vectors
from evoframe.operators import codebook, graph, retrieval, rollup, stats, windows
from evoframe.sources import readers
from evoframe.streaming import states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})  # no negative zero


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]]


def _union(rows: list[str]) -> str:
    return " union all ".join(rows)


# ---- statistics ----


@query("""select l_returnflag, l_linestatus, count(l_quantity) as qty_n, round(avg(l_quantity), 6) as qty_mean, round(var_samp(l_quantity), 6) as qty_var,
 round(stddev_samp(l_quantity), 6) as qty_std, min(l_quantity) as qty_min, max(l_quantity) as qty_max, count(l_discount) as disc_n, round(avg(l_discount), 6) as disc_mean,
 round(var_samp(l_discount), 6) as disc_var, round(stddev_samp(l_discount), 6) as disc_std, min(l_discount) as disc_min, max(l_discount) as disc_max from lineitem group by all""")
def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"))
    return _rounded(stats.summary(rows, ["qty", "disc"], ["l_returnflag", "l_linestatus"]), "qty_mean", "qty_var", "qty_std", "disc_mean", "disc_var", "disc_std")


@query("select l_returnflag, round(avg(l_tax), 6) as mean_tax, count(*) as n from lineitem group by 1")
def stats_mean(spark: SparkSession, d: str) -> DataFrame:
    found = stats.summary(_t(spark, d, "lineitem").select("l_returnflag", F.col("l_tax").alias("tax")), ["tax"], ["l_returnflag"])
    return _rounded(found.select("l_returnflag", F.col("tax_mean").alias("mean_tax"), F.col("tax_n").alias("n")), "mean_tax")


@query(_union([f"select '{a}' as i, '{b}' as j, round(covar_samp({a}, {b}), 4) + 0.0 as cov, round(covar_pop({a}, {b}), 4) + 0.0 as cov_pop, round(corr({a}, {b}), 6) as corr from lineitem" for a, b in _PAIRS]))
def stats_covariance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(stats.covariance(_t(spark, d, "lineitem"), NUMBERS), "cov", "cov_pop", digits=4), "corr")


@query(_union([f"select '{a}' as i, '{b}' as j, round(sum({a} * {b}) / count(*), 4) as moment from lineitem" for a, b in _PAIRS]))
def stats_second_moment(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.second_moment(_t(spark, d, "lineitem"), NUMBERS), "moment", digits=4)


@query(_union([f"select '{a}' as i, '{b}' as j, round(covar_samp({a}, {b}), 4) as cov, round(case when isnan(corr({a}, {b})) then 0 else coalesce(corr({a}, {b}), 0) end, 6) as corr from lineitem" for a in NUMBERS[:2] for b in NUMBERS[2:]]))
def stats_cross_covariance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(stats.cross_covariance(_t(spark, d, "lineitem"), NUMBERS[:2], NUMBERS[2:]), "cov", digits=4), "corr")


_FLAGS = {"cheap": "l_extendedprice < 20000", "bulk": "l_quantity > 30", "taxed": "l_tax > 0.04"}
_IOU = "select '{a}' as i, '{b}' as j, sum((({x}) and ({y}))::int)::int as shared, round(sum((({x}) and ({y}))::int) / (sum(({x})::int) + sum(({y})::int) - sum((({x}) and ({y}))::int) + 1e-20), 6) as iou from lineitem"


def _flags(names: list[str]) -> dict:
    return {n: F.expr(_FLAGS[n]) for n in names}


@query("select i, j, shared::bigint as shared, iou from (" + _union([_IOU.format(a=a, b=b, x=_FLAGS[a], y=_FLAGS[b]) for i, a in enumerate(_FLAGS) for b in list(_FLAGS)[i:]]) + ")")
def stats_iou(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.iou(_t(spark, d, "lineitem"), _flags(list(_FLAGS))), "iou")


@query("select i, j, shared::bigint as shared, iou from (" + _union([_IOU.format(a=a, b=b, x=_FLAGS[a], y=_FLAGS[b]) for a in ("cheap",) for b in ("bulk", "taxed")]) + ")")
def stats_cross_iou(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.iou(_t(spark, d, "lineitem"), _flags(["cheap"]), _flags(["bulk", "taxed"])), "iou")


@query("""select r.i::bigint as bin, coalesce(c.n, 0)::bigint as n from (select unnest(range(0, (select max(l_linenumber) from lineitem)::bigint + 1)) as i) r
 left join (select l_linenumber as k, count(*) as n from lineitem group by 1) c on r.i = c.k""")
def stats_bincount(spark: SparkSession, d: str) -> DataFrame:
    return stats.bincount(_t(spark, d, "lineitem"), "l_linenumber")


@query("select label, round(avg(sqrt(list_inner_product(embedding::double[], embedding::double[]))), 6) as norm_mean from embeddings group by 1")
def stats_norm_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.norm_mean(_t(spark, d, "embeddings"), "embedding", ["label"]), "norm_mean")


_RANKED = "with r as (select event_type, value, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as n from events where value is not null)"
_HAZEN = _RANKED + """, g as (select event_type, max(n) as n, unnest({points}) as q from r group by 1),
 p as (select *, least(greatest(q * n + 0.5, 1.0), n) as h from g)
 select p.event_type, p.q::double as q, round(sum(case when r.rn = floor(h) then 1 - (h - floor(h)) else h - floor(h) end * r.value), 6) as value
 from p join r on r.event_type = p.event_type and r.rn in (floor(h), floor(h) + 1) group by 1, 2"""


@query(_HAZEN.format(points="[0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]"))
def stats_quantile_hazen(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.hazen_quantile(_t(spark, d, "events"), "value", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], ["event_type"]), "value")


@query(_HAZEN.format(points="list_transform(range(0, 101), lambda x: x / 100.0)"))
def stats_readout(spark: SparkSession, d: str) -> DataFrame:
    points = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i / 100.0)
    return _rounded(stats.hazen_quantile(_t(spark, d, "events"), "value", points, ["event_type"]), "value")


@query(_RANKED + " select event_type, value as x, round((max(rn) - count(*) / 2.0) / max(n), 6) as rank01 from r group by 1, 2")
def stats_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.hazen_rank(_t(spark, d, "events"), "value", ["event_type"]), "rank01")


@query()
def stats_quantile_kll(spark: SparkSession, d: str) -> DataFrame:
    return stats.kll_quantile(_t(spark, d, "lineitem"), "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99], ["l_returnflag"])


_TOP = "select o_orderpriority, o_orderkey, o_totalprice, place from (select *, row_number() over (partition by o_orderpriority order by o_totalprice {way}, o_orderkey) as place from orders) where place <= 5"


@query(_TOP.format(way="desc"))
def stats_topk_largest(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_k(_t(spark, d, "orders"), "o_totalprice", 5, "o_orderkey", ["o_orderpriority"]).select("o_orderpriority", "o_orderkey", "o_totalprice", "place")


@query(_TOP.format(way="asc"))
def stats_topk_smallest(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_k(_t(spark, d, "orders"), "o_totalprice", 5, "o_orderkey", ["o_orderpriority"], largest=False).select("o_orderpriority", "o_orderkey", "o_totalprice", "place")


@query("select user_id, array_to_string(list(event_type order by ts, event_id), ',') as path from events group by 1")
def stats_history(spark: SparkSession, d: str) -> DataFrame:
    return stats.history(_t(spark, d, "events"), "event_type", ["ts", "event_id"], ["user_id"]).select("user_id", F.array_join("values", ",").alias("path"))


@query("""select l_linestatus, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) as iqr,
 round(avg(l_extendedprice) / (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) + 1e-8), 6) as spread from lineitem group by 1""")
def stats_iqr(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(stats.iqr_scaled(_t(spark, d, "lineitem"), "l_extendedprice", ["l_linestatus"]), "iqr", digits=4), "spread")


@query("select l_returnflag, round(-sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1.0), 8) as weighted from lineitem group by 1")
def stats_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.weighted_mean(_t(spark, d, "lineitem"), F.col("l_discount"), F.col("l_quantity"), ["l_returnflag"]), "weighted", digits=8)


@query("select l_returnflag, round(sum(sqrt(l_quantity)) / count(*), 6) as integral from lineitem group by 1")
def stats_integrate(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem")
    size = stats.integrate(rows, F.lit(1), ["l_returnflag"]).withColumnRenamed("integral", "n")
    found = stats.integrate(rows, F.sqrt("l_quantity"), ["l_returnflag"]).join(size, "l_returnflag")
    return _rounded(found.select("l_returnflag", (F.col("integral") / F.col("n")).alias("integral")), "integral")


@query("""with e as (select vec_id, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings)
 select a.i::bigint as i, b.i::bigint as j, round(sum(a.v * b.v) / count(*), 6) as moment from e a join e b using (vec_id) where a.i < 8 and b.i < 8 group by 1, 2""")
def stats_gram(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.gram(_t(spark, d, "embeddings").select(F.slice("embedding", 1, 8).alias("v")), "v", 8), "moment")


@query()
def stats_gram_whole(spark: SparkSession, d: str) -> DataFrame:
    """All components; stats_gram has the first 8, which its SQL can check."""
    rows = _t(spark, d, "embeddings").select("embedding")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    return _rounded(stats.gram(rows, "embedding", max(dim, 0)), "moment")


@query()
def sample_seeded(spark: SparkSession, d: str) -> DataFrame:
    return stats.seeded_sample(_t(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from (select *, row_number() over (order by o_orderkey) - 1 as idx from orders) where idx between 10 and 59")
def sample_index_range(spark: SparkSession, d: str) -> DataFrame:
    """Places come from counts below each of a fixed set of ranges, so the order is never built in one task."""
    rows = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    r = stats.ranked(rows, "o_orderkey").select(F.col("x").cast("long").alias("o_orderkey"), (F.col("last") - 1).alias("idx"))
    return readers.index_range(rows.join(r, "o_orderkey"), 10, 59).select("o_orderkey", "o_totalprice")


# ---- ordered clean-up, rollups ----


@query("select doc_id, lang, source from (select *, row_number() over (partition by lang, source order by doc_id) as r from documents) where r = 1")
def docs_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return windows.first_wins(_t(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"])


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def resume_remaining(spark: SparkSession, d: str) -> DataFrame:
    return rollup.remaining(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id")


@query("""with s as (select source, count(*) as samples, sum((quality = 1)::int) as passes from labels join documents using (doc_id) group by 1), k as (select *, unnest([1, 2, 5]) as k from s),
 p as (select *, case when samples = 0 or passes = 0 then 0.0 when samples - passes < k then 1.0 else 1 - list_reduce(list_prepend(1.0::double, list_transform(range((samples - passes + 1)::bigint, samples + 1), lambda i: 1 - k::double / i)), lambda x, y: x * y) end as p from k where k <= samples)
 select source, k::bigint as k, samples, passes::bigint as passes, round(p, 6) as pass_at_k from p""")
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return _rounded(rollup.pass_table(rows, ["source"], F.col("quality") == 1), "pass_at_k")


# statuses by event_id, and the bucket of each written out for the SQL
_STATUSES = ["PASSED", "FAILED", "API_ERROR", "SIGNATURE_ERROR", "NO_TEST", "EXTRACTION_FAILED", "COMPILE_ERROR", "TIMEOUT", "ERROR", "NO_CODE", "test crashed", "compile failed", "NO_API", "EXCEPTION"]
_STATUS_SQL = "case event_id % 15 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_STATUSES)) + " end"
_BUCKET = "case event_id % 15 when 0 then 'passed' when 1 then 'test_failed' when 2 then 'api_error' when 3 then 'signature_error' when 4 then 'no_test' when 5 then 'extraction_error' when 6 then 'compilation_failed' when 7 then 'timeout' when 10 then 'test_failed' when 11 then 'compilation_failed' else 'other_error' end"


def _results(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.expr(_STATUS_SQL).alias("status"))
    return rows.withColumn("bucket", rollup.bucket(F.col("status") == "PASSED", F.col("status"))).withColumns({"cases_total": F.pmod("event_id", F.lit(7)), "cases_passed": F.pmod("event_id", F.lit(5))})


@query(f"select {_BUCKET} as bucket, count(*) as n from events group by 1")
def status_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


_SUMMARY = f"""with r as (select user_id % 10 as grp, {_BUCKET} as b, event_id % 7 as ct, event_id % 5 as cp from events),
 s as (select grp, count(*) as total, count(*) filter (b <> 'no_test') as tested, count(*) filter (b = 'passed') as passed, count(*) filter (b in ('api_error', 'signature_error')) as misused, coalesce(sum(cp) filter (b <> 'no_test'), 0) as cp, coalesce(sum(ct) filter (b <> 'no_test'), 0) as ct from r group by 1)
 select grp::bigint as grp, total, tested, passed, round(coalesce(passed / nullif({{whole}}, 0), 0.0), 6) as pass_rate, round(coalesce(({{whole}} - misused) / nullif({{whole}}, 0), 0.0), 6) as usage_accuracy, round(coalesce(cp / nullif(ct, 0), 0.0), 6) as coverage from s"""


@query(_SUMMARY.format(whole="tested"))
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rollup.summary(_results(spark, d).withColumn("grp", F.col("user_id") % 10), by=["grp"]), "pass_rate", "usage_accuracy", "coverage")


@query(_SUMMARY.format(whole="total"))
def eval_summary_total(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rollup.summary(_results(spark, d).withColumn("grp", F.col("user_id") % 10), by=["grp"], denominator="total"), "pass_rate", "usage_accuracy", "coverage")


@query(f"select user_id % 5 as grp, count(*) as total, count(*) filter (lower({_STATUS_SQL}) like '%api%') as api_errors, count(*) filter (lower({_STATUS_SQL}) like '%signature%') as signature_errors, count(*) filter (lower({_STATUS_SQL}) like '%compile%') as compile_errors, count(*) filter (lower({_STATUS_SQL}) like '%timeout%') as timeout_errors from events group by 1")
def eval_legacy_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rollup.legacy_buckets(_results(spark, d).withColumn("grp", F.col("user_id") % 5), F.col("status"), ["grp"])


@query("""with r as (select event_id, sum((event_type = 'purchase')::int) over (order by event_id) as passes, row_number() over (order by event_id) as done, count(*) over () as n from events)
 select done, passes::bigint as passes from r where event_id % 10 = 9 or done = n""")
def progress_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return rollup.snapshots(_t(spark, d, "events"), "event_id", F.col("event_type") == "purchase")


@query("select props, n from (select props, count(*) as n, min(event_id) as first from events where props is not null group by 1 order by n desc, first limit 10)")
def error_top10(spark: SparkSession, d: str) -> DataFrame:
    return rollup.top_values(_t(spark, d, "events"), "props", "event_id", 10)


@query("select host, n from (select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, count(*) as n, min(page_id) as first from pages where url is not null group by 1 order by n desc, first limit 10)")
def module_top10(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "pages").where("url is not null").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), "page_id")
    return rollup.top_values(rows, "host", "page_id", 10)


@query("select user_id, count(*) filter (event_type = 'purchase') as passed, count(*) filter (event_type <> 'purchase') as failed from events group by 1 order by count(*) desc, user_id limit 10")
def validation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.validation(_t(spark, d, "events").select("user_id", (F.col("event_type") == "purchase").alias("passed")), "user_id")


@query("select lang, count(*) as n, count(*) filter (text is null or text = '') as no_text, count(*) filter (n_chars > 2000) as long from documents group by 1")
def docs_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("no_text"), F.count_if(F.col("n_chars") > 2000).alias("long"))


# ---- retrieval ----

_WORDS = "regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9_]+')"


@query(f"""with w as (select doc_id, {_WORDS.format(t='text')} as w from documents), l as (select doc_id, len(w) as n from w), t as (select count(*) as docs, avg(n) as mean_len from l),
 p as (select doc_id, unnest(w) as t from w), tf as (select doc_id, t, count(*) as tf from p group by 1, 2), df as (select t, count(*) as df from tf group by 1),
 q as (select item_id, t, count(*) as times from (select item_id, unnest({_WORDS.format(t='text')}) as t from benchmark) group by 1, 2),
 s as (select item_id, doc_id, sum(times * ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean_len))) as score from q join df using (t) join tf using (t) join l using (doc_id), t group by 1, 2),
 a as (select item_id, doc_id, coalesce(score, 0) as score from (select item_id, doc_id from benchmark, documents) left join s using (item_id, doc_id)),
 r as (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as place from a)
 select item_id, doc_id, round(score, 5) as score, place from r where place <= 3""")
def bm25_top3(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.bm25(_t(spark, d, "documents"), _t(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "doc_id", F.col("text"), "item_id", F.col("question")), "score", digits=5)


_STOP = "'a', 'an', 'the', 'is', 'are', 'was', 'were', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'from', 'how', 'can', 'you', 'i', 'we', 'they', 'that', 'this', 'what', 'when'"


@query(f"""with q as (select item_id, list_filter(regexp_split_to_array(trim(lower(coalesce(text, ''))), '\\s+'), lambda w: length(w) > 2 and w not in ({_STOP})) as kw from benchmark),
 s as (select item_id, doc_id, len(list_filter(kw, lambda w: contains(lower(text), w))) as hits from q, documents where text is not null),
 r as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as place from s where hits > 0) select item_id, doc_id, hits, place from r where place <= 3""")
def keyword_top3(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_top(_t(spark, d, "documents"), _t(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "doc_id", "text", "item_id", "question")


@query(f"""with d as (select p_partkey as idx, p_brand as name, replace(p_type, ' ', '::') as module, p_name as said from part),
 q as (select idx as query_id, case when idx % 60 = 0 then name else 'none' end as qn, case when idx % 40 = 0 then module when idx % 60 = 20 then split_part(module, '::', 1) || '::other' else '' end as qm, said as asked from d where idx % 20 = 0),
 k as (select query_id, unnest(list_filter(regexp_split_to_array(trim(lower(asked)), '\\s+'), lambda w: length(w) > 2 and w not in ({_STOP}))) as w from q),
 h as (select query_id, idx, count(*) as hits from k join d on contains(lower(said), w) group by 1, 2),
 a as (select query_id, idx, 1 as tier, 0 as hits from q join d on qn = name and qm = module union all select query_id, idx, 2, 0 from q join d on qn = name union all select query_id, idx, 3, 0 from q join d on qm <> '' and starts_with(module, split_part(qm, '::', 1)) union all select query_id, idx, 4, hits from h),
 b as (select *, min(tier) over (partition by query_id) as best from a), r as (select *, row_number() over (partition by query_id order by hits desc, idx) as place from b where tier = best)
 select query_id, idx, tier::bigint as tier, place from r where place <= 3""")
def tiered_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").selectExpr("p_partkey as idx", "p_brand as name", "replace(p_type, ' ', '::') as module", "p_name as said")
    asked = part.where("idx % 20 = 0").selectExpr("idx as query_id", "if(idx % 60 = 0, name, 'none') as name", "case when idx % 40 = 0 then module when idx % 60 = 20 then concat(split_part(module, '::', 1), '::other') else '' end as module", "said as asked")
    return retrieval.tiered(part, asked, text="said", query="asked")


@query("""with d as (select doc_id, text, length(text) as n from documents where length(text) > 0), s as (select *, unnest(case when n > 1000 then range(0, (ceil((n - 1000) / 800.0) * 800)::bigint + 1, 800) else [0::bigint] end) as start from d)
 select doc_id, start, substr(text, start + 1, 1000) as chunk from s""")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunks(_t(spark, d, "documents").select("doc_id", "text"), "text", 1000, 200)


_KEYS = "k as (select label, vec_id as kid, embedding::double[] as kv from (select *, row_number() over (partition by label order by vec_id) as r from embeddings) where r = 1)"


def _keys(spark: SparkSession, d: str) -> DataFrame:
    first = windows.first_wins(_t(spark, d, "embeddings"), ["label"], ["vec_id"])
    return first.select(F.col("vec_id").alias("key_id"), F.col("embedding").alias("key"), F.lit(1.2).alias("eps"), F.col("label").cast("string").alias("edit_id"))


@query(f"""with {_KEYS}, s as (select vec_id, kid as key_id, list_distance(embedding::double[], kv) as dist from embeddings, k), r as (select *, row_number() over (partition by vec_id order by dist, key_id) as place from s)
 select vec_id, key_id, round(dist, 6) as dist, place from r where place <= 3""")
def nearest_keys(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.nearest(_t(spark, d, "embeddings"), _keys(spark, d), 3, "vec_id", "key_id", "embedding", "key"), "dist")


@query(f"""with {_KEYS}, s as (select vec_id, kid as key_id, list_distance(embedding::double[], kv) as dist from embeddings, k), r as (select *, row_number() over (partition by vec_id order by dist, key_id) as place from s)
 select vec_id, key_id, round(dist, 6) as dist, dist <= 1.2 as hit from r where place = 1""")
def codebook_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(codebook.lookup(_t(spark, d, "embeddings"), _keys(spark, d), "vec_id", "embedding"), "dist")


@query()
def codebook_build(spark: SparkSession, d: str) -> DataFrame:
    edits = _t(spark, d, "embeddings").withColumn("grp", F.col("label") % 5)
    return codebook.build(edits, "grp", "vec_id", "embedding", "label", "vec_id", eps=1.0).select("grp", "key_id", F.round("eps", 6).alias("eps"), "label", "edit_id")


# ---- graphs over region, nation, customer and orders ----

_NODES = "nodes as (select 0 as g, 'r' || r_regionkey as id, 'region' as type, 0.0::double as v from region union all select 0, 'n' || n_nationkey, 'nation', 0.0 from nation union all select 0, 'c' || c_custkey, 'customer', c_acctbal / 10000 from customer union all select 0, 'o' || o_orderkey, 'order', o_totalprice / 1000000 from orders)"
_EDGES = "edges as (select 0 as g, 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'in_region' as type from nation union all select 0, 'c' || c_custkey, 'n' || c_nationkey, 'in_nation' from customer union all select 0, 'o' || o_orderkey, 'c' || o_custkey, 'placed_by' from orders)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    for name in ("region", "nation", "customer", "orders"):
        _t(spark, d, name).createOrReplaceTempView(f"g_{name}")
    put = lambda s: s.replace("from region", "from g_region").replace("from nation", "from g_nation").replace("from customer", "from g_customer").replace("from orders", "from g_orders").replace("::double", "D")
    nodes = spark.sql(put(f"with {_NODES} select g as graph_id, id as node_id, type, cast(v as double) as v from nodes"))
    edges = spark.sql(put(f"with {_EDGES} select g as graph_id, src, dst, type from edges"))
    return nodes, edges


def _seeds(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_id").isin("n3", "n7")).select("graph_id", "node_id")


_HOPS = f"""with recursive {_NODES}, {_EDGES}, u as (select src as a, dst as b from edges union select dst, src from edges),
 h(id, hops) as (select id, 0 from nodes where id in ('n3', 'n7') union select b, hops + 1 from h join u on a = id where hops < 3)"""


@query(_HOPS + " select id as node_id, min(hops)::bigint as hops from h group by 1")
def khop_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.k_hop(edges, _seeds(nodes), 3).select("node_id", F.col("hops").cast("long").alias("hops"))


@query(_HOPS + " select src, dst, type from edges where src in (select id from h) and dst in (select id from h)")
def khop_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.prune(nodes, edges, _seeds(nodes), 3, F.lit(False), True)[1].select("src", "dst", "type")


@query(_HOPS + " select id as node_id, type from nodes where id in (select id from h) or type = 'region'")
def khop_prune(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.prune(nodes, edges, _seeds(nodes), 3, F.col("type") == "region", False)[0].select("node_id", "type")


@query(f"with {_EDGES} select src, dst, type, dense_rank() over (order by type) - 1 as type_id from edges")
def edge_type_ids(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.edge_kinds(edges.unionByName(edges), nodes).select("src", "dst", "type", "type_id")


@query(f"with {_NODES}, {_EDGES} select id as node_id, 1 + count(dst) as degree, round(pow(1 + count(dst), -0.5), 6) as norm from nodes left join edges on dst = id group by 1")
def indegree_norm(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return _rounded(graph.in_degree_norm(edges, nodes).select("node_id", "degree", "norm"), "norm")


@query(f"with {_EDGES} select src, dst, type from edges union all select dst, src, 'rev_' || type from edges where type in ('in_region', 'in_nation')")
def reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.reversed_edges(_graph(spark, d)[1], ["in_region", "in_nation"]).select("src", "dst", "type")


@query(f"with {_NODES} select type, count(*) as n from nodes group by 1")
def node_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.type_histogram(_graph(spark, d)[0], "node_id")


@query(f"with {_NODES}, {_EDGES}, s as (select dst, v from edges join nodes on id = src), m as (select dst, max(v) as top from s group by 1) select dst, round(sum(exp(v - top) * v) / sum(exp(v - top)), 6) as message from s join m using (dst) group by 1")
def attention_aggregate(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    scored = edges.join(nodes.select("graph_id", F.col("node_id").alias("src"), "v"), ["graph_id", "src"])
    return _rounded(graph.attention(scored, F.col("v"), F.col("v")).select("dst", "message"), "message")


@query("""with p as (select p_size, p_brand, p_type, row_number() over (partition by p_size, p_brand order by p_partkey) as r from part), o as (select p_size as k, p_brand as name, p_type as t from p where r = 1 and p_size % 2 = 0), n as (select p_size - 1 as k, p_brand as name, p_type as t from p where r = 1 and p_size % 2 = 1),
 j as (select coalesce(o.k, n.k) as k, coalesce(o.name, n.name) as name, o.t as old_type, n.t as new_type, o.name is not null as a, n.name is not null as b from o full join n on o.k = n.k and o.name = n.name)
 select k::bigint as k, name, case when not b then 'removed' when not a then 'added' else 'type_changed' end as change, old_type, new_type from j where not a or not b or old_type is distinct from new_type""")
def param_diff(spark: SparkSession, d: str) -> DataFrame:
    first = windows.first_wins(_t(spark, d, "part"), ["p_size", "p_brand"], ["p_partkey"])
    old = first.where("p_size % 2 = 0").selectExpr("cast(p_size as bigint) as k", "p_brand as name", "p_type as type")
    new = first.where("p_size % 2 = 1").selectExpr("cast(p_size - 1 as bigint) as k", "p_brand as name", "p_type as type")
    return graph.param_diff(old, new, ["k"])


@query("""with o as (select o_custkey as k, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as ordinal from orders), c as (select l_suppkey as k, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as ordinal from lineitem)
 select k, ordinal, o_orderkey, l_orderkey, l_linenumber from o join c using (k, ordinal)""")
def ordinal_zip(spark: SparkSession, d: str) -> DataFrame:
    left = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    right = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber")
    return graph.ordinal_zip(left, right, ["k"], ["o_orderkey"], ["l_orderkey", "l_linenumber"]).select("k", "ordinal", "o_orderkey", "l_orderkey", "l_linenumber")


@query("""with l as (select l_orderkey, l_partkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as r from lineitem)
 select o_orderkey, l_partkey, l_linenumber from orders join l on o_orderkey = l_orderkey where r = 1""")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    # lines of one number go by their place in the table, as they do in the SQL
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    found = graph.first_match(_t(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"], ["l_linenumber", "at"], ["o_orderkey"])
    return found.select("o_orderkey", "l_partkey", "l_linenumber")


@query("select c_custkey as node, case when r = 0 then c_mktsegment else c_mktsegment || '_' || r end as unique_id from (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) - 1 as r from customer)")
def running_names(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_nationkey").alias("graph_id"), F.col("c_mktsegment").alias("prefix"), F.col("c_custkey").alias("pos"))
    return graph.running_names(rows).select(F.col("pos").alias("node"), "unique_id")


@query("""with a as (select c_custkey as id, c_nationkey as g, row_number() over (partition by c_nationkey order by c_custkey) - 1 as at from customer)
 select o_orderkey, x.g::bigint as g, x.at as src_index, y.at as dst_index from (select o_orderkey, o_custkey as s, o_orderkey % 50 + 1 as t from orders) join a x on s = x.id join a y on t = y.id where x.g = y.g""")
def index_nodes(spark: SparkSession, d: str) -> DataFrame:
    people = _t(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("graph_id"), F.col("c_custkey").alias("node_id"))
    made = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 50 + 1).alias("dst"))
    made = made.join(people.withColumnRenamed("node_id", "src"), "src").withColumn("type", F.col("o_orderkey"))
    return graph.index_nodes(people, made).select(F.col("type").alias("o_orderkey"), F.col("graph_id").alias("g"), "src_index", "dst_index")


# ---- windows over tokens ----


@query(f"""with d as (select doc_id, len({_WORDS.format(t='text')}) as n from documents), s as (select *, unnest(range(0, (greatest(ceil((n - 40) / 30.0), 0) * 30)::bigint + 1, 30)) as start from d where n > 0)
 select doc_id, start, least(start + 40, n)::bigint as "end" from s""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", F.size(retrieval.tokens(F.col("text"))).alias("n"))
    made = rows.select("doc_id", F.inline(windows.spans(F.col("n"), 40, 10)))
    return made.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""with d as (select doc_id, len({_WORDS.format(t='text')}) as n from documents), s as (select *, unnest(range(0, n, 30)) as start from d where n > 0)
 select doc_id, start, least(start + 40, n)::bigint as "end" from s""")
def token_windows_tail(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", F.size(retrieval.tokens(F.col("text"))).alias("n"))
    made = rows.select("doc_id", F.inline(windows.spans(F.col("n"), 40, 10, tail=True)))
    return made.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""with d as (select doc_id, {_WORDS.format(t='text')} as w from documents), p as (select doc_id, w, len(w) as n, unnest(range(0, len(w), 40)) as start from d)
 select doc_id, start, len(list_filter(w[start + 1 : start + 40], lambda x: length(x) > 8)) as hits, case when len(list_filter(w[start + 1 : start + 40], lambda x: length(x) > 8)) = 0 then 'skip' else 'focus' end as action from p""")
def window_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", retrieval.tokens(F.col("text")).alias("w"))
    rows = rows.withColumn("marked", F.filter(F.transform("w", lambda x, i: F.when(F.length(x) > 8, i)), lambda i: i.isNotNull()))
    made = windows.window_hits(rows, ["doc_id"], F.size("w"), F.col("marked"), 40)
    return made.select("doc_id", F.col("start").cast("long").alias("start"), "hits", windows.focus(F.col("hits")).alias("action"))


@query(f"""with t as (select item_id, unnest({_WORDS.format(t='text')}) as w, generate_subscripts({_WORDS.format(t='text')}, 1) as i from benchmark) select item_id, i::bigint as i, round(length(w) / avg(length(w)) over (partition by item_id), 6) as weight from t""")
def weight_normalised(spark: SparkSession, d: str) -> DataFrame:
    sized = _t(spark, d, "benchmark").select("item_id", F.transform(retrieval.tokens(F.col("text")), lambda x: F.length(x).cast("double")).alias("w"))
    made = sized.select("item_id", F.posexplode(windows.normalised(F.col("w"))).alias("i", "weight"))
    return _rounded(made.select("item_id", (F.col("i") + 1).cast("long").alias("i"), "weight"), "weight")


@query()
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", F.size(retrieval.tokens(F.col("text"))).alias("n"))
    return windows.length_batches(rows, "doc_id", "n", 20_000)




@query("""with s as (select c.conv_id, c.turn, a.n, b.n as m from (select *, regexp_extract_all(lower(text), '[a-z0-9_]+') as n from conversations) c
 join (select conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_]+') as n from conversations) a on a.conv_id = c.conv_id and a.turn = c.turn join (select conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_]+') as n from conversations) b on b.conv_id = c.conv_id and b.turn = c.turn + 1),
 x as (select conv_id, turn, t, count(*) as a from (select conv_id, turn, unnest(n) as t from s) group by all), y as (select conv_id, turn, t, count(*) as b from (select conv_id, turn, unnest(m) as t from s) group by all),
 o as (select conv_id, turn, sum(least(a, b)) as hits from x join y using (conv_id, turn, t) group by all)
 select conv_id, turn, round(coalesce(2.0 * hits / (len(n) + len(m)), 0), 6) as f1 from s left join o using (conv_id, turn) where len(n) + len(m) > 0""")
def unigram_f1(spark: SparkSession, d: str) -> DataFrame:
    from evoframe.functions.similarity import gram_f1

    said = _t(spark, d, "conversations").select("conv_id", "turn", retrieval.tokens(F.col("text")).alias("n"))
    after = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("m"))
    both = said.join(after, ["conv_id", "turn"]).where("size(n) + size(m) > 0")
    return _rounded(gram_f1(both, ["conv_id", "turn"], "n", "m", 1), "f1")


# ---- rollups and vectors ----


@query("""select o_orderpriority as change_type, count(*) as total, count(*) filter (o_orderstatus <> 'P') as built, count(*) filter (o_orderstatus = 'P') as failed, round(avg(o_custkey % 100) filter (o_orderstatus <> 'P'), 6) as mean_nodes, round(avg(o_orderkey % 1000) filter (o_orderstatus <> 'P'), 6) as mean_edges from orders group by 1""")
def built_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Orders read as graphs that were built or not."""
    rows = _t(spark, d, "orders").selectExpr("o_orderpriority as change_type", "o_orderstatus <> 'P' as built", "o_custkey % 100 as nodes", "o_orderkey % 1000 as edges")
    return _rounded(rollup.built(rows), "mean_nodes", "mean_edges")


@query("select g, m, n from (select *, row_number() over (partition by g order by n desc, m) as r from (select user_id as g, event_type as m, count(*) as n from events where event_type is not null group by 1, 2)) where r = 1")
def most_frequent(spark: SparkSession, d: str) -> DataFrame:
    return rollup.most_frequent(_t(spark, d, "events").selectExpr("user_id as g", "event_type as m"), ["g"], "m")


@query("""with r as (select l_orderkey as g, l_linenumber as t, l_quantity as p, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) as place from lineitem)
 select g, t, round(p / sum(p) over (partition by g), 6) as p, place from r where place <= 2""")
def top_renormalised(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey as g", "l_linenumber as t", "l_quantity as p")
    return _rounded(vectors.top_k(rows, ["g"], "p", 2, "t", True).select("g", "t", "p", "place"), "p")


# ---- mergeable states: folded over whole tables, they say what one aggregation says ----

_BY_FLAG = [f"select l_returnflag, '{a}' as i, '{b}' as j, round(covar_samp({a}, {b}), 4) + 0.0 as cov, round(covar_pop({a}, {b}), 4) + 0.0 as cov_pop, round(coalesce(corr({a}, {b}), 0), 6) as corr from lineitem group by 1" for a in ("l_quantity", "l_tax") for b in ("l_discount",)]


@query(_union(_BY_FLAG))
def state_covariance(spark: SparkSession, d: str) -> DataFrame:
    found = states.fold(_t(spark, d, "lineitem"), states.CrossCovariance(["l_quantity", "l_tax"], ["l_discount"]), ["l_returnflag"])
    return _rounded(_rounded(found, "cov", "cov_pop", digits=4), "corr")


@query("select user_id, place, value, tie from (select user_id, row_number() over (partition by user_id order by value desc, event_id) as place, value, event_id as tie from events where value is not null) where place <= 3")
def state_best(spark: SparkSession, d: str) -> DataFrame:
    return states.fold(_t(spark, d, "events"), states.Best("value", "event_id", 3), ["user_id"])


@query("with c as (select l_returnflag, l_linenumber - 1 as bin, count(*) as n from lineitem group by 1, 2), m as (select l_returnflag, max(bin) as m from c group by 1), b as (select l_returnflag, unnest(range(0, m + 1)) as bin from m) select b.l_returnflag, b.bin::bigint as bin, coalesce(n, 0) as n from b left join c on b.l_returnflag = c.l_returnflag and b.bin = c.bin")
def state_tally(spark: SparkSession, d: str) -> DataFrame:
    return states.fold(_t(spark, d, "lineitem").selectExpr("l_returnflag", "l_linenumber - 1 as bin"), states.Tally("bin"), ["l_returnflag"])


_ABOVE = {"big": "l_quantity - 25", "cheap": "0.05 - l_discount", "taxed": "l_tax"}


@query(_union([f"select '{a}' as i, '{b}' as j, sum(({x} > 0 and {y} > 0)::int)::bigint as shared, round(sum(({x} > 0 and {y} > 0)::int) / (sum(({x} > 0 or {y} > 0)::int) + 1e-20), 6) as iou from lineitem" for a, x in _ABOVE.items() for b, y in _ABOVE.items()]))
def state_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(states.fold(_t(spark, d, "lineitem").selectExpr(*[f"{x} as {a}" for a, x in _ABOVE.items()]), states.Overlap(list(_ABOVE))), "iou")
