import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoframe.functions import code, similarity
from evoframe.operators import codebook, graph, rollup, stats, windows
from evoframe.sources import readers
from evoframe.streaming import running


def test_python_signature():
    s = code.python_signature("async def f(self, a: dict[str, int] = {}, *args, **kw) -> bool:")
    assert (s["name"], s["async_"], s["is_method"], s["return_type"]) == ("f", True, True, "bool")
    assert [p["name"] for p in s["params"]] == ["self", "a", "args", "kw"]
    assert s["params"][1]["type"] == "dict[str, int]" and s["params"][1]["default"] == "{}"
    assert s["params"][2]["var_positional"] and s["params"][3]["var_keyword"]
    assert code.python_signature(None)["params"] == []


def test_rust_signature():
    assert code.rust_signature("pub struct S<T>")["kind"] == "struct"
    s = code.rust_signature("unsafe impl<T> A<T> for B<T> where T: C")
    assert (s["kind"], s["impl_trait"], s["impl_for"]) == ("impl", "A<T>", "B<T>")
    assert s["where"] == [{"type_param": "T", "bounds": ["C"]}]
    s = code.rust_signature("pub const fn g(&mut self) -> Option<u8>")
    assert (s["kind"], s["modifiers"], s["self_kind"], s["return_type"]) == ("fn", ["const"], "&mut self", "Option<u8>")
    s = code.rust_signature("fn p<T>(f: Box<dyn Fn(&str) -> T>, n: (u8, u8)) -> T")
    assert [p["name"] for p in s["params"]] == ["f", "n"] and s["return_type"] == "T"


def test_comments_and_imports():
    text = '"""Doc."""\nimport os, sys\nfrom a.b import c as d\n\n\n\ndef f():\n    """Doc."""\n    return 1  # one\n'
    assert "Doc" not in code.strip_python_comments(text) and "# one" not in code.strip_python_comments(text)
    assert code.python_imports(text) == ["os", "sys", "a.b.c"]
    assert code.python_imports("import x\nbroken(") == ["x"]


def test_similarity():
    t = similarity.python_tokens("def f(x):\n    return x\n")
    assert similarity.sentence_bleu(t, t) == pytest.approx(100)
    assert similarity.weighted_ngram(t, t) == pytest.approx(100)
    assert similarity.syntax_match("x = 1", "(") == 0
    assert similarity.data_flow("y = x\nreturn_ = y + z") == {("x", "y", "assign"), ("y", "return_", "assign"), ("z", "return_", "assign")}


def test_pass_at_k(spark):
    rows = [(10, 4, 2, 2 / 3), (0, 0, 1, 0.0), (3, 5, 1, 1.0), (5, 4, 2, 1.0), (5, 0, 1, 0.0)]
    df = spark.createDataFrame(rows, "n long, c long, k long, e double")
    for r in df.select(rollup.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p"), "e").collect():
        assert r.p == pytest.approx(r.e)


def test_windows(spark):
    df = spark.range(1).select(windows.spans(F.lit(10), 4).alias("a"), windows.spans(F.lit(10), 4, 2).alias("b"), windows.spans(F.lit(10), 4, 2, tail=True).alias("c"), windows.spans(F.lit(0), 4).alias("d"))
    r = df.first()
    assert [tuple(x) for x in r.a] == [(0, 4), (4, 8), (8, 10)]
    assert [tuple(x) for x in r.b] == [(0, 4), (2, 6), (4, 8), (6, 10)]
    assert [tuple(x) for x in r.c] == [(0, 4), (2, 6), (4, 8), (6, 10), (8, 10)]
    assert r.d == []


def test_hazen(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double")
    assert {r.q: r.value for r in stats.hazen_quantile(df, "x", [0.0, 0.25, 1.0]).collect()} == {0.0: 1.0, 0.25: 1.5, 1.0: 4.0}


def test_length_batches(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 3, 3, 3, 3, 2, 2, 0, 9])], "id long, n int")
    got: dict[int, list] = {}
    for r in windows.length_batches(df, "id", "n", 9).collect():
        got.setdefault(r.batch, []).append((r.id, r.width))
    sizes = dict(df.collect())
    assert sum(map(len, got.values())) == 8
    for rows in got.values():
        width = rows[0][1]
        assert width == max(sizes[i] for i, _ in rows) and (len(rows) * width <= 9 or len(rows) == 1)


def test_codebook():
    b = codebook.Book(1.0)
    assert b.add(np.array([0.0, 0.0]), 0, "a") == "insert"
    assert b.add(np.array([5.0, 0.0]), 0, "b") == "insert"
    assert b.add(np.array([1.5, 0.0]), 0, "c") == "expand" and b.eps[0] == 1.5
    assert b.add(np.array([1.0, 0.0]), 1, "d") == "split" and b.eps[0] == pytest.approx(0.5 - 1e-5) and b.eps[2] == 0.5


def test_code_columns(spark):
    df = spark.createDataFrame([("use foo_bar::X;\nuse std::fs;\nextern crate baz;", "1.99.0")], "c string, v string")
    r = df.select(code.crate_names(F.col("c")).alias("n"), code.rust_version(F.col("v")).alias("v"), code.to_pascal(F.lit("as_fd")).alias("p"), code.to_snake(F.lit("AsFd")).alias("s"), code.has_rust_signature(F.lit("fn a.b("), F.lit("fn a(")).alias("h")).first()
    assert (r.n, r.v, r.p, r.s, r.h) == (["baz", "foo-bar"], "1.91.0", "AsFd", "as_fd", False)


def test_param_diff(spark):
    old = spark.createDataFrame([(1, "self", None), (1, "a", "int"), (1, "b", None)], "g long, name string, type string")
    new = spark.createDataFrame([(1, "a", "str"), (1, "c", None)], "g long, name string, type string")
    assert sorted((r.name, r.change) for r in graph.param_diff(old, new, ["g"]).collect()) == [("a", "type_changed"), ("b", "removed"), ("c", "added")]


def test_readers(spark, tmp_path):
    path = tmp_path / "docs.json"
    path.write_text('[{"name": "a", "module": "m"}, {"name": "b", "other": 1}]', encoding="utf-8")
    rows = readers.READERS["rust"](spark, str(path)).orderBy("idx").collect()
    assert [(r.idx, r["name"], r["module"]) for r in rows] == [(0, "a", "m"), (1, "b", None)]
    assert readers.READERS["rust"](spark, str(tmp_path / "none.json")).count() == 0
    out = tmp_path / "out.json"
    readers.write_json_array(readers.READERS["python"](spark, str(path)).select("idx", "name"), str(out))
    assert '"name": "a"' in out.read_text()


def test_stores(spark, tmp_path):
    store = readers.StateStore(spark, str(tmp_path / "states"))
    made = []

    def compute():
        made.append(1)
        return spark.range(3).selectExpr("sum(id) as s")

    assert store.get(compute, size=3).first().s == 3 and store.get(compute, size=3).first().s == 3 and len(made) == 1
    readers.StateStore(spark, str(tmp_path / "states"), use_cache=False).get(compute, size=3)
    assert len(made) == 2
    results = readers.ResultStore(spark, str(tmp_path / "results"))
    samples = spark.createDataFrame([("a",), ("b",)], "id string")
    assert results.remaining(samples).count() == 2
    results.append(spark.createDataFrame([("a", True)], "id string, passed boolean"))
    assert [r.id for r in results.remaining(samples).collect()] == ["b"]


def test_states_merge_for_any_split(spark, tmp_path):
    rows = [(i % 3, float((i * 37) % 101) + 1e6) for i in range(600)]
    df = spark.createDataFrame(rows, "g long, x double")
    stat = running.RunningStats(spark, str(tmp_path / "s"), ["g"], "x")
    for b, part in enumerate(df.randomSplit([0.2, 0.5, 0.3], 7)):
        stat.add(part, b)
        stat.add(part, b)  # a replayed batch counts once
    once = sorted(map(str, stat.result().collect()))
    stat.compact(1)
    stat.add(df, 0)  # a batch that is in the compacted state
    assert len(stat._folders("upto")) == 1 and list(stat._folders("batch_id")) == [2]
    stat.compact()
    assert not stat._folders("batch_id") and len(once) == len(stat.result().collect())
    got = {r.g: r for r in stat.result().collect()}
    for r in df.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.min("x").alias("lo")).collect():
        assert got[r.g].n == r.n and got[r.g].lo == r.lo
        assert math.isclose(got[r.g].mean, r.m, rel_tol=1e-12) and math.isclose(got[r.g].variance, r.v, rel_tol=1e-9)


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, x double")
    df.write.parquet(str(tmp_path / "in"))
    stat = running.RunningStats(spark, str(tmp_path / "s"), ["k"], "x")
    stat.start(spark.readStream.schema("k string, x double").parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.k: (r.n, r.mean) for r in stat.result().collect()} == {"a": (2, 2.0), "b": (1, 5.0)}


def test_gram_equals_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, -1.0],), (None,)], "v array<double>")
    assert {(r.i, r.j): r.moment for r in stats.gram(df, "v", 2).collect()} == {(0, 0): 5.0, (0, 1): -0.5, (1, 0): -0.5, (1, 1): 2.5}
    c = np.array([[5.0, -0.5], [-0.5, 2.5]])
    assert np.allclose(stats.null_projector(c, 0.0), np.eye(2) - c) and stats.ridge(c, np.eye(2), 2.0)[0, 0] == 11


def test_sketch_quantiles(spark):
    """Ranks of the sketch are off by under a thousandth of the rows."""
    df = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double").alias("x"))
    values = np.sort([r.x for r in df.collect()])
    r = running.read_out(running.partial(df, [], "x"), [], (0.01, 0.25, 0.5, 0.9, 0.999)).first()
    for q, name in ((0.01, "q0_01"), (0.25, "q0_25"), (0.5, "q0_5"), (0.9, "q0_9"), (0.999, "q0_999")):
        assert abs(np.searchsorted(values, r[name]) / len(values) - q) < 1e-3
