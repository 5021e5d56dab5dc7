"""Small rules that no query reaches, on rows worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evoframe.functions import code
from evoframe.operators import codebook, graph, rollup, windows
from evoframe.sources import readers


def test_windows_of_positions(spark):
    r = random.Random(2)
    for size, overlap, tail in ((4, 0, False), (4, 3, False), (5, 2, True), (7, 0, True), (3, 1, False)):
        rows = [(i, n, sorted(r.sample(range(n + 3), min(n, r.randint(0, 6)))) if n else []) for i, n in enumerate([0, 1, 2, 3, 4, 5, 9, 20, 41])]
        df = spark.createDataFrame(rows, "doc int, n int, marked array<int>")
        got = {}
        for x in windows.window_hits(df, ["doc"], F.col("n"), F.col("marked"), size, overlap, tail).collect():
            got.setdefault(x.doc, set()).add((x.start, x.end, x.hits))
        spans = {x.doc: [(s.start, s.end) for s in x.s] for x in df.select("doc", windows.spans(F.col("n"), size, overlap, tail).alias("s")).collect()}
        for i, _, marked in rows:
            assert got.get(i, set()) == {(s, e, sum(s <= p < s + size for p in marked)) for s, e in spans[i]}, (size, overlap, tail, i)


def test_tokens_with_masks(spark):
    df = spark.createDataFrame([([5, 6, 7], [1, 0, 1], 5), ([], [], 2), ([1, 2], [0, 0], 1)], "t array<long>, m array<long>, width int")
    got = df.select(windows.padded(F.col("t"), F.col("width")).alias("p"), windows.unmasked(F.col("t"), F.col("m")).alias("u")).collect()
    assert [tuple(r) for r in got] == [([5, 6, 7, 0, 0], [5, 7]), ([0, 0], []), ([1, 2], [])]


def test_sorted_graphs_and_clean_attributes(spark):
    nodes = spark.createDataFrame([(1, "b", "call"), (1, "a", "call"), (1, "z", "api"), (1, "c", "odd"), (0, "q", "odd")], "graph_id long, node_id string, type string")
    assert [(r.graph_id, r.node_id) for r in graph.sort_nodes(nodes, {"api": 0, "call": 1}).collect()] == [(0, "q"), (1, "z"), (1, "a"), (1, "b"), (1, "c")]
    edges = spark.createDataFrame([(1, "b", "a", "y"), (1, "b", "a", "x"), (1, "a", "b", "z"), (0, "z", "z", "z")], "graph_id long, src string, dst string, type string")
    assert [tuple(r)[1:] for r in graph.sort_edges(edges).collect()] == [("z", "z", "z"), ("a", "b", "z"), ("b", "a", "x"), ("b", "a", "y")]
    attrs = spark.createDataFrame([({"a": "1", "b": "", "c": None, "d": "[]", "e": "{}", "source": "s", "source_role": "old"},)], "m map<string,string>")
    assert tuple(attrs.select(graph.drop_empty(F.col("m")).alias("x"), graph.drop_debug(F.col("m")).alias("y")).first()) == ({"a": "1", "source": "s", "source_role": "old"}, {"a": "1"})
    assert [r.type for r in graph.code_nodes(spark.createDataFrame([("code_call",), ("api",)], "type string")).collect()] == ["code_call"]


def test_code_rules(spark):
    rows = spark.createDataFrame([
        ("std::fs", "use serde::X;", "use old::a; a()", "def test_a(): pass\n  def  test_b(): pass", "ﬁne<|end|> x<|eot_id|>"), ("tokio::io", "use x::y;", "fresh_one(1)", "", None), ("other::m", "use std::a;\nuse my_crate::b;", "use old::{b, a};\nfresh_one()", "#[test]\nfn a() {}\n#[test]", "  a  "), (None, "", "", None, ""),
    ], "module string, code string, used string, tests string, said string")
    got = rows.select(
        code.main_crate(F.col("module"), F.col("code"), ["tokio"]).alias("crate"), code.migration(F.col("used"), F.lit("a"), F.lit("fresh_one"), F.lit("old")).alias("m"),
        code.python_tests(F.col("tests")).alias("p"), code.python_tests(F.col("tests"), at_least_one=True).alias("q"), code.rust_tests(F.col("tests")).alias("r"), code.clean_text(F.col("said")).alias("s"),
    ).collect()
    assert [r.crate for r in got] == ["std", "tokio", "my-crate", "std"]
    assert [tuple(r.m) for r in got] == [(True, False, False), (False, True, True), (True, True, False), (False, False, False)]
    assert [(r.p, r.q, r.r) for r in got] == [(1, 2, 0), (0, 1, 0), (0, 1, 2), (0, 1, 0)]
    assert [r.s for r in got] == ["fine x", "", "a", ""]


def test_chains_of_checks(spark):
    rows = [(False, False, "long enough code", True, True, True), (True, True, "", False, False, False), (False, True, "", False, False, False), (False, False, "short", True, True, True), (False, False, "long enough code", False, False, True), (False, False, "long enough code", False, True, True), (False, False, "long enough code", True, True, False)]
    df = spark.createDataFrame(rows, "no_query boolean, no_test boolean, code string, used boolean, signed boolean, ok boolean")
    ask = lambda first: [r[0] for r in df.select(rollup.failure(*[F.col(c) for c in ("no_query", "no_test", "code", "used", "signed", "ok")], code_first=first)).collect()]
    assert ask(False) == ["PASSED", "NO_QUERY", "NO_TEST", "EXTRACTION_FAILED", "SIGNATURE_ERROR", "API_ERROR", "FAILED"]
    assert ask(True) == ["PASSED", "NO_TEST", "NO_TEST", "NO_CODE", "API_ERROR", "API_ERROR", "FAILED"]


def test_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("1.1", ["a"], "X", False), ("1.1", [], None, False), ("1.2", ["a", "b"], None, True)], "version string, crates array<string>, status string, passed boolean")
    rollup.write_report(rollup.validation_report(rows), str(tmp_path / "report"))
    read = lambda name: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "report" / name)).collect())
    assert read("errors") == [("UNKNOWN", 1), ("X", 1)] and read("crates") == [("a", 2), ("b", 1)] and read("by_version") == [("1.1", 0, 2), ("1.2", 1, 0)]
    assert read("total") == [(3, 1, pytest.approx(1 / 3))] and read("by_kind") == [("stdlib", 1, 0, 0.0), ("third_party", 2, 1, 0.5)]


def test_corpora(spark, tmp_path):
    texts = [f"line {i}" if i % 7 else "" for i in range(200)]
    want = [t for t in texts if t]
    (tmp_path / "a.txt").write_text("\n".join(texts[:120]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # several blocks of a file
        got = readers.corpus(spark, str(tmp_path / "a.txt")).orderBy("idx").collect()
        assert [r.text for r in got] == [t for t in texts[:120] if t] and [r.idx for r in got] == list(range(len(got)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "n long, said string").coalesce(1)
    rows.write.parquet(str(tmp_path / "p"))
    rows.write.json(str(tmp_path / "j.json"))
    for path in ("p", "j.json"):
        assert [r.text for r in readers.corpus(spark, str(tmp_path / path), "said").orderBy("idx").collect()] == want


def test_pages_of_samples(spark):
    df = spark.range(10).withColumnRenamed("id", "idx")
    ids = lambda x: sorted(r.idx for r in x.collect())
    assert ids(readers.page(df, 3, 2)) == [3, 4] and ids(readers.page(df, 8)) == [8, 9] and ids(readers.prefix(df, 0)) == list(range(10)) and ids(readers.index_range(df, 2, 0)) == []


def plain_book(edits, eps, moving):
    """Codebook entries [key, radius, label, id] after all edits in order."""
    book = []
    for key, label, name in edits:
        if not book:
            book.append([key, eps, label, name])
            continue
        near = min(book, key=lambda e: math.dist(e[0], key))
        d = math.dist(near[0], key)
        if d > eps + near[1]:
            book.append([key, eps, label, name])
        elif near[2] != label:
            near[1] = d / 2 - 1e-5
            book.append([key, d / 2, label, name])
        elif d > near[1]:
            if moving:
                near[0] = [0.5 * a + 0.5 * b for a, b in zip(near[0], key)]
            near[1] = d
    return book


@pytest.mark.parametrize("expand", ["coverage", "moving_average"])
def test_codebooks(spark, expand):
    r = random.Random(expand)
    edits = [(g, i, [r.uniform(0, 4), r.uniform(0, 4)], float(r.randint(0, 1)), f"e{i}") for g in ("a", "b") for i in range(40)]
    rows = spark.createDataFrame([*edits, ("a", 99, None, 0.0, "none")], "g string, i long, v array<double>, label double, e string").repartition(5)
    got = {"a": [], "b": []}
    for x in codebook.build(rows, "g", "i", "v", "label", "e", eps=0.8, expand=expand).orderBy("grp", "key_id").collect():
        got[x.grp].append((x.key, x.eps, x.label, x.edit_id))
    for g in got:
        want = plain_book([(v, label, e) for h, _, v, label, e in edits if h == g], 0.8, expand == "moving_average")
        assert len(want) == len(got[g]) > 3
        for (key, radius, label, name), found in zip(want, got[g]):
            assert found == (pytest.approx(key), pytest.approx(radius), label, name)
    assert codebook.delete(spark.createDataFrame([("x",), (None,)], "edit_id string"), "x").count() == 1
    with pytest.raises(ValueError):
        codebook.Book(1.0, "other")
