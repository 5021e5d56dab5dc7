"""Literal rows whose answers are worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from evoframe.functions import code, similarity, vectors
from evoframe.operators import graph, node_text, python_graph, retrieval, rollup
from evoframe.plans import fixtures
from evoframe.sources import graphs, projections, readers


def column(spark, values, schema, *made):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*made).collect()]


def test_buckets(spark):
    told = {"PASSED": "passed", "NO_TEST": "no_test", "SIGNATURE_ERROR": "signature_error", "API_ERROR": "api_error", "EXTRACTION_FAILED": "extraction_error", "COMPILE_ERROR": "compilation_failed", "compile it": "compilation_failed", "Timeout": "timeout", "FAILED": "test_failed", "TEST_FAILED": "test_failed", "my test": "test_failed", "ERROR": "other_error", "NO_API": "other_error", "EXCEPTION": "other_error", "failed": "other_error", None: "other_error", "": "other_error"}
    got = dict(column(spark, [(k,) for k in told], "s string", "s", rollup.bucket(F.col("s") == "PASSED", F.col("s"))))
    assert got == told


def test_coverage_leaves_out_what_had_no_test(spark):
    rows = spark.createDataFrame([("no_test", 3, 9), ("passed", 2, 4), ("api_error", 0, 4)], "bucket string, cases_passed int, cases_total int")
    r = rollup.summary(rows).first()
    assert (r.total, r.tested, r.passed, r.pass_rate, r.usage_accuracy, r.coverage) == (3, 2, 1, 0.5, 0.5, 0.25)


def test_snapshots_with_gaps(spark):
    rows = spark.createDataFrame([(7 * i * i, i % 3 == 0) for i in range(25)], "o long, p boolean")
    assert sorted(tuple(r) for r in rollup.snapshots(rows, "o", F.col("p"), span=100).collect()) == [(10, 4), (20, 7), (25, 9)]


def test_built_and_report(spark):
    rows = spark.createDataFrame([("a", True, 4, 6), ("a", False, None, None), ("a", True, 5, 6), ("b", False, None, None)], "change_type string, built boolean, nodes int, edges int")
    assert sorted(tuple(r) for r in rollup.built(rows).collect()) == [("a", 3, 2, 1, 4.5, 6.0), ("b", 1, 0, 1, 0.0, 0.0)]
    runs = spark.createDataFrame([("1.70.0", ["serde"], "PASSED", True), ("1.70.0", [], "FAILED", False), ("1.80.0", ["serde", "rand"], None, False)], "version string, crates array<string>, status string, passed boolean")
    tables = {k: sorted(tuple(r) for r in t.collect()) for k, t in rollup.validation_report(runs).items()}
    assert tables["by_kind"] == [("stdlib", 1, 0, 0.0), ("third_party", 2, 1, 0.5)] and tables["crates"] == [("rand", 1), ("serde", 2)]
    assert tables["by_version"] == [("1.70.0", 1, 1), ("1.80.0", 0, 1)] and tables["errors"] == [("FAILED", 1), ("UNKNOWN", 1)]
    names = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, "b"), (2, None), (2, "z")], "g int, m string")
    assert sorted(tuple(r) for r in rollup.most_frequent(names, ["g"], "m").collect()) == [(1, "a", 2), (2, "z", 1)]


def test_tiers(spark):
    docs = spark.createDataFrame([(0, "get", "std::io", "reads bytes"), (1, "get", "tokio::io", "reads"), (2, "put", "std::fs", "writes the file"), (3, "cut", "stdx", "cuts a file"), (4, "x", None, "nothing")], "idx long, name string, module string, said string")
    asked = [(1, "get", "tokio::io", ""), (2, "get", "none", ""), (3, "none", "std::other", ""), (4, "none", "none::x", "how can you cut the FILE"), (5, "none", "", "is it"), (6, "", "", "file"), (7, "none", "::x", "")]
    q = spark.createDataFrame(asked, "query_id long, name string, module string, asked string")
    got = {}
    for r in sorted(retrieval.tiered(docs, q, 2, "said", "asked").collect(), key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append((r.tier, r.idx))
    # 4: cut and file are asked (how, can, you, the are not); 5 asks nothing; 7: every module starts with nothing
    assert got == {1: [(1, 1)], 2: [(2, 0), (2, 1)], 3: [(3, 0), (3, 2)], 4: [(4, 3), (4, 2)], 6: [(4, 2), (4, 3)], 7: [(3, 0), (3, 1)]}


def test_keywords_count_repeats(spark):
    docs = spark.createDataFrame([(1, "Alpha beta"), (2, "beta"), (3, "ALPHAbet"), (4, None)], "d long, t string")
    q = spark.createDataFrame([(1, "alpha alpha beta"), (2, "the of"), (3, None), (4, "beta")], "q long, t string")
    rows = sorted((r.q, r.place, r.d, r.hits) for r in retrieval.keyword_top(docs, q, "d", "t", "q", "t", 2, block=2).collect())
    assert rows == [(1, 1, 1, 3), (1, 2, 3, 2), (4, 1, 1, 1), (4, 2, 2, 1)]


def test_formatted_documents(spark):
    row = (1, 1, "f", "m", None, "fn f()", "Says é", "x" * 499, "1.0", "2.0", "signature", "", ['a"b', "c", "d"])
    schema = "query_id int, place int, name string, module string, type string, signature string, documentation string, source_code string, from_version string, to_version string, change_type string, description string, examples array<string>"
    found = spark.createDataFrame([row, (1, 2, "g", None, "fn", None, "", "x" * 500, "1.0", "", "", None, [])], schema)
    text = retrieval.format_documents(found).first().text
    assert text == "[Document 1]\nAPI: f\nModule: m\nType: N/A\nSignature: fn f()\nDocumentation: Says é\nSource Code:\n" + "x" * 499 + "\nVersion: 1.0 → 2.0\n\n[Document 2]\nAPI: g\nModule: N/A\nType: fn\n"
    text = retrieval.format_matches(found).first().text
    assert text.startswith('### Retrieved API [1]: f (m)\nSignature: fn f()\nVersion: 1.0 → 2.0\nChange type: signature\nDocumentation: Says é\nExamples: ["a\\"b", "c"]\n\n### Retrieved API [2]: g ()')
    docs = found.select(F.col("place").cast("long").alias("idx"), *[c for c in found.columns if c not in ("query_id", "place")], F.lit("").alias("query"))
    q = spark.createDataFrame([(1, "g", "", ""), (2, "zz", "", "zz")], "query_id long, name string, module string, query string")
    told = {r.query_id: r.text for r in retrieval.documents_for(docs, q).collect()}
    assert told[1].startswith("[Document 1]\nAPI: g") and told[2] == "No relevant documentation found."


def test_recursive_pieces(spark):
    text = "one two three\nfour five\n\nsix seven eight nine ten\n\n" + "x" * 25
    got = retrieval.recursive_pieces(text, 12, 4)
    assert all(len(p) <= 12 and text[i : i + len(p)] == p for i, p in got)
    assert "".join(sorted(set(text) - set("".join(p for _, p in got)) - set(" \n"))) == "" and [p for _, p in got][:2] == ["one two", "two three"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "d long, t string")
    assert [(r.start, r.chunk) for r in retrieval.recursive_chunks(df, "t", 12, 4).where("d = 1").collect()] == got and retrieval.recursive_chunks(df, "t").where("d > 1").count() == 0


def test_weights_of_ngrams():
    # unigrams: return 1, x 0.2 against return 1, y 0.2; bigrams weigh 0.6 each and none is shared
    assert similarity.weighted_ngram(["return", "x"], ["return", "y"]) == pytest.approx(100 * (2 * 1.0 / 2.4) / 4)
    assert similarity.python_tokens("a ? 'b") == ["a", "b"]


def test_syntax_in_depth_first_order():
    assert similarity._kinds("x = f(1)") == ["Module", "Assign", "Name", "Store", "Call", "Name", "Load", "Constant"]
    a, b = "x = 1\ny = f(x)", "y = f(x)\nx = 1\nz = 2"
    import difflib

    assert similarity.syntax_match(a, b) == 100 * difflib.SequenceMatcher(None, similarity._kinds(b), similarity._kinds(a)).ratio()


def test_data_flow_kinds():
    assert similarity.data_flow("a[i] = x\nb += c\nd: int = e\nfor k in ks:\n    pass\nwith open(p) as f:\n    pass\n") == {("c", "b", "aug_assign"), ("b", "b", "aug_assign"), ("e", "d", "ann_assign"), ("ks", "k", "for"), ("open", "f", "with"), ("p", "f", "with")}
    assert similarity.data_flow("def g(x):\n    async def h():\n        async with x as y: pass\n        async for z in x: pass\n    return x") == {("x", "<return>", "return")}


def test_corpus_scores(spark):
    pairs = spark.createDataFrame([("x = 1", "x = 1"), ("", "x = 1")], "a string, b string")
    r = similarity.corpus_code_bleu(pairs, "a", "b").first()
    assert r.syntax == pytest.approx((100 + similarity.syntax_match("", "x = 1")) / 2) and r.code_bleu == pytest.approx(sum((r.bleu, r.ngram, r.syntax, r.flow)) / 4)
    assert similarity.corpus_code_bleu(pairs.limit(0), "a", "b").first().code_bleu == 0
    texts = lambda *t: spark.createDataFrame(list(enumerate(t)), "i int, t string")
    assert [similarity.detect_language(texts(*t), "t", "i").first().language for t in (("x = 1", "fn f() {}", "let x"), ("fn f() {}", ""), ("", " "))] == ["python", None, None]


def test_python_answers(spark):
    fenced = "Sure:\n```python3 \nimport os\n\n@deco\ndef f(x):\n    return 1\n\ndef test_f():\n    assert f(1)\n\nprint(f(2))\ntest_f()\n# run the tests\nasync def g():\n    pass\n```\n```python\nx\n```"
    # decorators before the first function go; what stands at its level stays
    assert code.python_answer(fenced) == "import os\n\ndef f(x):\n    return 1\n\nprint(f(2))\nasync def g():\n    pass"
    assert code.python_answer_tuned("```python\nimport os\ndef f(x):\n    return 1\nprint(f(2))\n```") == "import os\ndef f(x):\n    return 1"
    assert code.python_answer("```\nhello there all\n```\n```\ndef f(): pass\n```") == "def f(): pass"
    assert code.python_answer("[PYTHON]\ndef f():\n    pass\n[/PYTHON]\n```\n```") == "def f():\n    pass"
    assert code.python_answer("def f():\n  pass\n```") == "def f():\n  pass" and code.python_answer("just words") == "just words" and code.python_answer(None) == ""
    assert code.python_answer_tuned("no code") == "no code" and code.python_answer_tuned("def f(): pass") == "def f(): pass"
    assert column(spark, [(fenced,)], "t string", code.answer_code(F.col("t")), code.tuned_answer_code(F.lit("no code"))) == [(code.python_answer(fenced), "no code")]


def test_rust_answers(spark):
    rows = ["a\n```\nfn f() {}\n```\n```rust\nfn longer() {}\n```", "text\n  use a::b;\nfn f() {}\n\n", "nothing here", "` fn `"]
    made = column(spark, [(r,) for r in rows], "t string", code.rust_code_lines(F.col("t")), code.rust_code_lines(F.col("t"), lines=False))
    assert made == [("fn longer() {}", "fn longer() {}"), ("  use a::b;\nfn f() {}", "text\n  use a::b;\nfn f() {}"), ("nothing here", "nothing here"), ("` fn `", "fn")]


def test_test_files(spark):
    source = "use a::b;\n  use c::d;\nfn f() {}"
    tests = "use a::b;\nuse e::f;\n#[cfg(test)]\nmod t { use a::b; }"
    c = lambda s: F.lit(s)
    made = spark.range(1).select(
        code.without_repeated_uses(c(source), c(tests)).alias("a"), code.without_repeated_uses(c(source), c("use a::b;")).alias("b"), code.rust_test_file(c("x"), c("t();")).alias("c"),
        code.python_test_file(c("def f(x): pass\ndef g(): pass"), c("f(1)")).alias("d"), code.python_test_file(c("def f(): pass"), c("import solution")).alias("e"),
        code.rust_test_inputs(c(source), c(tests), c("1.70.0")).alias("f"), code.rust_test_inputs(c("use serde_json::X;"), c("t"), c("0.9.1")).alias("g"),
    ).first()
    assert made.a == "use e::f;\n#[cfg(test)]\nmod t { use a::b; }" and made.b == "use a::b;"
    assert made.c == "x\n\n\n#[cfg(test)]\nmod tests {\n    use super::*;\n    \n    t();\n}\n"
    assert made.d == "from solution import f, g\nf(1)" and made.e == "import solution"
    assert made.f.third_party and made.f.rust_version == "1.84.0" and made.f.crate_version is None  # a, c and e are crates
    assert made.g.crates == ["serde-json"] and made.g.crate_version == "0.9.1" and made.g.rust_version == "1.84.0"


def test_replacements(spark):
    told = code.rust_replacement
    assert told("old", "", "pub type Old<T> = New<T>;", "", "") == "New<T>"
    assert told("old", "", "", '#[deprecated(since = "1", note = "use `fresh()` instead")]', "") == "fresh"
    assert told("old", "", "", "", "This was replaced by `Other::one`.") == "Other::one"
    assert told("Old", "use a::Thing;\nuse b::{String, Vec};", "", "", "") == "Thing"
    assert told("old", "x.run(); y.run(); z.stop(); z.clone(); z.clone(); z.clone()", "", "", "") == "run"
    assert told("Old", "use a::{B, A, A};", "", "", "") == "A" and told("Old", "", "", "", "") is None
    rows = column(spark, [("pub struct S<T>", "renamed from `a` in 2 to `b`"), ("impl<T> Tr for m::N<T> {", "nothing"), ("use a::B;", None), ("", "")], "c string, d string", code.declared_name(F.col("c")), code.renamed(F.col("d")).alias("r"))
    assert [(n, tuple(r)) for n, r in rows] == [("S", ("a", "b")), ("N", (None, None)), ("B", (None, None)), (None, (None, None))]
    changed = spark.createDataFrame([("x.a(); x.b()", "x.b(); x.a()"), ("x.a()", "unsafe { x.c() }")], "o string, n string").select(code.behaviour_changes(F.col("o"), F.col("n")).alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in changed] == [[], [("behavior_changed", None, None), ("unsafe_changed", False, True)]]


def test_samples(spark):
    schema = "idx long, name string, module string, from_version string, to_version string, type string, change_type string, signature string, documentation string, source_code string, old_source_code string, query string, rephrased_query string, function_signature string, code string"
    rows = [(0, "f", "std::io", "1", "2", None, None, "", "d", "src", "", "q", "", " fn f() ", ""), (1, None, "m", None, None, None, None, "s", None, None, None, "", None, None, "c # x"), (2, "f", "std::io", "1", "2", "fn", "x", "s", "d2", "", "old", "q", "r", "", "code")]
    df = spark.createDataFrame(rows, schema)
    a, b, c = projections.rust_samples(df, "Qwen2").orderBy("idx").collect()
    subject = "API Information: std::io::f\nAPI Signature: std::io::f\nTask: q\nFunction Signature:\n```rust\nfn f()\n```"
    assert a.subject == f"<|im_start|>user\n{subject}<|im_end|>\n<|im_start|>assistant\n" and (a.id, a.target, a.answer, a.type, a.change_type) == ("f_1_to_2", "src", "<|im_end|>", "fn", "signature")
    assert b.id == "unknown" and b.question.startswith("<|im_start|>user\nImplement using m::None") and b.target == "c # x"
    assert "Task: r" in c.question and c.target == "code" and c.answer == "code<|im_end|>"
    p = projections.python_samples(df.withColumns({"module": F.lit("pkg"), "name": F.coalesce("name", F.lit(""))}), "my-llama-2").orderBy("idx").collect()
    assert p[0].question.startswith("API Information: pkg.f\n") and p[1].code == "c" and p[1].question == "Implement using pkg."
    docs = projections.api_docs(df).orderBy("idx").collect()
    assert [r.idx for r in docs] == [0, 1] and docs[0].old_source_code is None and docs[1].documentation == ""
    pair = spark.createDataFrame([("python", "f", "pkg", "s", "q", "def f()", "x = 1 # one", None)], "language string, api_name string, api_module string, signature string, edit_query string, edit_function_signature string, edit_code string, id string")
    for name in ("from_version", "to_version", "gen_query", "gen_function_signature", "gen_code", "edit_test_program", "gen_test_program", "change_type"):
        pair = pair.withColumn(name, F.lit(None).cast("string"))
    r = projections.pair_samples(pair, "Llama-3").first()
    assert "API Information: pkg.f\n" in r.subject and r.subject.startswith("<|begin_of_text|>") and r.answer == "x = 1<|eot_id|>" and r.id == "f__to_"
    t = projections.token_rows(spark.createDataFrame([([5, 6, 7],), ([],)], "t array<int>"), "t", 2).collect()
    assert [(r.input_ids, r.position_ids, r.attention_mask) for r in t] == [([5, 6], [0, 1], [1, 1]), ([], [], [])]


def test_vectors(spark):
    one = spark.createDataFrame([([3.0, 4.0], [0.3, 0.4], [1, 3], {"a.x": 1, "b": 2})], "v array<double>, w array<double>, i array<int>, m map<string,int>")
    r = one.select(
        vectors.clamped(F.col("v"), F.lit(1.0)).alias("a"), vectors.clamped(F.col("w"), F.lit(1.0)).alias("b"), vectors.layer_share(F.col("v"), F.col("w"), 5, 2).alias("c"), vectors.unselected(F.lit(4), F.col("i")).alias("d"),
        vectors.push_prefix("p", F.col("m")).alias("e"), vectors.pull_prefix("a", F.col("m")).alias("f"), vectors.pooled(F.array("v", "w", "v"), F.array(F.lit(1), F.lit(0), F.lit(1))).alias("g"), vectors.restored(F.array(*[F.lit(float(x)) for x in range(4)]), 2).alias("h"),
    ).first()
    assert r.a == pytest.approx([0.6, 0.8], abs=1e-6) and r.b == [0.3, 0.4] and r.c == pytest.approx([0.9, 1.2]) and r.d == [0, 2]
    assert r.e == {"p.a.x": 1, "p.b": 2} and r.f == {"x": 1} and r.g == pytest.approx([0.6, 0.8]) and r.h == [[0.0, 1.0], [2.0, 3.0]]
    p = spark.createDataFrame([(1, t, x) for t, x in enumerate((0.1, 0.5, 0.3, 0.1))], "g int, t int, p double")
    assert [(r.t, round(r.p, 4)) for r in vectors.top_k(p, ["g"], "p", 2, "t", True).orderBy("place").collect()] == [(1, 0.625), (2, 0.375)]
    assert vectors.auxiliary(p, "t", 2).count() == 2 and vectors.sample_portion(p, 1.0).count() == 4


def nodes_of(spark, rows):
    return spark.createDataFrame([(1, f"n{i}", t, n, i, a) for i, (t, n, a) in enumerate(rows)], "graph_id long, node_id string, type string, name string, pos long, attrs map<string,string>")


def test_node_texts(spark):
    rust = {
        ("api_updated", "f", "module=std::io change_type=signature from_version=1 to_version=2"): "⭐ANCHOR: std::io::f [signature] 1→2", ("code_function", "f", "visibility=pub params=x return_type=u8 generics=T"): "pub fn f<T>(x) -> u8",
        ("code_api_call", None, "api=run call_type=method_call receiver=x"): "x.run(...)", ("code_api_call", None, "api=run"): "run(...)", ("code_call_arg", None, "value=1 position=0"): "arg0: 1", ("code_call_arg", None, "value=1"): "arg: 1",
        ("code_return", None, "value=x return_kind=tail"): "[tail] return x", ("code_return", None, ""): "return", ("code_variable", "v", "is_mut=true init_value=1"): "let mut v = 1", ("code_param", "p", "param_type=u8 function=f"): "f::p: u8",
        ("function_def", "f", "return_type=u8 role=old"): "fn f() -> u8 [old]", ("struct_def", "S", "role=new"): "struct def S [new]", ("impl_block", None, "target_type=S trait_impl=T role=old"): "impl T for S [old]",
        ("import_group", None, 'imports=["a","b","c","d"] role=new'): "imports: a, b, c [new]", ("api", "f", "status=stable version=2 role=new"): "api f (stable) @v2 【NEW】", ("api", "f", "role=other"): "api f () [other]",
        ("sig", None, 'api=f visibility=pub is_async=true params=[{"name":"a","type":"u8"}] return_type=u8'): "sig pub async fn f(a: u8) -> u8", ("impl", None, "api=f source_code=line"): "impl f: line",
        ("change", None, "kind=moved from_version=1 to_version=2 old=a new=b"): "CHANGE: moved v1→v2 [a→b]", ("change", None, "kind=k param=p"): "CHANGE: k [param: p]", ("transition", None, "is_breaking=true reason=r"): "transition [BREAKING]: reason: r",
        ("dependencies", None, 'items=["x"]'): "deps: x", ("other", None, ""): None, ("macro_call", "vec", "role=old"): "vec! [old]", ("method_call", "run", "role=new"): ".run() [new]",
    }
    attrs = lambda s: dict(x.split("=", 1) for x in s.split()) if s else {}
    made = nodes_of(spark, [(t, n, attrs(a)) for t, n, a in rust]).orderBy("pos").select(node_text.rust_text()).collect()
    assert [r[0] for r in made] == [v if k[0] != "other" else f"other: n{i}" for i, (k, v) in enumerate(rust.items())]
    python = {
        ("api_updated", "a.f", "module=m change_type=x from_version=1 to_version=2"): "⭐ANCHOR: a.f [x] v1→2", ("func_param", "p", "annotation=int default=1"): "param p: int=1", ("code_api_call", None, "api=os.path.join"): "join(...)",
        ("code_call_arg", "k", "keyword=true value=2"): "k=2", ("code_call_arg", "k", "position=0"): "arg[0]=?", ("func_return", None, ""): "->", ("change", None, 'changes=[{"kind":"added","name":"x","new":"1"}]'): None,
        ("change", None, 'changes=[{"kind":"typed","name":"x","old_type":"a","new":"b"}]'): "Δ typed:x [a→b]", ("change", None, ""): None, ("new_signature", "f", 'params=[{"name":"self"},{"name":"a","type":"int"}] return_type=str'): "def f(a: int) -> str [NEW]",
        ("old_signature", None, "api=m.g"): "def g() [OLD]", ("api", "f", "status=s behavior_desc=does role=old"): "api f (s): does 【OLD】", ("api", None, ""): None, ("odd", None, "api=z"): "odd: z",
    }
    python[("change", None, 'changes=[{"kind":"added","name":"x","new":"1"}]')] = "Δ added:x [→1]"
    made = nodes_of(spark, [(t, n, attrs(a)) for t, n, a in python]).withColumn("shown", F.lit("")).orderBy("pos").select(node_text.python_text()).collect()
    assert [r[0] for r in made] == list(python.values())


def test_graphs_of_records(spark):
    nodes, edges = python_graph.build(fixtures.records(spark))
    said = {(r.graph_id, r.node_id): r.text for r in node_text.with_parameters(nodes, edges).select("graph_id", "node_id", node_text.python_text().alias("text")).collect()}
    assert said[(1, "code_function_read")] == "def read(path)" and said[(1, "new_signature")] == "def load(path: str, mode: str, strict: bool) -> dict [NEW]" and said[(1, "api")] == "⭐ANCHOR: pkg.load [signature]"
    assert {r.src for r in node_text.linked_signatures(nodes, edges).where("type = 'evolved_to'").collect()} == set()  # an edge is there
    counts = {r.graph_id: (r.api, r.change, r.functions, r.evolved) for r in node_text.meta_counts(nodes).collect()}
    assert counts[1] == (1, 1, 1, 2)


def test_valid_nodes(spark):
    rows = [("change", "ab", {}), ("change", "ab", {"kind": "moved"}), ("x", "unknown", {}), ("x", "abc", {}), ("a_placeholder", "abcdef", {}), ("a_placeholder", "x", {"purpose": "bridge"}), ("api", None, {})]
    nodes = nodes_of(spark, rows)
    ok = lambda c: [r.ok for r in nodes.orderBy("pos").select(graph.valid_node(c).alias("ok")).collect()]
    assert ok("generic") == [True, True, False, True, False, True, True] and ok("api_evolution") == [False, True, False, True, False, True, True] and ok("type_dependencies")[6] is False
    edges = spark.createDataFrame([(1, "n0", "n1", "t"), (1, "n0", "n2", "t")], "graph_id long, src string, dst string, type string")
    assert graph.valid_graph(nodes, edges)[1].count() == 1
    assert [r.type for r in graph.type_histogram(nodes, "pos").collect()] == ["change", "x", "a_placeholder", "api"]


def test_perplexity(spark):
    r = spark.createDataFrame([(math.log(0.5),)] * 3, "p double").agg(similarity.perplexity(F.col("p")).alias("x")).first()
    assert r.x == pytest.approx(math.exp(3 * math.log(2) / 4))


def test_graph_files(spark, tmp_path):
    import json

    graphs_ = [{"nodes": [{"id": "api", "type": "api_updated", "name": "f", "params": [{"name": "a"}], "ok": True}, {"id": "c", "type": "change"}, {"type": "lost"}], "edges": [{"from": "api", "to": "c", "relation": "has"}, {"from": "c", "to": "api"}], "api": {"change_type": "x"}}, None]
    (tmp_path / "g.json").write_text(json.dumps(graphs_, ensure_ascii=False))
    tables, nodes, edges = graphs.read_graphs(spark, str(tmp_path / "g.json"))
    assert [(r.graph_id, r.valid, r.api) for r in tables.orderBy("graph_id").collect()] == [(0, True, {"change_type": "x"}), (1, False, None)]
    assert [(r.node_id, r.name, r.attrs) for r in nodes.orderBy("pos").collect()] == [("api", "f", {"params": '[{"name":"a"}]', "ok": "true"}), ("c", None, {})]
    assert {(r.src, r.dst, r.type) for r in edges.collect()} == {("api", "c", "has"), ("c", "api", "relates")}
    graphs.write_graphs(nodes, edges, str(tmp_path / "out"))
    assert tuple(spark.read.parquet(str(tmp_path / "out/stats")).first()) == (1, 2, 2, 2.0, 2.0)
    assert [r.has_graph for r in graphs.with_graph(spark.range(3).withColumnRenamed("id", "idx"), tables).orderBy("idx").collect()] == [True, False, False]
    assert graphs.read_graphs(spark, str(tmp_path / "none.json")) is None


def test_sources(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab"[i % 2] * i) for i in range(5)], "idx long, t string")
    store = graphs.VectorStore(spark, str(tmp_path / "v"))
    for _ in range(2):  # made, then read
        got = store.open_or_build(docs, "t", lambda texts: [[len(t), t.count("a")] for t in texts], 2)
        assert {r.idx: r.vector for r in got.collect()} == {i: [float(i), float(i if i % 2 == 0 else 0)] for i in range(5)}
    assert graphs.resolve(spark, store.versions.folders()[0]).count() == 5 and graphs.resolve(spark, str(tmp_path / "w")) is None and graphs.resolve(spark, docs) is docs
    assert graphs.source(spark, lambda: docs, 2).count() == 2 and graphs.source(spark, docs, 3, seed=4).count() == 3 and graphs.source(spark, docs.toPandas()).count() == 5
    assert graphs.subset(docs, lambda d: d.t.startswith("a")).count() == 2
    assert graphs.map_rows(docs, lambda f: f.assign(n=f.t.str.len())[["idx", "n"]], "idx long, n long").agg(F.sum("n")).first()[0] == 10
    state = readers.StateStore(spark, str(tmp_path / "s"))
    assert graphs.corpus_stat(state, docs, lambda d: d.agg(F.count("t").alias("n")), 3, layer="x").first().n == 3


def test_reports(spark):
    docs = spark.createDataFrame([("fn", "std::io", "d", ""), ("fn", "std::fs", "", None), ("struct", None, "d", "s")], "type string, module string, documentation string, source_code string")
    tables = {k: [tuple(r) for r in t.collect()] for k, t in rollup.docs_report(docs).items()}
    assert sorted(tables["by_type"]) == [("fn", 2), ("struct", 1)] and tables["by_module"] == [("std", 2), ("", 1)] and tables["missing"] == [(3, 1, 2)]
    records = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "graph_id long, change_type string")
    nodes = spark.createDataFrame([(1, "evo_x"), (1, "evo_y"), (3, "api")], "graph_id long, node_id string")
    assert sorted(tuple(r) for r in rollup.with_evolution(records, nodes).collect()) == [("a", 2, 1), ("b", 1, 0)]


def test_encoder_and_spans(spark):
    import numpy as np

    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [5.0, 1.0]], 0, 2), ([[1.0, 2.0]], 0, 0)], "v array<array<double>>, s int, e int")
    assert [r.m for r in rows.select(vectors.span_mean(F.col("v"), F.col("s"), F.col("e")).alias("m")).collect()] == [[2.0, 4.0], None]
    f = vectors.encoder(np.array([[1.0, -1.0]]), np.array([0.5]), np.array([[2.0], [3.0]]), np.array([0.0, 1.0]))
    assert [r.x for r in spark.createDataFrame([([1.0, 3.0],), ([3.0, 1.0],)], "v array<double>").select(f("v").alias("x")).collect()] == [[-1.5, -1.25], [5.0, 8.5]]
    log = spark.createDataFrame([(1, s, x) for s, x in enumerate((5.0, 4.9, 4.0, 4.5))], "g int, s int, x double")
    assert [(r.best, r.improved) for r in vectors.improvements(log, ["g"], "s", "x", 0.5).orderBy("s").collect()] == [(5.0, True), (4.9, False), (4.0, True), (4.0, False)]
