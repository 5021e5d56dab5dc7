"""Registered queries of rules over cases that stand in the documents' words.

Each document takes one case, by its id, with its first word put in place of $1, so inputs and answers grow and vary with the
table; the SQL puts the word into the answers, which are worked out by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evoframe.functions import code, similarity, vectors
from evoframe.operators import evolution, graph, node_text, retrieval, rollup
from evoframe.sources import projections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_WORD = "select doc_id, regexp_extract(text, '[a-z]{3,}') as w from documents where regexp_matches(text, '[a-z]{3,}')"


def _sql(value, kind: str) -> str:
    if value is None:
        return f"cast(null as {kind})"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"cast({value} as {kind})"


def answers(columns: str, rows: list[tuple], of: int | None = None):
    """Register a query with its rows; columns are `name type` pairs of SQL, the first the number of the case, of which there
    are `of` (if not as many as rows say)."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    base = min(r[0] for r in rows)
    of = of or max(r[0] for r in rows) - base + 1
    values = ", ".join("(" + ", ".join(_sql(v, k) for v, k in zip(row, kinds)) + ")" for row in rows)
    put = ", ".join(f"replace({n}, '$1', w) as {n}" if k == "varchar" else n for n, k in zip(names[1:], kinds[1:]))

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"with d as ({_WORD}) select d.doc_id as {names[0]}, {put} from d join (values {values}) t({', '.join(names)}) on d.doc_id % {of} + {base} = t.{names[0]}"
        return f

    return add


def _put(c: Column, kind: T.DataType) -> Column:
    """The document's word in the texts of a value."""
    word = lambda x: F.replace(x, F.lit("$1"), F.col("__word"))
    if isinstance(kind, T.StringType):
        return word(c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(c, word)
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return F.transform_values(c, lambda _, v: word(v))
    return c


def cases(spark: SparkSession, d: str, rows: list[tuple], schema: str, of: int | None = None) -> DataFrame:
    """The rows of each document's case; the first column, the number of the case, becomes the document's id."""
    made = spark.createDataFrame(rows, schema)
    key, *others = made.schema.fields
    base = min(r[0] for r in rows)
    of = of or max(r[0] for r in rows) - base + 1
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("__doc"), F.regexp_extract("text", "[a-z]{3,}", 0).alias("__word")).where("__word <> ''")
    met = docs.join(F.broadcast(made.withColumnRenamed(key.name, "__case")), F.pmod("__doc", F.lit(of)) + base == F.col("__case"))
    return met.select(F.col("__doc").alias(key.name), *[_put(F.col(f.name), f.dataType).alias(f.name) for f in others])


def _rows(spark: SparkSession, d: str, values: list, schema: str) -> DataFrame:
    return cases(spark, d, [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], f"i long, {schema}")


RUST_ANSWERS = ["a\n```\nfn f() {}\n```\n```rust\nfn longer_$1() {}\n```", "text\n  use a::b;\nfn f() {}\n\n", "nothing here", "` fn `"]


@answers("i bigint, tagged varchar, lines varchar, plain varchar", [(0, "fn longer_$1() {}", "fn longer_$1() {}", "fn longer_$1() {}"), (1, "text\n  use a::b;\nfn f() {}", "  use a::b;\nfn f() {}", "text\n  use a::b;\nfn f() {}"), (2, "nothing here", "nothing here", "nothing here"), (3, "fn", "` fn `", "fn")])
def rust_answer_code(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, RUST_ANSWERS, "t string").select("i", code.rust_code(F.col("t")).alias("tagged"), code.rust_code_lines(F.col("t")).alias("lines"), code.rust_code_lines(F.col("t"), lines=False).alias("plain"))


PYTHON_ANSWERS = ["```python\nimport $1\n\ndef f(x):\n    return 1\n\ndef test_f():\n    assert f(1)\n\nprint(f(2))\ntest_f()\n```", "```\nhello there\n```\n```\ndef f_$1(): pass\n```", "[PYTHON]\ndef f():\n    pass\n[/PYTHON]\n```\n```", "def f():\n  pass\n```", "just words"]


@answers("i bigint, answer varchar, tuned varchar", [(0, "import $1\n\ndef f(x):\n    return 1\n\nprint(f(2))", "import $1\n\ndef f(x):\n    return 1"), (1, "def f_$1(): pass", "def f_$1(): pass"), (2, "def f():\n    pass", "def f():\n    pass"), (3, "def f():\n  pass", "def f():\n  pass"), (4, "just words", "just words")])
def python_answer_code(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, PYTHON_ANSWERS, "t string").select("i", code.answer_code(F.col("t")).alias("answer"), code.tuned_answer_code(F.col("t")).alias("tuned"))


_TESTS = [("use a$1::b;\nfn f() {}", "use a$1::b;\nuse e::f;\n#[cfg(test)]\nmod t {}"), ("x", "use a$1::b;"), ("use serde_json::X;", "t();")]


@answers(
    "i bigint, cleaned varchar, whole varchar, rust varchar, crate varchar, crates varchar",
    [
        (0, "use e::f;\n#[cfg(test)]\nmod t {}", "use a$1::b;\nfn f() {}\n\nuse a$1::b;\nuse e::f;\n#[cfg(test)]\nmod t {}", "1.84.0", "0.9.1", "a$1,e"),
        (1, "use a$1::b;", "x\n\n\n#[cfg(test)]\nmod tests {\n    use super::*;\n    \n    use a$1::b;\n}\n", "1.84.0", "0.9.1", "a$1"),
        (2, "t();", "use serde_json::X;\n\n\n#[cfg(test)]\nmod tests {\n    use super::*;\n    \n    t();\n}\n", "1.84.0", "0.9.1", "serde-json"),
    ],
)
def rust_test_files(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, _TESTS, "c string, t string").withColumn("x", code.rust_test_inputs(F.col("c"), F.col("t"), F.lit("0.9.1")))
    return rows.select("i", F.col("x.tests").alias("cleaned"), code.rust_test_file(F.col("c"), F.col("t")).alias("whole"), F.col("x.rust_version").alias("rust"), F.col("x.crate_version").alias("crate"), F.array_join("x.crates", ",").alias("crates"))


@answers("i bigint, whole varchar", [(0, "from solution import f_$1, g\nf(1)"), (1, "import solution\nf()"), (2, "f()")])
def python_test_files(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, [("def f_$1(x): pass\ndef g(): pass", "f(1)"), ("def f(): pass", "import solution\nf()"), ("x = 1", "f()")], "c string, t string")
    return rows.select("i", code.python_test_file(F.col("c"), F.col("t")).alias("whole"))


_REPLACED = [
    ("old", "", "pub type Old<T> = New$1<T>;", "", ""), ("old", "", "", '#[deprecated(since = "1", note = "use `fresh$1()` instead")]', ""), ("old", "", "", "", "This was replaced by `Other::one$1`."),
    ("Old", "use a::Thing$1;\nuse b::{String, Vec};", "", "", ""), ("old", "x.run$1(); y.run$1(); z.stop(); z.clone(); z.clone()", "", "", ""), ("Old", "use a::{B, A$1, A$1};", "", "", ""), ("Old", "", "", "", ""),
]


@answers("i bigint, replacement varchar", [(0, "New$1<T>"), (1, "fresh$1"), (2, "Other::one$1"), (3, "Thing$1"), (4, "run$1"), (5, "A$1"), (6, None)])
def rust_replacements(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, _REPLACED, "name string, code string, old string, source string, docs string")
    return rows.select("i", code.replacement(*[F.col(c) for c in ("name", "code", "old", "source", "docs")]).alias("replacement"))


@answers("i bigint, declared varchar, was varchar, is_now varchar, changes varchar", [(0, "S$1", "a$1", "b", ""), (1, "N$1", None, None, "behavior_changed,unsafe_changed"), (2, "B$1", None, None, "behavior_changed"), (3, None, None, None, "")])
def rust_declarations(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, [("pub struct S$1<T>", "renamed from `a$1` in 2 to `b`", "x.a()", "x.a(); x.a()"), ("impl<T> Tr for m::N$1<T> {", "", "x.a()", "unsafe { x.c() }"), ("use a::B$1;", None, "x.a()", None), ("", "", None, None)], "c string, d string, o string, n string")
    made = rows.select("i", code.declared_name(F.col("c")).alias("declared"), code.renamed(F.col("d")).alias("r"), code.behaviour_changes(F.col("o"), F.col("n")).alias("x"))
    return made.select("i", "declared", F.col("r.old").alias("was"), F.col("r.new").alias("is_now"), F.array_join(F.col("x.kind"), ",").alias("changes"))


_SAMPLES = [("f$1", "std::io", "1", "2", None, "q", "", " fn f() ", "", "src"), (None, "m", None, None, "s", "", None, None, "c # $1", None), ("f$1", "std::io", "1", "2", "s", "q", "r", "", "code", "")]
_SAMPLE = "name string, module string, from_version string, to_version string, signature string, query string, rephrased_query string, function_signature string, code string, source_code string, type string, change_type string"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, [(*s, None, None) for s in _SAMPLES], _SAMPLE).withColumnRenamed("i", "idx")


@answers(
    "idx bigint, id varchar, subject varchar, target varchar, answer varchar",
    [
        (0, "f$1_1_to_2", "<|im_start|>user\nAPI Information: std::io::f$1\nAPI Signature: std::io::f$1\nTask: q\nFunction Signature:\n```rust\nfn f()\n```<|im_end|>\n<|im_start|>assistant\n", "src", "<|im_end|>"),
        (1, "unknown", "<|im_start|>user\nImplement using m::None<|im_end|>\n<|im_start|>assistant\n", "c # $1", "c # $1<|im_end|>"),
        (2, "f$1_1_to_2", "<|im_start|>user\nAPI Information: std::io::f$1\nAPI Signature: s\nTask: r\nFunction Signature:\n```rust\n\n```<|im_end|>\n<|im_start|>assistant\n", "code", "code<|im_end|>"),
    ],
)
def rust_sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return projections.rust_samples(_samples(spark, d), "Qwen2").select("idx", "id", "subject", "target", "answer")


@answers(
    "idx bigint, id varchar, subject varchar, target varchar",
    [
        (0, "f$1_1_to_2", "API Information: std::io.f$1\nAPI Signature: \nTask: q\nFunction Signature:\n```python\nfn f()\n```", ""),
        (1, "unknown", "Implement using m.", "c"),
        (2, "f$1_1_to_2", "API Information: std::io.f$1\nAPI Signature: s\nTask: r\nFunction Signature:\n```python\n\n```", "code"),
    ],
)
def python_sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return projections.python_samples(_samples(spark, d), "my-llama-2").select("idx", "id", "subject", "target")


@answers("i bigint, model varchar, question varchar, answer varchar", [(0, "Llama-3", "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n$1<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "a<|eot_id|>"), (1, "Llama-2", "$1", "a"), (2, "qwen2", "<|im_start|>user\n$1<|im_end|>\n<|im_start|>assistant\n", "a<|im_end|>"), (3, "LLAMA3", "$1", "a")])
def chat_templates(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, [("Llama-3", "$1"), ("Llama-2", "$1"), ("qwen2", "$1"), ("LLAMA3", "$1")], "model string, q string")
    return rows.select("i", "model", code.chat(F.col("model"), F.col("q")).alias("question"), code.ended(F.col("model"), F.lit("a")).alias("answer"))


_DOC = "query_id long, place int, name string, module string, type string, signature string, documentation string, source_code string, from_version string, to_version string, change_type string, description string, examples array<string>"
_DOCS = [(1, 1, "f$1", "m", None, "fn f()", "Says é $1", "src", "1.0", "2.0", "signature", "", ['a"b', "c", "d"]), (1, 2, "g", None, "fn", None, "", "x" * 500, "1.0", "", "", None, [])]


@answers("query_id bigint, text varchar", [(1, "[Document 1]\nAPI: f$1\nModule: m\nType: N/A\nSignature: fn f()\nDocumentation: Says é $1\nSource Code:\nsrc\nVersion: 1.0 → 2.0\n\n[Document 2]\nAPI: g\nModule: N/A\nType: fn\n")])
def formatted_documents(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.format_documents(cases(spark, d, _DOCS, _DOC))


@answers("query_id bigint, text varchar", [(1, '### Retrieved API [1]: f$1 (m)\nSignature: fn f()\nVersion: 1.0 → 2.0\nChange type: signature\nDocumentation: Says é $1\nExamples: ["a\\"b", "c"]\n\n### Retrieved API [2]: g ()\nSignature: \nVersion: 1.0 → \nChange type: ')])
def formatted_matches(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.format_matches(cases(spark, d, _DOCS, _DOC))


def _nodes(spark: SparkSession, d: str, rows: list[tuple]) -> DataFrame:
    """Every document is a graph of all the nodes."""
    return cases(spark, d, [(1, f"n{i}", t, n, i, a) for i, (t, n, a) in enumerate(rows)], "graph_id long, node_id string, type string, name string, pos long, attrs map<string,string>")


@answers("graph_id bigint, node_id varchar, text varchar", [(1, "n0", "⭐ANCHOR: std::f$1 [x] 1→2"), (1, "n1", "pub fn f<T>(x) -> u8"), (1, "n2", "x.run(...)"), (1, "n3", "arg0: 1"), (1, "n4", "let mut v = 1"), (1, "n5", "impl T for S [old]"), (1, "n6", "sig pub async fn f(a: u8) -> u8"), (1, "n7", "CHANGE: moved v1→v2 [a→b]"), (1, "n8", "transition [BREAKING]: reason: r"), (1, "n9", "other: n9")])
def rust_node_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = [("api_updated", "f$1", {"module": "std", "change_type": "x", "from_version": "1", "to_version": "2"}), ("code_function", "f", {"visibility": "pub", "params": "x", "return_type": "u8", "generics": "T"}), ("code_api_call", None, {"api": "run", "call_type": "method_call", "receiver": "x"}), ("code_call_arg", None, {"value": "1", "position": "0"}), ("code_variable", "v", {"is_mut": "true", "init_value": "1"}), ("impl_block", None, {"target_type": "S", "trait_impl": "T", "role": "old"}), ("sig", None, {"api": "f", "visibility": "pub", "is_async": "true", "params": '[{"name":"a","type":"u8"}]', "return_type": "u8"}), ("change", None, {"kind": "moved", "from_version": "1", "to_version": "2", "old": "a", "new": "b"}), ("transition", None, {"is_breaking": "true", "reason": "r"}), ("other", None, {})]
    return _nodes(spark, d, rows).select("graph_id", "node_id", node_text.rust_text().alias("text"))


@answers("graph_id bigint, node_id varchar, text varchar", [(1, "n0", "⭐ANCHOR: a.f$1 [x] v1→2"), (1, "n1", "param p: int=1"), (1, "n2", "join(...)"), (1, "n3", "k=2"), (1, "n4", "->"), (1, "n5", "Δ added:x [→1], typed:y [a→b]"), (1, "n6", None), (1, "n7", "def f(a: int) -> str [NEW]"), (1, "n8", "api f (s): does 【OLD】"), (1, "n9", "odd: z")])
def python_node_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = [("api_updated", "a.f$1", {"module": "m", "change_type": "x", "from_version": "1", "to_version": "2"}), ("func_param", "p", {"annotation": "int", "default": "1"}), ("code_api_call", None, {"api": "os.path.join"}), ("code_call_arg", "k", {"keyword": "true", "value": "2"}), ("func_return", None, {}), ("change", None, {"changes": '[{"kind":"added","name":"x","new":"1"},{"kind":"typed","name":"y","old_type":"a","new":"b"}]'}), ("change", None, {}), ("new_signature", "f", {"params": '[{"name":"self"},{"name":"a","type":"int"}]', "return_type": "str"}), ("api", "f", {"status": "s", "behavior_desc": "does", "role": "old"}), ("odd", None, {"api": "z"})]
    return _nodes(spark, d, rows).withColumn("shown", F.lit("")).select("graph_id", "node_id", node_text.python_text().alias("text"))


@answers("graph_id bigint, node_id varchar, plain boolean, evolution boolean", [(1, "n0", True, False), (1, "n1", True, True), (1, "n2", False, False), (1, "n3", True, True), (1, "n4", False, False), (1, "n5", True, True)])
def valid_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = [("change", "ab", {}), ("change", "ab", {"kind": "moved"}), ("x", "unknown", {}), ("x", "abc$1", {}), ("a_placeholder", "abcdef", {}), ("a_placeholder", "x", {"purpose": "bridge"})]
    return _nodes(spark, d, rows).select("graph_id", "node_id", graph.valid_node().alias("plain"), graph.valid_node("api_evolution").alias("evolution"))


@answers("i bigint, ngram double, syntax double, flow double", [(0, 75.0, 100.0, 100.0), (1, 20.8333, 100.0, 0.0), (2, 0.0, 0.0, 0.0)])
def similarity_rules(spark: SparkSession, d: str) -> DataFrame:
    made = similarity.code_bleu(_rows(spark, d, [("v_$1 = x", "v_$1 = x"), ("return v_$1", "return y"), ("(", "v_$1 = 1")], "a string, b string"), "a", "b")
    return made.select("i", *[F.round(c, 4).alias(c) for c in ("ngram", "syntax", "flow")])


@answers("i bigint, a double, b double, c double, d varchar, e varchar", [(0, 0.6, 0.8, 0.9, "0,2", "x"), (1, 0.3, 0.4, -0.9, "0,1,2,3", "")])
def vector_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, [([3.0, 4.0], [0.3, 0.4], [1, 3], {"a.x": 1, "b": 2}), ([0.3, 0.4], [3.0, 4.0], [], {})], "v array<double>, w array<double>, s array<int>, m map<string,int>")
    clamped = vectors.clamped(F.col("v"), F.lit(1.0))
    return rows.select("i", F.round(clamped[0], 6).alias("a"), F.round(clamped[1], 6).alias("b"), F.round(vectors.layer_share(F.col("v"), F.col("w"), 5, 2)[0], 6).alias("c"), F.array_join(vectors.unselected(F.lit(4), F.col("s")), ",").alias("d"), F.array_join(F.map_keys(vectors.pull_prefix("a", F.col("m"))), ",").alias("e"))


@answers("graph_id bigint, src varchar, dst varchar, type varchar", [(1, "a$1", "b", "x"), (1, "o", "n", "evolved_to"), (2, "n", "o", "x")], of=3)
def linked_signatures(spark: SparkSession, d: str) -> DataFrame:
    nodes = cases(spark, d, [(g, n, t) for g in (1, 2) for n, t in (("o", "old_signature"), ("n", "new_signature"))] + [(3, "o", "old_signature")], "graph_id long, node_id string, type string")
    return node_text.linked_signatures(nodes, cases(spark, d, [(1, "a$1", "b", "x"), (2, "n", "o", "x")], "graph_id long, src string, dst string, type string", of=3))


_CHANGED = [
    (1, "chown$1", "stabilized", "1.70", "1.73", "use a::b;", None, None, None, None, None), (2, "old_fn$1", "deprecated", None, None, "x.run()", "pub fn fresh$1(a: u8) -> u8 {}", "pub fn old_fn$1(a: u8) -> u8 {}", None, "This was replaced by `fresh$1`.", ""),
    (3, "get", "implicit", None, None, "", "unsafe { self.b() }", "self.a()", None, None, None), (4, "g$1", "signature", None, None, "", "pub fn g$1(y: u8) -> u8 { }", "pub fn g$1(x: u8) -> u8 { }", None, None, None),
]
_CHANGE = "graph_id long, name string, change_type string, from_version string, to_version string, code string, source_code string, old_source_code string, signature string, documentation string, replacement_api string"


@answers(
    "graph_id bigint, node_id varchar, text varchar",
    [
        (1, "v0", "api chown$1 (unstable) @v1.70 【OLD】"), (1, "v1", "api chown$1 (stable) @v1.73 【NEW】"), (1, "stab", "CHANGE: stabilization (unstable→stable) v1.70→v1.73"), (1, "code_imports", "deps: a::b"),
        (2, "old", "api old_fn$1 (deprecated) 【OLD】"), (2, "new", "api fresh$1 (active) 【NEW】"), (2, "deprecation", "deprecation: reason: functionality_replaced, migration: signature_changed"),
        (3, "old", "impl get [old]"), (3, "new", "impl get [new]"), (3, "c0", "CHANGE: behavior_changed"), (3, "c1", "CHANGE: unsafe_changed [false→true]"),
        (4, "old", "sig pub fn g$1(x: u8) -> u8 【OLD】"), (4, "new", "sig pub fn g$1(y: u8) -> u8 【NEW】"), (4, "c0", 'CHANGE: param_added [param: [{"name":"y","type":"u8"}]]'), (4, "c1", 'CHANGE: param_removed [param: [{"name":"x","type":"u8"}]]'), (4, "c2", "CHANGE: rename [x→y]"),
    ],
)
def evolution_nodes(spark: SparkSession, d: str) -> DataFrame:
    return evolution.evolution(cases(spark, d, _CHANGED, _CHANGE))[0].select("graph_id", "node_id", node_text.rust_text().alias("text"))


@answers(
    "graph_id bigint, src varchar, dst varchar, type varchar",
    [
        (1, "v0", "v1", "stabilizes"), (1, "v0", "stab", "stabilizes_via"), (1, "stab", "v1", "produces"), (1, "v1", "code_imports", "requires"), (2, "old", "deprecation", "deprecated_via"), (2, "deprecation", "new", "recommends"), (2, "old", "new", "replaced_by"),
        (3, "old", "new", "refactors"), (3, "old", "c0", "has_change"), (3, "c0", "new", "modifies"), (3, "old", "c1", "has_change"), (3, "c1", "new", "modifies"),
        (4, "old", "new", "evolves"), (4, "old", "new", "evolves_to"), (4, "old", "c0", "has_change"), (4, "c0", "new", "modifies"), (4, "old", "c1", "has_change"), (4, "c1", "new", "modifies"), (4, "old", "c2", "has_change"), (4, "c2", "new", "modifies"),
    ],
)
def evolution_edges(spark: SparkSession, d: str) -> DataFrame:
    return evolution.evolution(cases(spark, d, _CHANGED, _CHANGE))[1]


_ATTRS = "graph_id long, node_id string, type string, name string, attrs map<string,string>"


@answers("graph_id bigint, src varchar, dst varchar, type varchar", [(1, "old_f", "new_f", "evolves_to"), (1, "old_f", "new_f", "return_type_changed"), (1, "old_s", "new_e", "type_evolves"), (1, "old_p", "new_p", "param_preserved"), (1, "old_q", "new_q", "param_type_changed")], of=2)
def structure_edges(spark: SparkSession, d: str) -> DataFrame:
    of = lambda **x: {"function": "f$1", **x}
    old = cases(spark, d, [(1, "f", "function_def", "f$1", {"return_type": "u8"}), (1, "s", "struct_def", "S", {}), (1, "p", "param", "a", of(param_type="u8")), (1, "q", "param", "b", of(param_type="u8")), (2, "f", "function_def", "f$1", {})], _ATTRS, of=2)
    new = cases(spark, d, [(1, "f", "function_def", "f$1", {"return_type": "u9"}), (1, "e", "enum_def", "S", {}), (1, "p", "param", "a", of(param_type="u8")), (1, "q", "param", "b", of(param_type="i8"))], _ATTRS, of=2)
    return evolution.structure_edges(old, new)
