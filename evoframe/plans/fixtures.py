"""Registered queries over cases of code and change records that stand in the documents' words, and over derived values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.functions import code, similarity
from evoframe.operators import rollup

from .literals import _rows, answers, cases
from .literals import ORACLE as _ANSWERS
from .literals import QUERIES as _CASES
from .queries import ORACLE as _ALL
from .queries import QUERIES as _OTHERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PYTHON_SIGNATURES = ["async def f_$1(self, a: dict[str, int] = {}, *args, **kw) -> bool:", "def g_$1(x: int, /, y: str = \"a,b\", *, z=None) -> list[tuple[int, str]]", "f(a, $1, ...)", "f(...)", "h(x) — returns the $1 text", ""]
RUST_SIGNATURES = ["pub struct S$1<T>", "unsafe impl<T> A$1<T> for B<T> where T: C + Send", "pub const fn g$1(&mut self) -> Option<u8>", "pub fn parse$1<T: Into<String>, F>(input: &str, f: F) -> Result<T, E> where F: Fn(&str) -> T", "enum Kind$1<'a> { A, B }", "pub const MAX$1: usize = 3;", "type Pair$1<T> = (T, T);"]
RESPONSES = [
    ("python", "Here:\n```python\nimport os\n\ndef f(x):\n    return os.path.join(x, '$1')\n```\nDone."),
    ("python", "def g(a):\n    return a.removeprefix('$1')\n"),
    ("rust", "```rust\nuse std::fs;\nuse tokio_util::io::{self, Reader};\n\npub fn read(p: &str) -> String { // $1\n    fs::read_to_string(p).unwrap()\n}\n```\n```\nshort\n```"),
    ("rust", "fn main() { println!(\"$1\"); }"),
    ("rust", ""),
]
RECORDS = [
    (1, "pkg.load", "pkg", "signature", "def load(path: str, mode: str = 'r', *, strict: bool = False) -> dict", "def load(path, flag: int) -> list", "import pkg\n\ndef read(path):\n    return pkg.load(path, mode='r')\n"),
    (2, "removeprefix", "str", "stabilized", "def removeprefix(prefix: str) -> str", "", "def cut(s):\n    return s.removeprefix('a')\n"),
    (3, "old_call", "pkg", "deprecated", "old_call(x): use `new_call` instead", None, "def f(x):\n    return old_call(x)\n"),
    (4, "sum", "math", "implicit", "sum(x) — now skips null values", None, "broken(:\n  sum(1)"),
    (5, "x", None, None, None, None, None),
]


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_RECORD = "graph_id long, name string, module string, change_type string, signature string, old_signature string, code string"


def records(spark: SparkSession, d: str | None = None) -> DataFrame:
    """The change records, or one of them for each document."""
    return cases(spark, d, RECORDS, _RECORD) if d else spark.createDataFrame(RECORDS, _RECORD)


_V = "case event_id % 5 when 0 then '1.' || event_id % 130 || '.3' when 1 then '0.' || event_id % 7 || '.1' when 2 then '' when 3 then '1.x.' || event_id else '1.' || event_id % 99 end"


@query(f"select event_id, v, case when not regexp_matches(v, '^1\\.[0-9]{{1,2}}(\\.|$)') then '1.84.0' else '1.' || least(greatest(split_part(v, '.', 2)::int, 71), 91) || '.0' end as version, starts_with(v, '0.') as is_crate from (select event_id, {_V} as v from events)")
def rust_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{_V} as v")
    return rows.select("event_id", "v", code.rust_version(F.col("v")).alias("version"), code.is_crate_version(F.col("v")).alias("is_crate"))


_O = "case event_id % 5 when 0 then event_id % 9 || ' passed, ' || event_id % 4 || ' failed in 0.1s' when 1 then 'test result: FAILED. ' || event_id % 30 || ' passed; ' || event_id % 3 || ' failed; 0 ignored' when 2 then '' when 3 then event_id || ' passed, ' || event_id % 6 || ' errors in 1s' else 'no tests ran' end"
_N = "coalesce(nullif(regexp_extract(v, '([0-9]+) {w}', 1), '')::int, 0)"
_LIB = "coalesce(nullif(regexp_extract(v, 'test result:.*?([0-9]+) passed; ([0-9]+) failed', {i}), '')::int, 0)"


@query(f"select event_id, {_N.format(w='passed')} as py_passed, {_N.format(w='passed')} + {_N.format(w='failed')} + {_N.format(w='error')} as py_total, {_LIB.format(i=1)} as rust_passed, {_LIB.format(i=1)} + {_LIB.format(i=2)} as rust_total from (select event_id, {_O} as v from events)")
def output_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{_O} as v").select("event_id", code.pytest_counts(F.col("v")).alias("p"), code.libtest_counts(F.col("v")).alias("r"))
    return rows.select("event_id", F.col("p.passed").alias("py_passed"), F.col("p.total").alias("py_total"), F.col("r.passed").alias("rust_passed"), F.col("r.total").alias("rust_total"))


_GRID = "l_orderkey % 11 as n, l_partkey % 12 as c, l_linenumber % 5 + 1 as k"


@query(f"select n, c, k, count(*) as rows, round(case when n = 0 or c = 0 then 0.0 when c > n or n - c < k then 1.0 else 1 - list_reduce(list_prepend(1.0::double, list_transform(range(n - c + 1, n + 1), lambda i: 1 - k::double / i)), lambda x, y: x * y) end, 6) as p from (select {_GRID} from lineitem) group by n, c, k")
def pass_at_k_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*_GRID.split(", ")).groupBy("n", "c", "k").agg(F.count(F.lit(1)).alias("rows"))
    return grid.select("n", "c", "k", "rows", F.round(rollup.pass_at_k(F.col("n"), F.col("c"), F.col("k")), 6).alias("p"))


_PLAIN = '"var_positional":false,"var_keyword":false'


@answers(
    "i bigint, clean varchar, behaviour varchar, parsed varchar",
    [
        (0, PYTHON_SIGNATURES[0], "", f'{{"name":"f_$1","async_":true,"params":[{{"name":"self",{_PLAIN}}},{{"name":"a","type":"dict[str, int]","default":"{{}}",{_PLAIN}}},{{"name":"args","var_positional":true,"var_keyword":false}},{{"name":"kw","var_positional":false,"var_keyword":true}}],"return_type":"bool","is_method":true}}'),
        (1, PYTHON_SIGNATURES[1], "", f'{{"name":"g_$1","async_":false,"params":[{{"name":"x","type":"int",{_PLAIN}}},{{"name":"y","type":"str","default":"\\"a",{_PLAIN}}},{{"name":"b\\"",{_PLAIN}}},{{"name":"z","default":"None",{_PLAIN}}}],"return_type":"list[tuple[int, str]]","is_method":false}}'),
        (2, "f(a, $1)", "", f'{{"name":"","async_":false,"params":[{{"name":"a",{_PLAIN}}},{{"name":"$1",{_PLAIN}}}],"is_method":false}}'),
        (3, "f()", "", '{"name":"","async_":false,"params":[],"is_method":false}'),
        (4, PYTHON_SIGNATURES[4], "returns the $1 text", f'{{"name":"","async_":false,"params":[{{"name":"x",{_PLAIN}}}],"is_method":false}}'),
        (5, "", "", '{"name":"","async_":false,"params":[],"is_method":false}'),
    ],
)
def python_signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, PYTHON_SIGNATURES, "v string").select("i", code.clean_signature(F.col("v")).alias("clean"), code.behaviour(F.col("v")).alias("behaviour"), code.parse_python_signature(F.col("v")).alias("s"))
    return rows.select("i", "clean", "behaviour", F.to_json("s").alias("parsed"))


@answers(
    "i bigint, parsed varchar",
    [
        (0, '{"kind":"struct","name":"S$1","visibility":"pub","modifiers":[],"generics":["T"],"params":[],"where":[]}'),
        (1, '{"kind":"impl","name":"B<T>","modifiers":["unsafe"],"generics":["T"],"params":[],"where":[{"type_param":"T","bounds":["C","Send"]}],"impl_trait":"A$1<T>","impl_for":"B<T>"}'),
        (2, '{"kind":"fn","name":"g$1","visibility":"pub","modifiers":["const"],"generics":[],"params":[],"self_kind":"&mut self","return_type":"Option<u8>","where":[]}'),
        (3, '{"kind":"fn","name":"parse$1","visibility":"pub","modifiers":[],"generics":["T: Into<String>","F"],"params":[{"name":"input","type":"&str"},{"name":"f","type":"F"}],"return_type":"Result<T, E>","where":[{"type_param":"F","bounds":["Fn(&str) -> T"]}]}'),
        (4, '{"kind":"enum","name":"Kind$1","modifiers":[],"generics":["\'a"],"params":[],"where":[]}'),
        (5, '{"kind":"const","name":"MAX$1","visibility":"pub","modifiers":[],"generics":[],"params":[],"where":[]}'),
        (6, '{"kind":"type_alias","name":"Pair$1","modifiers":[],"generics":["T"],"params":[],"where":[]}'),
    ],
)
def rust_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, RUST_SIGNATURES, "v string").select("i", F.to_json(code.parse_rust_signature(F.col("v"))).alias("parsed"))


@answers(
    "i bigint, language varchar, found varchar, too_short boolean, crates varchar, uses varchar",
    [
        (0, "python", "import os\n\ndef f(x):\n    return os.path.join(x, '$1')", False, "", ""), (1, "python", "def g(a):\n    return a.removeprefix('$1')", False, "", ""),
        (2, "rust", "use std::fs;\nuse tokio_util::io::{self, Reader};\n\npub fn read(p: &str) -> String { // $1\n    fs::read_to_string(p).unwrap()\n}", False, "tokio-util", "std::fs,tokio_util::io::self,tokio_util::io::Reader"),
        (3, "rust", 'fn main() { println!("$1"); }', False, "", ""), (4, "rust", "", True, "", ""),
    ],
)
def code_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, RESPONSES, "language string, response string")
    found = F.when(F.col("language") == "rust", code.rust_code(F.col("response"))).otherwise(code.python_code(F.col("response")))
    rows = rows.select("i", "language", found.alias("found"))
    return rows.select("i", "language", "found", code.too_short(F.col("found")).alias("too_short"), F.array_join(code.crate_names(F.col("found")), ",").alias("crates"), F.array_join(code.use_imports(F.col("found")), ",").alias("uses"))


@answers("i bigint, py_signature boolean, rust_signature boolean, py_api boolean, rust_api boolean", [(0, True, False, False, False), (1, False, False, True, False), (2, False, True, False, True), (3, False, False, False, False), (4, False, False, False, False)])
def usage_check(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, RESPONSES, "language string, response string")
    none = F.lit("")
    return rows.select("i", code.has_python_signature(F.col("response"), F.lit("def f(x)")).alias("py_signature"), code.has_rust_signature(F.col("response"), F.lit("pub fn read(p: &str)")).alias("rust_signature"), code.uses_python_api(F.col("response"), F.lit("str.removeprefix"), none).alias("py_api"), code.uses_rust_api(F.col("response"), F.lit("read_to_string"), none, F.lit("std::fs"), none).alias("rust_api"))


@answers("i bigint, bleu double, ngram double, syntax double, flow double, code_bleu double", [(0, 67.0342, 70.2473, 100.0, 0.0, 59.3204), (1, 100.0, 75.0, 100.0, 100.0, 93.75), (2, 0.0, 0.0, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 100.0, 0.0, 25.0)])
def code_similarity(spark: SparkSession, d: str) -> DataFrame:
    pairs = [("def f_$1(x):\n    y = x + 1\n    return y\n", "def f_$1(x):\n    z = x + 1\n    return z\n"), ("v_$1 = 1", "v_$1 = 1"), ("not python (", "x = 1"), ("", "")]
    made = similarity.code_bleu(_rows(spark, d, pairs, "a string, b string"), "a", "b")
    return made.select("i", *[F.round(c, 4).alias(c) for c in ("bleu", "ngram", "syntax", "flow", "code_bleu")])


_ASKED = "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n{q}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "<|im_start|>user\n{q}<|im_end|>\n<|im_start|>assistant\n"


def _projected(row: tuple) -> tuple:
    """What a record is projected to: its path, its name in two chat templates, a prompt and its signature."""
    i, name, module, _, signature, *_ = row
    path = name if "." in name or not module else f"{module}.{name}"
    prompt = "\n".join(x for x in (f"Write python code.\n{name}", f"Use: {module}" if module else "", f"Signature: {signature}" if signature else "") if x)
    return i, path, *(t.format(q=name) for t in _ASKED), prompt, signature


@answers("graph_id bigint, path varchar, llama varchar, qwen varchar, prompt varchar, signature varchar", [_projected(r) for r in RECORDS])
def sample_project(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    return rows.select("graph_id", code.api_path(F.col("name"), F.col("module")).alias("path"), code.chat(F.lit("Llama-3"), F.col("name")).alias("llama"), code.chat(F.lit("Qwen2"), F.col("name")).alias("qwen"), code.code_prompt(F.col("name"), F.col("signature"), F.col("module")).alias("prompt"), code.usable_signature(F.col("signature")).alias("signature"))


_OLD = "case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then null else o_orderpriority end"
_NEW = "case when o_orderkey % 3 = 0 then o_orderpriority else o_orderstatus end"


@query(f"""with r as (select o_orderstatus as change_type, {_OLD} as a, {_NEW} as b, case when o_custkey % 2 = 0 then o_orderpriority end as c from orders)
 select change_type, count(*) as n, count(*) filter (coalesce(a, '') <> '') as has_old_source, count(*) filter (coalesce(a, '') <> '' and coalesce(a, '') <> coalesce(b, '')) as has_source_diff, count(*) filter (coalesce(c, '') <> '') as has_replacement from r group by 1""")
def change_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderstatus as change_type", f"{_OLD} as old_source_code", f"{_NEW} as source_code", "if(o_custkey % 2 = 0, o_orderpriority, null) as replacement_api")
    return rollup.coverage_of_changes(rows)


QUERIES |= _CASES
ORACLE |= _ANSWERS
assert not set(QUERIES) & set(_OTHERS) and not set(ORACLE) & set(_ALL)
