"""Whole graphs of literal Python records, one of each kind of change, worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from evoframe.functions import python_usage
from evoframe.operators import node_text, python_graph

RECORD = "graph_id long, name string, module string, change_type string, from_version string, to_version string, signature string, old_signature string, code string, function_signature string, description string, documentation string"
CODE = "import pkg\n\n@pkg.load\ndef read(path: str, *rest, mode=1) -> dict:\n    x = pkg.load(path, mode='r', **rest)\n    return [pkg.load(pkg.load(1)) for _ in x]\n\nclass A:\n    async def go(self):\n        return other(1)\n"
RECORDS = [
    (1, "pkg.load", "pkg", "signature", "1.0", "2.0", "def load(self, path: str, mode: str = 'r', ...) -> dict", "def load(self, path, flag: int) -> list", CODE, "def read(path: str, mode, other=2) -> dict:\n    pass", "", ""),
    (2, "pkg.load", "pkg", "stabilized", "1.0", "2.0", "pkg.load(path: str, *rest, mode='r', a, b, c, d) — now stable", None, "x = pkg.load(1)", "x = 1\ny = 2", None, None),
    (3, "pkg.load", "pkg", "deprecated", "1", "2", "fresh(a, b=(1, 2)) # or other()", "load(a)", "load(1)", None, "Old. Please use `pkg.sub.fresh` now", "replaced by no"),
    (4, "load", "", "deprecated", "", "", "from a.b import c", "x", "load(1)", "", "", "It was replaced  with 'new.one'."),
    (5, "load", "", "deprecated", "", "", "from a.b import c", "", "load(1)", "", None, None),
    (6, "load", "", "deprecated", "", "", "list(a)", "", "load(1)", "", None, None),
    (7, "m.sum", "m", "implicit", "1", "2", "sum(x, /, start=0) -> int — skips nulls now", "sum(x) — counts nulls", "def f(:\n  sum(1)\n  m.sum (2)", None, None, None),
    (8, "f", None, None, None, None, "def f(a)", "", "", None, None, None),
    (9, "f", None, "signature", None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def made(spark):
    nodes, edges = python_graph.build(spark.createDataFrame(RECORDS, RECORD))
    found, links = {}, {}
    for r in nodes.collect():
        assert r.node_id not in found.setdefault(r.graph_id, {})
        found[r.graph_id][r.node_id] = r
    for r in edges.collect():
        links.setdefault(r.graph_id, []).append((r.src, r.dst, r.type))
    assert all(len(v) == len(set(v)) for v in links.values())
    return found, {k: set(v) for k, v in links.items()}, nodes, edges


def test_usage():
    rows = list(python_usage.usage_rows(CODE, "pkg.load"))
    assert [r[1] for r in rows if r[0] == "node"] == ["code_function_read", "code_param_path", "code_api_call", "code_api_call_1", "code_call_arg_pos0", "code_call_arg_kw_mode", "code_call_arg_kw_**kwargs", "code_api_call_2", "code_call_arg_pos0_1", "code_api_call_3", "code_call_arg_pos0_2", "code_function_go", "code_param_self"]
    assert {(r[1], r[2], r[3]) for r in rows if r[0] == "edge"} == {
        ("code_function_read", "code_param_path", "has_param"), ("code_function_read", "code_api_call", "decorated_by"), ("code_function_read", "code_api_call_1", "calls"), ("code_api_call_1", "code_call_arg_pos0", "has_arg"), ("code_api_call_1", "code_call_arg_kw_mode", "has_kwarg"),
        ("code_api_call_1", "code_call_arg_kw_**kwargs", "has_kwarg"), ("code_function_read", "code_api_call_2", "calls"), ("code_function_read", "code_api_call_3", "calls"), ("code_api_call_2", "code_call_arg_pos0_1", "has_arg"), ("code_api_call_3", "code_call_arg_pos0_2", "has_arg"), ("code_function_go", "code_param_self", "has_param"),
    }
    assert [r[1] for r in python_usage.usage_rows("def f(:\n  sum(1)\n  m.sum (2)\n  summed(3)", "m.sum")] == ["code_function_f", "code_api_call_0", "code_api_call_1"]
    assert list(python_usage.usage_rows(None, None)) == [] and list(python_usage.usage_rows("f()", "")) == [] and [r[3] for r in python_usage.usage_rows("a().b.load(1)", "load")] == ["code_api_call", "code_call_arg", "has_arg"]


def test_signature(made):
    nodes, edges = made[0][1], made[1][1]
    listed = json.loads(nodes["evo_sig_change"].attrs["changes"])
    assert listed == [{"kind": "param_removed", "name": "flag", "old_type": "int"}, {"kind": "param_added", "name": "mode", "new_type": "str"}, {"kind": "param_type_changed", "name": "path", "new_type": "str"}, {"kind": "return_type_changed", "old": "list", "new": "dict"}]
    assert {k: v for k, v in nodes["evo_sig_change"].attrs.items() if k != "changes"} == {"api": "pkg.load", "kind": "signature"}
    assert nodes["new_signature"].name == "load" and [p["name"] for p in json.loads(nodes["new_signature"].attrs["params"])] == ["self", "path", "mode"] and nodes["old_signature"].attrs["return_type"] == "list"
    evolved = {("old_signature", "new_signature", "evolves"), ("evo_sig_change", "old_signature", "has_change"), ("evo_sig_change", "new_signature", "has_change"), ("api", "new_signature", "defines_current"), ("api", "old_signature", "defines_previous")}
    own = {("api", f"func_param_{p}", "constrains_param") for p in ("path", "mode", "other")} | {("api", "func_return", "constrains_return")}
    bound = {("func_param_path", "code_param_path", "constrains_arg"), ("func_param_mode", "code_call_arg_kw_mode", "constrains_arg"), ("new_signature", "func_param_path", "sig_param_matches"), ("new_signature", "func_param_mode", "sig_param_matches")}
    bridges = {("code_function_read", "api", "implements_query")} | {(c, "api", "calls") for c in ("code_api_call", "code_api_call_1", "code_api_call_2", "code_api_call_3")}
    inside = {(r[1], r[2], r[3]) for r in python_usage.usage_rows(CODE, "pkg.load") if r[0] == "edge" and r[1] != "code_function_go"}
    assert edges == evolved | own | bound | bridges | inside
    assert "code_function_go" not in nodes  # not near the API
    assert nodes["func_param_other"].attrs == {"default": "2"} and nodes["api"].attrs == {"module": "pkg", "change_type": "signature", "from_version": "1.0", "to_version": "2.0"}


def test_stabilized(made):
    nodes, edges = made[0][2], made[1][2]
    assert nodes["evo_old"].attrs == {"api": "pkg.load", "role": "old", "version": "1.0", "status": "unstable/experimental", "signature_summary": "(path, rest, mode, a, b)"}
    assert nodes["evo_new"].attrs["status"] == "stable" and nodes["evo_new"].type == "api"
    assert edges == {("evo_old", "evo_new", "evolves"), ("api", "evo_new", "defines_current"), ("api", "evo_old", "defines_previous"), ("code_api_call", "api", "calls"), ("code_api_call", "code_call_arg_pos0", "has_arg")}


def test_deprecated(made):
    nodes, edges = made[0], made[1]
    assert nodes[3]["evo_new"].attrs == {"api": "pkg.sub.fresh", "status": "active", "role": "new"} and nodes[3]["evo_old"].attrs == {"api": "pkg.load", "status": "deprecated", "role": "old"}
    assert nodes[3]["new_signature"].name == "fresh" and [(p["name"], p.get("default")) for p in json.loads(nodes[3]["new_signature"].attrs["params"])] == [("a", None), ("b", "(1, 2)")]
    call = {("code_api_call", "api", "calls"), ("code_api_call", "code_call_arg_pos0", "has_arg")}
    anchored = {("api", "evo_old", "defines_previous"), ("api", "evo_new", "defines_current"), ("api", "new_signature", "defines_current")}
    assert edges[3] == call | anchored | {("evo_old", "evo_new", "deprecated_via"), ("evo_old", "old_signature", "has_change"), ("evo_new", "new_signature", "defines_current"), ("api", "old_signature", "defines_previous")}
    assert [nodes[i]["evo_new"].attrs["api"] for i in (4, 5, 6)] == ["new.one", "a.b.c", "load"]
    assert nodes[6]["evo_new"].attrs["status"] == "new" and {("evo_old", "evo_new", "recommends"), ("evo_old", "new_signature", "defines_current")} <= edges[6]
    assert "params" not in nodes[5]["new_signature"].attrs and nodes[5]["new_signature"].name == "c"


def test_implicit(made):
    nodes, edges = made[0][7], made[1][7]
    assert nodes["evo_old"].attrs["behavior_desc"] == "counts nulls" and nodes["evo_new"].attrs["behavior_desc"] == "skips nulls now" and nodes["evo_new"].attrs["version"] == "2"
    assert [p["name"] for p in json.loads(nodes["new_signature"].attrs["params"])] == ["x", "start"] and nodes["new_signature"].attrs["return_type"] == "int"
    assert {("evo_old", "evo_new", "evolves"), ("evo_new", "new_signature", "defines_current"), ("code_api_call_0", "api", "calls"), ("code_api_call_1", "api", "calls"), ("code_function_f", "api", "implements_query")} <= edges


def test_others_and_texts(made):
    nodes, edges = made[0], made[1]
    assert json.loads(nodes[8]["evo_sig_change"].attrs["changes"]) == [{"kind": "param_added", "name": "a"}] and "old_signature" not in nodes[8]
    assert set(nodes[9]) == {"api"} and 9 not in edges
    said = {(r.graph_id, r.node_id): r.text for r in node_text.with_parameters(made[2], made[3]).withColumn("text", node_text.python_text()).collect()}
    assert said[1, "evo_sig_change"] == "Δ param_removed:flag [int→], param_added:mode [→str], param_type_changed:path [→str], return_type_changed [list→dict]"


def test_replacements(spark):
    cases = [("f(x)", "", "", "f"), ("a.b.f (x)", None, "", "a.b.f"), ("import x.y", "", "", "x.y"), ("dict(x)", "", "", None), ("", "", "", None), ("g()", "nothing said", "Instead use \"h.i\"", "h.i"), ("no call", "", "", "no"), ("f", "", "", None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, a string, b string, want string")
    got = rows.withColumn("got", python_graph.replacement(F.coalesce("s", F.lit("")), F.coalesce("a", F.lit("")), F.coalesce("b", F.lit("")))).orderBy("i").collect()
    assert [r.got for r in got] == [c[3] for c in cases]
