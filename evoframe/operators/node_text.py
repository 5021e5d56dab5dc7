"""What a graph's node says: one text per node type, from the columns node_id, type, name and the map attrs.

Lists among the attributes are JSON texts. The wordings are fixed values of the graphs' contract. A null text means that
the node is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import G

_PARAMS = "array<struct<name: string, type: string>>"
_CHANGES = "array<struct<kind: string, name: string, old_type: string, old: string, new_type: string, new: string>>"


def _a(name: str) -> Column:
    """An attribute, '' where there is none."""
    return F.coalesce(F.col("name") if name == "name" else F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _if(value: Column, *parts: Column | str) -> Column:
    """The parts, joined, if the value is not empty, else ''."""
    return F.when(value != "", _cat(*parts)).otherwise("")


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _first(*values: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _true(name: str) -> Column:
    return F.lower(_a(name)) == "true"


def _list(name: str, kind: str = "array<string>") -> Column:
    return F.coalesce(F.from_json(_a(name), kind), F.array().cast(kind))


def _role() -> Column:
    """The role of a node of a state: old and new stand out."""
    return F.when(_a("role").isin("old", "new"), _cat(" 【", F.upper(_a("role")), "】")).otherwise(_tag())


def _tag() -> Column:
    return _if(_a("role"), " [", _a("role"), "]")


def _in_role(*parts: Column | str) -> Column:
    return _cat(*parts, " [", _a("role"), "]")


def _versions(before: str = "", mark: str = "→", after: str = "") -> Column:
    return F.when((_a("from_version") != "") & (_a("to_version") != ""), _cat(" ", before, _a("from_version"), mark, after, _a("to_version"))).otherwise("")


def _changed() -> Column:
    """What a change node says of its values, or else of its parameter."""
    param = _first(_a("param"), _a("params"))
    return F.when((_a("old") != "") & (_a("new") != ""), _cat(" [", _a("old"), "→", _a("new"), "]")).otherwise(_if(param, " [param: ", param, "]"))


def _cut(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def _by_type(texts: dict[str, Column], other: Column) -> Column:
    said = F.lit(None).cast("string")
    for kind, text in texts.items():
        said = F.when(F.col("type") == kind, text).otherwise(said)
    return F.when(F.col("type").isin(*texts), said).otherwise(other)


def rust_text() -> Column:
    """Texts of the nodes of Rust graphs."""
    params = _list("params", _PARAMS)
    shown = F.array_join(F.transform(F.slice(params, 1, 3), lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit(": "), F.coalesce(p["type"], F.lit("")))), ", ")
    modifiers = F.array_compact(F.array(F.nullif(_a("visibility"), F.lit("")), *[F.when(_true(f"is_{m}"), m) for m in ("const", "unsafe", "async")]))
    function = _cat(_if(_a("visibility"), _a("visibility"), " "), "fn ", _a("name"), _if(_a("generics"), "<", _a("generics"), ">"), "(", _a("params"), ")", _if(_a("return_type"), " -> ", _a("return_type")))
    status = F.when((_a("from_status") != "") & (_a("to_status") != ""), _cat(" (", _a("from_status"), "→", _a("to_status"), ")")).otherwise("")
    detail = F.concat_ws(", ", F.when(_a("reason") != "", _cat("reason: ", _cut(_a("reason"), 100))), F.when(_a("migration_complexity") != "", _cat("migration: ", _a("migration_complexity"))))
    kind = _first(_a("kind"), F.lit("transition"))
    returned = _if(_a("return_kind"), "[", _a("return_kind"), "] ")
    texts = {
        "api_updated": _cat("⭐ANCHOR: ", _if(_a("module"), _a("module"), "::"), _a("name"), " [", _a("change_type"), "]", _versions()),
        "code_function": F.when(_a("context") != "", _cat(function, " {", _cut(_a("context"), 100), "...")).otherwise(function),
        "code_param": _cat(_if(_a("function"), _a("function"), "::"), _a("name"), ": ", _a("param_type")),
        "code_api_call": F.when(_a("context") != "", _cut(_a("context"), 150)).otherwise(_cat(F.when((_a("call_type") == "method_call") & (_a("receiver") != ""), _cat(_a("receiver"), ".")).otherwise(""), _a("api"), "(...)")),
        "code_call_arg": _cat("arg", _a("position"), ": ", _a("value")),
        "code_receiver": _cat("receiver: ", _a("name")),
        "code_return": _cat(returned, "return", F.when(_a("context") != "", _cat(" ", _cut(_a("context"), 100))).otherwise(_if(_a("value"), " ", _a("value")))),
        "code_import": _cat("use ", _a("path")),
        "code_variable": _cat("let ", F.when(_true("is_mut"), "mut ").otherwise(""), _a("name"), _if(_a("var_type"), ": ", _a("var_type")), " = ", _a("init_value")),
        "func_param": _cat("param ", _a("name"), ": ", _a("param_type")),
        "func_return": _cat("returns ", _a("return_type")),
        "function_def": _in_role("fn ", _a("name"), "() -> ", _a("return_type")),
        "param": _in_role(_a("name"), ": ", _a("param_type")),
        "method_call": _in_role(".", _a("name"), "()"),
        **{k: _in_role(f"{k.replace('_', ' ')} ", _a("name")) for k in ("struct_def", "enum_def", "trait_def", "type_alias")},
        "impl_block": _in_role("impl ", _if(_a("trait_impl"), _a("trait_impl"), " for "), _a("target_type")),
        "import_group": _in_role("imports: ", F.array_join(F.slice(_list("imports"), 1, 3), ", ")),
        "macro_call": _in_role(_a("name"), "!"),
        "api": _cat("api ", _a("name"), " (", _a("status"), ")", _if(_a("version"), " @v", _a("version")), _role()),
        "sig": _cat("sig ", F.when(F.size(modifiers) > 0, _cat(F.array_join(modifiers, " "), " ")).otherwise(""), "fn ", _a("api"), "(", shown, F.when(F.size(params) > 3, ", ...").otherwise(""), ")", _if(_a("return_type"), " -> ", _a("return_type")), _role()),
        "impl": _cat("impl ", _a("api"), _tag(), _if(_a("source_code"), ": ", _cut(F.element_at(F.split(_a("source_code"), "\n"), 1), 100))),
        "change": _cat("CHANGE: ", _a("kind"), status, _versions("v", "→v"), _changed()),
        "transition": _cat(kind, F.when(_true("is_breaking"), " [BREAKING]").otherwise(""), _if(detail, ": ", detail)),
        "dependencies": _cat("deps: ", F.array_join(F.slice(_list("items"), 1, 3), ", ")),
    }
    return _by_type(texts, _cat(F.col("type"), ": ", F.coalesce("name", "node_id")))


def python_text() -> Column:
    """Texts of the nodes of Python graphs; a function's parameters are in its column `shown` (see with_parameters)."""
    dotted = F.when(_a("name").contains(".") | (_a("module") == ""), _a("name")).otherwise(_cat(_a("module"), ".", _a("name")))
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    typed = lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.when(F.coalesce(p["type"], F.lit("")) != "", F.concat(F.lit(": "), p["type"])).otherwise(""))
    params = F.array_join(F.transform(F.filter(_list("params", _PARAMS), lambda p: ~F.coalesce(p["name"], F.lit("")).isin("self", "cls")), typed), ", ")
    value = _first(_a("value"), F.lit("?"))
    either = lambda c, x: F.coalesce(F.nullif(c[f"{x}_type"], F.lit("")), c[x], F.lit(""))
    pair = lambda c: F.when((either(c, "old") != "") | (either(c, "new") != ""), F.concat(F.lit(" ["), either(c, "old"), F.lit("→"), either(c, "new"), F.lit("]"))).otherwise("")
    one = lambda c: F.concat(F.coalesce(c["kind"], F.lit("")), F.when(F.coalesce(c["name"], F.lit("")) != "", F.concat(F.lit(":"), c["name"])).otherwise(""), pair(c))
    changes = _list("changes", _CHANGES)
    fname, api, about = _first(_a("name"), last(_a("api"))), _first(_a("api"), _a("name")), F.trim(_a("behavior_desc"))
    signature = F.when(fname != "", _cat("def ", fname, "(", params, ")", _if(_a("return_type"), " -> ", _a("return_type")), F.when(F.col("type") == "new_signature", " [NEW]").otherwise(" [OLD]")))
    texts = {
        "api_updated": _cat("⭐ANCHOR: ", dotted, " [", _a("change_type"), "]", _versions("v")),
        "code_function": _cat("def ", _a("name"), "(", F.coalesce("shown", F.lit("")), ")", _if(_a("return_annotation"), " -> ", _a("return_annotation"))),
        "code_param": _cat(_a("name"), _if(_a("annotation"), ": ", _a("annotation"))),
        "func_param": _cat("param ", _a("name"), _if(_a("annotation"), ": ", _a("annotation")), _if(_a("default"), "=", _a("default"))),
        "code_api_call": F.when(F.trim(_a("call_repr")) != "", F.trim(_a("call_repr"))).otherwise(_cat(last(_a("api")), "(...)")),
        "code_call_arg": F.when(_true("keyword"), _cat(_a("name"), "=", value)).otherwise(_cat("arg[", _a("position"), "]=", value)),
        "func_return": _cat("->", _if(_a("annotation"), " ", _a("annotation"))),
        "change": F.when(F.size(changes) > 0, _cat("Δ ", F.array_join(F.transform(changes, one), ", "))).when((_a("kind") != "") | (_changed() != ""), _cat("Δ ", _a("kind"), _changed())),
        "new_signature": signature, "old_signature": signature,
        "api": F.when(api != "", _cat("api ", api, " (", _a("status"), ")", _if(_a("version"), " @v", _a("version")), _if(about, ": ", _cut(about, 80)), _role())),
    }
    return _by_type(texts, _cat(F.col("type"), ": ", _first(_a("name"), _a("api"), F.col("node_id"))))


def with_parameters(nodes: DataFrame, edges: DataFrame, order: str = "pos") -> DataFrame:
    """nodes with `shown`: the parameters of a function, in the order of their edges."""
    params = nodes.where("type = 'code_param'").select(G, F.col("node_id").alias("dst"), F.concat(_a("name"), _if(_a("annotation"), ": ", _a("annotation"))).alias("said"), F.col(order).alias("at"))
    owned = edges.where("type = 'has_param'").select(G, "src", "dst").join(params, [G, "dst"]).groupBy(G, F.col("src").alias("node_id"))
    told = owned.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), ", ").alias("shown"))
    return nodes.join(told, [G, "node_id"], "left")


def meta_counts(nodes: DataFrame) -> DataFrame:
    """(graph_id, api, change, old, new, calls, functions, evolved): how many nodes of each sort a graph has."""
    t, role = F.col("type"), _a("role")
    return nodes.groupBy(G).agg(
        F.count_if(t == "api_updated").alias("api"), F.count_if(t.isin("change", "transition")).alias("change"), F.count_if(role == "old").alias("old"), F.count_if(role == "new").alias("new"),
        F.count_if(t == "code_api_call").alias("calls"), F.count_if(t == "code_function").alias("functions"), F.count_if(t.isin("old_signature", "new_signature") | (t == "api") & role.isin("old", "new")).alias("evolved"),
    )


def with_invocations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges, and each call of the API to the graph's API as `invokes`."""
    known = nodes.where("node_id = 'api'").select(G).distinct()
    calls = nodes.where("type = 'code_api_call'").join(known, G, "left_semi")
    return edges.select(G, "src", "dst", "type").unionByName(calls.select(G, F.col("node_id").alias("src"), F.lit("api").alias("dst"), F.lit("invokes").alias("type")))


def linked_signatures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges, and old signature to new signature as evolved_to in graphs that have both and no edge between them."""
    one = lambda kind, name: nodes.where(F.col("type") == kind).groupBy(G).agg(F.min("node_id").alias(name))
    both = one("old_signature", "src").join(one("new_signature", "dst"), G)
    known = edges.select(G, F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    extra = both.withColumns({"x": F.least("src", "dst"), "y": F.greatest("src", "dst")}).join(known, [G, "x", "y"], "left_anti")
    return edges.select(G, "src", "dst", "type").unionByName(extra.select(G, "src", "dst", F.lit("evolved_to").alias("type")))
