"""Whole graphs of Python API changes: the code that calls the API, what changed, and what binds them.

Records are (graph_id, name, module, change_type, from_version, to_version, signature, old_signature, code,
function_signature, description, documentation); columns that lack are empty. Code is read by a table function joined
laterally, signatures in one Arrow pass; what changed is an expression over one record, and all binding is joins by graph.
Change lists sort by kind and name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions import python_usage
from evoframe.functions.code import balanced, clean_signature, parse_python_signature, usable_signature
from evoframe.sources.stored import stored

from .evolution import Graph, _edge, _joined, _node, _text
from .graph import G, drop_empty, endpoints_kept, first_match, prune

TEXTS = ("name", "module", "change_type", "from_version", "to_version", "signature", "old_signature", "code", "function_signature", "description", "documentation")
# How a text names a replacement, and calls that name none.
REPLACED_BY = r"(?i)(?:use|replaced\s+by|replaced\s+with|instead\s+use)\s+[`\"']?(\w[\w.]*)[`\"']?"
BUILTINS = ("list", "dict", "tuple", "set", "str", "int", "float")
MOST_SUMMARY, BEHAVIOUR = 5, 120
CHANGE = "struct<kind: string, name: string, old_type: string, new_type: string, old: string, new: string>"


def _bare(params: Column) -> Column:
    return F.filter(params, lambda p: ~p["name"].isin("self", "cls"))


def _names(params: Column) -> Column:
    return F.transform(params, lambda p: p["name"])


def _change(kind: str, **parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *[parts.get(c, F.lit(None)).cast("string").alias(c) for c in ("name", "old_type", "new_type", "old", "new")])


def changes(old: Column, new: Column) -> Column:
    """array<struct>: what two parsed signatures have not in common: parameters removed, added and retyped, and the result."""
    a, b = _bare(old["params"]), _bare(new["params"])
    sorted_by_name = lambda rows: F.array_sort(F.transform(rows, lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"))))
    lone = lambda x, y: sorted_by_name(F.filter(x, lambda p: ~F.array_contains(_names(y), p["name"])))
    of = lambda rows, name: F.try_element_at(F.filter(rows, lambda p: p["name"] == name), F.lit(1))["type"]
    both = F.filter(F.array_sort(F.array_intersect(_names(a), _names(b))), lambda n: ~of(a, n).eqNullSafe(of(b, n)))
    result = F.when(~old["return_type"].eqNullSafe(new["return_type"]), F.array(_change("return_type_changed", old=old["return_type"], new=new["return_type"])))
    return F.concat(
        F.transform(lone(a, b), lambda p: _change("param_removed", name=p["name"], old_type=p["type"])),
        F.transform(lone(b, a), lambda p: _change("param_added", name=p["name"], new_type=p["type"])),
        F.transform(both, lambda n: _change("param_type_changed", name=n, old_type=of(a, n), new_type=of(b, n))),
        F.coalesce(result, F.array().cast(f"array<{CHANGE}>")),
    )


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _before(c: Column, *marks: str) -> Column:
    for m in marks:
        c = F.substring_index(c, m, 1)
    return c


def _as_def(call: Column, *others: str) -> Column:
    """A call as the beginning of a definition, unless it is one."""
    known = call.startswith("def ") | call.startswith("async def ")
    for o in others:
        known = known | call.startswith(o)
    return F.when(known | (call == ""), call).otherwise(F.concat(F.lit("def "), call))


def first_call(texts: Column) -> Column:
    """A text up to the bracket that closes the first one."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if (inside := balanced(t, 0, "(", ")")) is None else t[: t.find("(") + len(inside) + 2].strip())

    return F.pandas_udf(run, "string")(texts)


def replacement(signature: Column, *told: Column) -> Column:
    """What replaces a deprecated API: as the texts say, in their order, else as the new signature imports or calls; null if
    nothing does."""
    said = [F.nullif(F.regexp_extract(t, REPLACED_BY, 1), F.lit("")) for t in told]
    s = _stripped(signature)
    module, name, whole = (F.regexp_extract(s, r"^from\s+([\w.]+)\s+import\s+(\w+)", 1), F.regexp_extract(s, r"^from\s+([\w.]+)\s+import\s+(\w+)", 2), F.regexp_extract(s, r"^import\s+([\w.]+)", 1))
    called = F.regexp_replace(F.regexp_extract(s, r"^(\w[\w.]*)\s*[(\s]", 1), r"^\.+|\.+$", "")
    call = F.when((called != "") & ~called.isin(*BUILTINS), called)
    return F.coalesce(*said, F.when(name != "", F.concat(module, F.lit("."), name)).when(whole != "", whole).otherwise(call))


def signature_summary(signature: Column) -> Column:
    """The first names in the brackets that end a signature, in brackets."""
    inside = _stripped(F.regexp_extract(clean_signature(_before(signature, " — ", " - ")), r"\(([^)]*)\)\s*$", 1))
    names = F.transform(F.split(inside, ","), lambda p: F.trim(F.regexp_replace(F.trim(_before(p, ":", "=")), r"^\*+", "")))
    kept = F.filter(names, lambda n: ~n.isin("", "self", "cls", "..."))
    return F.when(F.size(kept) > 0, F.concat(F.lit("("), F.array_join(F.slice(kept, 1, MOST_SUMMARY), ", "), F.lit(")"))).otherwise("")


def _signed(df: DataFrame, role: str, api: Column, parsed: Column, otherwise: Column) -> DataFrame:
    """The node of a signature, with its parameters as JSON."""
    return _node(df, f"{role}_signature", f"{role}_signature", {"old": 2, "new": 3}[role], F.coalesce(F.nullif(parsed["name"], F.lit("")), otherwise), api=api, params=F.to_json(parsed["params"]), return_type=parsed["return_type"], role=role)


def _state(df: DataFrame, role: str, api: Column, **attrs: Column | str) -> DataFrame:
    return _node(df, f"evo_{role}", "api", {"old": 0, "new": 1}[role], None, api=api, role=role, **attrs)


def signature(df: DataFrame) -> Graph:
    """Two signatures and one node with the list of what changed between them."""
    df = df.where("old_signature <> '' or signature <> ''").withColumns({"was": clean_signature(F.col("old_signature")), "now": clean_signature(F.col("signature")), "changes": changes(F.col("old"), F.col("new"))})
    had, has, both = df.where("was <> ''"), df.where("now <> ''"), df.where("was <> '' and now <> ''")
    changed = df.where(F.size("changes") > 0)
    note = _node(changed, "evo_sig_change", "change", 4, None, api=F.col("name"), kind="signature", changes=F.to_json("changes"))
    told = lambda rows, dst: _edge(rows.where(F.size("changes") > 0), "evo_sig_change", dst, "has_change")
    nodes = [_signed(had, "old", F.col("name"), F.col("old"), F.col("short")), _signed(has, "new", F.col("name"), F.col("new"), F.col("short")), note]
    return _joined(nodes), _joined([_edge(both, "old_signature", "new_signature", "evolves"), told(had, "old_signature"), told(has, "new_signature")])


def stabilized(df: DataFrame) -> Graph:
    """From experimental in one version to stable in another."""
    summary = signature_summary(F.col("signature"))
    state = lambda role, version, status: _state(df, role, F.col("name"), version=F.col(version), status=status, signature_summary=summary)
    return _joined([state("old", "from_version", "unstable/experimental"), state("new", "to_version", "stable")]), _edge(df, "evo_old", "evo_new", "evolves")


def deprecated(df: DataFrame) -> Graph:
    """From a deprecated API to what replaces it, else to its new signature, with the signatures of both."""
    df = df.withColumn("by", replacement(F.col("signature"), F.col("description"), F.col("documentation")))
    named = df.where("by is not null")
    other = df.where("signature <> '' and signature <> old_signature")
    unnamed = other.where("by is null")
    had = df.where("old_signature <> ''")
    nodes = [_state(df, "old", F.col("name"), status="deprecated"), _state(named, "new", F.col("by"), status="active"), _state(unnamed, "new", F.col("name"), status="new"), _signed(had, "old", F.col("name"), F.col("old"), F.col("short"))]
    nodes.append(_signed(other, "new", F.coalesce("by", "name"), F.col("call"), F.coalesce(F.nullif(F.substring_index("by", ".", -1), F.lit("")), F.col("short"))))
    owner = F.when(F.col("by").isNotNull(), "evo_new").otherwise("evo_old")
    edges = [_edge(named, "evo_old", "evo_new", "deprecated_via"), _edge(unnamed, "evo_old", "evo_new", "recommends"), _edge(had, "evo_old", "old_signature", "has_change"), _edge(other, owner, "new_signature", "defines_current")]
    return _joined(nodes), _joined(edges)


def implicit(df: DataFrame) -> Graph:
    """From one behaviour to another, as the signatures say after a dash; the new one's signature."""
    told = lambda c: F.substring(_stripped(F.coalesce(F.try_element_at(F.split(c, " — "), F.lit(2)), F.lit(""))), 1, BEHAVIOUR)
    state = lambda role, version, c: _state(df, role, F.col("name"), version=F.col(version), status="behavior", behavior_desc=told(F.col(c)))
    some = df.where("plain <> ''")
    nodes = [state("old", "from_version", "old_signature"), state("new", "to_version", "signature"), _signed(some, "new", F.col("name"), F.col("call"), F.col("short"))]
    return _joined(nodes), _joined([_edge(df, "evo_old", "evo_new", "evolves"), _edge(some, "evo_new", "new_signature", "defines_current")])


def _prepared(records: DataFrame) -> DataFrame:
    """Records with all texts, their kind of change, and the signatures parsed."""
    lacking = {c: F.lit("") for c in TEXTS if c not in records.columns}
    df = records.withColumns(lacking).select(G, *[_text(c).alias(c) for c in TEXTS])
    kind = F.when(F.col("change_type").isin("stabilized", "deprecated", "implicit"), F.col("change_type")).otherwise("signature")
    plain = clean_signature(_stripped(_before(F.col("signature"), " — ", " - ")))
    call = first_call(_stripped(F.regexp_replace(_stripped(_before(F.col("signature"), " — ")), r"(?m)\s*#.*$", "")))
    df = df.withColumns({"kind": kind, "short": F.substring_index("name", ".", -1), "plain": plain, "spoken": F.when(kind == "implicit", _as_def(plain)).when(kind == "deprecated", _as_def(call, "from ", "import ")).otherwise("")})
    parsed = {"old": "old_signature", "new": "signature", "call": "spoken"}
    df = df.withColumns({k: parse_python_signature(F.col(c)) for k, c in parsed.items()})
    usable = _text("usable")
    return df.withColumn("usable", usable_signature(F.col("function_signature"))).withColumn("own", parse_python_signature(usable))


def evolution(records: DataFrame) -> Graph:
    """The sub-graph of each prepared record by its kind of change."""
    made = [build(records.where(F.col("kind") == build.__name__)) for build in (signature, stabilized, deprecated, implicit)]
    return _joined([n for n, _ in made]), _joined([e for _, e in made])


def usage_graph(records: DataFrame) -> Graph:
    """Functions, calls and arguments of the records' code (graph_id, code, name); the first node of an id counts."""
    outer = lambda c: F.col(c).outer()
    rows = records.select(G, "code", F.col("name").alias("api")).lateralJoin(python_usage.usage(outer("code"), outer("api"))).drop("code", "api")
    rows = stored(rows, "parsed")
    first = F.row_number().over(Window.partitionBy(G, "id").orderBy("pos"))
    nodes = rows.where("kind = 'node'").withColumn("r", first).where("r = 1").select(G, F.col("id").alias("node_id"), "type", "name", F.col("pos").cast("long").alias("pos"), "attrs")
    return nodes, rows.where("kind = 'edge'").select(G, F.col("id").alias("src"), "dst", "type")


def build(records: DataFrame, k: int = 3) -> Graph:
    """(nodes, edges) of the records' graphs, cut to k hops around the API and its calls."""
    df = stored(_prepared(records), "records")
    anchor = _node(df, "api", "api_updated", -1, F.col("name"), **{c: F.col(c) for c in ("module", "change_type", "from_version", "to_version")})
    code, code_edges = usage_graph(df)
    first = code.where("type = 'code_function'").groupBy(G).agg(F.min_by("node_id", "pos").alias("node_id"))
    edges = [code_edges, _edge(first, F.col("node_id"), "api", "implements_query"), _edge(code.where("type = 'code_api_call'"), F.col("node_id"), "api", "calls")]

    evolved, evolved_edges = evolution(df)
    evolved = stored(evolved, "evolved")
    role = F.try_element_at("attrs", F.lit("role"))
    defines = F.when(role == "new", "defines_current").otherwise("defines_previous")
    edges += [evolved_edges, _edge(evolved.where(role.isin("old", "new")), "api", F.col("node_id"), defines)]

    own = df.select(G, F.posexplode("own.params").alias("at", "p")).select(G, "at", "p.*").where("name not in ('self', 'cls')")
    params = stored(_node(own, F.concat(F.lit("func_param_"), "name"), "func_param", F.col("at"), F.col("name"), annotation=F.col("type"), default=F.col("default")), "params")
    result = _node(df.where("own.return_type <> ''"), "func_return", "func_return", 0, annotation=F.col("own.return_type"))
    edges += [_edge(params, "api", F.col("node_id"), "constrains_param"), _edge(result, "api", "func_return", "constrains_return")]
    named = params.select(G, "name", F.col("node_id").alias("src"))
    taken = code.where("type = 'code_param'").select(G, "name", F.col("node_id").alias("dst"), "pos")
    given = code.where("type = 'code_call_arg' and name is not null").select(G, "name", F.col("node_id").alias("dst"))
    bound = first_match(named, taken, [G, "name"], ["pos"], ["src"]).select(G, "src", "dst").unionByName(named.join(given, [G, "name"]).select(G, "src", "dst"))
    shape = "array<struct<name: string>>"
    newer = evolved.where("node_id = 'new_signature'").select(G, F.explode(F.from_json(F.try_element_at("attrs", F.lit("params")), shape)).alias("p")).select(G, "p.name").where("name not in ('self', 'cls', '...')")
    edges += [_edge(bound, F.col("src"), F.col("dst"), "constrains_arg"), _edge(newer.join(named, [G, "name"]), "new_signature", F.col("src"), "sig_param_matches")]

    nodes = stored(_joined([anchor, code, evolved, params, result]).dropDuplicates([G, "node_id"]), "nodes")
    edges = stored(endpoints_kept(_joined(edges).dropDuplicates([G, "src", "dst", "type"]), nodes), "edges")
    seeds = nodes.where("type in ('code_api_call', 'api_updated')").select(G, "node_id")
    always = F.col("type").startswith("evo_") | F.col("type").startswith("func_") | F.col("type").isin("old_signature", "new_signature", "api_updated") | (F.col("type") == "api") & role.isin("old", "new")
    nodes, edges = prune(nodes, edges, seeds, k, always, keep_unseeded=True)
    return nodes.withColumn("attrs", drop_empty(F.col("attrs"))), edges
