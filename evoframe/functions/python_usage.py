"""A Python code text around its calls of an API, as a table function."""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql.functions import udtf

CALL, VALUE = 200, 80


def usage_rows(code: str | None, api: str | None) -> Iterator[tuple]:
    """Functions with their parameters, calls of the API with arguments, and decorators that are the API; where the text does
    not parse, functions and calls by their look. Ids are counted: x, x_1, x_2, ..."""
    code, api = code or "", api or ""
    short = api.split(".")[-1]
    made: list[tuple] = []
    seen: Counter[str] = Counter()

    def node(prefix: str, kind: str, name: str | None = None, **attrs: object) -> str:
        id_ = f"{prefix}_{seen[prefix]}" if seen[prefix] else prefix
        seen[prefix] += 1
        made.append(("node", id_, None, kind, name, {k: str(v) for k, v in attrs.items() if v is not None}))
        return id_

    def edge(src: str, dst: str, kind: str) -> None:
        made.append(("edge", src, dst, kind, None, {}))

    def is_api(spoken: str) -> bool:
        return spoken in (short, api) or spoken.endswith(f".{short}")

    def call(at: ast.Call, owner: str | None) -> None:
        id_ = node("code_api_call", "code_api_call", None, api=api, call_repr=ast.unparse(at)[:CALL])
        if owner:
            edge(owner, id_, "calls")
        for place, value in enumerate(at.args):
            edge(id_, node(f"code_call_arg_pos{place}", "code_call_arg", None, position=place, value=ast.unparse(value)[:VALUE]), "has_arg")
        for word in at.keywords:
            name = word.arg or "**kwargs"
            edge(id_, node(f"code_call_arg_kw_{name}", "code_call_arg", name, value=ast.unparse(word.value)[:VALUE], keyword=True), "has_kwarg")

    def function(at: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        spoken = lambda x: ast.unparse(x) if x else None
        id_ = node(f"code_function_{at.name}", "code_function", at.name, return_annotation=spoken(at.returns))
        for arg in at.args.args:
            edge(id_, node(f"code_param_{arg.arg}", "code_param", arg.arg, annotation=spoken(arg.annotation)), "has_param")
        for d in at.decorator_list:
            if isinstance(d, (ast.Name, ast.Attribute)) and is_api(ast.unparse(d)):
                edge(id_, node("code_api_call", "code_api_call", None, api=api, call_repr=f"@{ast.unparse(d)}"), "decorated_by")
        return id_

    if not code.strip():
        return
    try:
        waiting: list[tuple[ast.AST, str | None]] = [(ast.parse(code), None)]
    except (SyntaxError, ValueError, RecursionError):
        for name in re.findall(r"def\s+(\w+)\s*\(", code):
            node(f"code_function_{name}", "code_function", name)
        for n, _ in enumerate(re.finditer(rf"\b{re.escape(short)}\s*\(", code) if short else ()):
            made.append(("node", f"code_api_call_{n}", None, "code_api_call", None, {"api": api}))
        waiting = []
    while waiting:  # in the order of the text, a node before what is in it
        at, owner = waiting.pop()
        if isinstance(at, (ast.FunctionDef, ast.AsyncFunctionDef)):
            owner = function(at)
        elif isinstance(at, ast.Call) and short and isinstance(at.func, (ast.Name, ast.Attribute)) and (at.func.id == short if isinstance(at.func, ast.Name) else is_api(ast.unparse(at.func))):
            call(at, owner)
        waiting += [(child, owner) for child in reversed(list(ast.iter_child_nodes(at)))]
    for pos, (*row, attrs) in enumerate(made):
        yield (*row, pos, attrs)


@udtf(returnType="kind string, id string, dst string, type string, name string, pos int, attrs map<string, string>")
class usage:  # noqa: N801
    """Rows (kind, id, dst, type, name, pos, attrs) of a code text around its calls of an API."""

    def eval(self, text: str, api: str):
        yield from usage_rows(text, api)
