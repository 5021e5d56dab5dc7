"""Scalar functions over code text.

What regular expressions can say is a Column expression and stays in the JVM; what needs balanced brackets or a parser is
one Arrow function over whole batches, fed only the columns that it reads.
"""

import ast
import functools
import io
import operator
import re
import tokenize
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard library's crates and path words.
STD_CRATES = ("std", "core", "alloc", "proc_macro", "test", "self", "super", "crate")
#: Rust minor versions that are installed, and the one taken for anything else (fixed values).
RUST_MIN, RUST_MAX, RUST_DEFAULT = 71, 91, "1.84.0"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def truthy(c: Column) -> Column:
    """A string that is neither null nor empty."""
    return _text(c) != ""


# ---- native ----


def clean_signature(signature: Column) -> Column:
    """Without placeholders: f(a, ...) is f(a), f(..., b) is f(b), f(...) is f()."""
    s = F.regexp_replace(signature, r",\s*\.\.\.\s*\)", ")")
    s = F.regexp_replace(s, r"\(\s*\.\.\.\s*,\s*", "(")
    return F.trim(F.regexp_replace(s, r"\(\.\.\.\)", "()"))


def usable_signature(signature: Column) -> Column:
    """Of a text of several lines only a leading def line."""
    first = F.element_at(F.split(_text(signature), "\n"), 1)
    return F.when(~_text(signature).contains("\n"), signature).when(F.ltrim(first).rlike(r"^(async\s+)?def\b"), first).otherwise("")


def is_crate_version(v: Column) -> Column:
    return _text(v).startswith("0.")


def is_rust_version(v: Column) -> Column:
    minor = F.try_element_at(F.split(_text(v), r"\."), F.lit(2)).try_cast("int")
    return _text(v).startswith("1.") & F.coalesce(minor.between(0, 99), F.lit(False))


def rust_version(v: Column) -> Column:
    """1.<minor>.0 with the minor number clamped to what is installed; the default for anything else."""
    minor = F.try_element_at(F.split(_text(v), r"\."), F.lit(2)).try_cast("int")
    return F.when(is_rust_version(v), F.concat(F.lit("1."), F.least(F.greatest(minor, F.lit(RUST_MIN)), F.lit(RUST_MAX)).cast("string"), F.lit(".0"))).otherwise(RUST_DEFAULT)


def is_std(module: Column) -> Column:
    return _text(module).rlike(r"^(std|core|alloc)(::|$)")


def crate_names(code: Column) -> Column:
    """Distinct crates of `use` and `extern crate` lines, dashes for underscores, without the standard ones; sorted."""
    lines = F.transform(F.split(_text(code), "\n"), lambda x: F.trim(x))
    named = F.transform(lines, lambda x: F.regexp_extract(x, r"^(?:use|extern\s+crate)\s+([^\s;:]+)", 1))
    kept = F.filter(named, lambda x: (x != "") & ~x.isin(*STD_CRATES))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.replace(x, F.lit("_"), F.lit("-")))))


def main_crate(module: Column, code: Column, known: Sequence[str]) -> Column:
    """std for standard modules, else the module's crate if it is known, else the code's first crate, else std."""
    head = F.replace(F.element_at(F.split(_text(module), "::"), 1), F.lit("_"), F.lit("-"))
    lines = F.transform(F.split(_text(code), "\n"), lambda x: F.regexp_extract(F.trim(x), r"^use\s+([^\s;:]+)", 1))
    first = F.try_element_at(F.filter(lines, lambda x: (x != "") & ~x.isin(*STD_CRATES)), F.lit(1))
    return F.when(_text(module).rlike(r"^(std|core|alloc)::"), "std").when(_text(module).contains("::") & head.isin(*known), head).otherwise(F.coalesce(F.replace(first, F.lit("_"), F.lit("-")), F.lit("std")))


def use_imports(code: Column, most: int = 5) -> Column:
    """Paths of `use` lines, groups in braces written out, the first `most`."""
    found = F.regexp_extract_all(_text(code), F.lit(r"use\s+([\w:]+(?:::\{[^}]+\})?)\s*;"), F.lit(1))
    members = lambda u: F.regexp_extract_all(F.substring_index(u, "{", -1), F.lit(r"\w+"), F.lit(0))
    each = lambda u: F.when(u.contains("{"), F.transform(members(u), lambda x: F.concat(F.substring_index(u, "::{", 1), F.lit("::"), x))).otherwise(F.array(u))
    return F.slice(F.flatten(F.transform(found, each)), 1, most)


def _longest(blocks: Column) -> Column:
    """The longest trimmed block, the first of equal ones; null if none has text."""
    tidy = F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    most = F.array_max(F.transform(tidy, lambda b: F.length(b)))
    return F.try_element_at(F.filter(tidy, lambda b: F.length(b) == most), F.lit(1))


def rust_code(response: Column) -> Column:
    """The longest block fenced as Rust, else the longest bare block, else the text without stray fences."""
    r = _text(response)
    named = F.regexp_extract_all(r, F.lit(r"```(?:rust|rs|Rust)\b[^\n]*\n([\s\S]*?)```"), F.lit(1))
    bare = F.regexp_extract_all(r, F.lit(r"```\s*\n([\s\S]*?)```"), F.lit(1))
    return F.coalesce(_longest(named), _longest(bare), F.regexp_replace(r, r"^[`\s]+|[`\s]+$", ""))


def python_code(response: Column) -> Column:
    """The longest fenced block, else all from the first line that looks like code, else the text."""
    r = _text(response)
    fenced = F.regexp_extract_all(r, F.lit(r"```(?:python)?\s*([\s\S]*?)```"), F.lit(1))
    tail = F.regexp_extract(r, r"(?m)^(\s*(?:import |from |def |class |@)[\s\S]*)", 1)
    return F.coalesce(_longest(fenced), F.nullif(F.regexp_replace(tail, r"^\n+|\s+$", ""), F.lit("")), r)


def rust_code_lines(response: Column, lines: bool = True) -> Column:
    """The longest fenced block, its language named or not; else, with `lines`, all from the first line that begins like
    Rust, or the text; without, the text without stray fences."""
    r = _text(response)
    fenced = F.regexp_extract_all(r, F.lit(r"```(?:rust)?\s*([\s\S]*?)```"), F.lit(1))
    if not lines:
        return F.coalesce(_longest(fenced), F.regexp_replace(r, r"^[` \n\t]+|[` \n\t]+$", ""))
    tail = F.regexp_extract(F.regexp_replace(r, r"^\s+|\s+$", ""), r"(?m)^([^\S\n]*(?:use|fn|pub|struct|impl|mod)[^\S\n]+[\s\S]*)", 1)
    return F.coalesce(_longest(fenced), F.nullif(tail, F.lit("")), r)


def too_short(code: Column, least: int = 10) -> Column:
    return F.length(F.trim(_text(code))) < least


def _quoted(name: Column) -> Column:
    """A name as a regular expression that matches itself."""
    return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def has_python_signature(code: Column, signature: Column) -> Column:
    """The code defines the signature's function; true if the signature names none."""
    name = F.regexp_extract(_text(signature), r"(?U)def\s+(\w+)\s*\(", 1)
    return (name == "") | F.regexp_like(_text(code), F.concat(F.lit(r"def\s+"), _quoted(name), F.lit(r"\s*\(")))


def has_rust_signature(code: Column, signature: Column) -> Column:
    """The code defines the signature's function; false if either is empty or none is named."""
    bare = F.regexp_replace(F.regexp_replace(_text(signature), r"#\[.*?\]", ""), r"//.*?\n", "")
    name = F.regexp_extract(F.regexp_replace(bare, r"pub\s+", ""), r"(?U)fn\s+(\w+)", 1)
    return (name != "") & truthy(code) & F.regexp_like(_text(code), F.concat(F.lit(r"fn\s+"), _quoted(name), F.lit(r"\s*[(<]")))


def uses_python_api(code: Column, name: Column, change_type: Column) -> Column:
    """The API's short name stands in the code as a word; always true for deprecated or unnamed APIs."""
    short = F.element_at(F.split(_text(name), r"\."), -1)
    return ~truthy(name) | (F.lower(_text(change_type)) == "deprecated") | F.regexp_like(_text(code), F.concat(F.lit(r"(?U)\b"), _quoted(short), F.lit(r"\b")))


def to_pascal(name: Column) -> Column:
    """as_fd is AsFd; every part's tail is lower-cased."""
    up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(F.split(_text(name), "_"), up), "")


def to_snake(name: Column) -> Column:
    """AsFd is as_fd."""
    return F.regexp_replace(F.lower(F.regexp_replace(_text(name), "([A-Z])", "_$1")), "^_+", "")


def uses_rust_api(code: Column, name: Column, change_type: Column, module: Column, replacement: Column) -> Column:
    """The API, or a deprecated one's replacement, stands in the code under its name, or its other case.

    A deprecated API that is still imported from its module does not pass. Every trait, path or call form of a name has
    the name as a word, so one word test per spelling covers them all; only a brace group may start inside a word.
    """
    code_, deprecated = _text(code), (F.lower(_text(change_type)) == "deprecated") & truthy(replacement)
    target = F.when(deprecated, replacement).otherwise(_text(name))
    base, old = (F.element_at(F.split(x, "::"), -1) for x in (target, _text(name)))
    word = lambda w: F.regexp_like(code_, F.concat(F.lit(r"(?U)\b"), _quoted(w), F.lit(r"\b")))
    grouped = lambda w: F.regexp_like(code_, F.concat(F.lit(r"use\s+.*::\{[^}]*"), _quoted(w)))
    q_mod, q_old = _quoted(_text(module)), _quoted(old)
    imported = F.regexp_like(code_, F.concat(F.lit(r"use\s+"), q_mod, F.lit("::"), q_old, F.lit(r"\b"))) | F.regexp_like(code_, F.concat(F.lit(r"use\s+"), q_mod, F.lit(r"::\{[^}]*\b"), q_old, F.lit(r"\b[^}]*\}")))
    other = F.when(base.contains("_"), to_pascal(base)).when(base.rlike("[A-Z]"), to_snake(base)).otherwise(base)
    found = word(target) | word(base) | word(other) | grouped(base) | grouped(other)
    return truthy(code) & (target != "") & ~(deprecated & truthy(module) & imported) & found


def migration(code: Column, old: Column, new: Column, module: Column) -> Column:
    """struct<uses_old, uses_new, migrated> for a deprecated API and its replacement."""
    none = F.lit("")
    a, b = uses_rust_api(code, old, none, module, none), uses_rust_api(code, new, none, module, none)
    return F.struct(a.alias("uses_old"), b.alias("uses_new"), (b & ~a).alias("migrated"))


def pytest_counts(output: Column) -> Column:
    """struct<passed, total> of a pytest summary; 0 of 0 where there is none."""
    n = lambda word: F.coalesce(F.regexp_extract(_text(output), rf"(\d+) {word}", 1).try_cast("int"), F.lit(0))
    return F.struct(n("passed").alias("passed"), (n("passed") + n("failed") + n("error")).alias("total"))


def libtest_counts(output: Column) -> Column:
    """struct<passed, total> of Rust's test summary."""
    n = lambda i: F.coalesce(F.regexp_extract(_text(output), r"test result:.*?(\d+) passed; (\d+) failed", i).try_cast("int"), F.lit(0))
    return F.struct(n(1).alias("passed"), (n(1) + n(2)).alias("total"))


def rust_tests(program: Column) -> Column:
    return F.regexp_count(_text(program), F.lit(r"#\[test\]"))


def python_tests(program: Column, at_least_one: bool = False) -> Column:
    n = F.regexp_count(_text(program), F.lit(r"def\s+test_" if at_least_one else "def test_"))
    return F.greatest(n, F.lit(1)) if at_least_one else n


def behaviour(signature: Column, most: int = 120) -> Column:
    """What stands after the em dash of a signature."""
    return F.substring(F.trim(_text(F.try_element_at(F.split(_text(signature), " — "), F.lit(2)))), 1, most)


# How the names of the model families are spelt, and the marks that end their answers.
FAMILIES = {"llama": (("Llama3", "Llama-3", "llama3", "llama-3"), "<|eot_id|>"), "qwen": (("Qwen", "qwen"), "<|im_end|>")}


def _family(model: Column, name: str) -> Column:
    return functools.reduce(operator.or_, [_text(model).contains(x) for x in FAMILIES[name][0]])


def chat(model: Column, question: Column) -> Column:
    """A question in the model family's own chat template; as it stands for others. Spellings are case-sensitive."""
    llama = F.concat(F.lit("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n"), question, F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"))
    qwen = F.concat(F.lit("<|im_start|>user\n"), question, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.when(_family(model, "llama"), llama).when(_family(model, "qwen"), qwen).otherwise(question)


def ended(model: Column, answer: Column) -> Column:
    """An answer with the end mark of the model family."""
    return F.when(_family(model, "llama"), F.concat(answer, F.lit(FAMILIES["llama"][1]))).when(_family(model, "qwen"), F.concat(answer, F.lit(FAMILIES["qwen"][1]))).otherwise(answer)


def api_path(name: Column, module: Column, mark: str = ".") -> Column:
    """The name if it is a path already or there is no module, else module and name."""
    return F.when(_text(name).contains(mark) | ~truthy(module), name).otherwise(F.concat_ws(mark, module, name))


def code_prompt(question: Column, signature: Column, api: Column, docs: Column | None = None, language: str = "python") -> Column:
    parts = [F.concat(F.lit(f"Write {language} code.\n"), _text(question)), F.when(truthy(api), F.concat(F.lit("Use: "), api)), F.when(truthy(signature), F.concat(F.lit("Signature: "), signature))]
    if docs is not None:
        parts.append(F.when(truthy(docs), F.concat(F.lit("Documentation:\n"), docs)))
    return F.concat_ws("\n", *parts)


# What marks a test module, and the module that is put around bare tests.
TEST_MARK = "#[cfg(test)]"
TEST_MODULE = ("\n#[cfg(test)]\nmod tests {\n    use super::*;\n    \n    ", "\n}\n")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_repeated_uses(code: Column, tests: Column) -> Column:
    """The tests without those `use` lines before the test module that the code has too; as they stand without such a module."""
    line = lambda x: stripped(x).rlike(r"^use [\s\S]*;$")
    own = F.transform(F.filter(F.split(_text(code), "\n"), line), stripped)
    at = F.instr(_text(tests), TEST_MARK)
    before, after = F.substr(tests, F.lit(1), at - 1), F.substr(tests, at)
    kept = F.filter(F.split(before, "\n"), lambda x: ~(line(x) & F.array_contains(own, stripped(x))))
    return F.when(at > 0, F.concat(F.array_join(kept, "\n"), after)).otherwise(tests)


def rust_test_file(code: Column, tests: Column) -> Column:
    """Code and tests as one file; bare tests get a test module around them."""
    whole = F.when(_text(tests).contains(TEST_MARK), tests).otherwise(F.concat(F.lit(TEST_MODULE[0]), _text(tests), F.lit(TEST_MODULE[1])))
    return F.concat(_text(code), F.lit("\n\n"), whole)


def python_test_file(code: Column, tests: Column) -> Column:
    """The tests, with an import of the code's functions before them if they import nothing of it."""
    names = F.regexp_extract_all(_text(code), F.lit(r"(?U)def\s+(\w+)\s*\("), F.lit(1))
    needed = ~_text(tests).contains("from solution import") & ~_text(tests).contains("import solution") & (F.size(names) > 0)
    return F.when(needed, F.concat(F.lit("from solution import "), F.array_join(names, ", "), F.lit("\n"), _text(tests))).otherwise(tests)


def rust_test_inputs(code: Column, tests: Column, to_version: Column) -> Column:
    """struct<code, tests, rust_version, crate_version, third_party, crates>: third-party code is built by the default Rust."""
    cleaned = without_repeated_uses(code, tests)
    crates = F.array_sort(F.array_union(crate_names(code), crate_names(cleaned)))
    third = F.size(crates) > 0
    rust = F.when(third, rust_version(F.lit(RUST_DEFAULT))).otherwise(rust_version(to_version))
    return F.struct(code.alias("code"), cleaned.alias("tests"), rust.alias("rust_version"), F.when(third & is_crate_version(to_version), to_version).alias("crate_version"), third.alias("third_party"), crates.alias("crates"))


def same_set(a: Column, b: Column) -> Column:
    """Two arrays hold the same members, whatever their order and repeats."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def behaviour_changes(old: Column, new: Column) -> Column:
    """array<struct<kind, old, new>>: whether called methods or intrinsics differ, and whether `unsafe` came or went."""
    calls = lambda c, p: F.regexp_extract_all(_text(c), F.lit(p), F.lit(1))
    same = same_set(calls(old, r"\.([a-z_][a-z0-9_]*)\s*\("), calls(new, r"\.([a-z_][a-z0-9_]*)\s*\(")) & same_set(calls(old, r"intrinsics::([a-z0-9_]+)"), calls(new, r"intrinsics::([a-z0-9_]+)"))
    a, b = _text(old).contains("unsafe"), _text(new).contains("unsafe")
    none = F.lit(None).cast("boolean")
    kinds = F.array(F.when(~same, F.struct(F.lit("behavior_changed").alias("kind"), none.alias("old"), none.alias("new"))), F.when(a != b, F.struct(F.lit("unsafe_changed").alias("kind"), a.alias("old"), b.alias("new"))))
    return F.filter(kinds, lambda x: x.isNotNull())


# Where a source text declares a name, in the order of asking.
DECLARATIONS = (r"\b(?:pub\s+)?type\s+(\w+)\b", r"\b(?:pub\s+)?struct\s+(\w+)\b", r"\b(?:pub\s+)?enum\s+(\w+)\b", r"\b(?:pub\s+)?const\s+([A-Z_][A-Z0-9_]*)\b", r"\b(?:pub\s+)?fn\s+(\w+)\b")


def declared_name(code: Column) -> Column:
    """The name that a Rust text declares: a type, struct, enum, constant or function, what an impl is for, or what it uses; null if none."""
    found = lambda p: F.nullif(F.regexp_extract(_text(code), p, 1), F.lit(""))
    target = found(r"\bimpl\b[^\\n]*?\bfor\b\s*([^\s{]+)")
    target = F.element_at(F.split(F.element_at(F.split(target, "<"), 1), "::"), -1)
    return F.coalesce(*[found(p) for p in DECLARATIONS], target, found(r"\buse\s+[^;]+::(\w+)\s*;"))


def renamed(documentation: Column) -> Column:
    """struct<old, new> of a text that says what was renamed from what; nulls if it does not."""
    part = lambda i: F.nullif(F.regexp_extract(_text(documentation), r"(?i)renamed from\s+`([^`]+)`.*?to\s+`([^`]+)`", i), F.lit(""))
    return F.struct(part(1).alias("old"), part(2).alias("new"))


# ---- brackets and parsers ----


def split_top(text: str, mark: str = ",", opening: str = "([{", closing: str = ")]}") -> list[str]:
    """Parts between the marks that stand outside all brackets; a closing bracket with none open is plain text."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch in opening:
            depth += 1
        elif ch in closing and not (ch == ">" and text[i - 1 : i] == "-"):
            depth = max(0, depth - 1)
        elif ch == mark and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
    parts.append(text[start:].strip())
    return [p for p in parts if p]


def balanced(text: str, start: int, opening: str, closing: str) -> str | None:
    """What stands inside the bracket that opens at or after start."""
    i = text.find(opening, start)
    if i < 0:
        return None
    depth = 0
    for j in range(i, len(text)):
        if text[j] == opening:
            depth += 1
        elif text[j] == closing and not (closing == ">" and text[j - 1] == "-"):
            depth -= 1
            if not depth:
                return text[i + 1 : j]
    return None


def _parameters(inside: str) -> Iterator[tuple[str, int, int]]:
    """(text, place of its first =, of its first : before that; -1 where there is none) of each parameter, in one pass."""
    depth, text, equal, colon = 0, "", -1, -1
    for ch in inside + "\0":
        depth += (ch in "([{") - (ch in ")]}")
        if ch == "\0" or ch == "," and depth == 0:
            if text.strip() not in ("", "/", "*", "..."):
                yield text, equal, colon
            text, equal, colon = "", -1, -1
            continue
        if ch == "=" and equal < 0:
            equal = len(text)
        elif ch == ":" and equal < 0 and colon < 0:
            colon = len(text)
        text += ch


def python_signature(text: str | None) -> dict:
    """name, async_, params, return_type, is_method of a def line."""
    line = (text or "").strip()
    _, *returned = re.split(r"\)\s*->", line, maxsplit=1)
    params = []
    for part, equal, colon in _parameters(line[line.find("(") + 1 : line.rfind(")")]) if 0 <= line.find("(") < line.rfind(")") else ():
        stars = len(part.lstrip()) - len(part.lstrip().lstrip("*"))
        label = part[: colon if colon >= 0 else equal if equal >= 0 else len(part)].strip().lstrip("*").strip()
        kind = part[colon + 1 : equal if equal >= 0 else len(part)].strip() if colon >= 0 else None
        params.append({"name": label, "type": kind, "default": part[equal + 1 :].strip() if equal >= 0 else None, "var_positional": stars == 1, "var_keyword": stars > 1})
    words = re.findall(r"\w+|\(", line)
    name = next((w for d, w, mark in zip(words, words[1:], words[2:]) if d == "def" and mark == "("), "")
    result = returned[0].strip().rstrip(":").strip() if returned else ""
    return {"name": name, "async_": line.startswith("async "), "params": params, "return_type": result or None, "is_method": bool(params) and params[0]["name"] in ("self", "cls")}


def rust_signature(text: str | None) -> dict:
    """kind, name, visibility, modifiers, generics, params, self_kind, return_type, where, impl_trait, impl_for."""
    s = re.sub(r"//[^\n]*", "", text or "").strip()
    out = {"kind": "", "name": "", "visibility": None, "modifiers": [], "generics": [], "params": [], "self_kind": None, "return_type": None, "where": [], "impl_trait": None, "impl_for": None}
    seen = re.match(r"(pub(?:\([^)]*\))?)\s+", s)
    if seen:
        out["visibility"], s = seen[1], s[seen.end() :]
    head, where = (re.split(r"\bwhere\b", s, maxsplit=1) + [""])[:2]
    for clause in split_top(where.split("{")[0].rstrip(" ;,"), ",", "<([", ">)]"):
        left, _, right = clause.partition(":")
        out["where"].append({"type_param": left.strip(), "bounds": split_top(right, "+", "<([", ">)]")})
    named = re.search(r"\b(struct|enum|type)\s+(\w+)", head) or (re.search(r"\b(const|static)\s+(?!fn\b)(\w+)\s*:", head))
    impl = re.match(r"(?:unsafe\s+)?impl\b", head)
    fn = re.search(r"\bfn\s+(\w+)", head)
    if named and not (fn and fn.start() < named.start()) and not impl:
        out["kind"] = {"type": "type_alias", "static": "const"}.get(named[1], named[1])
        out["name"] = named[2]
        rest = head[named.end() :].lstrip()
        if rest.startswith("<"):
            out["generics"] = split_top(balanced(rest, 0, "<", ">") or "", ",", "<([", ">)]")
    elif impl:
        out["kind"] = "impl"
        rest = head[impl.end() :].strip()
        if rest.startswith("<"):
            inner = balanced(rest, 0, "<", ">") or ""
            out["generics"], rest = split_top(inner, ",", "<([", ">)]"), rest[len(inner) + 2 :].strip()
        rest = rest.split("{")[0].strip()
        trait, _, whom = rest.partition(" for ")
        out["impl_trait"], out["impl_for"] = (trait.strip(), whom.strip()) if whom else (None, trait.strip())
        out["name"] = out["impl_for"]
        if head.startswith("unsafe"):
            out["modifiers"] = ["unsafe"]
    elif fn:
        out["kind"], out["name"] = "fn", fn[1]
        out["modifiers"] = re.findall(r"\b(?:const|async|unsafe|extern)\b", head[: fn.start()])
        rest = head[fn.end() :].lstrip()
        if rest.startswith("<"):
            inner = balanced(rest, 0, "<", ">") or ""
            out["generics"], rest = split_top(inner, ",", "<([", ">)]"), rest[len(inner) + 2 :]
        inner = balanced(rest, 0, "(", ")") or ""
        for part in split_top(inner, ",", "<([", ">)]"):
            own = re.fullmatch(r"(?:mut\s+)?self|&(?:'\w+\s+)?(?:mut\s+)?self", part)
            label, colon, kind = part.partition(":")
            if own or label.strip() in ("self", "mut self"):
                out["self_kind"] = part
            elif colon:
                out["params"].append({"name": label.strip().removeprefix("mut ").strip(), "type": kind.strip()})
        tail = rest[rest.find("(") + len(inner) + 2 :]
        arrow = re.match(r"\s*->\s*([^{;]+)", tail)
        out["return_type"] = arrow[1].strip() if arrow else None
    return out


def python_imports(code: str | None) -> list[str]:
    """Imported paths, in order; by lines where the text does not parse."""
    found: list[str] = []
    try:
        for node in ast.walk(ast.parse(code or "")):
            if isinstance(node, ast.Import):
                found += [a.name for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                found += [f"{node.module}.{a.name}" if node.module else a.name for a in node.names]
    except (SyntaxError, ValueError):
        for line in (code or "").splitlines():
            if m := re.match(r"\s*from\s+([\w.]+)\s+import\s+(.+)", line):
                found += [f"{m[1]}.{n.split(' as ')[0].strip(' ()')}" for n in m[2].split(",")]
            elif m := re.match(r"\s*import\s+(.+)", line):
                found += [n.split(" as ")[0].strip() for n in m[1].split(",")]
    return list(dict.fromkeys(found))


def strip_python_comments(code: str | None) -> str:
    """Code without comments and docstrings, runs of blank lines made one."""
    text = code or ""
    drop: list[tuple[tuple[int, int], tuple[int, int]]] = []
    try:
        tree = ast.parse(text)
        for node in ast.walk(tree):
            body = getattr(node, "body", None)
            if isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str) and len(body) > 1:
                drop.append((body[0].lineno, body[0].end_lineno))
        lines = text.split("\n")
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                lines[t.start[0] - 1] = lines[t.start[0] - 1][: t.start[1]].rstrip()
        gone = {i for a, b in drop for i in range(a, b + 1)}
        lines = [x for i, x in enumerate(lines, 1) if i not in gone]
    except (SyntaxError, ValueError, tokenize.TokenError):
        lines = [re.sub(r"(^|\s)#.*$", "", x) for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in lines)).strip()


def drop_tests(code: str, coroutines: bool = True) -> list[str]:
    """The lines of imports and functions, without tests, calls of tests and comments on them. With `coroutines`, async
    functions count as functions, and what stands at a function's level after it stays too."""
    heads = ("def ", "async def ") if coroutines else ("def ",)
    kept: list[str] = []
    level, in_test = None, False  # the last function's indentation; whether it was a test
    for line in code.split("\n"):
        bare = line.strip()
        depth = len(line) - len(line.lstrip())
        if not bare:
            stays = bool(kept) and not in_test
        elif bare.startswith(tuple(h + "test_" for h in heads)):
            stays, in_test = False, True
        elif in_test and line[0] in " \t":
            stays = False
        else:
            in_test = False
            about_tests = bare.startswith("test_") and "(" in bare or bare.startswith("#") and "test" in bare.lower()
            if not about_tests and bare.startswith(heads):
                level = depth
            stays = not about_tests and (bare.startswith(("import ", "from ")) or level is not None and (depth > level or depth == level and (coroutines or bare.startswith(heads))))
        if stays:
            kept.append(line)
    while kept and not kept[-1].strip():
        kept.pop()
    return kept


def _tagged(text: str) -> str | None:
    """What stands between the first [PYTHON] and the first [/PYTHON]."""
    low, high = text.find("[PYTHON]") + len("[PYTHON]"), text.find("[/PYTHON]")
    return text[low:high].strip() if "[PYTHON]" in text and high > low else None


def python_answer(text: str | None) -> str:
    """Python code of an answer, without its tests: the longest block fenced as Python, else the longest bare one (those
    that define or import something first), else what is tagged, else a text without fences."""
    text = text or ""
    named = re.findall(r"```(?:[Pp]ython[23]?|py)\b[^\n]*\n([\s\S]*?)```", text)
    bare = [b.strip() for b in re.findall(r"```\s*\n([\s\S]*?)```", text) if b.strip()]
    telling = [b for b in bare if "def " in b or "import " in b]
    code = max(named, key=len).strip() if named else max(telling or bare, key=len) if bare else _tagged(text)
    if code is None:
        rest = re.sub(r"```\s*$", "", text.strip())
        if not rest or "```" in rest:
            return text.strip()
        code = rest.strip()
    return "\n".join(drop_tests(code)) or text.strip()


def python_answer_tuned(text: str | None) -> str:
    """As python_answer, for tuned models: the first block fenced as Python, else what is tagged, else a text that defines something."""
    text = text or ""
    start = text.find("```python")
    end = text.find("```", start + len("```python\n")) if start >= 0 else -1
    code = text[start + len("```python\n") : end].strip() if end >= 0 else _tagged(text)
    if code is None:
        if "def " not in text:
            return text.strip()
        code = text
    return "\n".join(drop_tests(code, False)) or text.strip()


# Words that are no API's name, types that all code uses, and methods that all code calls.
NO_NAMES = frozenset("this that it the a an or".split())
COMMON_TYPES = frozenset("Self String Vec Option Result Box Arc Rc Error".split())
COMMON_METHODS = frozenset("new clone to_string map unwrap expect is_some is_none".split())
# How a note and a documentation name a replacement.
NOTE_SAYS = (r"superseded by `([\w:]+)`", r"[Uu]se `?([\w:]+)(?:\(\))?`?", r"use (?:the )?([\w:]+) (?:impl|instead)")
DOCS_SAY = (r"[Uu]se `?([\w:]+)(?:\(\))?`? instead", r"replaced by `?([\w:]+)`?", r"superseded by `?([\w:]+)`?")


def _most(words: list[str]) -> str | None:
    """The most common word, the first in order among equals."""
    return min(Counter(words).items(), key=lambda x: (-x[1], x[0]))[0] if words else None


def rust_replacement(name: str | None, code: str | None, old_source: str | None, source: str | None, documentation: str | None) -> str | None:
    """What replaces a deprecated Rust API: its type alias, what its note or documentation says, the one type that the code
    imports, the method that the code calls most (for names in lower case), the type imported most."""
    name, code, documentation = name or "", code or "", documentation or ""
    if alias := re.search(r"pub type \w+[^=]*=\s*([^;{]+)", old_source or ""):
        return alias[1].strip()
    note = re.search(r'#\[deprecated[^\]]*note\s*=\s*"([^"]+)"', source or "") or re.search(r'note\s*=\s*"([^"]+)"', documentation)
    for said, patterns in ((note[1] if note else "", NOTE_SAYS), (documentation, DOCS_SAY)):
        for pattern in patterns:
            if (m := re.search(pattern, said)) and m[1] not in NO_NAMES:
                return m[1]
    used = re.findall(r"use [^;{]+::(\w+)\s*;", code) + [t.strip() for group in re.findall(r"use [^;]+\{([^}]+)\}", code) for t in group.split(",")]
    types = [u for u in used if u and u[0].isupper() and u not in COMMON_TYPES]
    own = set(re.findall(r"(?:struct|enum|trait)\s+(\w+)", code))
    types = [t for t in types if t not in own] or types
    if len(set(types)) == 1:
        return types[0]
    called = [m for m in re.findall(r"\.(\w+)\(", code) if m not in COMMON_METHODS] if name[:1].islower() else []
    return _most(called) or _most(types)


def clean_generated(text: str | None) -> str:
    """Compatibility-normalised text without end-of-text marks."""
    return re.sub(r"<\|[^|>]*\|>", "", unicodedata.normalize("NFKD", text or "")).strip()


_PARAM = "array<struct<name: string, type: string, default: string, var_positional: boolean, var_keyword: boolean>>"


def _udf(f, schema: str):
    """Column -> Column by f over Arrow batches; made when called, as a schema's text needs a session."""

    def call(column: Column) -> Column:
        def struct(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([f(x) for x in s])

        def plain(s: pd.Series) -> pd.Series:
            return s.map(f)

        return F.pandas_udf(struct if schema.startswith("struct") else plain, schema)(column)

    return call


parse_python_signature = _udf(python_signature, f"struct<name: string, async_: boolean, params: {_PARAM}, return_type: string, is_method: boolean>")
parse_rust_signature = _udf(rust_signature, "struct<kind: string, name: string, visibility: string, modifiers: array<string>, generics: array<string>, params: array<struct<name: string, type: string>>, self_kind: string, return_type: string, where: array<struct<type_param: string, bounds: array<string>>>, impl_trait: string, impl_for: string>")
parse_python_imports = _udf(python_imports, "array<string>")
strip_comments = _udf(strip_python_comments, "string")
clean_text = _udf(clean_generated, "string")
answer_code = _udf(python_answer, "string")
tuned_answer_code = _udf(python_answer_tuned, "string")


def replacement(name: Column, code: Column, old_source: Column, source: Column, documentation: Column) -> Column:
    """rust_replacement over columns."""

    def told(*parts: pd.Series) -> pd.Series:
        return pd.Series([rust_replacement(*row) for row in zip(*parts)], dtype=object)

    return F.pandas_udf(told, "string")(name, code, old_source, source, documentation)
