"""Critical spans: where an answer says what an API's change is about, and which tokens that touches.

The words to look for come from several sources, in an order of precedence: the API's name and module, the code's function
with its parameters, what changed, what replaces it, and the signatures. All are Columns over one row; every word is then
found in its answer, as rows (key, start, end, weight, source), and tokens with offsets take the largest weight that they
overlap by a range join over bins of offsets. Tokens that are parts of the answer itself are weighted where the answer is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.code import _quoted, _text

# Names that mark nothing, and the weight of a critical token.
RUST_SKIPPED = ("fn", "let", "mut", "pub", "use", "self")
PYTHON_SKIPPED = ("def", "return", "None", "True", "False", "self", "cls", "int", "str", "bool", "float", "bytes", "object", "type")
WEIGHT = 4.0
WIDTH = 64  #: offsets in a bin of the range join

_PAIRS = "array<struct<name: string, type: string>>"


def _some(words: Column) -> Column:
    return F.coalesce(words, F.array().cast("array<string>"))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?dU){pattern}"), F.lit(1))


def _one(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, f"(?dU){pattern}", 1)


def _list(word: Column) -> Column:
    return F.array(_text(word))


def _short(name: Column, mark: str) -> Column:
    return F.substring_index(_text(name), mark, -1)


def _longer(words: Column, least: int, skipped: Sequence[str] = ()) -> Column:
    kept = F.filter(words, lambda w: F.length(w) > least)
    return F.filter(kept, lambda w: ~w.isin(*skipped)) if skipped else kept


def _words(sources: dict[str, Column]) -> Column:
    """array<struct<text, source, rank>>: the words of all sources, each once with the first source that has it."""
    labelled = lambda name, rank: lambda w: F.struct(F.trim(w).alias("text"), F.lit(name).alias("source"), F.lit(rank).alias("rank"))
    parts = [F.transform(_some(words), labelled(name, rank)) for rank, (name, words) in enumerate(sources.items())]
    each = F.filter(F.concat(*parts), lambda w: F.length(w["text"]) >= 2)
    texts = F.array_distinct(F.transform(each, lambda w: w["text"]))
    return F.transform(texts, lambda t: F.element_at(F.filter(each, lambda w: w["text"] == t), 1))


def rust_words(name: Column, signature: Column) -> Column:
    """The words of a Rust change: the API's name and its last part, and of the function's signature the name, parameters,
    types, what it returns and its generics."""
    name, signature = _text(name), _text(signature)
    returned = F.trim(_one(signature, r"->\s*(.+?)(?:\s*where|\s*\{|;|$)"))
    return _words({
        "name": F.array(name, F.when(name.contains("::"), _short(name, "::")).otherwise("")),
        "function": _list(_one(signature, r"fn\s+(\w+)")),
        "parameter": _longer(_all(signature, r"(\w+)\s*:"), 2, RUST_SKIPPED),
        "type": _all(signature, r":\s*&?(?:mut\s+)?([A-Z]\w+)"),
        "return": _all(returned, r"\b([A-Z]\w+)\b"),
        "generic": F.filter(_all(_one(signature, r"<([^>]+)>"), r"\b([A-Z]\w*)\b"), lambda w: F.length(w) <= 20),
    })


def rust_signature_of(name: Column, params: Column, returns: Column) -> Column:
    """The signature that a graph's function node stands for."""
    return F.concat(F.lit("fn "), _text(name), F.lit("("), _text(params), F.lit(")"), F.when(_text(returns) != "", F.concat(F.lit(" -> "), returns)).otherwise(""))


#: What a Python change's words are taken from: strings, (name, type) pairs and lists.
PYTHON_FACTS = {
    "name": "string", "module": "string", "signature": "string", "function": "string", "params": _PAIRS, "returns": "string", "changed": "array<string>", "changed_types": "array<string>",
    "replacement": "string", "stable": "string", "behavior": "string", "new_name": "string", "old_name": "string", "new_params": _PAIRS, "new_returns": "string",
}


def python_words(facts: Column | None = None, **given: Column) -> Column:
    """The words of a Python change, by the facts in a struct or given by name; others are empty."""
    of = lambda c: (facts[c] if facts is not None else given.get(c, F.lit(None))).cast(PYTHON_FACTS[c])
    text = lambda c: _text(of(c))
    names = lambda pairs: F.transform(F.coalesce(pairs, F.array().cast(_PAIRS)), lambda p: _text(p["name"]))
    said = r"\b([A-Za-z]\w+)\b"
    types = lambda pairs, least: _longer(F.flatten(F.transform(F.coalesce(pairs, F.array().cast(_PAIRS)), lambda p: _all(_text(p["type"]), said))), least, PYTHON_SKIPPED)
    short = _short(of("name"), ".")
    path = F.when((text("module") != "") & (text("name") != ""), F.concat(text("module"), F.lit("."), short)).otherwise("")
    lists = lambda c: _some(of(c))
    api = lambda c: _longer(_list(_short(of(c), ".")), 2, PYTHON_SKIPPED)
    whole = F.when(text("replacement").contains("."), text("replacement")).otherwise("")
    return _words({
        "name": F.concat(_list(short), _longer(_list(text("module")), 2), _longer(_list(path), 3)),
        "function": _longer(_list(text("function")), 2, PYTHON_SKIPPED),
        "parameter": F.concat(_longer(names(of("params")), 1, PYTHON_SKIPPED), types(of("params"), 2)),
        "return": _longer(_all(text("returns"), said), 1, PYTHON_SKIPPED),
        "change": F.concat(_longer(lists("changed"), 1, PYTHON_SKIPPED), _longer(F.flatten(F.transform(lists("changed_types"), lambda t: _all(t, said))), 2, PYTHON_SKIPPED)),
        "replacement": F.concat(api("replacement"), _longer(_list(whole), 3), api("stable"), api("behavior")),
        "signature": F.concat(_longer(_all(text("signature"), r"\b(\w+)\s*[=:,\)]"), 2, PYTHON_SKIPPED), _all(_one(text("signature"), r"->\s*(.+?)$"), r"\b([A-Z]\w+)\b")),
        "state": F.concat(_longer(F.concat(_list(text("new_name")), _list(text("old_name"))), 2, PYTHON_SKIPPED), _longer(names(of("new_params")), 1, PYTHON_SKIPPED), types(of("new_params"), 2), _longer(_all(text("new_returns"), said), 2, PYTHON_SKIPPED)),
    })


_CHANGES = "array<struct<name: string, new_type: string, new: string>>"


def python_facts(graphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, facts): what the graphs (graph_id, name, module, signature) and their nodes say."""
    of = lambda c: F.coalesce(F.try_element_at("attrs", F.lit(c)), F.lit(""))
    kind, role, status, called = F.col("type"), of("role"), of("status"), F.coalesce(F.nullif("name", F.lit("")), F.lit(""))
    api = F.coalesce(F.nullif(of("api"), F.lit("")), called)
    newer = (kind == "api") & (role == "new") & (api != "")
    first = lambda when, value: F.min_by(value, F.when(when, F.struct("pos", "node_id")))
    last = lambda when, value: F.max_by(value, F.when(when, F.struct("pos", "node_id")))
    in_order = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", "node_id", value.alias("v"))))), lambda x: x["v"])
    changes = F.flatten(in_order(kind == "change", F.coalesce(F.from_json(of("changes"), _CHANGES), F.array().cast(_CHANGES))))
    retyped = lambda c: F.coalesce(F.nullif(c["new_type"], F.lit("")), c["new"], F.lit(""))
    own = (kind == "func_param") & ~called.isin("", "self", "cls")
    found = nodes.groupBy("graph_id").agg(
        first((kind == "code_function") & (called != ""), called).alias("function"), first((kind == "code_function") & (called != ""), of("return_annotation")).alias("own_returns"),
        in_order(own, F.struct(called.alias("name"), of("annotation").alias("type"))).alias("params"), last(kind == "func_return", of("annotation")).alias("returned"), changes.alias("changes"),
        *[first(newer & (status == s), api).alias(c) for s, c in (("replacement", "replacement"), ("stable", "stable"), ("behavior", "behavior"))], first(newer & ~status.isin("replacement", "stable", "behavior"), api).alias("other"),
        last(kind == "new_signature", called).alias("new_name"), last(kind == "new_signature", of("params")).alias("new_params"), last(kind == "new_signature", of("return_type")).alias("new_returns"), last(kind == "old_signature", called).alias("old_name"),
    )
    rows = graphs.select("graph_id", "name", "module", "signature").join(found, "graph_id", "left")
    facts = {
        "returns": F.coalesce(F.nullif("returned", F.lit("")), "own_returns"), "changed": F.filter(F.transform("changes", lambda c: _text(c["name"])), lambda n: n != ""), "changed_types": F.filter(F.transform("changes", retyped), lambda t: F.length(t) > 1),
        "replacement": F.coalesce("replacement", F.when(~F.col("other").eqNullSafe(F.col("name")), F.col("other"))), "new_params": F.from_json("new_params", _PAIRS),
    }
    return rows.select("graph_id", F.struct(*[facts.get(c, F.col(c)).cast(t).alias(c) for c, t in PYTHON_FACTS.items()]).alias("facts"))


def spans(df: DataFrame, key: Sequence[str], answer: str, words: Column, weight: float = WEIGHT) -> DataFrame:
    """(key..., start, end, weight, source, text): every place, from left to right and apart from one another, where a
    word stands in the answer. The answers stay where they are; only lengths of what lies between are summed up."""
    rows = df.select(*key, _text(F.col(answer)).alias("a"), F.explode(words).alias("w")).where(F.col("a").contains(F.col("w.text")))
    gaps = F.transform(F.split("a", _quoted(F.col("w.text")), -1), lambda p: F.length(p).cast("long"))
    rows = rows.select(*key, "w", F.posexplode(F.slice(gaps, 1, F.size(gaps) - 1)).alias("n", "gap"))
    size = F.length("w.text").cast("long")
    before = F.sum("gap").over(Window.partitionBy(*key, "w").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    start = before + F.col("n") * size
    return rows.select(*key, start.alias("start"), (start + size).alias("end"), F.lit(weight).alias("weight"), F.col("w.source").alias("source"), F.col("w.text").alias("text"))


def _binned(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    first = F.floor(F.col(start) / width)
    last = F.greatest(first, F.floor((F.col(end) - 1) / width))
    return df.withColumn(name, first).withColumn("__bin", F.explode(F.sequence(first, last)))


def overlaps(left: DataFrame, right: DataFrame, key: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Pairs of a left row (start, end) and a right row (from, to) of one key that overlap, end excluded, each once.

    Both sides are dealt to the bins of offsets that they reach, so a pair meets in the bins that it shares and is kept in
    the first of them; neither a key nor a long text is compared as a whole."""
    a, b = _binned(left, "start", "end", width, "__a"), _binned(right, "from", "to", width, "__b")
    met = a.join(b, [*key, "__bin"]).where((F.col("start") < F.col("to")) & (F.col("end") > F.col("from")) & (F.col("__bin") == F.greatest("__a", "__b")))
    return met.drop("__a", "__b", "__bin")


def token_weights(tokens: DataFrame, found: DataFrame, key: Sequence[str], default: float = 1.0, width: int = WIDTH) -> DataFrame:
    """The tokens (key..., pos, start, end) with the largest weight of the spans that each overlaps, else the default."""
    right = found.select(*key, F.col("start").alias("from"), F.col("end").alias("to"), "weight")
    met = overlaps(tokens.select(*key, "pos", "start", "end"), right, key, width).groupBy(*key, "pos").agg(F.max("weight").alias("weight"))
    return tokens.join(met, [*key, "pos"], "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


def tokens_of(df: DataFrame, key: Sequence[str], text: str, pattern: str = r"\s") -> DataFrame:
    """(key..., pos, start, end): the parts of a text between single separators, by code points; empty ones left out."""
    parts = F.posexplode(F.transform(F.split(_text(F.col(text)), pattern, -1), lambda p: F.length(p).cast("long"))).alias("pos", "size")
    rows = df.select(*key, parts)
    end = F.sum("size").over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) + F.col("pos")
    return rows.select(*key, "pos", (end - F.col("size")).alias("start"), end.alias("end")).where("end > start")


def weighted_parts(df: DataFrame, key: Sequence[str], text: str, words: Column, pattern: str = r"[\t\n\x0b\f\r ]", weight: float = WEIGHT, default: float = 1.0, held_rows: int = 1 << 17) -> DataFrame:
    """(key..., pos, start, end, weight): the rows of `tokens_of` with the weights that `token_weights` gives them by `spans`.

    Text and words stand in one row, so a text's parts are marked where it is read, and nothing but the result leaves the
    task: no row is shuffled. A task gives its rows out in batches of about `held_rows`."""
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*key).schema.fields}
    between = re.compile(pattern)

    def marked(answer: str, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, between.split(answer)), np.int64)
        end = np.cumsum(sizes) + np.arange(len(sizes))
        start, change = end - sizes, np.zeros(len(sizes) + 1, np.int64)
        for term in terms:
            found = np.array([m.start() for m in re.finditer(re.escape(term), answer)], np.int64)
            first, stop = np.searchsorted(end, found, "right"), np.searchsorted(start, found + len(term), "left")
            np.add.at(change, first[first < stop], 1)
            np.add.at(change, stop[first < stop], -1)
        return start, end, np.cumsum(change[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0

            def out() -> pa.RecordBatch:
                at, pos, start, end, hit = (np.concatenate(x) for x in zip(*parts))
                keys = [b.column(i).take(pa.array(at)) for i in range(len(key))]
                return pa.RecordBatch.from_arrays([*keys, pa.array(pos), pa.array(start), pa.array(end), pa.array(np.where(hit, weight, default))], [*key, "pos", "start", "end", "weight"])

            for j, (answer, terms) in enumerate(zip(b.column(len(key)), b.column(len(key) + 1))):
                start, end, hit = marked(answer.as_py(), terms.as_py() or [])
                pos = np.flatnonzero(end > start)
                parts.append((np.full(len(pos), j), pos.astype(np.int32), start[pos], end[pos], hit[pos]))
                held += len(pos)
                if held >= held_rows:
                    yield out()
                    parts, held = [], 0
            if held:
                yield out()

    rows = df.select(*key, _text(F.col(text)).alias("__text"), F.transform(words, lambda w: w["text"]).alias("__words"))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in key), "pos int, start long, end long, weight double"]))
