"""Critical words and spans, and which tokens they touch, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evoframe.operators import critical


def plain_rust(name, signature):
    found = [name] + ([name.split("::")[-1]] if "::" in name else [])
    found += re.findall(r"fn\s+(\w+)", signature)[:1]
    found += [p for p in re.findall(r"(\w+)\s*:", signature) if len(p) > 2 and p not in critical.RUST_SKIPPED]
    found += re.findall(r":\s*&?(?:mut\s+)?([A-Z]\w+)", signature)
    if m := re.search(r"->\s*(.+?)(?:\s*where|\s*\{|;|$)", signature):
        found += re.findall(r"\b([A-Z]\w+)\b", m[1])
    if m := re.search(r"<([^>]+)>", signature):
        found += [g for g in re.findall(r"\b([A-Z]\w*)\b", m[1]) if len(g) <= 20]
    return list(dict.fromkeys(w.strip() for w in found if len(w.strip()) >= 2))


RUST = [
    ("std::fs::chown", "pub fn chown<P: AsRef<Path>>(dir: P, uid: Option<u32>, mut self: Self) -> io::Result<Output> where P: X {"),
    ("f", "fn f(a: &mut Vec<u8>, naïve: Größe) -> Größe;"), ("", ""), (None, None), ("a::b::c", "no signature"), ("x y", "fn  spaced <TT, UU> (first : First) -> (Second, Third)"),
]


def test_rust_words(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(RUST)], "i int, name string, signature string")
    got = {r.i: r.w for r in rows.select("i", critical.rust_words(F.col("name"), F.col("signature")).alias("w")).collect()}
    for i, (name, signature) in enumerate(RUST):
        assert [w.text for w in got[i]] == plain_rust(name or "", signature or ""), i
    assert [(w.text, w.source) for w in got[0]][:3] == [("std::fs::chown", "name"), ("chown", "name"), ("dir", "parameter")]
    made = spark.range(1).select(critical.rust_signature_of(F.lit("f"), F.lit("a: u8"), F.lit("R")).alias("a"), critical.rust_signature_of(F.lit("f"), F.lit(None), F.lit("")).alias("b")).first()
    assert tuple(made) == ("fn f(a: u8) -> R", "fn f()")


def test_python_words(spark):
    pairs = lambda *p: F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("type")) for a, b in p])
    words = critical.python_words(
        name=F.lit("pkg.sub.load"), module=F.lit("pkg.sub"), signature=F.lit("load(path: str, mode='r', *, n) -> Frame"), function=F.lit("run_it"), params=pairs(("rows", "list[Row]"), ("x", "int"), ("self", None)),
        returns=F.lit("dict[str, Out]"), changed=F.array(F.lit("mode"), F.lit("self"), F.lit("q")), changed_types=F.array(F.lit("Optional[Kind]")), replacement=F.lit("pkg.fresh"), stable=F.lit("io"), behavior=F.lit("pkg.acts"),
        new_name=F.lit("load2"), old_name=F.lit("def"), new_params=pairs(("enc", "Codec"), ("z", None)), new_returns=F.lit("None"),
    )
    got = {(w.text, w.source) for w in spark.range(1).select(words.alias("w")).first().w}
    assert got == {
        ("load", "name"), ("pkg.sub", "name"), ("pkg.sub.load", "name"), ("run_it", "function"), ("rows", "parameter"), ("list", "parameter"), ("Row", "parameter"), ("dict", "return"), ("Out", "return"), ("mode", "change"),
        ("Optional", "change"), ("Kind", "change"), ("fresh", "replacement"), ("acts", "replacement"), ("pkg.fresh", "replacement"), ("path", "signature"), ("Frame", "signature"), ("load2", "state"), ("enc", "state"), ("Codec", "state"),
    }
    assert spark.range(1).select(critical.python_words().alias("w")).first().w == []


def test_facts_of_graphs(spark):
    graphs = spark.createDataFrame([(1, "p.f", "p", "f(a)"), (2, "g", None, None)], "graph_id long, name string, module string, signature string")
    nodes = spark.createDataFrame([
        (1, "c0", "code_function", "run", 5, {"return_annotation": "Out"}), (1, "c1", "code_function", "later", 6, {}), (1, "func_param_a", "func_param", "a", 1, {"annotation": "A"}), (1, "func_param_self", "func_param", "self", 0, {}),
        (1, "evo_x", "change", None, 9, {"changes": '[{"name": "a", "old_type": "int", "new_type": "Big"}, {"kind": "return_type_changed", "old": "x", "new": "Yes"}]'}),
        (1, "new_signature", "new_signature", "f", 9, {"params": '[{"name": "a", "type": "Big"}]', "return_type": "R"}), (1, "old_signature", "old_signature", "f0", 9, {}),
        (1, "evo_new", "api", None, 9, {"role": "new", "status": "active", "api": "p.fresh"}), (1, "evo_old", "api", None, 9, {"role": "old", "status": "replacement", "api": "p.no"}),
        (1, "evo_s", "api", None, 9, {"role": "new", "status": "stable", "api": "p.s"}),
    ], "graph_id long, node_id string, type string, name string, pos long, attrs map<string,string>")
    got = {r.graph_id: r.facts for r in critical.python_facts(graphs, nodes).collect()}
    f = got[1]
    assert (f.name, f.module, f.function, f.returns, f.replacement, f.stable, f.behavior, f.new_name, f.old_name, f.new_returns) == ("p.f", "p", "run", "Out", "p.fresh", "p.s", None, "f", "f0", "R")
    assert [tuple(p) for p in f.params] == [("a", "A")] and f.changed == ["a"] and f.changed_types == ["Big", "Yes"] and [tuple(p) for p in f.new_params] == [("a", "Big")]
    assert got[2].function is None and got[2].name == "g"
    words = spark.createDataFrame([(1,)], "graph_id long").join(critical.python_facts(graphs, nodes), "graph_id").select(critical.python_words(F.col("facts")).alias("w")).first().w
    assert {"fresh", "Big", "Out", "run", "p.fresh"} <= {w.text for w in words}


def plain_weights(text, words, offsets, weight):
    spans = [m.span() for w in words for m in re.finditer(re.escape(w), text)]
    return spans, [weight if any(not (e <= s or b >= t) for s, t in spans) else 1.0 for b, e in offsets]


@pytest.mark.parametrize("width", [1, 7, 64])
def test_spans_and_tokens(spark, width):
    r = random.Random(width)
    texts = ["".join(r.choice(["ab", "a", "b ", "é", " ", ".", "\\E", "(", "aab", "𝄞"]) for _ in range(r.randint(0, 90))) for _ in range(25)] + ["", None, "ab" * 2000]
    words = ["ab", "aa", "a.b", "\\E(", "b é", "(", "𝄞a", "ab ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    said = F.array(*[F.struct(F.lit(w).alias("text"), F.lit("s").alias("source"), F.lit(0).alias("rank")) for w in words])
    found = critical.spans(df, ["doc"], "text", said, weight=3.0)
    got = {}
    for x in found.collect():
        got.setdefault(x.doc, []).append((x.start, x.end))
    tokens = critical.tokens_of(df, ["doc"], "text")
    offsets = {}
    for x in tokens.collect():
        offsets.setdefault(x.doc, []).append((x.start, x.end))
    weights = {}
    for x in critical.token_weights(tokens, found, ["doc"], width=width).collect():
        weights.setdefault(x.doc, {})[x.start, x.end] = x.weight
    for i, text in enumerate(texts):
        own = [m.span() for m in re.finditer(r"[^\s]+", text or "")]
        assert sorted(offsets.get(i, [])) == own
        spans, want = plain_weights(text or "", words, own, 3.0)
        assert sorted(got.get(i, [])) == sorted(spans)
        assert [weights[i][o] for o in own] == want if own else i not in weights


def test_overlaps_of_odd_ranges(spark):
    """Each pair once, whatever the bins; a range without length overlaps where it stands inside another."""
    r = random.Random(1)
    left = [(k, r.randint(0, 40), r.randint(0, 12)) for k in (1, 2) for _ in range(40)]
    right = [(k, r.randint(0, 40), r.randint(0, 30)) for k in (1, 3) for _ in range(30)] + [(1, 0, 5000)]
    a = spark.createDataFrame([(i, k, s, s + n) for i, (k, s, n) in enumerate(left)], "i int, k int, start int, end int")
    b = spark.createDataFrame([(i, k, s, s + n) for i, (k, s, n) in enumerate(right)], "j int, k int, from int, to int")
    got = sorted((x.i, x.j) for x in critical.overlaps(a, b, ["k"], width=8).collect())
    want = sorted((i, j) for i, (k, s, n) in enumerate(left) for j, (l, t, m) in enumerate(right) if k == l and s < t + m and s + n > t)
    assert got == want and len(set(want)) == len(want) > 100


def test_parts_weighted_in_place(spark):
    r = random.Random(7)
    texts = ["", None, " ", "a b", "x\x0by\tab  ab\r\nabab aab ", "ﬁ😀ab ab😀", *["".join(r.choice("ab \n😀") for _ in range(r.randint(1, 60))) for _ in range(40)]]
    df = spark.createDataFrame([(i, t, r.sample(["ab", "aba", "b a", "😀a", "  ", "ba\n", "zz"], r.randint(0, 4))) for i, t in enumerate(texts)], "i int, text string, said array<string>")
    words = F.transform("said", lambda w: F.struct(w.alias("text"), F.lit("name").alias("source"), F.lit(0).alias("rank")))
    want = critical.token_weights(critical.tokens_of(df, ["i"], "text"), critical.spans(df, ["i"], "text", words), ["i"]).select("i", "pos", "start", "end", "weight")
    got = critical.weighted_parts(df, ["i"], "text", words, held_rows=7)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().toString()
