"""Similarity of code texts: weighted n-gram F1, sentence BLEU, syntax and data-flow match."""

from __future__ import annotations

import ast
import difflib
import io
import keyword
import math
import re
import tokenize
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Without white space around it, with \\n line ends."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"(?U)^\s+|\s+$", "")


def grams(tokens: Column | str, n: int) -> Column:
    """The n-grams of a token array as strings; none if it is shorter."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(t, i, n), "\x01"))


def gram_f1(df: DataFrame, key: Sequence[str], left: str, right: str, n: int, weight=None) -> DataFrame:
    """(key..., f1) of the (weighted) n-gram multisets of two token arrays; 0 where none is shared."""
    w = weight or (lambda g: F.lit(1.0))
    both = df.select(*key, grams(left, n).alias("a"), grams(right, n).alias("b"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, g: s + w(g))
    once = F.array_intersect(F.col("a"), F.col("b"))
    count = lambda c, g: F.size(F.filter(c, lambda x: x == g))
    shared = F.aggregate(once, F.lit(0.0), lambda s, g: s + w(g) * F.least(count(F.col("a"), g), count(F.col("b"), g)))
    whole = total(F.col("a")) + total(F.col("b"))
    return both.select(*key, F.when(whole > 0, 2 * shared / whole).otherwise(0.0).alias("f1"))


# A token that is not a keyword counts for this much.
PLAIN_WEIGHT = 0.2
# Fixed value: the tokens of a text that Python's own tokenizer refuses.
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|==|!=|<=|>=|:=|->|[-+*/%<>{}()[\].,:=]")


def python_tokens(code: str) -> list[str]:
    """Python's own tokens, or words and signs where the text is not Python."""
    skip = {tokenize.ENCODING, tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.COMMENT}
    try:
        return [t.string for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type not in skip]
    except (tokenize.TokenError, SyntaxError):
        return _TOKEN.findall(code)


def _counts(tokens: list[str], n: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def _weight(gram: tuple[str, ...]) -> float:
    """The mean weight of an n-gram's tokens: 1 for keywords, PLAIN_WEIGHT for the others."""
    return sum(1.0 if keyword.iskeyword(t) else PLAIN_WEIGHT for t in gram) / len(gram)


def weighted_ngram(candidate: list[str], reference: list[str]) -> float:
    """Mean over n = 1..4 of the F1 of n-grams by weight, times 100."""
    scores = []
    for n in range(1, 5):
        a, b = _counts(candidate, n), _counts(reference, n)
        both, whole = (sum(c * _weight(g) for g, c in x.items()) for x in (a & b, a + b))
        scores.append(2 * both / whole if a and b else 0.0)
    return 100 * sum(scores) / 4


def sentence_bleu(candidate: list[str], reference: list[str]) -> float:
    """BLEU of one pair, times 100: orders up to the candidate's length; a zero count after the first is smoothed by halves."""
    logs, smooth = [], 1.0
    for n in range(1, 5):
        a, b = _counts(candidate, n), _counts(reference, n)
        total = sum(a.values())
        if not total:
            break
        hit = sum(min(c, b[g]) for g, c in a.items())
        if not hit:
            smooth *= 2
            logs.append(math.log(100 / (smooth * total)))
        else:
            logs.append(math.log(100 * hit / total))
    if not logs or not sum((_counts(candidate, 1) & _counts(reference, 1)).values()):
        return 0.0
    brevity = min(1.0, math.exp(1 - len(reference) / len(candidate)))
    return brevity * math.exp(sum(logs) / len(logs))


def _kinds(code: str) -> list[str]:
    """Names of the syntax nodes, depth first, each before its children."""
    found, open_ = [], [ast.parse(code)]
    while open_:
        node = open_.pop()
        found.append(type(node).__name__)
        open_ += reversed(list(ast.iter_child_nodes(node)))
    return found


def syntax_match(candidate: str, reference: str) -> float:
    """Ratio of the sequences of syntax-node names, times 100; 0 where either is not Python. The matcher's ratio depends on
    the order of its arguments; the reference comes first."""
    try:
        a, b = _kinds(candidate), _kinds(reference)
    except (SyntaxError, ValueError):
        return 0.0
    return 100 * difflib.SequenceMatcher(None, b, a).ratio()


#: Per statement: the kind of its edges, and the parts that values come from and that names are bound in.
_FLOWS = {
    ast.Assign: ("assign", lambda n: [n.value], lambda n: [n]), ast.AnnAssign: ("ann_assign", lambda n: [n.value], lambda n: [n.target]),
    ast.AugAssign: ("aug_assign", lambda n: [n.value, n.target], lambda n: [n.target]), ast.For: ("for", lambda n: [n.iter], lambda n: [n.target]),
    ast.withitem: ("with", lambda n: [n.context_expr], lambda n: [n.optional_vars]),
}


def data_flow(code: str) -> set[tuple[str, str, str]]:
    """(from, to, kind): names whose values flow into bound names, and into what is returned. Only names that are stored
    are targets, so `a[i] = x` has none. Loops and contexts of coroutines are left out."""

    def names(parts: list[ast.AST | None], stored: bool = False) -> set[str]:
        return {x.id for p in parts if p is not None for x in ast.walk(p) if isinstance(x, ast.Name) and (not stored or isinstance(x.ctx, ast.Store))}

    edges: set[tuple[str, str, str]] = set()
    tree = ast.parse(code)
    coroutine = {id(i) for n in ast.walk(tree) if isinstance(n, ast.AsyncWith) for i in n.items}
    for node in ast.walk(tree):
        if type(node) in _FLOWS and id(node) not in coroutine:
            kind, sources, targets = _FLOWS[type(node)]
            edges |= {(s, t, kind) for t in names(targets(node), True) for s in names(sources(node))}
        elif isinstance(node, ast.Return):
            edges |= {(s, "<return>", "return") for s in names([node.value])}
    return edges


def _set_f1(a: set, b: set) -> float:
    return 200 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def flow_match(candidate: str, reference: str) -> float:
    """F1 of data-flow edges, times 100; of token sets where neither has any."""
    try:
        a, b = data_flow(candidate), data_flow(reference)
    except (SyntaxError, ValueError):
        return 0.0
    return _set_f1(a, b) if a or b else _set_f1(set(python_tokens(candidate)), set(python_tokens(reference)))


def code_bleu(df: DataFrame, candidate: str, reference: str, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """df with bleu, ngram, syntax, flow (0 to 100 each) and their weighted total, code_bleu."""

    @F.pandas_udf("bleu double, ngram double, syntax double, flow double")
    def scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            s, t = python_tokens(x), python_tokens(y)
            rows.append((sentence_bleu(s, t), weighted_ngram(s, t), syntax_match(x, y), flow_match(x, y)))
        return pd.DataFrame(rows, columns=["bleu", "ngram", "syntax", "flow"])

    made = df.withColumn("__s", scores(normalise(F.col(candidate)), normalise(F.col(reference)))).select(*df.columns, "__s.*")
    parts = ["bleu", "ngram", "syntax", "flow"]
    return made.withColumn("code_bleu", sum((F.col(p) * w for p, w in zip(parts, weights)), F.lit(0.0)))


def corpus_code_bleu(df: DataFrame, candidate: str, reference: str, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """One row: the means of the four scores over all pairs, 0 where there is none, and their weighted total."""
    parts = ["bleu", "ngram", "syntax", "flow"]
    means = code_bleu(df, candidate, reference, weights).agg(*[F.coalesce(F.avg(p), F.lit(0.0)).alias(p) for p in parts])
    return means.withColumn("code_bleu", sum((F.col(p) * w for p, w in zip(parts, weights)), F.lit(0.0)))


def _is_python(code: str) -> bool:
    try:
        ast.parse(code)
    except (SyntaxError, ValueError):
        return False
    return True


def detect_language(df: DataFrame, text: str, order: str, most: int = 10) -> DataFrame:
    """One row, language: python if at least half (rounded down, one at least) of the first `most` texts that are not blank parse, else null."""
    parses = F.pandas_udf(lambda s: s.map(_is_python), "boolean")
    told = df.select(order, normalise(F.col(text)).alias("t")).orderBy(order).limit(most).where("t <> ''").select(parses("t").alias("ok"))
    n, good = F.count(F.lit(1)), F.count_if("ok")
    return told.agg(F.when((n > 0) & (good >= F.greatest(F.lit(1), F.floor(n / 2))), "python").alias("language"))


def perplexity(logp: Column) -> Column:
    """exp(-sum log p / (n + 1)): all input tokens count, one more than are scored."""
    return F.exp(-F.sum(logp) / (F.count(F.lit(1)) + 1))
