"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case. Of each run of
`window` words the `gram`-word piece of least hash (leftmost on ties) is a fingerprint. A document and an item that
share `window` words select the same piece of them, so joining fingerprints finds every such span; each hit is then
extended: all windows around it are compared word by word, and words in equal windows are hit. Items of fewer words
than a window are one window, found by their whole hash.

Fingerprints of the corpus are only exploded and probed, never shuffled, while the items' side is under `broadcast_rows`
rows; beyond that the join shuffles both sides. Each hit is one row with the words around it, whatever the number of items
that have it, and the hit words of a document are the union of ranges in order.

A fingerprint is one long: 34 bits of hash over 30 bits of word position.

Cases: null text has no words; an item without words, or a null item id, never occurs; equal items each count; a row
with a null id is never hit; rows that share an id get the union of their hits; very long texts are one row of words each,
with at most one fingerprint a word; among equal hashes the leftmost counts; an empty table gives an empty result; other
columns, of whatever names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sized

BITS = 30
LOW = (1 << BITS) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text as they stand; an empty array for null."""
    parts = F.split(F.coalesce(text, F.lit("")), BREAK)
    skip = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    return F.slice(parts, skip, F.greatest(F.size(parts) - skip + 1 - F.when(F.element_at(parts, -1) == "", 1).otherwise(0), F.lit(0)))


def _hash(start: str, size: int) -> str:
    """Hash bits of `size` words from index `start` (from 0) of the array w, over the index."""
    return f"(xxhash64({', '.join(f'w[{start} + {i}]' for i in range(size))}) & {~LOW}L) | {start}"


def _bind(value: str, name: str, body: str) -> str:
    """body with name bound to value. A lambda's variable is evaluated once; a column used inside a lambda is not."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prints(gram: int, window: int) -> str:
    """Fingerprints of the word array w."""
    least = f"least({', '.join(f'h[i + {k}]' for k in range(window - gram + 1))})" if window > gram else "h[i]"
    grams = f"transform(sequence(0, size(w) - {gram}), i -> {_hash('i', gram)})"
    each = f"array_distinct(transform(sequence(0, size(w) - {window}), i -> {least}))"
    return f"if(size(w) >= {window}, {_bind(grams, 'h', each)}, cast(array() as array<bigint>))"


def _split(text: str) -> str:
    """The words of a text expression, as words()."""
    return _bind(f"split({text}, r'{BREAK}')", "s", "slice(s, if(s[0] = '', 2, 1), greatest(size(s) - if(s[0] = '', 1, 0) - if(element_at(s, -1) = '', 1, 0), 0))")


#: Words for hashing. A capital sigma's lower case depends on what stands around it, so it is replaced first: then equal words
#: with A-Z lowered are equal here. Different words may be too; the extension compares words as they are with A-Z lowered.
WORDS = _split("lower(replace(coalesce(text, ''), 'Σ', 'σ'))")
AS_THEY_STAND = _split("coalesce(text, '')")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items (sorted item ids as strings), contaminated."""
    scratch = Scratch(docs.sparkSession, "winnowing")
    prints, back = _prints(gram, window), window - gram
    test = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    test = scratch.save(test.withColumn("plain", F.transform(words(F.col("text")), lambda x: F.translate(x, UPPER, LOWER))).where("size(plain) > 0"), "items")
    short = sorted(r.n for r in test.select(F.size("plain").alias("n")).where(f"n < {window}").distinct().collect())  # at most window - 1 numbers
    whole = f"case {' '.join(f'when size(w) = {m} then array({_hash('0', m)})' for m in range(1, window))} else {prints} end"
    # an item's fingerprint with the item's words that windows around it can have; kind is the size of a short item, else 0
    side = test.select("item", "plain", F.explode(F.expr(_bind(WORDS, "w", whole))).alias("f")).selectExpr("item", "plain", f"cast(f & {LOW}L as int) as j", f"shiftright(f, {BITS}) as key", f"if(size(plain) < {window}, size(plain), 0) as kind")
    side = scratch.save(side.selectExpr("item", "kind", "key", "j", f"greatest(j - {back}, 0) as first", f"slice(plain, greatest(j - {back}, 0) + 1, j - greatest(j - {back}, 0) + {window}) as theirs"), "side")

    corpus = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # per document: the number of words (kind -1), fingerprints (0) and, for short items of m words, all hashes of m words (m)
    if short:
        parts = ["array(named_struct('kind', -1, 'v', cast(size(w) as bigint)))", f"transform({prints}, x -> named_struct('kind', 0, 'v', x))"]
        parts += [f"if(size(w) >= {m}, transform(sequence(0, size(w) - {m}), i -> named_struct('kind', {m}, 'v', {_hash('i', m)})), cast(array() as array<struct<kind: int, v: bigint>>))" for m in short]
        rows = corpus.select("doc", F.expr(f"inline({_bind(WORDS, 'w', f'concat({', '.join(parts)})')})"))
    else:
        rows = corpus.select("doc", F.expr(f"posexplode({_bind(WORDS, 'w', f'concat(array(cast(size(w) as bigint)), {prints})')}) as (p, v)")).select("doc", F.expr("if(p = 0, -1, 0)").alias("kind"), "v")
    few = side.limit(broadcast_rows + 1).count() <= broadcast_rows
    keys = side.selectExpr("key as k", "kind as item_kind").distinct()
    # the rows of kind -1 meet nothing; a key of their own keeps them from meeting in one task where this is shuffled
    rows = rows.withColumn("key", F.expr(f"if(kind = -1, xxhash64(doc, v), shiftright(v, {BITS}))"))
    found = rows.join(F.broadcast(keys) if few else keys, F.expr("kind = item_kind and key = k"), "left").where("kind = -1 or k is not null")
    found = scratch.save(found.selectExpr("doc", "kind", f"cast(if(kind = -1, v, v & {LOW}L) as int) as i", "key"), "found")
    counts = found.where("kind = -1").select(F.col("doc").alias(id_col), F.col("i").cast("long").alias("n_words"))

    # extension: the words around each hit against the items'; a document's hits are at most its words for each kind
    hits = found.where("kind >= 0 and doc is not null")
    near = corpus.where("text is not null").join(sized(scratch.save(hits.select("doc").distinct(), "hit-docs")), "doc", "left_semi")
    near = near.join(hits.groupBy("doc").agg(F.collect_set(F.struct("kind", "i", "key")).alias("hits")), "doc")
    part = f"slice(w, greatest(x.i - {back}, 0) + 1, x.i - greatest(x.i - {back}, 0) + {window})"
    cut = f"transform(hits, x -> struct(x.kind as kind, x.i as i, x.key as key, greatest(x.i - {back}, 0) as low, {part} as ours))"
    near = near.select("doc", F.expr(f"inline({_bind(AS_THEY_STAND, 'w', cut)})")).withColumn("ours", F.transform("ours", lambda x: F.translate(x, UPPER, LOWER)))
    pairs = near.join(F.broadcast(side) if few else side, ["kind", "key"])
    # starts s of equal windows in the item; all have the fingerprint in them, so their union is one range
    starts = f"""filter(sequence(first, j), s -> s - first + {window} <= size(theirs) and i - j + s >= low and i - j + s - low + {window} <= size(ours)
        and slice(ours, i - j + s - low + 1, {window}) = slice(theirs, s - first + 1, {window}))"""
    pairs = pairs.withColumn("s", F.expr(f"if(kind > 0, if(slice(ours, i - low + 1, kind) = theirs, array(j), array()), {starts})")).where("size(s) > 0")
    spans = scratch.save(pairs.selectExpr("doc", "item", "i - j + s[0] as low", f"i - j + element_at(s, -1) + if(kind > 0, kind, {window}) as high").distinct(), "spans")
    before = Window.partitionBy("doc").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spans.select("doc", "low", "high").distinct().withColumn("reach", F.coalesce(F.max("high").over(before), F.lit(0)))
    hit = ranges.groupBy("doc").agg(F.sum(F.expr("greatest(high - greatest(low, reach), 0)")).cast("long").alias("n_hit"))
    met = spans.select("doc", "item").distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = hit.join(met, "doc").select(F.col("doc").alias(id_col), "n_hit", "items")
    result = counts.join(both, id_col, "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return result.select(id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
