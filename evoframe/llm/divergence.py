"""How far the sources of a language differ in their words, by joint count histograms.

Terms are runs of letters and of characters beyond ASCII, of which only A to Z are lower-cased. A language keeps the terms
that at least `least` of its documents hold. In a group (lang, source), and in a whole language, a kept term that occurs
`count` times has p = 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)), N being the group's occurrences of kept terms and
V their number in the language: whole numbers, so every result is exact.

Two sources differ by the sum of |p - q| over all kept terms. As p depends on the count alone, each pair of sources needs
only its joint histogram: how many terms have the counts (a, b). Terms that both sources hold are tallied together; those
that one or both lack are implied: the histogram of one source alone less what was tallied with it gives the cells (a, 0),
and the number of kept terms the cell (0, 0). |p - q| is then worked out once per cell and multiplied by its tally.

Scale: words are summed up in each task before any shuffle, so a hot source is rows of terms at most. To tally, sources
are dealt to blocks of about BLOCK and terms to buckets of about TERMS; a task gets the counts of two blocks in one bucket,
which is bounded, and a row of counts goes to as many tasks as there are blocks, not to every other source. The result
itself has a row per pair of sources.

Cases: null text, language or source is an empty one; a group without terms is there, with count 0 for each kept term; with
no kept terms all values are 0; repeated rows and ids count as documents each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, PRIOR = 1_000_000_000, 5
#: Sources and terms that one task of the tally gets, about.
BLOCK, TERMS = 64, 512
CELLS = "lang string, a string, b string, ca long, cb long, m long"


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a term; decimals, as the product passes 64 bits from some 10^10 occurrences on."""
    wide = (F.lit(PRIOR) + count).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + F.lit(PRIOR) * terms).cast("decimal(19,0)")) + F.lit(1)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, d documents)."""
    words = F.regexp_extract_all(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(TERM), 0)
    # every word once for n, and every different word of a document once more for d
    sides = F.array(F.struct(F.lit(0).alias("d"), F.col("w").alias("w")), F.struct(F.lit(1).alias("d"), F.array_distinct("w").alias("w")))
    rows = docs.select("lang", "source", words.alias("w")).select("lang", "source", F.explode(sides).alias("x")).select("lang", "source", "x.d", F.explode("x.w").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum(F.lit(1) - F.col("d")).alias("n"), F.sum("d").alias("d"))


def _joint(table: pa.Table) -> pa.Table:
    """Cells (ca, cb) of all pairs of sources of two blocks, over the terms that both hold in one bucket."""
    lang, i, j = (table.column(x)[0].as_py() for x in ("lang", "i", "j"))
    source, term = (pc.dictionary_encode(table.column(x).combine_chunks()) for x in ("source", "term"))
    levels, level = np.unique(np.asarray(table.column("n")), return_inverse=True)
    grid = np.full((len(source.dictionary), len(term.dictionary)), -1, np.int64)
    grid[np.asarray(source.indices), np.asarray(term.indices)] = level
    block = np.zeros(len(grid), np.int64)
    block[np.asarray(source.indices)] = np.asarray(table.column("block"))
    names = source.dictionary.to_pylist()
    order = sorted(range(len(names)), key=lambda x: names[x].encode())
    out: list[tuple[str, str, np.ndarray, np.ndarray, np.ndarray]] = []
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            if i != j and block[a] == block[b]:
                continue  # tallied where the block meets itself
            both = (grid[a] >= 0) & (grid[b] >= 0)
            cell, m = np.unique(grid[a][both] * len(levels) + grid[b][both], return_counts=True)
            out.append((names[a], names[b], levels[cell // len(levels)], levels[cell % len(levels)], m))
    pair = pa.array(np.repeat(np.arange(len(out)), [len(o[4]) for o in out]))
    side = lambda k: pa.array([o[k] for o in out], pa.string()).take(pair)
    column = lambda k: np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64)
    return pa.table({"lang": pa.array([lang] * len(pair), pa.string()), "a": side(0), "b": side(1), "ca": column(2), "cb": column(3), "m": column(4)})


def joint_histograms(kept: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, m): m kept terms occur ca times in source a and cb times in b, cells with a zero included."""
    size = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.ceil(F.max("terms") / TERMS).alias("buckets"))
    rows = kept.select("lang", "source", "term", "n").join(size, "lang")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")).withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "bucket", "block", "source", "term", "n")
    held = rows.groupBy("lang", "i", "j", "bucket").applyInArrow(_joint, CELLS)
    zero = F.lit(0).cast("long")
    cell = lambda a, b, m: F.struct(a.alias("ca"), b.alias("cb"), m.alias("m"))
    ca, cb, m = F.col("ca"), F.col("cb"), F.col("m")
    met = held.select("lang", "a", "b", F.explode(F.array(cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m))).alias("x"))
    alone = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    n = F.col("n")
    left = pairs.select("lang", "a", "b").join(alone.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", cell(n, zero, m).alias("x"))
    right = pairs.select("lang", "a", "b").join(alone.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", cell(zero, n, m).alias("x"))
    lacked = pairs.select("lang", "a", "b", cell(zero, zero, F.col("terms") - F.col("ha") - F.col("hb")).alias("x"))
    cells = met.unionByName(left).unionByName(right).unionByName(lacked).select("lang", "a", "b", "x.*")
    return cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: the sum of |p - q| to each other source of the language, ranked.
    Part `term`: of the kept terms that the group holds with a larger p than the whole language, the `top` largest p - q."""
    scratch = Scratch(docs.sparkSession, "divergence")
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    word = Window.partitionBy("lang", "term")
    kept = scratch.save(term_counts(docs), "counts").withColumns({"docs": F.sum("d").over(word), "whole": F.sum("n").over(word), "first": F.row_number().over(word.orderBy("source"))})
    kept = scratch.save(kept.where(F.col("docs") >= least).select("lang", "source", "term", "n", "whole", (F.col("first") == 1).cast("long").alias("first")), "kept")
    # Of a group: all its occurrences and the kept terms that it holds; of the language: all occurrences and kept terms.
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"), F.sum("first").alias("terms"))
    none = docs.groupBy("lang", "source").agg(*(F.lit(0).cast("long").alias(c) for c in ("total", "held", "terms")))
    groups = sums.unionByName(none).groupBy("lang", "source").agg(*(F.sum(c).alias(c) for c in ("total", "held", "terms")))
    lang = Window.partitionBy("lang")
    groups = scratch.save(groups.select("lang", "source", "total", "held", F.sum("terms").over(lang).alias("terms"), F.sum("total").over(lang).alias("all")), "groups")

    one = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("na"), F.col("held").alias("ha"), "terms")
    two = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("nb"), F.col("held").alias("hb"))
    pairs = scratch.save(one.join(two, "lang").where("a < b"), "pairs")
    f = F.abs(share(F.col("ca"), F.col("na"), F.col("terms")) - share(F.col("cb"), F.col("nb"), F.col("terms")))
    values = joint_histograms(kept, pairs, groups).join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(f * F.col("m")).alias("value"))
    values = pairs.select("lang", "a", "b").join(values, ["lang", "a", "b"], "left")
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = values.select("lang", ways.alias("x"), F.coalesce("value", F.lit(0)).cast("long").alias("value")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("whole"), F.col("all"), F.col("terms"))
    term = kept.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = term.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(ranked)).unionByName(term)
