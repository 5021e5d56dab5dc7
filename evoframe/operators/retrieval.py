"""Text retrieval: BM25, tiered and keyword lookup, formatted results, chunks, nearest vectors."""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.sources.stored import shared_folder, stored

from . import vector_index
from .text_index import TextIndex, tokens as tokens

# Words that keyword lookup leaves out.
STOP_WORDS = ("a", "an", "the", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "with", "by", "from", "how", "can", "you", "i", "we", "they", "that", "this", "what", "when")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: Column, query_id: str, query_text: Column, k: int = 3, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, place): the k best documents of each query; ties and empty scores by document id.

    The documents are indexed once (see TextIndex, which can be kept and searched again). Repeated query tokens count
    repeatedly; documents of no score fill up a query's places.
    """
    index = TextIndex(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}")
    index.add(docs, doc_id, doc_text)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "d")).cast("long")
    best = stored(index.search(queries, query_id, query_text, k, k1, b).withColumn("place", place), "best")
    # where fewer than k documents score, all that do are among the best, and the first k documents can fill up
    first = docs.select(F.col(doc_id).alias("d")).orderBy("d").limit(k)
    open_ = queries.select(F.col(query_id).alias("q")).join(best.where(F.col("place") == k).select("q"), "q", "left_anti")
    fill = open_.crossJoin(F.broadcast(first)).join(best.select("q", "d"), ["q", "d"], "left_anti").withColumn("score", F.lit(0.0))
    found = best.drop("place").unionByName(fill).withColumn("place", place).where(F.col("place") <= k)
    return found.select(F.col("q").alias(query_id), F.col("d").alias(doc_id), "score", "place")


def keywords(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased words of over two characters that are not stop words; punctuation stays, repeats stay."""
    return F.filter(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), "\\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def relevance(text: Column, words: Column) -> Column:
    """How many of the words the lower-cased text contains as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.when(low.contains(w), 1).otherwise(0))


def keyword_top(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, k: int = 3, block: int = 200_000) -> DataFrame:
    """(query_id, doc_id, hits, place): documents that contain most keywords, zero ones left out, ties by document id.

    The distinct keywords make one automaton that passes over each text once; a task keeps k documents for each query. The
    queries go to the tasks in blocks of about `block` (query, keyword) rows. Queries of the same keywords are one, which
    their least id stands for until the end. Rows with a null id are left out.
    """
    every = queries.select(F.col(query_id).alias("id"), keywords(F.col(query)).alias("words")).where("id is not null")
    every = every.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("words")).where("size(words) > 0")
    every = stored(every, "every")
    alike = stored(every.groupBy("words").agg(F.min("id").alias("q")), "alike")
    asked = stored(alike.select("q", F.explode("words").alias("w")).groupBy("q", "w").agg(F.count(F.lit(1)).alias("times")), "asked")
    rows = docs.select(F.col(doc_id).alias("d"), F.lower(F.coalesce(text, F.lit(""))).alias("low")).where("d is not null")
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *rows.schema.fields]}
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow()
        parts.append(rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(own), k), f"q {kinds['q']}, d {kinds['d']}, hits long"))
    scored = functools.reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("hits"), "d"))
    best = scored.withColumn("place", place.cast("long")).where(F.col("place") <= k)
    told = best.join(alike, "q").join(every, "words")
    return told.select(F.col("id").alias(query_id), F.col("d").alias(doc_id), "hits", "place")


def _scan(asked: Broadcast, k: int, held_rows: int = 1 << 18):
    """A task's function from (d, low) to the k best documents (q, d, hits) of each query. A document adds a row for each
    query that it has a keyword of; what cannot be among a query's best any more is left out at once, and so is a document
    after k of its batch that have the same keywords and smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        table = asked.value
        if not table.num_rows:
            return
        names = table.column("q").unique()
        at = np.asarray(pc.index_in(table.column("q"), names).combine_chunks())
        times = np.asarray(table.column("times").combine_chunks())
        words = pc.dictionary_encode(table.column("w").combine_chunks())
        order = np.argsort(np.asarray(words.indices), kind="stable")
        cuts = np.searchsorted(np.asarray(words.indices)[order], np.arange(1, len(words.dictionary)))
        posts, find = np.split(order, cuts), ahocorasick.Automaton()
        for i, w in enumerate(words.dictionary.to_pylist()):
            find.add_word(w, i)
        find.make_automaton()
        least, best, held, size = np.zeros(len(names), np.int64), None, [], 0

        def settle() -> pa.Table:
            """The k best of what is held, and each query's bound."""
            rows = pa.concat_tables(([best] if best is not None else []) + held)
            rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("hits", "descending"), ("d", "ascending")]))
            q = np.asarray(rows.column("q"))
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = np.flatnonzero(place == k - 1)
            least[q[last]] = np.asarray(rows.column("hits"))[last]
            return rows.filter(pa.array(place < k))

        for b in batches:
            found_q, found_d, found_hits = [], [], []
            alike: Counter[frozenset] = Counter()
            for j in np.asarray(pc.sort_indices(b.column(0))).tolist():
                met = frozenset(w for _, w in find.iter(b.column(1)[j].as_py()))
                alike[met] += 1
                if met and alike[met] <= k:
                    rows = np.concatenate([posts[w] for w in met])
                    q, inverse = np.unique(at[rows], return_inverse=True)
                    hits = np.bincount(inverse, times[rows]).astype(np.int64)
                    live = hits >= least[q]
                    found_q.append(q[live])
                    found_hits.append(hits[live])
                    found_d.append(np.full(int(live.sum()), j))
            if found_q:
                ids = b.column(0).take(pa.array(np.concatenate(found_d)))
                held.append(pa.table({"q": np.concatenate(found_q), "d": ids, "hits": np.concatenate(found_hits)}))
                size += held[-1].num_rows
            if size >= held_rows:
                best, held, size = settle(), [], 0
        if held:
            best = settle()
        if best is not None:
            done = best.combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(done.column("q").combine_chunks()), done.column("d").combine_chunks(), done.column("hits").combine_chunks()], ["q", "d", "hits"])

    return run


def tiered(docs: DataFrame, queries: DataFrame, k: int = 3, text: str | None = None, query: str | None = None) -> DataFrame:
    """(query_id, idx, tier, place): for queries (query_id, name, module) the first tier that has documents (idx, name, module).

    Tiers: 1 name and module, 2 name, 3 modules that start with the first segment of the asked one, 4 most keywords of the
    column `query` in the documents' column `text`, if both are named. The best k of a tier in the order of idx, in tier 4
    by keywords first. Empty names and modules ask nothing. Of all documents that a tier gives to one question, only the
    first k are joined with those who ask it, so neither a frequent name nor a frequent question makes pairs of all. The
    third tier meets the documents' modules cut to the lengths that are asked.
    """
    d = docs.select("idx", "name", F.coalesce("module", F.lit("")).alias("module"))
    q = queries.select("query_id", F.col("name").alias("qn"), F.col("module").alias("qm")).where("query_id is not null")
    tier = lambda n: F.lit(n).alias("tier")

    def first(rows: DataFrame, *key: str) -> DataFrame:
        return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("idx"))).where(F.col("__r") <= k).drop("__r")

    both = first(d.where("module <> ''"), "name", "module").select(F.col("name").alias("qn"), F.col("module").alias("qm"), "idx")
    named = q.where("qn <> ''").join(both, ["qn", "qm"]).select("query_id", "idx", tier(1))
    named = named.unionByName(q.where("qn <> ''").join(first(d, "name").select(F.col("name").alias("qn"), "idx"), "qn").select("query_id", "idx", tier(2)))
    asked = q.where("qm <> ''").select("query_id", F.element_at(F.split("qm", "::"), 1).alias("head"))
    sizes = sorted(r.n for r in asked.select(F.length("head").alias("n")).distinct().collect())  # at most the longest name's length
    heads = d.select("idx", "module", F.explode(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>")).alias("n")).where("length(module) >= n")
    heads = heads.select("idx", F.substring("module", F.lit(1), F.col("n")).alias("head"))
    heads = first(heads.where("head <> ''").join(asked.select("head").distinct(), "head", "left_semi"), "head")
    found = named.unionByName(heads.join(asked.where("head <> ''"), "head").select("query_id", "idx", tier(3)))
    if 0 in sizes:  # a module that begins with :: has an empty first segment, with which every module starts
        found = found.unionByName(asked.where("head = ''").select("query_id").crossJoin(F.broadcast(d.select("idx").orderBy("idx").limit(k))).select("query_id", "idx", tier(3)))
    over = Window.partitionBy("query_id")
    best = found.withColumn("best", F.min("tier").over(over)).where("tier = best")
    best = best.withColumn("place", F.row_number().over(over.orderBy("idx")).cast("long")).where(F.col("place") <= k).select("query_id", "idx", F.col("tier").cast("long").alias("tier"), "place")
    if text is None or query is None:
        return best
    best = stored(best, "tiers")
    rest = queries.select("query_id", F.col(query).alias("asked")).join(best.select("query_id").distinct(), "query_id", "left_anti")
    words = keyword_top(docs.select("idx", F.col(text).alias("said")), rest, "idx", "said", "query_id", "asked", k)
    return best.unionByName(words.select("query_id", "idx", F.lit(4).cast("long").alias("tier"), "place"))


def search_text(*parts: str) -> Column:
    """What a document is searched in, or a query for: its parts with spaces between, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in parts])


def _line(label: str, value: Column, end: str = "\n") -> Column:
    """A labelled line, or nothing where the value is null or empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value, F.lit(end))).otherwise("")


def format_documents(found: DataFrame, query_id: str = "query_id", place: str = "place") -> DataFrame:
    """(query_id, text): the documents of each query as numbered text; source code only under 500 characters."""
    of = lambda c: F.coalesce(F.col(c), F.lit("N/A"))
    versions = F.when((F.coalesce("from_version", F.lit("")) != "") & (F.coalesce("to_version", F.lit("")) != ""), F.concat(F.lit("Version: "), "from_version", F.lit(" → "), "to_version", F.lit("\n"))).otherwise("")
    source = F.when(F.length("source_code") < 500, F.col("source_code"))
    one = F.concat(
        F.format_string("[Document %d]\n", F.row_number().over(Window.partitionBy(query_id).orderBy(place))), F.lit("API: "), of("name"), F.lit("\nModule: "), of("module"), F.lit("\nType: "), of("type"), F.lit("\n"),
        _line("Signature: ", F.col("signature")), _line("Documentation: ", F.col("documentation")), _line("Source Code:\n", source), versions,
    )
    return _joined(found, one, query_id, place, "\n")


def format_matches(found: DataFrame, query_id: str = "query_id", place: str = "place") -> DataFrame:
    """(query_id, text): the documents of a ranked search as numbered sections; long parts are cut, two examples at most."""
    of = lambda c: F.coalesce(F.col(c), F.lit(""))
    is_list = dict(found.dtypes)["examples"].startswith("array")
    bare = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")  # noqa: E731  # JSON of one value
    as_json = F.concat(F.lit("["), F.array_join(F.transform(F.slice("examples", 1, 2), bare), ", "), F.lit("]")) if is_list else bare(F.substring("examples", 1, 300))
    some = F.size("examples") > 0 if is_list else F.length("examples") > 0
    one = F.concat_ws(
        "\n", F.format_string("### Retrieved API [%d]: %s (%s)", F.row_number().over(Window.partitionBy(query_id).orderBy(place)), of("name"), of("module")),
        F.concat(F.lit("Signature: "), of("signature")), F.concat(F.lit("Version: "), of("from_version"), F.lit(" → "), of("to_version")), F.concat(F.lit("Change type: "), of("change_type")),
        F.when(of("documentation") != "", F.concat(F.lit("Documentation: "), F.substring("documentation", 1, 400))), F.when(of("description") != "", F.concat(F.lit("Description: "), F.substring("description", 1, 200))),
        F.when(some, F.concat(F.lit("Examples: "), F.substring(as_json, 1, 300))),
    )
    return _joined(found, one, query_id, place, "\n\n")


def _joined(found: DataFrame, one: Column, query_id: str, place: str, between: str) -> DataFrame:
    """A query's few texts in the order of their places."""
    parts = found.select(query_id, F.struct(F.col(place).alias("at"), one.alias("text")).alias("x"))
    return parts.groupBy(query_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), between).alias("text"))


def documents_for(docs: DataFrame, queries: DataFrame, k: int = 3, use_vectors: bool = False, **vectors: str) -> DataFrame:
    """(query_id, text) for all queries: formatted documents by tiers, or the nearest by vector.

    docs has idx, the parts that are formatted and those of search_text; queries have query_id, name, module and query. With
    use_vectors, docs and queries have a column `vector` too. Queries without documents say so.
    """
    if use_vectors:
        near = nearest(queries, docs, k, "query_id", "idx", vectors.get("query_vector", "vector"), vectors.get("vector", "vector"))
        found = near.select("query_id", "idx", "place")
    else:
        told = docs.withColumn("said", search_text("name", "module", "documentation", "query"))
        found = tiered(told, queries, k, "said", "query").select("query_id", "idx", "place")
    text = format_documents(found.join(docs.select("idx", "name", "module", "type", "signature", "documentation", "source_code", "from_version", "to_version"), "idx"))
    return queries.select("query_id").join(text, "query_id", "left").select("query_id", F.coalesce("text", F.lit("No relevant documentation found.")).alias("text"))


SEPARATORS = ("\n\n", "\n", " ", "")


def recursive_pieces(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[tuple[int, str]]:
    """(start, piece): the text cut at the first separator that it has, pieces that are still too long by the next one;
    neighbours are joined again up to `size`, each new piece beginning with up to `overlap` characters of the one before."""
    mark = next((m for m in separators if m == "" or m in text), "")
    finer = separators[separators.index(mark) + 1 :] if mark else ()
    spans: list[tuple[int, int]] = []  # pieces as ranges of the text; a separator begins its piece
    if mark:
        cuts = [m.start() for m in re.finditer(re.escape(mark), text) if m.start()]
        spans = list(zip([0, *cuts], [*cuts, len(text)]))
    else:
        spans = [(i, i + 1) for i in range(len(text))]
    out: list[tuple[int, str]] = []
    held: list[tuple[int, int]] = []

    def close() -> None:
        if held:
            whole = text[held[0][0] : held[-1][1]]
            if piece := whole.strip():
                out.append((held[0][0] + len(whole) - len(whole.lstrip()), piece))

    for low, high in spans:
        if high - low > size and finer:
            close()
            held = []
            out += [(low + at, piece) for at, piece in recursive_pieces(text[low:high], size, overlap, finer)]
            continue
        if held and high - held[0][0] > size:
            close()
            while held and (held[-1][1] - held[0][0] > overlap or high - held[0][0] > size):
                held.pop(0)
        held.append((low, high))
    close()
    return out


def recursive_chunks(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """df's other columns with start and chunk: pieces of at most `size` characters, cut at paragraphs, lines, words, letters."""
    rest = [c for c in df.columns if c != text]

    @F.pandas_udf("array<struct<start: long, chunk: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": i, "chunk": c} for i, c in recursive_pieces(t or "", size, overlap)])

    return df.select(*rest, F.explode(cut(F.col(text))).alias("x")).select(*rest, "x.start", "x.chunk")


def chunks(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """df's other columns with start and chunk: pieces of `size` characters every size - overlap, the last ending with the text."""
    step = size - overlap
    n = F.length(text)
    starts = F.when(n > size, F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int") * step, F.lit(step))).otherwise(F.array(F.lit(0)))
    rest = [c for c in df.columns if c != text]
    return df.where(n > 0).select(*rest, text, F.explode(starts).alias("start")).select(*rest, F.col("start").cast("long").alias("start"), F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def nearest(points: DataFrame, keys: DataFrame, k: int, point_id: str, key_id: str, vector: str, key_vector: str) -> DataFrame:
    """(point_id, key_id, dist, place): the k nearest keys of each point, ties by key id. The index of the keys can be kept
    and searched again (see vector_index)."""
    found = vector_index.search(points, vector_index.build(keys, key_id, key_vector), k, point_id, vector)
    return found.select(F.col("pid").alias(point_id), F.col("kid").alias(key_id), "dist", "place")
