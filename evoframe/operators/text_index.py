"""BM25 over a stored inverted index that is built once, added to, and searched often.

Documents are dealt to buckets of about BUCKET by their place; a row of the index is a term in a bucket, with the documents,
counts and lengths, and what bounds them: the largest count and the least length. Texts are read once, when they are added. A
search reads the rows of its terms only. A task scores one bucket against the queries, in pieces of bounded size, and keeps
k documents of each; buckets of which a query's bounds add up to less than its k-th best elsewhere are skipped for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evoframe.sources.folders import Numbered
from evoframe.sources.stored import stored

BUCKET = 1024
#: Cells of the matrix of scores that a task holds at once, and (query, term) rows that go to the tasks at once.
CELLS, ASKED = 2 << 20, 200_000
#: One of so many buckets is scored first, for the bounds of the others.
FIRST = 16


def tokens(text: Column) -> Column:
    """ASCII letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


class TextIndex:
    """An index in the folder `path`, in versions of which only whole ones are read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.posts, self.sizes = Numbered(spark, f"{path}/posts", "version"), Numbered(spark, f"{path}/sizes", "version")

    def add(self, docs: DataFrame, doc_id: str, text: Column, version: int | None = None) -> None:
        """Add documents as the next version, or in place of an earlier try of a version. What a version adds up to is written
        last; without it a version is not read."""
        version = max(self.sizes.folders(), default=-1) + 1 if version is None else version
        count = docs.count()
        rows = docs.select(F.col(doc_id).alias("d"), tokens(text).alias("w"), F.monotonically_increasing_id().alias("row"))
        # one shuffle: what is counted by (bucket, row, term) and then by (bucket, term) is dealt by the bucket already
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-count // BUCKET))))).repartition("bucket")
        words = dealt.select("bucket", "row", "d", F.size("w").alias("len"), F.explode("w").alias("t"))
        counts = words.groupBy("bucket", "row", "d", "len", "t").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        found = counts.groupBy("bucket", "t").agg(F.collect_list(F.struct("d", "tf", "len")).alias("p"), F.sum("tf").alias("total"), F.max("tf").alias("most"), F.min("len").alias("least"))
        found = found.select((F.lit(version << 32) + F.col("bucket")).alias("bucket"), "t", F.col("p.d").alias("d"), F.col("p.tf").alias("tf"), F.col("p.len").alias("len"), "total", "most", "least")
        self.posts.write(found.sortWithinPartitions("t"), version)
        written = self.spark.read.parquet(self.posts.folders()[version])
        self.sizes.write(written.agg(F.lit(count).cast("long").alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("tokens")), version)

    def _posts(self) -> DataFrame:
        kept, found = self.sizes.folders(), self.posts.folders()
        return self.spark.read.parquet(*(found[i] for i in sorted(kept)))

    def search(self, queries: DataFrame, query_id: str, query: Column, k: int = 3, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(q, d, score): the k documents of the largest score for each query, ties by document; those of no score are not
        there. A token that a query repeats counts repeatedly."""
        count, total = self.sizes.read().agg(F.sum("docs"), F.sum("tokens")).first()
        posts, mean = self._posts(), total / max(1, count)
        asked = queries.select(F.col(query_id).alias("q"), F.explode(tokens(query)).alias("t")).where("q is not null").groupBy("q", "t").agg(F.count(F.lit(1)).alias("times"))
        known = posts.select("t", F.size("d").alias("n")).join(asked.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.sum("n").alias("df"))
        idf = F.ln((F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        asked = stored(asked.join(known, "t").select("q", "t", (F.col("times") * idf * (k1 + 1)).alias("w")))
        kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields} | {"d": posts.schema["d"].dataType.elementType.simpleString()}
        schema = f"q {kinds['q']}, d {kinds['d']}, score double"
        blocks = max(1, -(-asked.count() // ASKED))
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "d"))
        found = []
        for i in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)
            live = posts.join(own.select("t").distinct(), "t", "left_semi").select("bucket", "t", "d", "tf", "len", "most", "least")
            table = own.toArrow()
            score = lambda rows, least: rows.groupBy("bucket").applyInArrow(_scorer(self.spark, table, least, k, k1, b, mean), schema)  # noqa: B023, E731
            first = stored(score(live.where(F.col("bucket") % FIRST == 0), None))
            bound = first.withColumn("place", place).where(F.col("place") == k).select("q", F.round("score", 9).alias("bound")).toArrow()
            found += [first, score(live.where(F.col("bucket") % FIRST != 0), bound)]
        best = found[0]
        for more in found[1:]:
            best = best.unionByName(more)
        return best.withColumn("place", place).where(F.col("place") <= k).select("q", "d", "score")


def _scorer(spark: SparkSession, asked: pa.Table, bounds: pa.Table | None, k: int, k1: float, b: float, mean: float) -> Callable[[pa.Table], pa.Table]:
    """A task's function from the rows of one bucket to the k best documents (q, d, score) of each query."""
    shared = spark.sparkContext.broadcast((asked, bounds))

    def pieces(width: int, total: int) -> Iterator[tuple[int, int]]:
        step = max(1, CELLS // max(1, width))
        for i in range(0, total, step):
            yield i, min(total, i + step)

    def run(bucket: pa.Table) -> pa.Table:
        asked, bounds = shared.value
        names = asked.column("q").unique()
        q = np.asarray(pc.index_in(asked.column("q"), names).combine_chunks())
        at = pc.index_in(asked.column("t").combine_chunks(), bucket.column("t").combine_chunks())
        term, w = np.asarray(at.fill_null(-1)), np.asarray(asked.column("w"))
        q, term, w = q[term >= 0], term[term >= 0], w[term >= 0]
        impact = lambda tf, size: tf / (tf + k1 * (1 - b + b * size / max(mean, 1e-300)))
        least = np.zeros(len(names))
        if bounds is not None and bounds.num_rows:
            least[np.asarray(pc.index_in(bounds.column("q"), names).combine_chunks())] = np.asarray(bounds.column("bound"))
            top = impact(np.asarray(bucket.column("most"), float), np.asarray(bucket.column("least"), float))
            may = np.bincount(q, w * top[term], len(names)) + 1e-8 >= least
            q, term, w = q[may[q]], term[may[q]], w[may[q]]
        columns = {c: bucket.column(c).combine_chunks() for c in ("d", "tf", "len")}
        starts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(columns["d"])))])
        ids = columns["d"].flatten().dictionary_encode()
        slot, known = np.asarray(ids.indices.fill_null(len(ids.dictionary))), ids.dictionary
        has_null = bool(ids.indices.null_count)
        share = impact(np.asarray(columns["tf"].flatten(), float), np.asarray(columns["len"].flatten(), float))
        width = len(known) + has_null
        rank = np.empty(width, np.int64)  # documents in the order of their ids, null first
        order = np.asarray(pc.sort_indices(known))
        rank[order] = np.arange(len(known)) + has_null
        if has_null:
            rank[len(known)] = 0
        out_q, out_d, out_s = [], [], []
        by_term = np.lexsort((q, term))
        q, term, w = q[by_term], term[by_term], w[by_term]
        for low, high in pieces(width, len(names)):
            mine = (q >= low) & (q < high)
            if not mine.any():
                continue
            scores = np.zeros((high - low, width))
            heads = np.flatnonzero(np.diff(term[mine], prepend=-1))
            for i, j in zip(heads, [*heads[1:], mine.sum()]):
                t = term[mine][i]
                cells = slice(starts[t], starts[t + 1])
                scores[np.ix_(q[mine][i:j] - low, slot[cells])] += np.outer(w[mine][i:j], share[cells])
            rounded = np.round(scores, 9)
            if width > 4 * k:
                cut = np.partition(rounded, width - k, 1)[:, width - k]
                rows, docs = np.nonzero((rounded >= cut[:, None]) & (scores > 0))
            else:
                rows, docs = np.nonzero(scores > 0)
            best = np.lexsort((rank[docs], -rounded[rows, docs], rows))
            rows, docs = rows[best], docs[best]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, docs = rows[place < k], docs[place < k]
            out_q.append(rows + low)
            out_d.append(docs)
            out_s.append(scores[rows, docs])
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        docs = joined(out_d, np.int64)
        taken = known.take(pa.array(docs, mask=docs == len(known))) if len(known) else pa.nulls(len(docs), known.type)
        return pa.table({"q": names.take(pa.array(joined(out_q, np.int64))), "d": taken, "score": pa.array(joined(out_s, float))})

    return run
