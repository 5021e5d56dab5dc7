"""N-gram Jaccard join on prefix trees.

A document is the set of hashes of its distinct k-word shingles, in one global order: the most frequent shingles first,
the rest by hash. Any order gives exact results; this one puts rare shingles at the far end, where the prefix filter
looks, so common passages make no candidates. Documents of equal word sequences are joined first and stand for one.

1. The n - ceil(t n) + 1 rarest shingles of each set are its prefix; sets that link share one of them at least.
2. In each prefix shingle's cell the rows are ordered by the number of rarer shingles before it; each is paired with its
   neighbour and the cell's first, which of copies with edits is the one that is edited least.
3. Pairs are verified in prefix trees: the partners of a set, in the order of their token sequences, are a depth-first
   walk of their trie. Overlaps of shared path starts are kept, and a subtree is left where the overlap so far plus what
   can follow is below what the sizes ask for.
4. Connected components of the links. Cells whose members are in one component need nothing more; in the others, pairs of
   different components are made where both sets have room left for the overlap that a link needs, if both are in as many
   such cells as a link needs, and are verified too. So every two sets that link are in one component in the end, without
   all pairs of a group of copies ever being made.

Cases: null, empty or blank texts have no shingle and link with nothing; fewer than k words make one shingle, the whole
sequence; a null id gets its set size and a null component; repeated ids are one node; very long texts are one set each,
cut out of the batch that they come in; an empty table gives an empty result; other columns, of whatever names, are
ignored. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, connected_components, mix, returning, sized, text_slices, utf8

U64 = np.uint64
TOP = U64(1 << 63)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the first word of each row (n + 1)."""
    n = len(data)
    space, bound = _SPACE[data], np.zeros(n + 1, bool)
    bound[at] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    start = np.flatnonzero(~space & (before | bound[:n]))
    end = np.flatnonzero(~space & (after | bound[1:])) + 1
    return Rolling(_LOWER[data]).spans(start, end), np.searchsorted(start, at)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, U64)
    np.cumsum(x, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


class Shingles:
    """The shingle hashes of a batch of texts, row by row, and a 128-bit key of each word sequence."""

    def __init__(self, column: pa.Array, k: int):
        words, at = word_hashes(*utf8(column))
        self.n_words = np.diff(at)
        place = np.arange(len(words), dtype=U64) - np.repeat(at[:-1], self.n_words).astype(U64)
        seat = mix(place + U64(1))
        self.key1, self.key2 = _sums(mix(words ^ seat), at), _sums(mix(words * U64(3) + seat), at)
        m = max(0, len(words) - k + 1)
        value = np.zeros(m, U64)
        for i in range(k):
            value += words[i : i + m] * U64(2 * i + 1) ** U64(7) * U64(0x9E3779B97F4A7C15) + (words[i : i + m] >> U64(7 + i))
        self.value, self.first, self.k = mix(value), at, k

    def row(self, i: int) -> np.ndarray:
        """The distinct shingles of row i."""
        n = int(self.n_words[i])
        if n >= self.k:
            return np.unique(self.value[self.first[i] : self.first[i] + n - self.k + 1])
        return mix(self.key1[i : i + 1] ^ mix(self.key2[i : i + 1] + U64(n))) if n else np.zeros(0, U64)


def ordered(row: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Set members as order keys: frequent ones by rank, then the others by hash; ascending."""
    if not len(heavy):
        return np.sort(row | TOP)
    at = np.minimum(np.searchsorted(heavy, row), len(heavy) - 1)
    keys = np.where(heavy[at] == row, rank[at], row | TOP)
    keys.sort()
    return keys


def frequent(texts: DataFrame, k: int, most: int, least: int = 3, flush: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and ranks of the `most` most frequent shingles: what several texts of one task share.

    It steers the order only; its size is bounded by `most`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            value, n = np.unique(np.concatenate(held), return_counts=True)
            value, n = value[n >= least], n[n >= least]
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

        held, size = [], 0
        for b in text_slices(batches, 0):
            s = Shingles(b.column(0), k)
            for i in range(b.num_rows):
                held.append(s.row(i))
                size += len(held[-1])
            if size > flush:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    found = texts.mapInArrow(returning(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(most).toArrow()
    token = found.column("token").to_numpy().view(U64)
    order = np.argsort(token)
    return token[order], order.astype(U64)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, max_frequent: int = 1 << 17) -> DataFrame:
    """One row per row of df: id_col, n_shingles, component_id (smallest id reachable by links, itself included)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "ngrams")
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sent = spark.sparkContext.broadcast(frequent(docs.select("text"), k, max_frequent))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = sent.value
        for b in text_slices(batches, 1):
            s = Shingles(b.column(1), k)
            size, parts = np.zeros(b.num_rows, np.int64), []
            for i in range(b.num_rows):
                row = ordered(s.row(i), heavy, rank)
                size[i] = n = len(row)
                parts.append(row[n - (n - -(-percent * n // 100) + 1) :][::-1] if n else row)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.key1.view(np.int64)), pa.array(s.key2.view(np.int64)), pa.array(size), prefix], ["doc", "key1", "key2", "n", "prefix"])

    signed = scratch.save(docs.mapInArrow(returning(sign), "doc long, key1 long, key2 long, n long, prefix array<long>"), "signed")
    real = signed.where("n > 0 and doc is not null")
    rows = signed.count()
    first = scratch.save(real.groupBy("key1", "key2").agg(F.min("doc").alias("rep")), "first", rows)
    # texts and prefixes stay where they are while the ids that choose among them can be sent to every task
    copies = scratch.save(real.select("doc", "key1", "key2").join(first, ["key1", "key2"]).where("doc <> rep").select("doc").distinct(), "copies", rows)
    kept = real.select("doc", "n", "prefix").join(sized(copies), "doc", "left_anti")
    cells = kept.select("doc", "n", F.posexplode("prefix").alias("pos", "token")).selectExpr("token", "doc", "shiftleft(n, 32) | pos as np")
    # the first of a cell has the fewest rarer shingles, so of copies with edits it is the one that is edited least
    window = "over (partition by token order by np & 4294967295L, shiftright(np, 32), doc)"
    cells = cells.selectExpr("token", "doc", "np", f"lag(struct(doc, np)) {window} as prev", f"lead(doc) {window} as next", f"first(struct(doc, np)) {window} as head").where("prev is not null or next is not null")
    whole = lambda x: f"named_struct('doc', {x}.doc, 'n', shiftright({x}.np, 32), 'pos', cast({x}.np & 4294967295L as int))"
    cells = cells.selectExpr("token", "doc", "shiftright(np, 32) as n", "cast(np & 4294967295L as int) as pos", f"if(prev is null, null, {whole('prev')}) as prev", f"{whole('head')} as head")
    shared = scratch.save(cells, "shared")
    def sized_alike(an: str, bn: str) -> str:
        return f"100 * least({an}, {bn}) >= {percent} * greatest({an}, {bn})"

    def least_shared(an: str, bn: str) -> str:
        """Two sets that link share this many prefix shingles at least: all those common to both within the prefix that
        ends first, which lacks at most what its set has alone."""
        overlap = f"(({percent} * ({an} + {bn}) + {99 + percent}) div {100 + percent})"
        return f"({overlap} + 1 - (({percent} * greatest({an}, {bn}) + 99) div 100))"

    near = shared.where("prev is not null").selectExpr("explode(array_distinct(array(prev, head))) as o", "doc", "n", "pos")
    near = near.where(sized_alike("o.n", "n")).where("o.doc <> doc").selectExpr("struct(o.n as n, o.doc as doc) as x", "struct(n, doc) as y").selectExpr("least(x, y) as x", "greatest(x, y) as y")
    # neighbours in few cells for their size are left to the pairs across components below
    near = near.groupBy("x", "y").agg(F.count(F.lit(1)).alias("met")).where(f"4 * met >= {least_shared('x.n', 'y.n')}").selectExpr("x.doc as a", "y.doc as b")
    pairs = scratch.save(near, "pairs")

    def sets(who: DataFrame, name: str, have: DataFrame | None = None) -> DataFrame:
        """(doc, set) of all documents of the pairs; those in `have` are not made again."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heavy, rank = sent.value
            for b in text_slices(batches, 1):
                s = Shingles(b.column(1), k)
                rows = [ordered(s.row(i), heavy, rank).astype(">u8").tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["doc", "set"])

        wanted = who.selectExpr("explode(array(a, b)) as doc").distinct()
        if have is not None:
            wanted = wanted.join(have.select("doc"), "doc", "left_anti")
        wanted = scratch.save(wanted, f"{name}-ids", rows)
        made = scratch.save(docs.join(sized(wanted), "doc", "left_semi").mapInArrow(returning(run), "doc long, set binary"), name)
        return made if have is None else made.unionByName(have)

    made = sets(pairs, "sets-1")
    links = scratch.save(verify(pairs, made, percent), "links-1")
    label = scratch.save(connected_components(links, scratch, "cc-1", rows), "label", rows)
    # cells whose members are of several components, and in how many of these a document is: a pair of different
    # components meets in no more of them than either is in
    placed = shared.select("token", "doc", "n", "pos").join(sized(label.withColumnRenamed("id", "doc")), "doc", "left").withColumn("c", F.coalesce("component", "doc")).drop("component")
    several = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    mixed = scratch.save(placed.join(several, "token", "left_semi"), "mixed")
    most = scratch.save(mixed.groupBy("doc").agg(F.count(F.lit(1)).alias("s")), "most")
    mixed = mixed.join(sized(most), "doc")
    x, y = mixed.alias("x"), mixed.alias("y")
    # the first shingle that a linking pair has in common leaves both sets room for the overlap: only there a pair is made
    overlap = f"(({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"
    first_in_common = f"x.pos <= x.n - {overlap} and y.pos <= y.n - {overlap}"
    across = x.join(y, F.expr(f"x.token = y.token and x.doc < y.doc and x.c <> y.c and {sized_alike('x.n', 'y.n')} and {first_in_common} and least(x.s, y.s) >= {least_shared('x.n', 'y.n')}"))
    across = across.select(F.expr("x.doc").alias("a"), F.expr("y.doc").alias("b")).distinct()
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = scratch.save(across.join(tried, ["a", "b"], "left_anti"), "pairs-2")
    if not more.isEmpty():
        links = links.unionByName(verify(more, sets(more, "sets-2", made), percent))
        label = connected_components(links, scratch, "cc-2", rows)
    scratch.drop("shared", "mixed", "sets-1", "pairs")
    label = label.withColumnRenamed("id", "rep")
    whole = first.join(label, "rep", "left").select("key1", "key2", F.coalesce("component", "rep").alias("component_id"))
    result = signed.drop("prefix").join(whole, ["key1", "key2"], "left")
    component = F.when(F.col("doc").isNull(), None).when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id"))
    return result.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int, salts: int = 16) -> DataFrame:
    """The pairs (a, b) that link: for each a, its partners' trie is walked with a's set."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))  # a hub's partners go to several tasks
    # the walks that a set takes part in: as the leader (role 0) or as a partner (role 1); a set moves once for each
    walks = dealt.selectExpr("b as doc", "a", "salt", "1 as role").unionByName(dealt.selectExpr("a as doc", "a", "salt", "0 as role").distinct())
    rows = sets.join(sized(walks), "doc").repartition("a", "salt").select("a", "salt", "role", "doc", "set").sortWithinPartitions("a", "salt", "role", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, trees = None, []  # of the leader, or of each of its texts where rows share its id
        for b in batches:
            found: list[tuple[int, int]] = []
            raw, at = utf8(b.column(4))
            for i, (a, salt, role, other) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
                tokens = raw[at[i] : at[i + 1]].view(">u8").astype(U64)
                if (a, salt) != walk:
                    walk, trees = (a, salt), []
                if role == 0:
                    trees.append(_Walk(tokens, percent))
                elif any([t.links(tokens) for t in trees]):
                    found.append((a, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(returning(run), "a long, b long")


class _Walk:
    """A depth-first walk over the trie of a leader's partners, with the overlap at each node of the path."""

    def __init__(self, own: np.ndarray, percent: int):
        self.own, self.percent = own, percent
        self.path, self.overlap = own[:0], np.zeros(1, np.int64)

    def links(self, tokens: np.ndarray) -> bool:
        own = self.own
        need = -(-self.percent * (len(own) + len(tokens)) // (100 + self.percent))
        m = min(len(self.path), len(tokens))
        differ = self.path[:m] != tokens[:m]
        shared = int(differ.argmax()) if differ.any() else m  # the depth where the walk leaves the last path
        so_far = int(self.overlap[shared])
        left = len(own) - int(np.searchsorted(own, tokens[shared - 1], "right")) if shared else len(own)
        if so_far + min(len(tokens) - shared, left) < need:
            self.path, self.overlap = tokens[:shared], self.overlap[: shared + 1]
            return False
        rest = tokens[shared:]
        at = np.minimum(np.searchsorted(own, rest), len(own) - 1)
        self.overlap = np.concatenate([self.overlap[: shared + 1], so_far + np.cumsum(own[at] == rest)])
        self.path = tokens
        return int(self.overlap[-1]) >= need
