"""Language identification by words first, then character n-grams.

Words are runs of letters with their combining marks, in Python's lower case, in training and prediction alike. A known word
scores its log frequency per language. An unseen word backs off: its longest character n-grams (with word
ends marked) that the model knows are averaged; if none of that length is known, the next shorter length is tried.
The model is fitted on a bounded sample of labelled rows: about `label_rows` of each label, those of smallest id hash, so
a rare language is learned as well as a common one. All words and n-grams of the sample are held.

Cases: a text that is null or has no letter is `und` with score 0; ties go to the language that sorts first; rows with a
null label or a null id are never learned from; without labelled rows every text is `und`. Repeated rows each get their
result; an empty table gives an empty result. Whole texts are read, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, returning, sized

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
CACHE = 60_000


class LanguageModel:
    """Log scores of words and n-grams per language, as tables of numbers beside the index of each."""

    def __init__(self, languages: list[str], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray], longest: int):
        self.languages, self.longest = languages, longest
        self.words, self.word_logs = {w: i for i, w in enumerate(words[0])}, words[1]
        self.grams, self.gram_logs = {g: i for i, g in enumerate(grams[0])}, grams[1]

    def word(self, w: str) -> np.ndarray:
        """Log score of a word in each language, relative to the mean over languages."""
        at = self.words.get(w)
        if at is not None:
            return self.word_logs[at]
        marked, find = f"^{w}$", self.grams.get
        for n in range(min(self.longest, len(marked)), 0, -1):
            known = [g for i in range(len(marked) - n + 1) if (g := find(marked[i : i + n])) is not None]
            if known:
                return self.gram_logs[known].mean(0) if len(known) > 1 else self.gram_logs[known[0]]
        return np.zeros(len(self.languages))


def _logs(table: pa.Table, languages: list[str], sums: dict) -> tuple[list[str], np.ndarray]:
    """The distinct texts of rows (l, w, n) and their log frequencies per language, less the mean over languages.
    sums: the total of each (language, length of the text), or of each language at length 0."""
    names = table.column("w").unique()
    at = np.asarray(pc.index_in(table.column("w"), names).combine_chunks())
    to = np.asarray(pc.index_in(table.column("l"), pa.array(languages, pa.string())).combine_chunks())
    counts = np.zeros((len(names), len(languages)))
    counts[at, to] = np.asarray(table.column("n").combine_chunks())
    texts = names.to_pylist()
    size = np.array([len(t) if ("", 0) not in sums else 0 for t in texts], np.int64)
    total = np.array([[sums.get((x, k), 0) for x in languages] for k in range(int(size.max(initial=0)) + 1)])
    if not len(texts):
        return texts, counts.astype(np.float32)
    logs = np.log((counts + 0.1) / (total[size] + 1.0))
    return texts, (logs - logs.mean(1, keepdims=True)).astype(np.float32)


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", label_rows: int = 1_000, longest: int = 5) -> LanguageModel:
    rows = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(label_col).cast("string").alias("l"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col)).alias("h"))
    # of each label the rows whose hash is under the share of all hashes that `label_rows` are of its rows
    labels = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    limits = labels.select("l", F.when(F.col("n") > label_rows, (F.lit(-(2.0**63)) + F.lit(2.0**64) * label_rows / F.col("n")).cast("long")).otherwise((1 << 63) - 1).alias("limit"))
    rows = rows.join(sized(Scratch(df.sparkSession, "labels").save(limits, "limits", 0)), "l").where(F.col("h") <= F.col("limit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        found: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                found.setdefault(lang.as_py(), Counter()).update(WORD.findall(text.as_py().lower()))
        for lang, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["l", "w", "n"])

    words = rows.select("l", "t").mapInArrow(returning(count), "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    words = Scratch(df.sparkSession, "words").save(words, "words")
    marked = F.concat(F.lit("^"), "w", F.lit("$"))
    grams = words.select("l", marked.alias("m"), "n", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k")).where("length(m) >= k")
    grams = grams.select("l", "n", F.explode(F.expr("transform(sequence(1, length(m) - k + 1), i -> substring(m, i, k))")).alias("w")).groupBy("l", "w").agg(F.sum("n").alias("n"))
    # the sample is bounded, and so are its words and n-grams
    words, grams = words.toArrow(), grams.toArrow()
    languages = sorted(x for x in words.column("l").unique().to_pylist())
    sums: dict = {("", 0): 0}
    for x, n in zip(*(words.column(c).to_pylist() for c in ("l", "n"))):
        sums[(x, 0)] = sums.get((x, 0), 0) + n
    by_length: dict = {}
    for x, w, n in zip(*(grams.column(c).to_pylist() for c in ("l", "w", "n"))):
        by_length[(x, len(w))] = by_length.get((x, len(w)), 0) + n
    return LanguageModel(languages, _logs(words, languages, sums), _logs(grams, languages, by_length), longest)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) with lang_pred and score added; any old ones of those names are replaced.

    score is the winner's share of exp(mean log score per word) over the languages.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("lang_pred", "score")]
    base = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = StructType([*base.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: label_rows texts of each label

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        n = len(model.languages)
        known, logs = model.words.get, model.word_logs
        # words that back off, in two generations: those met since the younger one began, and those met in the one before
        now: dict[str, np.ndarray] = {}
        before: dict[str, np.ndarray] = {}

        def unseen(w: str) -> np.ndarray:
            nonlocal now, before
            got = now.get(w)
            if got is None:
                got = before.get(w)
                now[w] = got = model.word(w) if got is None else got
                if len(now) > CACHE // 2:
                    now, before = {}, now
            return got

        for b in batches:
            texts, langs, scores = b.column(b.num_columns - 1), [], []
            for i in range(b.num_rows):
                text = texts[i].as_py()
                words = WORD.findall(text.lower()) if text else []
                if not n or not any(any(map(str.isalpha, w)) for w in words):
                    langs.append("und"), scores.append(0.0)
                    continue
                at = list(map(known, words))
                if None in at:
                    rare = [unseen(w) for w, x in zip(words, at) if x is None]
                    at = [x for x in at if x is not None]
                    total = np.sum(rare, 0, np.float64) + logs[at].sum(0, dtype=np.float64)
                else:
                    total = logs[at].sum(0, dtype=np.float64)
                mean = total / len(words)
                best = int(mean.argmax())
                langs.append(model.languages[best])
                scores.append(float(1 / np.exp(mean - mean[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text")).mapInArrow(returning(told), schema)


def learnable(id_col: str = "doc_id", folds: int = 4, held: int = 2) -> Column:
    """Rows outside the held-out fold: crc32 of the id's text mod folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held
