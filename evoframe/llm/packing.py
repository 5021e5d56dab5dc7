"""Packing by power-of-two decomposition.

A document of n tokens is cut into full pieces of `max_length` and then into the binary digits of the rest, largest
first. Equal lengths share a bucket and each piece is a sequence of its own, so no sequence crosses documents and none
is padded. Sequence ids are dense, bucket after bucket: each task numbers its pieces of each length as it makes them, and
running sums over the counts per (length, task) place them, so no piece is sorted or shuffled for its number. Pieces are
stored before they are counted, so a task that is run again cannot number them anew.

Cases: null text is empty and has only the end token; very long texts are tokenised in pieces that end where the
tokeniser's own pre-tokens end; repeated rows are separate documents; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, returned_memory, sized

#: The pre-token pattern of byte-level BPE vocabularies of this family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, task long, row long"
_SPACED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
CACHE = 500_000


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in such a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _words(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit words."""
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class CachedEncoder:
    """Token ids of whole texts, by way of their space-separated chunks.

    A pre-token never spans the place before a space that follows a non-space, so ids of the chunks cut there are the
    ids of the text. Chunks are cached; new ones go through the vocabulary's merges. The fast encoder is built from
    the same vocabulary file and is used only if it agrees with the file's own tokenizer on a probe. A text that holds an
    added token of the file, as its end mark, goes through the file's own tokenizer as a whole, which gives that token's id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.own.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.encode = self._slow
        try:
            import tiktoken

            stand_in = _byte_chars()
            with open(path, encoding="utf-8") as f:
                vocab = json.load(f)["model"]["vocab"]
            ranks = {bytes(stand_in[c] for c in token): i for token, i in vocab.items() if all(c in stand_in for c in token) and i < 50256}
            fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            probe = "Les élèves n'ont pas  vu\n\n the 123rd Straße; ¿qué?\t <|end|> 漢字  x ½ don't"
            if fast.encode_ordinary(probe) == self._slow(probe):
                self.encode = fast.encode_ordinary
        except (ImportError, KeyError, ValueError):
            pass
        self.cache: dict[str, bytes] = {}

    def _slow(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.added and self.added.search(text):
            return np.array(self._slow(text), "<u4")
        if _SPACED.search(text) or text[0] == " ":
            first, *chunks = _CUT.split(text)
            chunks = [c[1:] for c in chunks]
        else:
            first, *chunks = text.split(" ")
        cache, encode = self.cache, self.encode
        if len(cache) > CACHE:
            cache.clear()
        got = list(map(cache.get, chunks))  # keyed without the space before
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    c = chunks[i]
                    x = cache.get(c)
                    if x is None:
                        x = _words(encode(" " + c))
                        if len(c) < 64:
                            cache[c] = x
                    got[i] = x
        return np.frombuffer(_words(encode(first)) + b"".join(got), "<u4")


def binary_pieces(n: int, max_length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    full, rest = divmod(n, max_length)
    pieces = [(i * max_length, max_length) for i in range(full)]
    start = full * max_length
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            pieces.append((start, 1 << bit))
            start += 1 << bit
    return pieces


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _rows(path: str | Callable[[], str], end_id: int, max_length: int, crc: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with returned_memory():
            yield from cut(batches)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = CachedEncoder(path if isinstance(path, str) else path()), TaskContext.get().partitionId()
        made: dict[int, int] = {}  # pieces of each length so far
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encoder.ids(text or ""), np.array(end_id, "<u4"))
                    for start, length in binary_pieces(len(ids), max_length):
                        raw = ids[start : start + length].tobytes()
                        rows.append((doc, start, length, zlib.crc32(raw) if crc else raw, len(ids), task, made.setdefault(length, 0)))
                        made[length] += 1
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 and not crc else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "start", "length", "ids_crc32" if crc else "ids", "doc_tokens", "task", "row"])

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int = 2048, end_id: int = 1, tokenizer: str | Callable[[], str] = tokenizer_path, digest: bool = False) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit; with digest=True ids_crc32 instead), doc_tokens, sequence_id, offset."""
    if max_length & (max_length - 1):
        raise ValueError("max_length has to be a power of two")
    scratch = Scratch(df.sparkSession, "packing")
    schema = PIECES.replace("ids binary", "ids_crc32 long") if digest else PIECES
    pieces = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_rows(tokenizer, end_id, max_length, digest), schema)
    pieces = scratch.save(pieces, "pieces")
    sizes = pieces.groupBy("length", "task").agg(F.max("row").alias("n"))  # a row for each length and task
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("n", F.col("n") + 1)
    longer = sizes.groupBy("length").agg(F.sum("n").alias("n")).select("length", before(Window.orderBy(F.desc("length"))).alias("longer"))  # a row for each length
    first = sizes.select("length", "task", before(Window.partitionBy("length").orderBy("task")).alias("first")).join(F.broadcast(longer), "length")
    numbered = pieces.join(sized(scratch.save(first.select("length", "task", (F.col("first") + F.col("longer")).alias("first")), "first", 0)), ["length", "task"])
    value = "ids_crc32" if digest else "ids"
    return numbered.select("doc_id", "start", "length", value, "doc_tokens", (F.col("first") + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
