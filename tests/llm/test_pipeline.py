"""The pipeline's stages, each against a brute-force version of it on what its predecessor kept."""

import os

import numpy as np
import pytest

import corpus_pipeline
from evoframe.llm import packing

from .test_operators import brute_jaccard, brute_leaks

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def brute_cut(rows, length=100):
    """Texts without the bytes that a string of `length` bytes covers which starts earlier too."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                hit[k : k + length] = b"\1" * length
            seen.add(s)
        left = bytes(c for c, h in zip(b, hit) if not h).decode("utf-8", "ignore")
        if not any(hit) or left.strip(" "):
            out[i] = left
    return out


def test_stages(spark):
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_strings", "decontamination", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "x", 0), (10_002, "12 34", "en", "x", 5)], docs.select(*corpus_pipeline.COLUMNS).schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    now = docs.select(*corpus_pipeline.COLUMNS).unionByName(odd)
    now = corpus_pipeline.identify_language(spark, now, DATA).persist()
    assert now.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in now.collect()} == set(texts)  # all clean documents stay, the two odd ones go
    now = corpus_pipeline.drop_near_duplicates(spark, now, DATA).persist()
    want = {i: texts[i] for i, (_, c) in brute_jaccard(texts.items()).items() if i == c}
    assert {r.doc_id: r.text for r in now.collect()} == want and now.columns == corpus_pipeline.COLUMNS
    now = corpus_pipeline.cut_repeats(spark, now, DATA).persist()
    want = brute_cut(want.items())
    assert {r.doc_id: r.text for r in now.collect()} == want and now.columns == corpus_pipeline.COLUMNS
    now = corpus_pipeline.drop_contaminated(spark, now, DATA).persist()
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = brute_leaks(want.items(), items)
    want = {i: t for i, t in want.items() if not hit[i][3]}
    assert {r.doc_id: r.text for r in now.collect()} == want and now.columns == corpus_pipeline.COLUMNS
    own = Tokenizer.from_file(packing.tokenizer_path())
    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for i, t in want.items():
        ids = np.frombuffer(b"".join(r.ids for r in sorted(got[i], key=lambda r: r.start)), "<u4").tolist()
        assert ids == [*own.encode(t, add_special_tokens=False).ids, 1]


def test_odd_rows(spark, tmp_path):
    """Null ids, repeated ids and rows, clashing names and empty tables, stage by stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = [r.text for r in docs.where("length(text) > 400").orderBy("doc_id").limit(6).collect()]
    items = " ".join(f"word{i}" for i in range(40))
    rows = [(1, some[0]), (2, some[0] + " more"), (2, some[1]), (2, some[1]), (None, some[0]), (None, items), (3, f"{some[2]} {items}"), (4, ""), (5, None), (6, some[3])]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], docs.select(*corpus_pipeline.COLUMNS).schema.simpleString()[7:-1].replace(":", " ") + ", rep string, items string, ranges string")
    spark.createDataFrame([(1, items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    every = lambda found: sorted(found, key=str)
    near = corpus_pipeline.drop_near_duplicates(spark, df, str(tmp_path))
    # 2 as a whole is near 1; null ids are in no group
    assert key(near) == every([(1, some[0]), (None, some[0]), (None, items), (3, f"{some[2]} {items}"), (4, ""), (5, None), (6, some[3])]) and near.columns == corpus_pipeline.COLUMNS
    twice = spark.createDataFrame([(7, some[4]), (7, some[4]), (7, some[5]), (8, "a b")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "0L as n_chars")
    assert key(corpus_pipeline.drop_near_duplicates(spark, twice, str(tmp_path))) == every([(7, some[4]), (7, some[5]), (8, "a b")])
    assert (3, f"{some[2]} {items}") not in key(corpus_pipeline.drop_contaminated(spark, df, str(tmp_path))) and corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).count() == len(rows) - 1
    cut = corpus_pipeline.cut_repeats(spark, df, str(tmp_path))
    assert (None, some[0]) in key(cut) and (5, None) in key(cut) and cut.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.identify_language(spark, df, str(tmp_path)).where("doc_id in (4, 5)").count() == 0
    df.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
