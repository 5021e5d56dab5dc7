"""Parallel JSON arrays, results that count once, states and vectors that are read only when whole, and the two indexes."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoframe.operators import retrieval, text_index, vector_index
from evoframe.sources import graphs, json_arrays, readers


def odd_values(r, count):
    word = lambda: "".join(r.choice(['a', '"', "\\", "{", "}", "[", "]", ",", "é", "\n", " ", "𝄞", "\\\"", "\\\\"]) for _ in range(r.randint(0, 30)))
    return [{"name": word(), "n": i, "more": r.choice([None, [word(), {"x": [1, 2]}], {"k": word()}])} if i % 11 else r.choice([None, {}, {"name": "x" * 3000}]) for i in range(count)]


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_json_arrays_in_blocks(spark, tmp_path, style, monkeypatch):
    values = odd_values(random.Random(str(style)), 700)
    (tmp_path / "a.json").write_text(json.dumps(values, **style) + "\n")
    monkeypatch.setattr(json_arrays, "SLICE", 997)  # many slices in a block
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1500", old):  # many blocks in the file, or one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = json_arrays.elements(spark, str(tmp_path / "a.json"))
            assert size == old or rows.rdd.getNumPartitions() > 4
            got = {r.idx: r.value for r in rows.collect()}
            assert sorted(got) == list(range(700)) and all(json.loads(got[i]) == values[i] for i in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_json_arrays_without_elements(spark, tmp_path):
    for name, text in (("empty", "[]"), ("spaces", " [ \n ] "), ("numbers", "[1, -2.5, \"a,b\", [3, [4]], null, true]"), ("one", '[{"a": "}"}]')):
        (tmp_path / f"{name}.json").write_text(text)
        got = [json.loads(r.value) for r in json_arrays.elements(spark, str(tmp_path / f"{name}.json")).orderBy("idx").collect()]
        assert got == json.loads(text)
    both = json_arrays.elements(spark, f"{tmp_path}/*.json").groupBy("path").agg(F.count("*").alias("n"), F.max("idx").alias("last")).collect()
    assert {(r.path.rsplit("/")[-1], r.n, r.last) for r in both} == {("numbers.json", 6, 5), ("one.json", 1, 0)}
    assert readers.json_array(spark, str(tmp_path / "none.json"), readers.RUST).count() == 0 and graphs.read_graphs(spark, str(tmp_path / "none.json")) is None


def test_results_count_once(spark, tmp_path):
    samples = spark.createDataFrame([(f"{i}_x",) for i in range(40)], "id string")
    path = str(tmp_path / "results")
    store = readers.ResultStore(spark, path)
    asked = []

    def evaluate(part):
        asked.extend(r.id for r in part.collect())
        if len(asked) > 15:
            raise RuntimeError("killed")
        return part.withColumn("passed", F.lit(True))

    with pytest.raises(RuntimeError):
        store.run(samples, evaluate, batches=6)
    stored = {r.id for r in store.read().collect()}
    assert stored and len(stored) < 40
    (tmp_path / "results" / "batch=99").mkdir()  # what a write leaves that breaks off
    (tmp_path / "results" / "batch=99" / "part-0.parquet").write_bytes(b"not whole")
    again = readers.ResultStore(spark, path)
    asked.clear()
    found = again.run(samples, lambda part: (asked.extend(r.id for r in part.collect()), part.withColumn("passed", F.lit(False)))[1], batches=6)
    assert Counter(r.id for r in found.collect()) == Counter({f"{i}_x": 1 for i in range(40)}) and set(asked) == {f"{i}_x" for i in range(40)} - stored
    again.commit(spark.createDataFrame([("0_x", True), ("new", False), ("new", True)], "id string, passed boolean"), 200)
    again.commit(spark.createDataFrame([("0_x", True), ("new", False), ("new", True)], "id string, passed boolean"), 200)  # tried again
    ids = Counter(r.id for r in again.read().collect())
    assert len(ids) == 41 and max(ids.values()) == 1 and again.read().where("id = 'new'").first().passed is False
    assert again.remaining(samples).count() == 0


def test_only_whole_folders_are_read(spark, tmp_path):
    states = readers.StateStore(spark, str(tmp_path / "states"))
    calls = []
    compute = lambda: (calls.append(1), spark.range(3))[1]
    assert states.get(compute, a=1).count() == 3 and states.get(compute, a=1).count() == 3 and len(calls) == 1
    mark = next((tmp_path / "states").glob("*/_SUCCESS"))
    mark.unlink()
    assert states.get(compute, a=1).count() == 3 and len(calls) == 2
    assert graphs.resolve(spark, str(tmp_path / "no")) is None and graphs.resolve(spark, str(mark.parent)).count() == 3
    store = graphs.VectorStore(spark, str(tmp_path / "vectors"))
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        return [[float(len(t))] for t in texts]

    first = spark.createDataFrame([(1, "a"), (2, "bb"), (2, "bb"), (3, None)], "idx long, t string")
    assert sorted((r.idx, r.vector) for r in store.open_or_build(first, "t", embed).collect()) == [(1, [1.0]), (2, [2.0]), (2, [2.0]), (3, [0.0])]
    made = seen.value
    more = first.unionByName(spark.createDataFrame([(9, "new one")], "idx long, t string"))
    assert sorted((r.idx, r.vector) for r in graphs.VectorStore(spark, str(tmp_path / "vectors")).open_or_build(more, "t", embed).collect())[-1] == (9, [7.0])
    assert seen.value == made + 1 and made == 3  # only what was not there


def plain_bm25(docs, queries, k, k1=1.5, b=0.75):
    import re

    words = lambda t: re.findall("[a-z0-9_]+", (t or "").lower())
    bags = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    mean = sum(n for *_, n in bags) / max(1, len(bags))
    out = {}
    for q, t in queries:
        scores = []
        for d, bag, n in bags:
            s = 0.0
            for w, times in Counter(words(t)).items():
                df = sum(w in other for _, other, _ in bags)
                if bag[w]:
                    s += times * math.log((len(bags) - df + 0.5) / (df + 0.5) + 1) * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * n / mean))
            if s > 0:
                scores.append((-round(s, 9), d))
        out[q] = [(d, pytest.approx(-s)) for s, d in sorted(scores)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("bucket, cells, asked", [(1024, 1 << 21, 200_000), (7, 64, 20)])
def test_text_index(spark, tmp_path, monkeypatch, bucket, cells, asked):
    for name, value in (("BUCKET", bucket), ("CELLS", cells), ("ASKED", asked), ("FIRST", 3)):
        monkeypatch.setattr(text_index, name, value)
    r = random.Random(bucket)
    words = [f"w{i}" for i in range(30)] + ["é", "X_1"]
    text = lambda: " ".join(r.choices(words, weights=range(1, 33), k=r.randint(0, 25)))
    docs = [(f"d{i:03}", text()) for i in range(150)] + [("dup1", "w1 w2"), ("dup2", "w1 w2"), ("none", None)]
    queries = [(i, text()) for i in range(25)] + [(90, ""), (91, "unknown"), (92, "w1 w1 w1 w2"), (93, None)]
    index = text_index.TextIndex(spark, f"file://{tmp_path}/index")
    frame = lambda rows: spark.createDataFrame(rows, "d string, t string").repartition(3)
    index.add(frame(docs[:100]), "d", F.col("t"))
    index.add(frame(docs[100:]), "d", F.col("t"))
    index.add(frame(docs[100:]), "d", F.col("t"), version=1)  # the same version again
    asked_ = spark.createDataFrame(queries, "q long, t string")
    for _ in range(2):  # built once, searched often
        got = {}
        for x in text_index.TextIndex(spark, f"file://{tmp_path}/index").search(asked_, "q", F.col("t"), k=4).collect():
            got.setdefault(x.q, []).append((-round(x.score, 9), x.d, x.score))
        assert {q: [(d, s) for _, d, s in sorted(v)] for q, v in got.items()} == plain_bm25(docs, queries, 4)
    (tmp_path / "index" / "sizes" / "version=1" / "_SUCCESS").unlink()
    index2 = text_index.TextIndex(spark, f"file://{tmp_path}/index")
    assert {x.d for x in index2.search(asked_, "q", F.col("t"), k=200).collect()} <= {d for d, _ in docs[:100]}


@pytest.mark.parametrize("keys, points, parts", [(512, 2048, 1024), (5, 7, 9)])
def test_vector_index(spark, monkeypatch, keys, points, parts):
    for name, value in (("KEYS", keys), ("POINTS", points), ("BALLS", parts)):
        monkeypatch.setattr(vector_index, name, value)
    r = np.random.default_rng(keys)
    middles = r.normal(size=(12, 16)) * 10
    rows = [(i, (middles[i % 12] + r.normal(size=16) * 0.1).tolist()) for i in range(300)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, [None] * 16), (904, middles[3].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    counted = spark.sparkContext.accumulator(0)
    found = vector_index.search(df, vector_index.build(df, "id", "v"), 4, "id", "v", counted).collect()
    got = {}
    for x in found:
        got.setdefault(x.pid, []).append((x.place, x.kid, x.dist))
    live = [(i, np.array(v)) for i, v in rows if v and None not in v]
    assert set(got) == {i for i, _ in live}
    for i, v in live:
        want = sorted((float(np.sqrt(((v - u) ** 2).sum())), j) for j, u in live)[:4]
        assert [(j, pytest.approx(d)) for d, j in want] == [(j, d) for _, j, d in sorted(got[i])]
    assert counted.value < 0.2 * len(live) ** 2  # the share of pairs that were compared, where vectors lie in groups
    few = vector_index.search(df, vector_index.build(df.where("id < 3"), "id", "v"), 5, "id", "v")
    assert few.groupBy("pid").count().where("count <> 3").count() == 0
    assert vector_index.search(df, vector_index.build(df.where("id < 0"), "id", "v"), 5, "id", "v").count() == 0


def test_keyword_scan_in_small_pieces(spark, monkeypatch):
    r = random.Random(8)
    words = ["alpha", "beta", "gamma", "alphabet", "delta", "bet"]
    docs = [(f"d{r.randrange(10**6):06}", " ".join(r.choices(words, k=r.randint(0, 6)))) for _ in range(200)]
    queries = [(i, " ".join(r.choices([*words, "the", "of"], k=r.randint(0, 4)))) for i in range(30)]
    plain = {}
    for q, t in queries:
        asked = [w for w in t.split() if len(w) > 2 and w not in retrieval.STOP_WORDS]
        hits = sorted((-sum(w in x for w in asked), d) for d, x in docs)
        plain[q] = [(d, -n) for n, d in hits if n][:3]
    scan = retrieval._scan
    for held in (1, 1 << 18):
        monkeypatch.setattr(retrieval, "_scan", lambda asked, k, held=held: scan(asked, k, held))
        got = {q: [] for q, _ in queries}
        for x in retrieval.keyword_top(spark.createDataFrame(docs, "d string, t string"), spark.createDataFrame(queries, "q long, t string"), "d", "t", "q", "t").orderBy("q", "place").collect():
            got[x.q].append((x.d, x.hits))
        assert got == plain
