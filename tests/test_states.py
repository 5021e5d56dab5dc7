"""Mergeable states: any split of the input gives the row of the whole, over tables, batches and streams."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evoframe.operators import stats
from evoframe.streaming import states

COLUMNS = ["a", "b", "c"]
SCHEMA = "g string, id long, a double, b double, c double, n long"


def rows(seed=1, count=400):
    r = random.Random(seed)
    made = []
    for i in range(count):
        a = r.gauss(1e6, 1)  # a large offset
        made.append((r.choice(["x", "y", "z"]), i, a, a * 2 + r.gauss(0, 1), r.choice([-1.0, 0.0, 2.0]), r.choice([0, 1, 1, 3, 7])))
    made += [("x", 900, None, 1.0, 1.0, None), ("only", 901, 5.0, 6.0, 7.0, 2), ("none", 902, None, None, None, None), (None, 903, 2.0, 3.0, 4.0, 1), (None, 904, 3.0, 5.0, math.nan, 1)]
    return made


ALL = {
    "moments": states.Moments("a"), "covariance": states.Covariance("a", "b", "c"), "cross": states.CrossCovariance(["a", "b"], ["c"]), "second": states.SecondMoment("b", "c"),
    "overlap": states.Overlap(["a", "c"]), "across": states.Overlap(["a", "b"], ["c"]), "tally": states.Tally("n"), "most": states.Best("c", "id", 5), "least": states.Best("a", "id", 3, largest=False),
}


def alike(got, want):
    assert len(got) == len(want)
    for x, y in zip(sorted(got, key=str), sorted(want, key=str)):
        for u, v in zip(x, y):
            assert u == pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else u == v, (x, y)


@pytest.mark.parametrize("name", ALL)
def test_any_split(name):
    state, frame = ALL[name], pd.DataFrame(rows(), columns=[c.split()[0] for c in SCHEMA.split(", ")])
    whole = state.finish(state.update(state.zero(), frame))
    r = random.Random(name)
    for parts in (2, 7, 60):
        cuts = sorted(r.sample(range(1, len(frame)), parts - 1))
        made = [state.update(state.zero(), frame.iloc[i:j]) for i, j in zip([0, *cuts], [*cuts, len(frame)])] + [state.zero()]
        r.shuffle(made)
        while len(made) > 1:
            made.append(state.merge(made.pop(), made.pop(0)))
        alike(state.finish(made[0]), whole)
        folded = state.zero()
        for i, j in zip([0, *cuts], [*cuts, len(frame)]):
            folded = state.update(folded, frame.iloc[i:j])
        alike(state.finish(folded), whole)
    state.finish(state.zero())  # an empty state says something or nothing


def test_tables_give_what_the_aggregates_give(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(6)
    whole = df.where("a is not null and b is not null and c is not null and not isnan(c)")
    read = lambda found, *columns: [tuple(r) for r in found.select(*columns).collect()]
    pairs = {(i, j): (x, y, z) for i, j, x, y, z in read(states.fold(df, ALL["covariance"]), "i", "j", "cov", "cov_pop", "corr")}
    want = read(stats.covariance(whole, COLUMNS), "i", "j", "cov", "cov_pop", "corr")
    assert len(pairs) == 9 and all(pairs[i, j] == pytest.approx(tuple(v), rel=1e-6) and pairs[j, i] == pytest.approx(tuple(v), rel=1e-6) for i, j, *v in want)
    cross = read(states.fold(df, ALL["cross"]), "i", "j", "cov", "corr")
    alike([(i, j, round(x, 5), round(y, 5)) for i, j, x, y in cross], [(i, j, round(x, 5), round(y, 5)) for i, j, x, y in read(stats.cross_covariance(whole, ["a", "b"], ["c"]), "i", "j", "cov", "corr")])
    both = df.where("b is not null and c is not null and not isnan(c)")
    second = {(i, j): x for i, j, x in read(states.fold(df, ALL["second"]), "i", "j", "moment")}
    assert all(second[i, j] == pytest.approx(x) for i, j, x in read(stats.second_moment(both, ["b", "c"]), "i", "j", "moment"))
    overlap = {(i, j): (s, x) for i, j, s, x in read(states.fold(df, ALL["overlap"]), "i", "j", "shared", "iou")}
    assert all(overlap[i, j] == (s, pytest.approx(x)) for i, j, s, x in read(stats.iou(df, {"a": F.col("a"), "c": F.col("c")}), "i", "j", "shared", "iou"))
    alike(read(states.fold(df, ALL["tally"]), "bin", "n"), read(stats.bincount(df, "n"), "bin", "n"))
    live = df.where("not isnan(c)")
    alike(read(states.fold(live, ALL["most"], ["g"]), "g", "place", "value", "tie"), read(stats.top_k(live, "c", 5, "id", ["g"]), "g", "place", "c", "id"))
    moments = {r.g: r for r in states.fold(df, ALL["moments"], ["g"], fan=2).collect()}
    for r in stats.summary(df, ["a"], ["g"]).collect():
        found = moments[r.g]
        assert (found.n, found.lo, found.hi) == (r.a_n, r.a_min, r.a_max)
        assert found.variance == pytest.approx(r.a_var) if r.a_n > 1 else found.variance is None
    assert moments["none"].n == 0 and moments["none"].mean is None and set(moments) == {"x", "y", "z", "only", "none", None}
    assert states.fold(df.limit(0), ALL["covariance"], ["g"]).count() == 0


def test_batches_count_once(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    table = states.StateTable(spark, f"file://{tmp_path}/states", ALL["covariance"], ["g"])
    with pytest.raises(ValueError):
        table.result()
    for i in range(4):
        table.add(df.where(f"id % 4 = {i}"), i)
    table.add(df.where("id % 4 = 2"), 2)  # a replayed batch
    again = states.StateTable(spark, f"file://{tmp_path}/states", ALL["covariance"], ["g"])  # another session reads what is saved
    want = [tuple(r) for r in states.fold(df, ALL["covariance"], ["g"]).collect()]
    got = [tuple(r) for r in again.result().collect()]
    assert sorted((r[:3] for r in got), key=str) == sorted((r[:3] for r in want), key=str)
    close = {r[:3]: r[3:] for r in got}
    assert all(close[r[:3]] == pytest.approx(r[3:], rel=1e-6, abs=1e-9) for r in want if r[3] is not None)
    (tmp_path / "states" / "batch=3" / "_SUCCESS").unlink()  # broken off: not read
    assert {r.n for r in again.states().collect()} != {r.n for r in table.folders.read().groupBy("g").agg(F.sum("n").alias("n")).collect()} or len(again.folders.folders()) == 3


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, old)


@pytest.mark.parametrize("name", ["moments", "covariance", "tally", "most"])
def test_stream_restarts(rocks, tmp_path, name):
    """A stream that is stopped and started again says in the end what the whole table says."""
    state, made = ALL[name], [r for r in rows() if r[0] is not None and not math.isnan(r[4] or 0.0)]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    said: dict = {}

    def keep(batch, _):
        for g, group in batch.toPandas().groupby("g"):
            said[g] = [tuple(x)[1:] for x in group.itertuples(index=False)]

    for part in range(3):
        rocks.createDataFrame([r for r in made if r[1] % 3 == part], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = rocks.readStream.schema(SCHEMA).parquet(source)
        query = states.watch(stream, state, ["g"]).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", out).trigger(availableNow=True).start()
        query.awaitTermination()
    want: dict = {}
    for r in states.fold(rocks.createDataFrame(made, SCHEMA), state, ["g"]).toPandas().itertuples(index=False):
        want.setdefault(r[0], []).append(tuple(r)[1:])
    plain = lambda x: [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in x]
    assert set(said) == set(want)
    for g in want:
        for x, y in zip(sorted(plain(said[g]), key=str), sorted(plain(want[g]), key=str)):
            assert all(u == pytest.approx(v, rel=1e-6, abs=1e-9) if isinstance(v, float) else u == v for u, v in zip(x, y)), (g, x, y)
