"""Size-tiered compaction of shards under a versioned manifest, with Spark's own readers and writers only.

An arrival is written as a run: a folder of small immutable Parquet shards. A run's tier is the logarithm, to base
`fanout`, of its bytes over `least_bytes`. Where a tier holds `fanout` runs, they are merged into runs of files of about
`target_bytes`, without a shuffle: each output file is one task that reads neighbouring small files. All merges of a round
run side by side and are one commit. Runs whose files are of the target size already are final.

Every change is one new manifest, a JSON file named by its version. It is written aside and renamed; the rename fails if
the version exists, so two writers cannot both commit it, and a reader sees a version whole or not at all. Files are
never changed: a reader of an old version keeps its files until vacuum(). Runs of a job that failed are not in any
manifest and go with vacuum() too.

Cases: an empty arrival adds its columns and no rows; a version without rows, or a new store, reads as an empty table of
the columns known so far; nulls, long texts, repeated rows and any further columns are stored as they are; a null arrival
is an arrival of its own; rows of runs that lack a column have null there, and a column that comes with another type
raises. read() adds shard_run, shard_part and shard_tier; where the rows have a column of such a name, it stays and the
added one has an underscore behind.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, least_bytes: int = 1 << 20, fanout: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.least, self.fanout = target_bytes, least_bytes, fanout
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # -- files --

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _list(self, name: str) -> list:
        at = self._path(name)
        return list(self._fs().listStatus(at)) if self._fs().exists(at) else []

    # -- manifests --

    def version(self) -> int:
        """The last committed version, 0 if there is none."""
        return max([0, *(int(s.getPath().getName()[:-5]) for s in self._list("manifest") if s.getPath().getName().endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "runs": []}
        stream = self._fs().open(self._path(f"manifest/{version:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, runs: list[dict], base: int, schema: StructType | None = None) -> int:
        """Make `runs` the version after `base`; fails if another writer has made it."""
        known = schema if schema is not None else self.schema(base)
        made = {"version": base + 1, "schema": known.jsonValue(), "runs": runs}
        aside = self._path(f"manifest/.{uuid.uuid4().hex}")
        stream = self._fs().create(aside, False)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(rename, 1)
        kinds[0] = rename.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self._conf).rename(aside, self._path(f"manifest/{base + 1:020d}.json"), kinds)
        return base + 1

    def schema(self, version: int | None = None) -> StructType:
        """The columns of all runs up to a version."""
        return StructType.fromJson(self.manifest(version).get("schema", StructType().jsonValue()))

    def _widened(self, now: dict, new: StructType) -> StructType:
        known = StructType.fromJson(now.get("schema", StructType().jsonValue()))
        kinds = {f.name: f.dataType for f in known}
        for f in new:
            if f.name not in kinds:
                known = known.add(f.name, f.dataType, True)
            elif kinds[f.name] != f.dataType:
                raise ValueError(f"column {f.name} is {kinds[f.name].simpleString()} in the store, not {f.dataType.simpleString()}")
        return known

    # -- runs --

    def _tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.least, self.fanout))) if size > self.least else 0

    def _run(self, folder: str, number: int, rows: int, tier: int = 0) -> dict:
        name = f"{folder}/run={number}"
        files = sorted((s.getPath().getName(), s.getLen()) for s in self._list(name) if s.getPath().getName().startswith("part-"))
        size = sum(n for _, n in files)
        return {"run": number, "path": name, "rows": rows, "bytes": size, "tier": max(tier, self._tier(size)), "files": [f for f, _ in files] if rows else []}

    def append(self, df: DataFrame) -> int:
        """Add the rows of df as one run; the version that has them."""
        now, seen = self.manifest(), Observation()
        schema, folder, number = self._widened(now, df.schema), f"data/{uuid.uuid4().hex}", self._next(now)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(f"{self.root}/{folder}/run={number}")
        return self.commit([*now["runs"], self._run(folder, number, seen.get["n"])], now["version"], schema)

    def append_arrivals(self, df: DataFrame, arrival: str) -> int:
        """Add one run per value of the column `arrival`, written by one job; the value stands in the manifest, not in the rows."""
        now, folder = self.manifest(), f"data/{uuid.uuid4().hex}"
        rows = df.drop(arrival)
        schema = self._widened(now, rows.schema)
        key = F.col(f"`{arrival}`").cast("string")
        known = df.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value").collect()  # a row per arrival, as in the manifest
        if not known:
            return self.commit(now["runs"], now["version"], schema)
        number = {r.value: self._next(now) + i for i, r in enumerate(known)}
        place = F.create_map(*[F.lit(x) for v, k in number.items() for x in (v if v is not None else "", k)]) if set(number) - {None} else None
        run = place[key] if place is not None else F.lit(None)
        if None in number:
            run = F.when(key.isNull(), number[None]).otherwise(run) if place is not None else F.lit(number[None])
            if "" in number:
                run = F.when(key == "", number[""]).otherwise(run)
        name = self._free("run", rows.columns)
        df.withColumn(name, run).drop(arrival).write.option("compression", "zstd").partitionBy(name).parquet(f"{self.root}/{folder}")
        made = []
        for r in known:
            if name != "run":  # the folders' name is ours, whatever the columns are called
                self._fs().rename(self._path(f"{folder}/{name}={number[r.value]}"), self._path(f"{folder}/run={number[r.value]}"))
            made.append(self._run(folder, number[r.value], r.n) | {"arrival": r.value})
        return self.commit([*now["runs"], *made], now["version"], schema)

    @staticmethod
    def _free(name: str, taken: list[str]) -> str:
        while name.lower() in {c.lower() for c in taken}:
            name += "_"
        return name

    @staticmethod
    def _next(manifest: dict) -> int:
        return 1 + max([0, *(r["run"] for r in manifest["runs"])])

    def _final(self, run: dict) -> bool:
        return not run["files"] or run["bytes"] / len(run["files"]) >= 0.5 * self.target

    def _groups(self, runs: list[dict]) -> list[tuple[int, list[dict]]]:
        """What one round merges: in each full tier neighbouring runs, `fanout` at least and of one target or what there is."""
        tiers: dict[int, list[dict]] = {}
        for r in sorted(runs, key=lambda r: r["run"]):
            if not self._final(r):
                tiers.setdefault(r["tier"], []).append(r)
        groups = []
        for tier, held in sorted(tiers.items()):
            take: list[dict] = []
            for r in held:
                take.append(r)
                if len(take) >= self.fanout and sum(x["bytes"] for x in take) >= self.target:
                    groups.append((tier, take))
                    take = []
            if len(take) >= self.fanout:
                groups.append((tier, take))
        return groups

    def compact(self, at_once: int = 16) -> int:
        """Merge tiers that are full until none is, `at_once` merges side by side; the last version."""
        while groups := self._groups((now := self.manifest())["runs"]):
            folder, first = f"data/{uuid.uuid4().hex}", self._next(now)

            def merge(number: int, tier: int, take: list[dict]) -> dict:
                files = max(1, round(sum(r["bytes"] for r in take) / self.target))
                self._rows(take).coalesce(files).write.option("compression", "zstd").parquet(f"{self.root}/{folder}/run={number}")  # noqa: B023
                return self._run(folder, number, sum(r["rows"] for r in take), tier + 1)  # noqa: B023

            with ThreadPoolExecutor(at_once) as pool:
                made = [f.result() for f in [pool.submit(merge, first + i, *g) for i, g in enumerate(groups)]]
            gone = {r["run"] for _, take in groups for r in take}
            self.commit([*(r for r in now["runs"] if r["run"] not in gone), *made], now["version"])
        return now["version"]

    def _rows(self, runs: list[dict], schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema if schema is not None else self.schema()).option("recursiveFileLookup", True)
        return reader.parquet(*[f"{self.root}/{r['path']}/{f}" for r in runs for f in r["files"]])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with shard_run, shard_part and shard_tier (see the module's text for their names)."""
        now, schema = self.manifest(version), self.schema(version)
        names = [self._free(n, schema.names) for n in ("shard_run", "shard_part", "shard_tier")]
        runs = [r for r in now["runs"] if r["files"]]
        if not runs:
            return self.spark.createDataFrame([], schema.add(names[0], LongType()).add(names[1], IntegerType()).add(names[2], IntegerType()))
        path, parts = F.input_file_name(), []
        for tier in sorted({r["tier"] for r in runs}):  # few: a logarithm of the sizes
            rows = self._rows([r for r in runs if r["tier"] == tier], schema)
            parts.append(rows.withColumns({names[0]: F.regexp_extract(path, r"/run=(\d+)/part-", 1).cast("long"), names[1]: F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1).cast("int"), names[2]: F.lit(tier)}))
        return functools.reduce(DataFrame.unionByName, parts)

    def vacuum(self, keep_versions: int = 1) -> None:
        """Drop what no manifest of the last keep_versions has."""
        last = self.version()
        used = {r["path"].split("/")[1] for v in range(max(1, last - keep_versions + 1), last + 1) for r in self.manifest(v)["runs"]}
        for s in self._list("data"):
            if s.getPath().getName() not in used:
                self._fs().delete(s.getPath(), True)
