"""Shards with size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Compaction puts shards of similar size into
tiers and merges runs of them into files up to the target size. Each change is committed as a new
manifest version: readers see the old version or the new one, never a mixture, and of two writers one has
to try again. A version's name belongs to the one writer that creates its lock file; a writer that dies
leaves its version out, and the next one skips it. Files of no manifest (a lost job's) are never read;
vacuum() deletes them and those that only versions older than the kept ones name.

A manifest lists all shards, some hundred bytes each: with files of a gigabyte, 100 TB are 10 MB of it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


@dataclass(frozen=True)
class Shard:
    path: str  # below the store
    bytes: int
    rows: int


@dataclass(frozen=True)
class Tiers:
    """Shards of bytes in [base * factor**k, base * factor**(k+1)) are of tier k; least similar ones make a run."""

    target_bytes: int = 128 << 20
    base_bytes: int = 1 << 20
    factor: int = 4
    least: int = 4

    def of(self, size: int) -> int:
        tier, edge = 0, self.base_bytes
        while size >= edge:
            tier, edge = tier + 1, edge * self.factor
        return tier

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge, each into one file of about the target size at most. Shards of at least half of
        that stay as they are. A tier is merged once it holds enough shards."""
        by_tier: dict[int, list[Shard]] = defaultdict(list)
        for s in shards:
            if 2 * s.bytes < self.target_bytes:
                by_tier[self.of(s.bytes)].append(s)
        runs = []
        for tier in sorted(by_tier):
            if len(by_tier[tier]) < self.least:
                continue
            run, size = [], 0
            for s in sorted(by_tier[tier], key=lambda s: (s.bytes, s.path)):
                if run and size + s.bytes > self.target_bytes:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.bytes
            runs.append(run)
        return [r for r in runs if len(r) > 1]


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def merged_schema(now: str | None, new: str | None) -> str | None:
    """The store's schema with the columns that an arrival adds, all nullable, as JSON; a column of another type, or
    one whose name differs in case only, is an error."""
    if now is None or new is None:
        return now or new
    fields = {f.name: f for f in StructType.fromJson(json.loads(now)).fields}
    cases = {name.lower(): name for name in fields}
    for f in StructType.fromJson(json.loads(new)).fields:
        if cases.get(f.name.lower(), f.name) != f.name:
            raise ValueError(f"column {f.name} is {cases[f.name.lower()]} in the store")
        if f.name not in fields:
            fields[f.name] = StructField(f.name, f.dataType, True, f.metadata)
        elif fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
    return StructType(list(fields.values())).json()


class ShardStore:
    """A folder with data/ and manifests/. Any Hadoop file system whose create() can refuse to overwrite will do."""

    def __init__(self, spark: SparkSession, root: str, tiers: Tiers = Tiers(), jobs_runs: int = 64, lock_seconds: int = 600):
        """lock_seconds: a version that was locked so long ago and has no manifest was a writer's that died."""
        self.spark, self.root, self.tiers, self.jobs_runs, self.lock_seconds = spark, root.rstrip("/"), tiers, jobs_runs, lock_seconds
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    # -- manifests

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        """(version, content); version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, {"schema": None, "shards": []}
        stream = self._fs.open(self._path(f"manifests/{version:020d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        content = json.loads(text)
        content["shards"] = [Shard(**s) for s in content["shards"]]
        return version, content

    def _locks(self) -> dict[int, float]:
        """The versions that some writer began and no manifest exists of, with their locks' ages in seconds."""
        folder, done = self._path("manifests"), set(self.versions())
        found = {}
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            name = s.getPath().getName()
            if name.endswith(".lock") and int(name[:-5]) not in done:
                found[int(name[:-5])] = time.time() - s.getModificationTime() / 1000
        return found

    def _commit(self, base: int, schema: str | None, shards: list[Shard], note: str) -> int:
        """Makes the version that follows base, if nothing else does. The manifest is written aside and renamed, so
        its whole content appears at once."""
        body = json.dumps({"schema": schema, "note": note, "base": base, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]})
        self._fs.mkdirs(self._path("manifests"))
        pending = {v: age for v, age in self._locks().items() if v > base}
        if max(self.versions(), default=0) > base or any(age < self.lock_seconds for age in pending.values()):
            raise Conflict(f"after version {base}")
        version = max([base, *pending]) + 1  # those between were dead writers'
        lock, final = self._path(f"manifests/{version:020d}.lock"), self._path(f"manifests/{version:020d}.json")
        try:
            self._fs.create(lock, False).close()
        except Exception as e:
            raise Conflict(f"version {version}") from e
        if max(self.versions(), default=0) > base:  # one of those wasn't dead
            self._fs.delete(lock, False)
            raise Conflict(f"after version {base}")
        aside = self._path(f"manifests/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(body.encode())
        out.close()
        if not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version}")
        self._settle(version)
        return version

    def _settle(self, version: int) -> None:
        """A writer so slow that others took it for dead finds out whether they built on its version or left it out."""
        while True:
            later = [v for v in self.versions() if v > version]
            if later:
                if self.manifest(later[0])[1].get("base", version) < version:
                    raise Conflict(f"version {version} came too late")
                return
            if not any(v > version and age < self.lock_seconds for v, age in self._locks().items()):
                return
            time.sleep(0.2)

    def change(self, make: Callable[[list[Shard]], tuple[list[Shard], set[str]]], schema: str | None, note: str, tries: int = 5) -> int:
        """Commits (added shards, replaced paths); tries again on the newest version if another writer came first."""
        for _ in range(tries):
            version, now = self.manifest()
            added, replaced = make(now["shards"])
            if replaced - {s.path for s in now["shards"]}:
                raise Conflict("shards to be replaced are gone")
            try:
                return self._commit(version, merged_schema(now["schema"], schema), [s for s in now["shards"] if s.path not in replaced] + added, note)
            except Conflict:
                continue
        raise Conflict(f"no commit in {tries} tries")

    # -- data

    def _write(self, df: DataFrame, rows_a_file: int = 0) -> list[Shard]:
        """Writes files of a folder of its own; returns those with rows."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", rows_a_file) if rows_a_file else df.write
        writer.parquet(f"{self.root}/{folder}")
        return self._shards(folder, df.schema)

    def _shards(self, folder: str, schema: StructType) -> list[Shard]:
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")}
        counted = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("file")).count().collect()  # a row for each new file
        return [Shard(f"{folder}/{r['file']}", sizes[r["file"]], r["count"]) for r in counted]

    def _check(self, schema: str) -> None:
        merged_schema(self.manifest()[1]["schema"], schema)

    def append(self, df: DataFrame, rows_a_shard: int = 0) -> int:
        """One arrival: its rows become new shards, as many as the arrival has partitions (or more, of at most rows_a_shard).

        New columns are added to the store's, null in older rows, and columns that an arrival lacks are null in its
        rows; a column of another type is refused before anything is written."""
        self._check(df.schema.json())
        shards = self._write(df, rows_a_shard)
        return self.change(lambda _: (shards, set()), df.schema.json(), f"append {sum(s.rows for s in shards)} rows")

    def adopt(self, folder: str, schema: StructType) -> int:
        """One arrival whose Parquet files lie in a folder below the store already: they are moved, not copied. A folder
        that doesn't exist is an arrival without rows."""
        self._check(schema.json())
        shards: list[Shard] = []
        if self._fs.exists(self._path(folder)):
            own = f"data/{uuid.uuid4().hex}"
            self._fs.mkdirs(self._path("data"))
            if not self._fs.rename(self._path(folder), self._path(own)):
                raise OSError(f"{folder} can't be moved")
            shards = self._shards(own, schema)
        return self.change(lambda _: (shards, set()), schema.json(), f"adopt {sum(s.rows for s in shards)} rows")

    def read(self, version: int | None = None) -> DataFrame:
        _, content = self.manifest(version)
        if content["schema"] is None:
            raise ValueError("the store is empty")
        schema = StructType.fromJson(json.loads(content["schema"]))
        if not content["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in content["shards"]])

    def compact(self) -> int:
        """Merges what the tiers' plan names; returns how many runs. A task reads one run's files and writes
        one file, so nothing is shuffled; a job takes jobs_runs runs and commits them together."""
        _, content = self.manifest()
        runs = self.tiers.plan(content["shards"])
        for k in range(0, len(runs), self.jobs_runs):
            part = runs[k : k + self.jobs_runs]
            schema = StructType.fromJson(json.loads(content["schema"]))
            frames = [self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in run]).coalesce(1) for run in part]
            merged = frames[0]
            for f in frames[1:]:
                merged = merged.unionAll(f)
            shards = self._write(merged)
            if sum(s.rows for s in shards) != sum(s.rows for run in part for s in run):
                raise RuntimeError("merged rows differ from their sources'")
            self.change(lambda _, shards=shards, part=part: (shards, {s.path for run in part for s in run}), None, f"merge {sum(map(len, part))} shards into {len(shards)}")
        return len(runs)

    def compact_fully(self, most_rounds: int = 32) -> int:
        """Compacts until no tier has a run to merge."""
        rounds = 0
        while rounds < most_rounds and self.compact():
            rounds += 1
        return rounds

    def vacuum(self, keep_versions: int = 2) -> int:
        """Deletes data that none of the newest versions names, then the older manifests. Readers of the versions
        kept go on undisturbed. For one writer at a time: it would also delete what another is about to commit."""
        versions = self.versions()
        kept = versions[-keep_versions:]
        named = {s.path for v in kept for s in self.manifest(v)[1]["shards"]}
        dropped = 0
        data = self._path("data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = folder.getPath().getName()
            files = [s.getPath() for s in self._fs.listStatus(folder.getPath())]
            old = [f for f in files if f"data/{name}/{f.getName()}" not in named and f.getName().startswith("part-")]
            dropped += len(old)
            if len(old) == len([f for f in files if f.getName().startswith("part-")]):
                self._fs.delete(folder.getPath(), True)
            else:
                for f in old:
                    self._fs.delete(f, False)
        for v in versions[:-keep_versions]:
            self._fs.delete(self._path(f"manifests/{v:020d}.json"), False)
            self._fs.delete(self._path(f"manifests/{v:020d}.lock"), False)
        return dropped


def shard_table(df: DataFrame, root: str, arrivals: int = 4, key: str | None = None, tiers: Tiers = Tiers(), rows_a_shard: int = 0) -> ShardStore:
    """Appends the table in arrivals, compacts after each as a running store would, and drops files that neither the
    newest version nor the one before it names.

    Rows go to arrivals by a hash of the whole row (or of key), so any columns, nulls, ties, repeated rows, empty
    and very long texts and an empty table will do; the store keeps every row with all its columns, repeated
    ones as often as they come. The table is read once: one write deals it into the arrivals' folders, whose
    files the store then takes over.
    """
    store = ShardStore(df.sparkSession, root, tiers)
    hashed = F.xxhash64(*([F.col(f"`{key}`")] if key else [F.col(f"`{c}`") for c in df.columns]))
    name, incoming = f"arrival_{uuid.uuid4().hex}", f"incoming-{uuid.uuid4().hex}"
    writer = df.withColumn(name, F.pmod(hashed, F.lit(arrivals)).cast("int")).write.partitionBy(name)
    (writer.option("maxRecordsPerFile", rows_a_shard) if rows_a_shard else writer).parquet(f"{store.root}/{incoming}")
    for k in range(arrivals):
        store.adopt(f"{incoming}/{name}={k}", df.schema)
        store.compact_fully()
        store.vacuum()
    store._fs.delete(store._path(incoming), True)
    return store
