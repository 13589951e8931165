"""A keyed table in a shared folder: hash buckets, runs, and commits that several writers can make at once.

A write adds a *run*: its rows, as Parquet in one folder per hash bucket. Nothing
old is read or written again, so its cost follows its own rows. A commit is the
file of the next version, made only if no other writer has made it; who comes second
reads what is there and tries the number after. A version lists the runs and the
buckets in which each counts; of the rows of a key the last run's holds. ``compact`` folds
the runs of a bucket into one; runs committed meanwhile stay on top of it.
Readers see whole versions, and a failed write leaves nothing that they read.

The commit needs a file system that can make a file only if it is absent: links
on a local one, renames that do not overwrite elsewhere (HDFS). Defined results: a null is a
key value as any other; values are cast to the types the table has, new columns are added,
missing ones are null; a table without rows has no version until something is written.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

RUN, BUCKET, GONE = "_run", "_bucket", "_gone"


class KeyedTable:
    """Rows by ``key``; ``bucket_by``, some of the key's columns, decides the bucket (all of them, if not given)."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], bucket_by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.bucket_by, self.buckets = list(bucket_by or key), buckets
        if not set(self.bucket_by) <= set(self.key):
            raise ValueError("a bucket is told by columns of the key")

    # Reading

    def version(self) -> int:
        """Of the last commit; -1 before the first."""
        return max((int(n[:-5]) for n in self._names(f"{self.path}/log") if n.endswith(".json") and not n.startswith(".")), default=-1)

    def manifest(self) -> dict | None:
        n = self.version()
        if n < 0:
            return None
        said = json.loads(self._read(f"{self.path}/log/{n:012d}.json"))
        if (said["key"], said["bucket_by"], said["buckets"]) != (self.key, self.bucket_by, self.buckets):
            raise ValueError(f"the table has key {said['key']} and {said['buckets']} buckets by {said['bucket_by']}")
        return said | {"version": n}

    def current(self) -> DataFrame | None:
        """The last version's rows; None before the first commit."""
        said = self.manifest()
        return said and self._rows(said, range(self.buckets))

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """Rows whose ``bucket_by`` values are among ``keys``; only their buckets are read, and their rows are dealt by ``bucket_by`` once.

        What follows may rely on that, unless ``keys`` has nulls.
        """
        said = self.manifest()
        if said is None:
            return None
        asked = self._typed(keys.select(*self.bucket_by).distinct(), StructType.fromJson(said["schema"]))
        null = reduce(Column.__or__, (F.col(c).isNull() for c in self.bucket_by))
        touched = asked.groupBy(self._bucket()).agg(F.max(null).alias("null")).collect()
        rows = self._rows(said, {r[BUCKET] for r in touched}, dealt=True)
        if not any(r["null"] for r in touched):
            return rows.join(asked, self.bucket_by, "left_semi")
        same = reduce(Column.__and__, (rows[c].eqNullSafe(asked[c]) for c in self.bucket_by))
        return rows.join(asked, same, "left_semi")

    def _rows(self, said: dict, buckets, dealt: bool = False) -> DataFrame:
        """Of each key in ``buckets`` the row of its last run. Buckets of a single run are read as they are.

        ``dealt``: by ``bucket_by``, before anything is merged.
        """
        schema, wanted = StructType.fromJson(said["schema"]), set(buckets)
        runs = [(r["id"], r["n"], r["gone"], sorted(wanted & set(r["buckets"]))) for r in said["runs"]]
        held = [b for *_, own in runs for b in own]
        several = {b for b in held if held.count(b) > 1} if len(held) < 4096 else {b for b, n in _counts(held).items() if n > 1}
        several |= {b for _, _, gone, own in runs if gone for b in own}
        if dealt and several:
            several = set(held)  # all at once: a union of two parts would have to be dealt again
        parts = []
        if any(set(own) - several for *_, own in runs):
            parts.append(self._read_runs([(i, n, sorted(set(own) - several)) for i, n, _, own in runs], schema).select(schema.names))
        if several:
            stacked = self._read_runs([(i, n, sorted(set(own) & several)) for i, n, _, own in runs], schema).drop(RUN, BUCKET)
            stacked = stacked.repartition(*self.bucket_by) if dealt else stacked
            rest = [c for c in schema.names if c not in self.key]
            last = stacked.groupBy(*self.key).agg(F.max_by(F.struct(*rest, GONE), "_n").alias("last"))
            parts.append(last.where(f"not last.{GONE}").select(*(F.col(c) if c in self.key else F.col("last")[c].alias(c) for c in schema.names)))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0].repartition(*self.bucket_by) if dealt and not several else reduce(DataFrame.unionByName, parts)

    def _read_runs(self, runs: list[tuple[str, int, list[int]]], schema: StructType) -> DataFrame:
        runs = [r for r in runs if r[2]]
        full = StructType([*schema.fields, StructField(GONE, BooleanType()), StructField(RUN, StringType()), StructField(BUCKET, IntegerType())])
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/{RUN}={i}" for i, _, _ in runs))
        # Conditions on the folders only: others are not listed for reading.
        rows = rows.where(reduce(Column.__or__, ((F.col(RUN) == i) & F.col(BUCKET).isin(own) for i, _, own in runs)))
        ordinal = F.create_map(*(x for i, n, _ in runs for x in (F.lit(i), F.lit(n))))
        return rows.withColumn("_n", ordinal[F.col(RUN)])

    # Writing

    def write(self, rows: DataFrame, latest: Column | None = None, writer: str | None = None, batch: int = 0) -> int | None:
        """Rows replace those of their keys. Returns the version made.

        Where ``rows`` has a key several times, the one with the greatest ``latest`` holds;
        without it keys have to be unique. A ``writer`` numbers its batches: one at or
        below its last committed number is not written again, and gives None.
        """
        return self._add(rows, False, latest, writer, batch)

    def remove(self, keys: DataFrame, writer: str | None = None, batch: int = 0) -> int | None:
        """Rows with these keys go."""
        return self._add(keys.select(*self.key).distinct(), True, None, writer, batch)

    def _add(self, rows: DataFrame, gone: bool, latest: Column | None, writer: str | None, batch: int) -> int | None:
        if {RUN, BUCKET, GONE} & set(rows.columns):
            raise ValueError(f"{RUN}, {BUCKET} and {GONE} are names of the table's own columns")
        said = self.manifest()
        if writer is not None and said and said["writers"].get(writer, -1) >= batch:
            return None
        schema = StructType.fromJson(said["schema"]) if said else StructType([])
        rows = self._typed(rows, schema)
        if latest is not None:
            # Dealt by bucket first, as they are written: the choice takes place where the rows lie.
            rest = F.struct(*(c for c in rows.columns if c not in self.key))
            rows = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).groupBy(BUCKET, *self.key).agg(F.max_by(rest, latest).alias("last"))
            rows = rows.select(*self.key, "last.*", BUCKET)
        run = self._write_run(rows, gone)
        rows = rows.drop(BUCKET)
        while True:
            said = self.manifest() or self._first()
            if writer is not None and said["writers"].get(writer, -1) >= batch:
                return None
            schema = StructType.fromJson(said["schema"])
            if any(f.name in schema.names and schema[f.name].dataType != f.dataType for f in rows.schema.fields):
                return self._add(rows, gone, None, writer, batch)  # another writer added the column with another type
            schema = StructType([*schema.fields, *(StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in schema.names)])
            n = said["next"]
            made = said | {"schema": json.loads(schema.json()), "runs": [*said["runs"], run | {"n": n}], "next": n + 1}
            if writer is not None:
                made["writers"] = said["writers"] | {writer: batch}
            if self._commit(made, said["version"] + 1):
                return said["version"] + 1

    def compact(self, runs: int = 4) -> bool:
        """Buckets in which ``runs`` runs or more count get one in their place. False if there are none, or another compaction was first."""
        said = self.manifest()
        counts = _counts(b for r in said["runs"] for b in r["buckets"]) if said else {}
        folded = {b for b, n in counts.items() if n >= runs}
        if not folded:
            return False
        base = {r["id"]: folded & set(r["buckets"]) for r in said["runs"]}
        run = self._write_run(self._rows(said, folded), False) | {"n": max(r["n"] for r in said["runs"] if base[r["id"]])}
        while True:
            now = self.manifest()
            own = {r["id"]: set(r["buckets"]) for r in now["runs"]}
            if any(not held <= own.get(i, set()) for i, held in base.items()):
                return False
            left = [r | {"buckets": sorted(set(r["buckets"]) - base.get(r["id"], set()))} for r in now["runs"]]
            made = now | {"runs": sorted((r for r in [*left, run] if r["buckets"]), key=lambda r: r["n"])}
            if self._commit(made, now["version"] + 1):
                return True

    def vacuum(self, older_s: float = 86_400, versions: int = 100) -> None:
        """Removes runs that the last version lacks and that are older than ``older_s``, and all but the last version files."""
        said = self.manifest()
        if said is None:
            return
        used = {f"{RUN}={r['id']}" for r in said["runs"]}
        for status in self._list(f"{self.path}/data"):
            if status.getPath().getName() not in used and status.getModificationTime() / 1000 < time.time() - older_s:
                self._fs().delete(status.getPath(), True)
        for name in sorted(self._names(f"{self.path}/log"))[:-versions]:
            self._fs().delete(self._path(f"{self.path}/log/{name}"), False)

    def _first(self) -> dict:
        return {"key": self.key, "bucket_by": self.bucket_by, "buckets": self.buckets, "schema": json.loads(StructType([]).json()), "runs": [], "next": 0, "writers": {}, "version": -1}

    def _typed(self, rows: DataFrame, schema: StructType) -> DataFrame:
        known = {f.name: f.dataType for f in schema.fields}
        return rows.select(*(F.col(f"`{c}`").cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in rows.columns))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _write_run(self, rows: DataFrame, gone: bool) -> dict:
        """The rows as a run that no version has yet. Keys are unique, so their hash deals them out evenly. Rows that name their bucket are dealt already."""
        run = uuid.uuid4().hex
        if BUCKET not in rows.columns:
            rows = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        rows.withColumn(GONE, F.lit(gone)).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/data/{RUN}={run}")
        own = sorted(int(n.split("=")[1]) for n in self._names(f"{self.path}/data/{RUN}={run}") if n.startswith(f"{BUCKET}="))
        return {"id": run, "gone": gone, "buckets": own}

    def _commit(self, made: dict, version: int) -> bool:
        """Makes the version's file, unless another writer has."""
        said = json.dumps({k: v for k, v in made.items() if k != "version"})
        draft, final = self._path(f"{self.path}/log/.{uuid.uuid4().hex}"), self._path(f"{self.path}/log/{version:012d}.json")
        fs, jvm = self._fs(), self.spark.sparkContext._jvm
        out = fs.create(draft, False)
        try:
            out.write(bytearray(said.encode()))
        finally:
            out.close()
        try:
            if fs.getScheme() == "file":
                files, paths = jvm.java.nio.file.Files, [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, draft)]
                files.createLink(*paths)
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf()).rename(draft, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(draft, False)
        return True

    # The file system

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.path).getFileSystem(self._conf())

    def _list(self, path: str) -> list:
        return list(self._fs().listStatus(self._path(path))) if self._fs().exists(self._path(path)) else []

    def _names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._list(path)]

    def _read(self, path: str) -> str:
        stream = self._fs().open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def _counts(buckets) -> dict[int, int]:
    found: dict[int, int] = {}
    for b in buckets:
        found[b] = found.get(b, 0) + 1
    return found
