"""Session helpers: the shared working folder, table access, code shipping."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only a single-JVM ``local`` master may lack the setting; a temporary folder
    of this machine is used there. On any other master a missing setting is an
    error, because a machine-local folder would lose data with its machine.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on master {master}")
    root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    spark.sparkContext.setCheckpointDir(root)
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder; :func:`release` deletes it."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_made: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Deletes the working folders this application has made so far (store versions, cut lineage). For the
    caller to call when no DataFrame it still needs was made from them. Returns their number."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        SharedFiles(spark, p).delete("")
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, hashed over all cores, for the Python
    work that follows. Inputs of many splits stay as they are: no shuffle at scale. Only for plain
    scans, whose number of splits is known without running anything."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, *cols)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per application, for Python workers."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", None):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="ledgerloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "ledgerloom_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("ledgerloom", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._ledgerloom_shipped = target


class SharedFiles:
    """Small driver-side wrapper over the Hadoop file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def names(self, rel: str) -> list[str]:
        at = self._path(rel)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, rel: str) -> bool:
        return self._fs.exists(self._path(rel))

    def delete(self, rel: str) -> None:
        self._fs.delete(self._path(rel), True)

    def read_json(self, rel: str) -> dict:
        stream = self._fs.open(self._path(rel))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit_json(self, rel: str, value: dict) -> None:
        """Atomic publish: write aside, then give the file its name, which fails if the name is taken.

        On a local disk the name is given by a hard link, elsewhere by the file system's rename, which
        on HDFS refuses an existing target. The loser of a race gets :class:`LostRace`."""
        aside = f"{rel}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(aside), False)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            if self._fs.getScheme() == "file":
                local = [self._path(x).toUri().getPath() for x in (aside, rel)]
                os.link(*local)
            elif self.exists(rel) or not self._fs.rename(self._path(aside), self._path(rel)):
                raise FileExistsError(rel)
        except FileExistsError:
            raise LostRace(f"lost the race to commit {rel}") from None
        finally:
            self._fs.delete(self._path(aside), False)

    def age_hours(self, rel: str) -> float:
        return (time.time() * 1000 - self._fs.getFileStatus(self._path(rel)).getModificationTime()) / 3_600_000


class LostRace(RuntimeError):
    """Another writer committed first."""


class Versioned:
    """A folder whose valid content is what its newest manifest lists.

    Every attempt to write uses a folder name of its own (:meth:`attempt`), so neither a crashed
    attempt nor a second writer is ever in the way; what no manifest lists does not exist for readers.
    The manifest also holds, per stream of batches, the highest batch applied: a batch that is given
    again is skipped, and its rows and its mark are published by the same rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, SharedFiles(spark, path)

    def manifest(self) -> tuple[int, dict]:
        """Latest committed manifest: (number, content); (0, {}) for a new folder."""
        done = [n for n in self.files.names("_manifests") if n.endswith(".json")]
        return (int(done[-1][:-5]), self.files.read_json(f"_manifests/{done[-1]}")) if done else (0, {})

    def attempt(self) -> str:
        return f"attempt=a{uuid.uuid4().hex}"

    def commit(self, build, batch: tuple[str, int] | None = None, tries: int = 5) -> dict:
        """``build(manifest)`` writes its files and returns (new manifest, info). If another writer was
        first, it is built again on that one's manifest. batch: (stream, number), numbers rising."""
        for left in reversed(range(tries)):
            number, old = self.manifest()
            if batch is not None and old.get("batches", {}).get(batch[0], -1) >= batch[1]:
                return {"commit": number, "skipped": True}
            new, info = build(old)
            new["batches"] = old.get("batches", {}) | ({batch[0]: batch[1]} if batch else {})
            try:
                self.files.commit_json(f"_manifests/{number + 1:012d}.json", new)
            except LostRace:
                if not left:
                    raise
                continue
            return {"commit": number + 1, "skipped": False, **info}
        raise ValueError("tries must be positive")

    def vacuum(self, kinds: list[str], older_than_hours: float = 24.0) -> int:
        """Deletes attempt folders and manifests that the newest manifest does not need. Younger ones
        stay: they may belong to a writer at work or a reader of the version before."""
        number, now = self.manifest()
        held = json.dumps(now)
        gone = [f"{k}/{n}" for k in kinds for n in self.files.names(k) if n not in held]
        gone += [f"_manifests/{n}" for n in self.files.names("_manifests") if n != f"{number:012d}.json"]
        gone = [g for g in gone if self.files.age_hours(g) >= older_than_hours]
        for g in gone:
            self.files.delete(g)
        return len(gone)
