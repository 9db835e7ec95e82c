"""A table of keyed rows whose batches become visible at once, and only once.

A batch is written to a folder of its own, then a manifest is published that lists it with those before.
Readers see the batches of the last manifest, of equal keys the latest row; what no manifest lists was
never committed. A batch of a stream that was committed already is not committed again, so a replay
after a failure changes nothing. `compact` folds the batches into one, `vacuum` removes folders that no
longer count. A manifest's number is taken by a rename that fails if another writer has it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .results import latest_of


@dataclass
class Manifest:
    """number: 0 before the first commit. folders: oldest first. last: each stream's last batch."""

    number: int = 0
    folders: list[str] = field(default_factory=list)
    last: dict[str, int] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has published a manifest meanwhile: read again and commit anew."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The last manifest of the table at `path`."""
    files, where = _files(spark, f"{path}/_manifests")
    if not files.exists(where):
        return Manifest()
    names = sorted(s.getPath().getName() for s in files.listStatus(where) if s.getPath().getName().endswith(".json"))
    if not names:
        return Manifest()
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/{names[-1]}"))
    try:
        return Manifest(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, new: Manifest) -> None:
    files, folder = _files(spark, f"{path}/_manifests")
    files.mkdirs(folder)
    to = spark._jvm.org.apache.hadoop.fs.Path
    name, draft = to(f"{path}/_manifests/{new.number:012d}.json"), to(f"{path}/_manifests/.{uuid.uuid4().hex}.draft")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(new.__dict__).encode()))
    stream.close()
    if files.exists(name) or not files.rename(draft, name):
        files.delete(draft, False)
        raise Conflict(f"manifest {new.number} is taken")


def commit(rows: DataFrame, path: str, batch: int, stream: str = "") -> bool:
    """Commits a batch; False if it, or a later one of the stream, is there already."""
    spark = rows.sparkSession
    now = manifest(spark, path)
    if batch <= now.last.get(stream, -1):
        return False
    folder = f"batch-{batch}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    _publish(spark, path, Manifest(now.number + 1, [*now.folders, folder], now.last | {stream: batch}))
    return True


def read(spark: SparkSession, path: str, key: str, at: str) -> DataFrame | None:
    """One row a key: of the latest batch, in it of the largest `at`; None before the first commit."""
    folders = manifest(spark, path).folders
    if not folders:
        return None
    parts = [spark.read.parquet(f"{path}/{f}").withColumn("_new", F.lit(k)) for k, f in enumerate(folders)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return latest_of(every, key, ["_new", at]).drop("_new")


def compact(spark: SparkSession, path: str, key: str, at: str) -> None:
    """Folds all batches into one, which becomes visible at once."""
    now = manifest(spark, path)
    if len(now.folders) > 1:
        folder = f"compact-{now.number}-{uuid.uuid4().hex}"
        read(spark, path, key, at).write.parquet(f"{path}/{folder}")
        _publish(spark, path, Manifest(now.number + 1, [folder], now.last))


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes the folders that the last manifest doesn't list, when no reader or writer is at work."""
    files, where = _files(spark, path)
    live = set(manifest(spark, path).folders)
    dead = sorted(s.getPath().getName() for s in files.listStatus(where) if s.getPath().getName().startswith(("batch-", "compact-")) and s.getPath().getName() not in live)
    for name in dead:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return dead


def run_commits(source: DataFrame, path: str, checkpoint: str, stream: str = "", work=None) -> None:
    """Commits all that a stream has, batch by batch, and stops; run again, it goes on."""

    def write(batch: DataFrame, number: int) -> None:
        commit(work(batch) if work else batch, path, number, stream)

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
