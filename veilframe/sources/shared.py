"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # folder of each application


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session in the cluster's spark.checkpoint.dir. Where that is unset, a session
    on one machine, as in tests, gets a temporary folder; a cluster has no such folder that its
    machines share, so that is an error."""
    name = spark.sparkContext.applicationId
    if name not in _own:
        path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            path = f"file://{tempfile.mkdtemp(prefix='veilframe-')}"
        _own[name] = f"{path.rstrip('/')}/veilframe-{name}"
        atexit.register(_remove, spark._jvm, _own[name])
    return _own[name]


def _remove(jvm, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
    except Exception:  # the JVM may be gone already
        pass


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts the lineage, survives lost
    executors, and gives the planner the true size. The tables go when the driver ends."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that has as many rows as the data: it is sorted and shuffled, never broadcast. The
    planner's guess comes from the bytes of compressed files, columns left out, and is far below what
    the driver would have to hold."""
    return df.hint("merge")


def remove(df: DataFrame) -> None:
    """Removes a stored table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(spark._jvm, path)
