"""Cutting lineage through tables written to the folder that all executors share.

The folder is the one in ``spark.checkpoint.dir``. Where that setting is missing
a session on this machine alone (tests) uses a temporary folder; on a cluster
it is an error. A table
outlives the executor that wrote it, is read back with column pruning, and goes
when the Python process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    conf = spark.sparkContext.getConf()
    at = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes the rows once and returns them as a scan without lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes the tables that ``keep`` wrote and ``df`` reads; for rounds that are done with."""
    for name in {f.rsplit("/", 2)[1] for f in df.inputFiles()}:
        for item in [x for x in _written if x[1].rsplit("/", 1)[1] == name]:
            _remove(*item)
            _written.remove(item)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
