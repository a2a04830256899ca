"""Session helpers shared by the whole library."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster should install the package (or ship it with --py-files); this only helps local runs.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else ROOT


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a session on one machine; on a cluster, whose executors would not see
    it, the session's warehouse does.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        one_machine = master == "local" or master.startswith("local[")
        named = "file://" + tempfile.mkdtemp(prefix="loomgraph-") if one_machine else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/loomgraph-scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back, which survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/loomgraph-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Delete what another writer puts at path when the process ends."""
    _written[path] = spark


def as_one(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of one schema that materialize() wrote, as one scan: the plan does not grow with their number."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._loomgraph_path for t in tables])


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing reads any more."""
    path = getattr(df, "_loomgraph_path", None)
    if path in _written:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has already ended
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
