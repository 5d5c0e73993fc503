"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def _tell_workers(spark: SparkSession) -> None:
    """Let Python workers find this package wherever the driver was started from."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), here]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _tell_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none (tests, local mode) one temporary folder is made per
    process, set in the session and removed at exit.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir.append(tempfile.mkdtemp(prefix="stratamem-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + os.path.abspath(_own_dir[0])


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors. Parquet is used rather than ``checkpoint()`` because
    later readers then prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, by: str, label: str = "cut") -> DataFrame:
    """As :func:`materialize`, in files bucketed by ``by``, so that later joins on it do not shuffle this side again."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{shared_dir(spark)}/{name}"
    cut = df.repartition(buckets, by)
    cut.write.bucketBy(buckets, by).sortBy(by).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def drop_materialized(*frames: DataFrame) -> None:
    """Delete the files behind materialized frames that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        base = shared_dir(spark).replace("file://", "").rstrip("/")
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if base in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
