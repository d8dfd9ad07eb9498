"""Session helpers: table access, the shared checkpoint folder, stable hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, or where that is unset and the master is local a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(spark, "_foliary_dir", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="foliary-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            where = spark._foliary_dir = "file://" + folder
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def clean_up(spark: SparkSession) -> None:
    """Remove what ``materialise`` and ``scratch`` laid down in this session. Checkpoints are Spark's own: it removes them with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``. Frames read from such tables must not be used afterwards."""
    for path in getattr(spark, "_foliary_made", []):
        hp = spark._jvm.org.apache.hadoop.fs.Path(path)
        hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)
    spark._foliary_made = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``clean_up`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark._foliary_made = [*getattr(spark, "_foliary_made", []), path]
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int) -> DataFrame | None:
    """``df`` marked for broadcast where it has ``most`` rows at most, else None; it should be a stored table, as its rows are counted. Tables
    cut from their lineage have no size that the planner knows, so that without this it would shuffle the large side in any case."""
    return F.broadcast(df) if df.count() <= most else None


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (columnar, so later reads prune columns)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that its functions run wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_foliary_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="foliary-"), "foliary_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._foliary_shipped = True
