"""Tables written once to the folder that all executors share.

Staging cuts lineage: whatever reads a staged table survives the loss of the
executors that made it, and a costly pass is never run twice.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master that has none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    current = sc.getCheckpointDir()
    if current is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    if not _written:
        atexit.register(_remove_all)
    path = f"{shared_dir(spark)}/brindle/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_all() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def sample_by_hash(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """The ``rows`` rows first by hash of those that differ in ``columns``, all if there are fewer; for fitting and pivots only.

    Rows are thinned by their hash before any are sorted, so that tasks send
    about twice the rows in all, however many tasks there are. The share is of
    the different hashes, so that repeats don't thin them; should it leave too
    few, nothing is thinned.
    """
    place = F.shiftrightunsigned("__hash", 2)
    hashed = df.withColumn("__hash", F.xxhash64(*columns))
    different = hashed.select("__hash").distinct()
    n = different.count()
    if 2 * rows < n:
        thin = place <= int(2 * rows / n * (1 << 62))
        if different.filter(thin).count() >= rows:
            hashed = hashed.filter(thin)
    return hashed.dropDuplicates(["__hash"]).orderBy(place, "__hash").limit(rows).drop("__hash")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
