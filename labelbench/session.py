"""Session, table loading and lineage helpers shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Tables the driver provides, one parquet file each below an sf directory.
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "labelbench") -> SparkSession:
    """Build (or reuse) a session tuned for this library.

    On a cluster the launcher already owns master, memory and the checkpoint
    folder; we only set what is missing.  AQE stays on so that joins against
    grouped results become broadcasts only after Spark has measured them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it to a shared file system.  Where it is unset, a local session takes a
    scratch folder of this machine; on a cluster that would not be shared, so it is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="labelbench-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # core configs may be read-only at runtime
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Materialise ``df`` as parquet in the shared checkpoint folder and read it back.

    A written table survives executor loss (unlike ``localCheckpoint``) and
    keeps the plan short for the stages that follow.
    """
    spark = spark or df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"table-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# (session, path) -> DataFrame.  Reading a path lists files and reads parquet
# footers (~0.1 s); a DataFrame is an immutable plan (no data is held), so the
# provided tables are read once per session.
_TABLE_CACHE: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one provided table; Catalyst prunes columns and pushes filters into the scan, whose
    tasks follow the row groups and ``spark.sql.files.maxPartitionBytes``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (id(spark), path)
    df = _TABLE_CACHE.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _TABLE_CACHE[key] = df
    return df
