"""Spark session and shared-folder helpers.

The library never decides where the cluster keeps reliable files: it reads
``spark.checkpoint.dir`` from the running session.  Only a local session that
has no such setting (tests, benchmarks on one machine) gets a fresh scratch
folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of intermediates are removed once their DataFrames are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "trapwise") -> SparkSession:
    """A local session for tests and benchmarks (no UI, AQE on)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("TRAPWISE_DRIVER_MEM", "12g")))
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster this is set by the operator (``spark.checkpoint.dir``) and
    is used as is.  Only when it is unset - a local run - a new scratch folder
    under the system temp dir is created and registered.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)  # set in the conf only: register it for checkpoint()
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="trapwise-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for an intermediate table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder); survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    For large tables: a checkpoint holds whole rows uncompressed, Parquet compressed columns.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove_stored(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads, and let Spark's cleaner drop the shuffle files of finished steps."""
    sc = tables[0].sparkSession.sparkContext
    for t in tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    release_shuffles(tables[0].sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps.

    It does when the driver's unused plans are collected; a finished step's plan is in use until the session's listeners
    have seen its end, a moment later.
    """
    for wait in (0.3, 0.3, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def _workers_can_import(spark: SparkSession) -> bool:
    def probe(_):
        import importlib.util

        yield importlib.util.find_spec("trapwise") is not None

    return all(spark.sparkContext.parallelize([0], 1).mapPartitions(probe).collect())


def ship_package(spark: SparkSession) -> None:
    """Make ``trapwise`` importable in the Python workers (once per context).

    Kernels run inside ``mapInArrow`` tasks and refer to functions of this
    package.  Workers on the driver's own machine that can import it need
    nothing; for a cluster the package is always zipped on the driver and distributed with
    ``addPyFile`` (Spark serves the file; executors never read a driver path).
    """
    import zipfile

    import trapwise

    sc = spark.sparkContext
    if getattr(sc, "_trapwise_shipped", False):
        return
    if sc.master.startswith("local[") and _workers_can_import(spark):
        sc._trapwise_shipped = True  # one machine: what one worker finds, all find
        return
    pkg = os.path.dirname(os.path.abspath(trapwise.__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="trapwise-pkg-"), "trapwise.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._trapwise_shipped = True
