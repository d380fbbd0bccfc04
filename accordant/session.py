"""Session helpers shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "accordant", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "localhost")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; where it names none, a scratch folder
    of a local session. Executors of a cluster would not share such a folder, so there it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(fallback)
    return fallback


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once as parquet in the shared checkpoint folder and read them back.

    Used where one result feeds several branches or the next round of a loop: the
    branches scan a small table instead of repeating the work, later steps restart
    from files when executors are lost, and column pruning and sizes stay known to
    the optimizer.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: paths that ``cut_lineage`` has written and nothing has deleted, oldest first
_SCRATCH: list[str] = []


def scratch() -> list[str]:
    """The written tables so far; the last is that of the latest ``cut_lineage``."""
    return list(_SCRATCH)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _SCRATCH.remove(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps whose results were written.

    Spark drops them when the driver's garbage collector meets their owner, which an idle
    driver rarely does.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
