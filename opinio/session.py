"""Session helpers: one place that builds a session for local runs and
resolves the shared checkpoint folder.

On a cluster the session is created by the platform; library code only
*reads* its settings.  ``local_session`` is for tests, the bench and the
driver contract, and it is the only place that fills in settings that are
unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Broadcast only what is proven small: the library broadcasts fixed
    # word tables explicitly; automatic broadcast stays at Spark's default.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "opinio", driver_memory: str = "16g") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting is read from the session.  Only a local session (tests,
    bench) gets a private folder when it is unset; on a cluster an unset
    value is an error, because a machine-local folder does not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    d = tempfile.mkdtemp(prefix="opinio-ckpt-", dir=os.environ.get("OPINIO_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared checkpoint folder, for tables that only live as long as the session: it lies in a
    folder of its own, which the file system removes when the driver ends."""
    parent = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)                                        # only what exists can be marked
    store.deleteOnExit(path)
    return f"{parent}/table"


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files a frame reads, each once (0 if it reads none)."""
    spark = df.sparkSession
    conf, total = spark._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
