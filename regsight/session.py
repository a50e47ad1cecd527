"""Session construction and shared-storage helpers.

The library never creates data on a machine-local path when running on a
cluster: intermediate tables and exports go under the folder the cluster
names in ``spark.checkpoint.dir``. A default is set only when the session
has none, which is the case in tests.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale. AQE re-plans joins from runtime sizes,
# splits skewed shuffle partitions and coalesces small ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # runtime bloom filters prune the large side of a selective join before its shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # remove reliable-checkpoint files once the DataFrame that owns them is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # many report types in one session: keep their compiled stages cached
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_LOCAL_CHECKPOINT_FALLBACK = "/tmp/regsight-checkpoints"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "regsight", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A local folder is set only when the setting is absent and Spark runs in
    local mode (tests); on a cluster a missing setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store)")
        configured = _LOCAL_CHECKPOINT_FALLBACK
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "regsight", f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Remove folders of ``scratch_path`` that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
