"""Session settings and the shared folder in which lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the package is written for. A cluster sets its own sizes; these are the ones that change plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when the split costs one more shuffle further down.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows that lie by source already are joined by (source, id) where they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Join by hash instead of sort where every partition of the smaller side is known to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(cores="*", shuffle_partitions=8, driver_memory="8g", app="sourcemart") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory)
               .config("spark.ui.enabled", "false"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings a given session needs: all are runtime settings, and sizes stay as the cluster set them."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only on a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sourcemart-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, for written tables and stream checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str = "settled") -> DataFrame:
    """Fix rows in a table in shared storage, so that later branches and retried tasks see the same rows.

    One pass (``checkpoint()`` would run the last stage twice), and readers load only the columns they use.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
