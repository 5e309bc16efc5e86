"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job relies on. Skewed join keys are split by adaptive execution, also when the
# split costs one more exchange further down.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Gene-model and peptide arithmetic is much work for few bytes: an exchange of a few MB still goes to all cores.
# The same holds for large ones: a task reads 16 MB, so that tasks grow in number with the tables, not in time and memory.
FINE = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
}
_OWN: dict[str, str] = {}  # what the session had before, where it was set


def tune(spark: SparkSession, fine: bool = False) -> SparkSession:
    """Apply the runtime settings to a session that already exists.

    ``fine`` lets adaptive execution keep small partitions, down to 64 kB, as long as cores are free, and keeps large ones
    at 16 MB.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, value in FINE.items():
        now = spark.conf.get(key)
        if fine and now != value:
            _OWN[key] = now
            spark.conf.set(key, value)
        elif not fine and now == value and key in _OWN:
            spark.conf.set(key, _OWN.pop(key))
    return spark


def local_session(cores: int = 8, memory: str = "8g", app: str = "neoquarry") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no Python call sites on every column: building large expressions is several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local session that has none gets a
    temporary one of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="neoquarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder where the cluster has not set one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def spread(df):
    """Deal a table out when its files give fewer splits than the session has cores.

    One small file is one task, which leaves the other cores idle in front of row-wise work. A table with
    enough splits is returned as it is, without an exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
