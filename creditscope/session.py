"""Session construction and the reliable checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    # The engine's own size check decides on broadcasts.  File sizes understate rows
    # in memory (compression), so they count several times over.
    "spark.sql.autoBroadcastJoinThreshold": "16MB",
    "spark.sql.sources.fileCompressionFactor": "5.0",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # A checkpoint goes when nothing refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "creditscope", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def recommended_conf(input_bytes: int, target_partition_bytes: int = 256 << 20,
                     min_partitions: int = 8) -> dict[str, str]:
    """Partition sizing for a given input volume: scan splits and shuffle
    partitions of ~``target_partition_bytes`` so a task's share fits executor
    memory; AQE then coalesces small partitions and splits skewed ones."""
    # Shuffles carry a fraction of the scanned bytes after projection and
    # partial aggregation; AQE coalesces whatever turns out small.
    parts = max(min_partitions, -(-input_bytes // (4 * target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster the folder is the shared one named by ``spark.checkpoint.dir``;
    it is never replaced.  Only a local-mode session (tests, bench) without one
    gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for cluster runs")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="creditscope-ckpt-"))
    return sc.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
