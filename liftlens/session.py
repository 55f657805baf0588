"""Session helpers: a local session for tests and the bench, and the shared
checkpoint folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, app: str = "liftlens") -> SparkSession:
    """A ``local[cores]`` session with AQE on and the UI off."""
    parts = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or one the
    context already has). Only a local session without that setting, as in
    tests, gets a fresh temporary folder; on a cluster a missing setting is an
    error, because a machine-local folder would not survive losing the node.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="liftlens-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its file system (local, HDFS, object store)."""
    fs, found = _file_system(spark, path)
    return fs.exists(found)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` and all below it on its file system."""
    fs, found = _file_system(spark, path)
    fs.delete(found, True)


def scale_settings(shuffle_bytes: int, cores: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Spark settings for a run that shuffles about ``shuffle_bytes`` (the
    projected impression log is the largest shuffle) on ``cores`` executor cores.

    The initial shuffle partition count keeps each partition near
    ``target_partition_bytes`` so sorts and hash aggregates fit in task memory
    without spilling much, and is at least a few waves of the cluster's cores;
    AQE then coalesces small partitions and splits skewed ones. Apply with
    ``for k, v in scale_settings(...).items(): spark.conf.set(k, v)``.
    """
    partitions = max(cores * 3, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes // 2),
    }
