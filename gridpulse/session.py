"""Session factory and shared scratch locations."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # serving operators checkpoint small frames per call; delete those files
    # once the frames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_conf(input_bytes: int, executor_cores_total: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the input and the cores.

    * scans split at 512 MB so a 100 TB table is ~200k tasks, not millions;
    * initial shuffle partitions = input / target, clamped to [2 x cores,
      100k]; AQE coalesces them to ~``target_partition_bytes`` each. The
      rollup shuffles carry only partial aggregates (tiny); the worst case
      is the upsert, which shuffles the change set itself, so the estimate
      assumes the whole input moves, capped so map statuses stay manageable;
    * skew handling and local shuffle reads on; no broadcast of unmeasured
      sides (there are no joins in the plans, the threshold only guards).
    """
    shuffle_parts = min(100_000, max(2 * executor_cores_total, input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.shuffle.partitions": str(int(shuffle_parts)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def create_session(
    app_name: str = "gridpulse",
    master: str | None = None,
    jars: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session; ``jars`` adds e.g. a JDBC driver jar;
    ``conf`` (e.g. ``cluster_conf(...)``) overrides the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if jars:
        builder = builder.config("spark.jars", jars)
    for key, value in {**_DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may leave it unset: then a folder beside the warehouse is
    set, once a session. On a cluster an unset folder is an error, because a
    machine-local one would be empty for the other executors.
    """
    root = None
    try:
        root = spark.sparkContext.getCheckpointDir()
    except Exception:  # Spark Connect has no SparkContext
        root = None
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{uuid.uuid4().hex[:12]}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the checkpoint root, deleted when the session ends."""
    path = f"{checkpoint_root(spark)}/gridpulse/{name}-{uuid.uuid4().hex[:12]}"
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    except AttributeError:  # Spark Connect has no gateway: the folder's owner cleans up
        pass
    return path
