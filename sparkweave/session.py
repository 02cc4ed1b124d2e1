"""Session and shared-folder helpers.

Work that must outlive a task (checkpoints, versioned tables, topic logs,
streaming checkpoints) goes under the shared folder named by
``spark.checkpoint.dir``.  On a cluster that setting must point at shared
storage (HDFS, S3A, ...); a local temporary folder is only created when the
session runs in local mode and nothing is configured (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "sparkweave", extra: dict | None = None) -> SparkSession:
    """Session used by tests and the bench (local mode)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_defaults(input_bytes: int, cores: int, split_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of input on ``cores``
    executor cores: file splits of ``split_bytes``, enough shuffle partitions
    that each holds about one split (AQE coalesces small ones and splits
    skewed ones at run time), broadcast only below 64 MB."""
    shuffle = max(cores * 2, input_bytes // split_bytes)
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def shared_root(spark: SparkSession) -> str:
    """Root of the shared work folder (``spark.checkpoint.dir``).

    Reads the setting from the session.  Only when it is unset *and* the
    session is local (tests) is a temporary folder created and registered as
    the checkpoint dir; on a cluster an unset value is an error, because a
    machine-local folder is not visible to executors.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage "
            "(hdfs://, s3a://, ...) before running sparkweave jobs on a cluster")
    app = sc.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="sparkweave-")
        sc.setCheckpointDir(_LOCAL_ROOTS[app])
    return _LOCAL_ROOTS[app]


def work_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared root: ``<root>/sparkweave/<parts...>``."""
    return "/".join([shared_root(spark), "sparkweave", *[p.strip("/") for p in parts]])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared root (one per run)."""
    return work_path(spark, name, uuid.uuid4().hex)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new folder below the shared root and read back:
    its lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
