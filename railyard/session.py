"""SparkSession construction and lineage helpers.

The library never creates its own session inside an operator: every public
function takes a ``SparkSession`` or a ``DataFrame``. ``build_session`` is for
scripts, tests and the bench.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. UTC keeps dates stable across engines; AQE
# re-plans joins and coalesces small shuffles at run time; LAST_WIN matches
# Python's ``json.loads`` when a model output repeats a key.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Settings for a large cluster (order of 1,000 executors, 100 TB of input).
# Sizing: 100 TB / 512 MB splits = about 200,000 scan tasks, each well inside
# executor memory; every aggregate combines map-side first, so shuffles carry
# partial aggregates, not rows. AQE starts from 16,000 shuffle partitions and
# coalesces them to about 256 MB each; a partition five times the median and
# over 1 GB is split (skew join). Broadcasts are capped at 64 MB: only
# month- or line-level aggregates are ever joined.
CLUSTER_PROFILE = {
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.shuffle.partitions": "16000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def build_session(
    master: str | None = None,
    app_name: str = "railyard",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
    cluster: bool = False,
) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults (and the
    cluster profile when ``cluster`` is set)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if cluster:
        conf.update(CLUSTER_PROFILE)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # remote session
        pass
    for k, v in conf.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``; where that is unset, a folder in the warehouse
    (``fallback`` in tests)."""
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server owns the setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # pragma: no cover - conf absent
            configured = None
    if not configured:
        # the warehouse is shared by all executors on a cluster
        configured = fallback or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a frame feeds several actions: a lost executor then recomputes
    from the checkpoint files, not from the whole upstream plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint location, for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts)
