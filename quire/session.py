"""Session helpers: local sessions for tests and benches, shared checkpoint dir."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Scratch folders of local applications without spark.checkpoint.dir, by application id.
_local_dirs: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
    """A local session configured like the cluster profile (AQE on, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.quire.scanPartitions", str(shuffle_partitions))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Where a local session (tests) has none, a scratch folder is made once per
    application and set as the context's checkpoint folder. On a cluster a
    missing setting is an error: executors can't see a folder of the driver.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local_dirs.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="quire-ckpt-")
        _local_dirs[sc.applicationId] = path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df, name: str = "table"):
    """Write `df` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint (never ``localCheckpoint``)
    and survives executor loss, but computes the input once (an RDD
    checkpoint recomputes it for the write job unless cached) and stores it
    columnar and compressed, so later reads prune columns.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quire-tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Session setting: drop the shuffle files of a query as soon as it has ended, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, a write leaves no shuffle files behind: for jobs whose steps each read what the last one wrote."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
