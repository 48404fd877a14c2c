"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every operator relies on.  They are SQL confs, so they can be
# applied to a session somebody else started.
RUNTIME_CONF = {
    # Day and hour columns are cut in this zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # One order, buyer or product may own a third of the rows: let Spark split
    # the hot side of a join, even if that costs another exchange further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Batch exchanges begin with many small parts, which adaptive execution puts together by their size:
    # the sorts of a task then fit its memory whatever the session's shuffle partitions.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Commit the changes of a batch, not whole state files; one store per join partition.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def configure(spark: SparkSession, time_zone: str = "UTC") -> SparkSession:
    """Apply the runtime settings to a running session."""
    for key, value in {**RUNTIME_CONF, "spark.sql.session.timeZone": time_zone}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "tillflow") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only where it is
    unset and all of Spark is in one process (tests) a temporary folder is used;
    on a cluster every executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tillflow-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def state_settings(spark: SparkSession, **settings: str):
    """Settings of the RocksDB state stores of queries started inside the block."""
    keys = {f"spark.sql.streaming.stateStore.rocksdb.{name.replace('__', '.')}": value for name, value in settings.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextlib.contextmanager
def state_partitions(spark: SparkSession, partitions: int | None = None):
    """Partition count for the state of queries started inside the block.

    A streaming query keeps the count of its first start for good, so it is the
    session's own value unless one is given.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if partitions is not None:
        spark.conf.set(key, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(key, before)
