"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: State store that streams with timers and several states per key need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(name: str = "draftlake", cores: str = "8", memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark on one machine; a cluster brings its own, with its own
    shared checkpoint folder."""
    folder = os.environ.get("DRAFTLAKE_CHECKPOINTS") or tempfile.mkdtemp(prefix="draftlake-ckpt-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(CHECKPOINT_KEY, folder)
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not shared and not sc.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="draftlake-ckpt-"))  # unset: one process, as in tests


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; used between passes of an iteration, so that a
    lost executor re-reads files instead of replaying all earlier passes."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def built_once(df: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each: the optimiser carries no expression over it, so
    a column that many expressions read is built once per row and not in each of them."""
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))
