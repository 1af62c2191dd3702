"""Session helpers: builder defaults, size limits, and the checkpoint folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Limits that decide between the plain plan and the split plan of an operator.
# Both are session settings, so a cluster can size them to its executors.
MAX_GROUP_ROWS = ("grainmill.maxGroupRows", 2_000_000)
EXACT_PERCENTILE_ROWS = ("grainmill.exactPercentileRows", 5_000_000)
BROADCAST_ROWS = ("grainmill.broadcastRows", 200_000)


def build_session(app: str = "grainmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; `conf` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def setting(spark: SparkSession, entry: tuple[str, int]) -> int:
    """Read an integer limit from the session, falling back to its default."""
    name, default = entry
    return int(spark.conf.get(name, str(default)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make `checkpoint()` usable: the cluster's shared folder, or a temp folder in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="grainmill-checkpoint-")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and freezes partition ids."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for intermediate files, beside the checkpoints all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid4().hex}"
