"""Session set-up, checkpoints and small size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "trailmesh", master: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster pass the session you have."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local (tests) is a scratch folder chosen here, once per session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    The written table survives the loss of executors, is read column by column, and its
    size is known to the planner. (A checkpointed RDD would carry the constraints of its
    plan along, and in a loop those grow with every round.)
    """
    path = f"{scratch_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by ``columns`` over as many tasks as the session has shuffle partitions.

    For steps that make much work of small rows: by their size alone, adaptive execution would
    put them into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def in_utc(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")
    return df


def epoch_seconds(column) -> F.Column:
    """Seconds with millisecond resolution."""
    return F.unix_millis(column) / F.lit(1000.0)
