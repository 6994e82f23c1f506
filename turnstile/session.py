"""Session settings the operators rely on, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Dates are UTC days, money is exact and a failed cast is an error, not a NULL.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs a later exchange again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A top-k per key is cut before the shuffle for deep pages as well; counting rows needs no memory.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # Rows dealt out by event stay where they are for a join on the event and something else.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(app: str = "turnstile", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the required settings to a session somebody else made."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a local-mode session (tests) gets a temporary folder when the setting is missing.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="turnstile-"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """df as stored in the shared folder: rows that are read several times and made once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def store_buckets(df: DataFrame, label: str, key: str) -> DataFrame:
    """df as stored in the shared folder in buckets of ``key``: rows that are read several times and need not move
    for a join on it."""
    spark = df.sparkSession
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
