"""Session settings and the shared folder that iterative and streaming jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings a new session should start with. Everything that depends on the size of
# the cluster (shuffle partitions, executor memory) is left to the deployment.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
}


def build_session(master: str | None = None, app: str = "waymark", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Timestamps are instants compared in UTC everywhere, also those of files without a zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """
    The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster session
    without it is an error, because a machine-local folder would lose data there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Materialise ``df`` in the shared folder and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df, *keys):
    """
    Input for a compute-heavy plan, in at least as many parts as there are cores.

    A small table in a single file would keep one core busy. A table that already has a split
    per core, as any large one does, is left as it is, so nothing large is shuffled. Rows go by
    key, which gives the same parts again when a lost task is repeated. Meant for scans: counting
    the parts of a plan with shuffles would run them.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)


def spread_rows(df, rows: int, *keys):
    """
    Input whose rows are expensive, in parts of about ``rows`` rows each, at least one per core.

    The time of the longest task then does not grow with the table, however few splits its files have.
    Counting a scan reads only the files' footers.
    """
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(wanted, *keys)
