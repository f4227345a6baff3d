"""Session settings the operators count on, and a local session for tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int | str | None = None, memory: str = "8g") -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
    b = (b.config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false"))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session, where all tasks share one machine, gets a folder of its own; it is remembered here, since the
    setting cannot be changed in a running session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        import tempfile
        _OWN[key] = tempfile.mkdtemp(prefix="tidemark-")
    return _OWN[key]


def scratch(spark: SparkSession, name: str) -> str:
    """A new empty path in the shared folder."""
    import uuid
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
