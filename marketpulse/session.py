"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

#: Setting of the state store of streaming jobs, and the store that can hold keyed state.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot lookup key even when the split costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    STATE_STORE: ROCKSDB,
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "marketpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Session setting that names a shared folder where ``spark.checkpoint.dir`` is unset.
SHARED_DIR = "spark.marketpulse.sharedDir"


def shared_dir(spark: SparkSession, purpose: str, base: str | None = None) -> str:
    """A new folder name under a folder that driver and executors share.

    That is ``base``, else the cluster's ``spark.checkpoint.dir``, else the folder named by
    ``SHARED_DIR``. Without any of them this fails rather than write to one machine's disk.
    Results may be read from there until they are consumed; the owner of the folder cleans it.
    """
    base = (
        base
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        or spark.conf.get(SHARED_DIR, None)
    )
    if not base:
        raise ValueError(f"set spark.checkpoint.dir or {SHARED_DIR} to a shared folder")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver started."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
