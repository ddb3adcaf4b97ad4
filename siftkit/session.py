"""Session helper and the folder that all executors share."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Setting read by ``sources.tables.dealt``; only ``bench.py`` sets it.
SCAN_PARTITIONS = "spark.siftkit.scanPartitions"
#: The folder for written tables; on a cluster it must be shared storage.
SHARED_DIR = "spark.checkpoint.dir"
#: Used where neither the submit command nor ``spark-defaults.conf`` says otherwise.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "siftkit", **given: str) -> SparkSession:
    """A session; what is in ``given`` (``"spark.x.y"`` by value) is set, all else only where nothing is set.

    Master, memory and shuffle partitions come from the submit command or
    ``spark-defaults.conf``.  Where no master is set the session is local, with two shuffle
    partitions a core and, if none is set, a temporary folder for written tables.
    """
    SparkContext._ensure_initialized()  # else the settings of the submit command cannot be read
    there = SparkConf()
    conf = DEFAULTS | {"spark.app.name": app}
    if (given.get("spark.master") or there.get("spark.master", "local")).startswith("local"):
        cpus = os.cpu_count() or 1
        conf |= {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": str(2 * cpus)}
        if not there.contains(SHARED_DIR) and SHARED_DIR not in given:
            conf[SHARED_DIR] = tempfile.mkdtemp(prefix="siftkit-shared-")
    conf = {k: v for k, v in conf.items() if not there.contains(k)} | given
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``."""
    path = spark.conf.get(SHARED_DIR, None)
    if not path:
        raise ValueError(f"set {SHARED_DIR} to a folder that the driver and all executors share")
    return path.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back.

    What is read twice then agrees, and is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
