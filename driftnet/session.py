"""Session settings for local work; on a cluster the submitted configuration decides."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cores}]").appName("driftnet").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own until the process ends; on a cluster that is an error, as
    executors would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in LOCAL:
        LOCAL[app] = tempfile.mkdtemp(prefix="driftnet-")
        atexit.register(shutil.rmtree, LOCAL[app], ignore_errors=True)
    return f"file://{LOCAL[app]}"
