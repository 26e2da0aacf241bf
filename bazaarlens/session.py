"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", app: str = "bazaarlens", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_used: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the session shares between its machines.

    Clusters name it in ``spark.checkpoint.dir``. Without the setting it is a folder in the session's
    warehouse, which must then be in a store that all machines see; a local session's may be on its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        on_disk = "://" not in warehouse or warehouse.startswith("file:")
        if on_disk and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = warehouse.rstrip("/") + "/work"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _used.append(path)
    return path


def clear_work(spark: SparkSession) -> int:
    """Empty the folders below ``work_path`` that this process has been given, once results are written; how many.

    DataFrames that read them cannot be used any more.
    """
    cleared = 0
    while _used:
        spark.createDataFrame([], "cleared boolean").write.mode("overwrite").parquet(_used.pop())
        cleared += 1
    return cleared
