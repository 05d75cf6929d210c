"""Session set-up and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def get_session(cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cairnflow")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_cairnflow_shipped", False):
        return
    handle, archive = tempfile.mkstemp(prefix="cairnflow-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, Path(PACKAGE.name) / path.relative_to(PACKAGE))
    sc.addPyFile(archive)
    sc._cairnflow_shipped = True
