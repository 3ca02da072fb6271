"""Session defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects: UTC, AQE on, Arrow on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftwork")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WEFTWORK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to the Python workers, which on a cluster don't have it; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="weftwork-ship-")) / "weftwork.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return spark
