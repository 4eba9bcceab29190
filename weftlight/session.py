"""Session defaults. On a cluster, settings that are already there win."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("weftlight")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, once per application.

    The archive lies in the shared folder, or in a local one in local mode. Where
    the shared folder is no mounted path, executors must have the package installed.
    """
    from weftlight.plans.lineage import shared_folder

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = shared_folder(spark)
    if folder.startswith(("file:", "/")):
        target = Path("/" + folder.removeprefix("file:").lstrip("/")) / "code" / f"weftlight-{context.applicationId}.zip"
        target.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as file:
            for path in sorted(root.rglob("*.py")):
                file.write(path, os.path.join(root.name, path.relative_to(root)))
        context.addPyFile(str(target))
    _shipped.add(context.applicationId)
