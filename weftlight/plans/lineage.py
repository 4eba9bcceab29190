"""Cutting lineage on storage that survives the loss of an executor.

The folder is the one the session names in ``spark.checkpoint.dir``. Only where
that is unset (tests, local runs) a local folder is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or a local one where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not str(spark.sparkContext.master).startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = spark.conf.get("weftlight.local.shared", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="weftlight-")
        spark.conf.set("weftlight.local.shared", made)
    return made


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark) + "/rdd")
    return df.checkpoint(eager)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table into the shared folder and read it back.

    Smaller than a checkpoint (columnar, compressed) and readable by pruned
    column, so it is the better cut where a wide table is read twice.
    """
    spark = df.sparkSession
    folder = _tables_of(spark)
    if folder not in _to_drop:
        _to_drop.add(folder)
        atexit.register(_drop_at_exit, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_to_drop: set[str] = set()
_dropped: dict[str, int] = {}


def generation(spark: SparkSession) -> tuple[str, int]:
    """Changes when the tables of an application are dropped: what was kept of them is gone then."""
    folder = _tables_of(spark)
    return folder, _dropped.get(folder, 0)


def _tables_of(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    """The tables of an application go when its driver ends; the results that read them are gone then."""
    try:
        _delete(spark, folder)
    except Exception:  # the JVM may have gone before
        pass


def drop_written(spark: SparkSession) -> None:
    """Removes the tables that ``written`` made in this application, once their readers are done."""
    folder = _tables_of(spark)
    _dropped[folder] = _dropped.get(folder, 0) + 1
    _delete(spark, folder)
