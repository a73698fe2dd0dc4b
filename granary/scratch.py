"""Tables that a query writes and reads again within one run, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []
_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder, on one machine only, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        found = _folders.setdefault(name, "") or "file://" + tempfile.mkdtemp(prefix="granary-")
        _folders[name] = found
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table: its lineage ends here, and it is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/scratch-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop() -> None:
    for spark, path in _paths:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone by now
            continue
