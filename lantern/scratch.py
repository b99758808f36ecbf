"""Tables in the folder that driver and executors share; writing one cuts a plan's lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir; a folder of our own only where none is named and
    all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all machines share")
        named = os.path.join(tempfile.gettempdir(), "lantern-shared")
    return named.rstrip("/")


_MADE: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the application's driver ends."""
    path = f"{shared_dir(spark)}/lantern-{spark.sparkContext.applicationId}"
    if path not in _MADE:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _MADE.add(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts the lineage. options: the writer's."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, made once for an application and key; for what is read from scratch tables, so `clear` ends it."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _KEPT:
        _KEPT[full] = make()
    return _KEPT[full]


def clear(spark: SparkSession) -> None:
    """Delete this session's scratch tables; results that still read them are void after it."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.discard(_folder(spark))
