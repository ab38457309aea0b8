"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master!r})")
        found = "file://" + tempfile.mkdtemp(prefix="foliary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foliary/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``save`` has written; results that were not written elsewhere before are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/foliary")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs the tasks in flight only, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_bitmap(ids: DataFrame, column: str, words: int) -> dict[int, int]:
    """A one-hash membership filter over ``ids[column]``: at most ``words`` 64-bit words, whatever the input.

    The filter only spares work: a value that is not in ``ids`` may pass, none that is in it fails.
    """
    h = F.xxhash64(F.col(column))
    slot = F.pmod(F.shiftright(h, 6), F.lit(words))
    bit = F.expr(f"shiftleft(1L, cast(xxhash64(`{column}`) & 63 as int))")
    rows = ids.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect()
    return {int(r["slot"]): int(r["bits"]) for r in rows}


def hash01(*cols: Column | str) -> Column:
    """A reproducible uniform number in [0, 1) of the given columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cols)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
