"""What the operators share: reading tables, and the folder that driver and executors have in common."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from ..plans import folders


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir as a uri. Where that is unset, a local master, as in tests, gets one of its own."""
    found = folders.shared_folder(spark)
    return found if urlparse(found).scheme else f"file://{found}"


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there, and every executor can read it."""
    spark = df.sparkSession
    path = fresh_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that no plan reads any more."""
    for df in tables:
        if files := df.inputFiles():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spare_name(taken, stem: str) -> str:
    """stem, or stem with a number, that clashes with no name in taken, whatever the case."""
    low = {x.lower() for x in taken}
    name, i = stem, 0
    while name.lower() in low:
        i += 1
        name = f"{stem}_{i}"
    return name
