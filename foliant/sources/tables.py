"""Work tables in the folder that all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the setting is missing, a temporary folder does for a session in
    one process (tests); on a cluster, executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is worked out once, what comes after is planned anew, and it
    outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df on all cores, for steps that take long for each row: a small file, a group of rows that is not split, or small
    partitions put together are one task's."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def of_each(df: DataFrame) -> DataFrame:
    """df, a table with a row for each of many documents, as the right side of a join: sorted and merged, whatever its
    size. Written, its maps are a small part of what they take in memory, so Spark would send it to the driver, and from
    there to all executors, where it does not fit."""
    return df.hint("merge")


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores behind it as long as a column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
