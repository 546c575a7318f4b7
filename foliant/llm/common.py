"""What the operators share: the folder all executors see, written work tables, small Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import shared_dir, written

__all__ = ["BROADCAST_ROWS", "fresh", "shared_dir", "shuffle_partitions", "sized", "slices", "table", "work_path", "written"]


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores behind it as long as a column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 100_000


def sized(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if a count shows that it is small enough; otherwise as it
    is, for a join that shuffles."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, max_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in runs of at most max_rows rows and about max_bytes of text (one row at least), so that the
    memory a task takes follows neither the batch size nor the table."""
    for batch in batches:
        at, used, rows = 0, 0, 0
        for i, v in enumerate(batch.column(batch.schema.get_field_index(column))):
            n = v.as_buffer().size if v.is_valid else 0
            if rows and (used + n > max_bytes or rows >= max_rows):
                yield batch.slice(at, rows)
                at, used, rows = i, 0, 0
            used, rows = used + n, rows + 1
        if rows:
            yield batch.slice(at, rows)
