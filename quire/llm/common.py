"""What the operators of this package share: reading a table, cutting lineage, Arrow stages.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which all executors and the driver share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import cut, shared_dir  # noqa: F401  cut is for the operators

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a table that ``cut`` has written and that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_dir(spark).removeprefix("file://")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def arrow_stage(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` in batches of at most ``rows`` rows. Spark bounds the bytes of what it sends (64 MB, or a row); this
    bounds what a stage turns into Python objects at once, and leaves the session's settings alone."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                yield batch.slice(k, rows)

    return df.mapInArrow(lambda batches: each(sliced(batches)), schema)


def empty_for_null(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` has not got."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted
