"""How tables lie in tasks."""

from __future__ import annotations

import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: a file with one row group is one task, however it is split. Tables of more than SPREAD_BYTES have row groups enough and stay as they are, without a shuffle."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a table and reads it again, in a folder that lasts as long as the block: below spark.checkpoint.dir,
    which driver and executors share, or in a temporary folder where none is named and all runs on this machine. Plans begin anew
    at such a table, so that what is built on it is short, and a lost executor costs no more than its tasks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    own = None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = own = tempfile.mkdtemp(prefix="work-")
    folder, number = f"{root.rstrip('/')}/work-{uuid.uuid4().hex}", itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(number)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if own:
            shutil.rmtree(own, ignore_errors=True)
