"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which a query's shuffle files go when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the folder named by spark.checkpoint.dir; in local mode (tests) a temporary one where none is set.

    The shuffle files that led to it go once it's written, as nothing reads them again.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-checkpoint-"))
    before = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        return df.select("*").checkpoint()  # a query of its own, as the setting holds from its making on
    finally:
        spark.conf.set(RELEASE, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def top(df: DataFrame, n: int | None, *order) -> DataFrame:
    """Ordered limit; the order must be total. None keeps all rows."""
    return df if n is None else df.orderBy(*order).limit(n)
