"""Tables that a plan writes once and reads several times, in the folder that the cluster shares.

An Arrow function that stands below several joins would be run again for each; and what
has to be the same for all readers (a numbering by partitions) must not be made twice.
The folder is that of ``spark.checkpoint.dir``; each table goes when the driver ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share; set it when the session is built")
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read back: a plan without a past."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tesserae/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds each row's number in the whole order, from 0 and without gaps.

    Ranges of the order, which Spark's sampling cuts, are numbered side by side; the one
    window without a partition has a row for each of them, however the keys are spread.
    """
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(starts, "_range").select(*df.columns, (F.col("_start") + F.col("_place")).cast("long").alias(name))


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone already; then the cluster's own clean-up is left
            return
