"""What the operators share: the scratch folder, ordered buckets and gapless numbering.

Scratch tables cut lineage. They lie in the folder that ``spark.checkpoint.dir``
names, which every executor and the driver share, so a lost executor costs a
reread and not a recomputation of everything before.
"""

from __future__ import annotations

import atexit
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_settled: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share; set it when the session is built")
    return where.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{scratch(spark)}/tesserae/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: a plan without a past."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _settled[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more."""
    for df in tables:
        if path := _settled.pop(df, None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone already; then the cluster's own clean-up is left
            return


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's names, whatever else the table has."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


#: Rows that travel to Python at once, unless the session asks for other than Spark's default: texts are long.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For applications (the queries and the pipeline), which own their session; operators leave it as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id (long) and text (null: empty), with ``more`` columns kept."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def cuts(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending key values that cut the rows into ordered buckets of like size."""
    if n < 2:
        return []
    at = F.percentile_approx(key, F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(min(1_000_000, max(10_000, 20 * n))))
    found = df.agg(at.alias("at")).head()
    return sorted(set(found["at"] or ())) if found else []


def bucket(key: str, at: list[int]) -> Column:
    """The number of cuts at or below the key; 0 for a null key. Two looks, each through the square root of their number."""
    if not at:
        return F.lit(0)
    step = max(1, int(len(at) ** 0.5))
    fine = F.array(*(F.lit(x) for x in at))
    coarse = F.array(*(F.lit(x) for x in at[step - 1 :: step]))
    up_to = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(key)))
    first = up_to(coarse) * step
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(first + up_to(F.slice(fine, first + 1, step))).cast("int")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Adds the gapless number of each row within its group, from 0.

    A group may hold most rows, and most rows may be alike, so rows are numbered
    within buckets of their group (by hash of the order and, for rows that are
    alike, by where they come from), and each bucket starts where those before it
    end. Groups are not null. ``rows``, the number of all rows, sets how many buckets
    there are. Ties in ``order`` fall to any of the tied rows; the buckets are
    written before they are counted, so a lost executor changes none.
    """
    n = max(64, -(-rows // 100_000))
    come = F.shiftright(F.monotonically_increasing_id(), 10)  # a thousand rows of a partition
    dealt = settle(df.withColumn("_b", F.pmod(F.xxhash64(*order, come), F.lit(n))), "dealt")
    sizes = dealt.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_b").orderBy(*order)
    ranked = dealt.withColumn("_r", F.row_number().over(within) - 1)
    return ranked.join(starts, [*group, "_b"]).select(*(ranked[c] for c in df.columns), (F.col("_start") + F.col("_r")).cast("long").alias(name))
