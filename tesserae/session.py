"""Session defaults and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(name: str = "tesserae", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benches; a cluster brings its own.

    Only where nothing names a shared folder (``spark.checkpoint.dir``, which cannot be set
    later) the session is built once more with one on this machine.
    """

    def built(more: dict[str, str]) -> SparkSession:
        builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
        for key, value in (DEFAULTS | {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | conf | more).items():
            builder = builder.config(key, value)
        return builder.getOrCreate()

    spark = built({})
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.stop()
        spark = built({"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tesserae-")})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows that travel to Python at once in the queries, unless the session asks for other than Spark's default: a text
#: with one sign beyond the first plane takes four bytes a character there, and each function holds its own copies.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For the queries, which own their session; operators leave it as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to as many tasks as a shuffle has, whatever their size: for keys that become texts or long work.

    A file of a few bytes a row is read by one task, and so would be all that follows from it.
    """
    dealt = rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
    # an array of one, exploded: else a filter on what is made of the key would be put, and that be made, before the exchange as well
    return dealt.withColumn(key, F.explode(F.array(key)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. A file and a folder of part files both work."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
