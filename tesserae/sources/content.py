"""Files named by the digest of what they hold, written by the tasks that have them.

A data source with a commit of two phases. Tasks put bodies in place under their names,
whole or not at all; a body that another attempt or an earlier version has put there is
the same and stays. Each attempt lists its names in a part of the new version's manifest.
Then the driver, told one part and three numbers by each task that counted, drops the
parts of attempts that did not, and names the version in ``.content/current``, last. A job that
fails leaves the version before it as it was. No body and no list of names passes the driver.

Under the folder: ``<sha256><suffix>`` files, ``.content/versions/<version>/*.parquet`` (name,
bytes), ``.content/current``. Any store will do that Spark reads and pyarrow's file systems know.
Defined results: a name that is not its body's digest, a null, or an empty body (Spark's
listings leave empty files out) is an error; a name given twice is one file; no rows are a
version without files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LISTED = pa.schema([("name", pa.string()), ("bytes", pa.int64())])


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a full URI, as Spark itself reads it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _there(store: stores.FileSystem, paths: list[str]) -> list[int | None]:
    """Sizes of files, None for what is not there."""
    return [i.size if i.type == stores.FileType.File else None for i in store.get_file_info(paths)] if paths else []


def _put(store: stores.FileSystem, at: str, temporary: str, body: bytes) -> None:
    """A file that is there in whole or not at all."""
    with store.open_output_stream(temporary) as f:
        f.write(body)
    try:
        store.move(temporary, at)
    except OSError:  # stores that do not rename over a file: another attempt was first
        if _there(store, [at]) != [len(body)]:
            store.delete_file(at)
            store.move(temporary, at)


@dataclass
class Listed(WriterCommitMessage):
    """What an attempt has done, and the part of the manifest that says so."""

    part: str
    written: int
    kept: int
    bytes: int


class Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, version: str):
        self.uri, self.version = uri, version

    def _open(self) -> tuple[stores.FileSystem, str, str, str]:
        store, base = stores.FileSystem.from_uri(self.uri)
        return store, base, f"{base}/.content/versions/{self.version}", f"{base}/.content/new/{self.version}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Listed:
        store, base, versions, fresh = self._open()
        for folder in (versions, fresh):
            store.create_dir(folder, recursive=True)
        attempt, written, kept, total = uuid.uuid4().hex, 0, 0, 0
        part = f"{attempt}.parquet"
        with store.open_output_stream(f"{versions}/{part}") as out, pq.ParquetWriter(out, LISTED) as listed:
            for batch in iterator:
                names, bodies = batch.column(0).to_pylist(), batch.column(1)
                sizes = []
                for name, size, body in zip(names, _there(store, [f"{base}/{n}" for n in names]), bodies, strict=True):
                    data = body.as_py()
                    if not data or hashlib.sha256(data).hexdigest() != name.split(".", 1)[0]:
                        raise ValueError(f"{name}: not the digest of the body, or there is none")
                    sizes.append(len(data))
                    if size == len(data):
                        kept += 1
                        continue
                    _put(store, f"{base}/{name}", f"{fresh}/{attempt}-{name}", data)
                    written += 1
                listed.write_batch(pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], schema=LISTED))
                total += sum(sizes)
        return Listed(part, written, kept, total)

    def _swept(self, store: stores.FileSystem, folder: str, kept: set[str] = frozenset()) -> None:
        for i in store.get_file_info(stores.FileSelector(folder, allow_not_found=True)):
            if i.base_name not in kept:
                (store.delete_dir if i.type == stores.FileType.Directory else store.delete_file)(i.path)

    def commit(self, messages: list[Listed | None]) -> None:
        store, base, versions, _ = self._open()
        done = [m for m in messages if m is not None]
        store.create_dir(versions, recursive=True)
        self._swept(store, versions, {m.part for m in done})
        if not done:  # a version without files can be read, too
            with store.open_output_stream(f"{versions}/none.parquet") as out:
                pq.write_table(LISTED.empty_table(), out)
        now = {"version": self.version} | {n: sum(getattr(m, n) for m in done) for n in ("written", "kept", "bytes")}
        store.create_dir(f"{base}/.content/new", recursive=True)
        body = json.dumps(now).encode()
        if _there(store, [f"{base}/.content/current"]) != [None] and store.type_name not in ("local", "s3", "gcs", "abfs"):
            store.delete_file(f"{base}/.content/current")  # stores that do not rename over a file
        _put(store, f"{base}/.content/current", f"{base}/.content/new/{self.version}.current", body)
        self._swept(store, f"{base}/.content/versions", {self.version})
        self._swept(store, f"{base}/.content/new")

    def abort(self, messages: list[Listed | None]) -> None:
        store, _, versions, fresh = self._open()
        for folder in (versions, fresh):
            if store.get_file_info(folder).type == stores.FileType.Directory:
                store.delete_dir(folder)


class ContentFiles(DataSource):
    """``df.write.format("content_files")`` for rows of name and body."""

    @classmethod
    def name(cls) -> str:
        return "content_files"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["version"])


def _removing(uri: str):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = stores.FileSystem.from_uri(uri)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, size in zip(names, _there(store, [f"{base}/{n}" for n in names]), strict=True):
                if size is not None:  # gone already, where this task runs again
                    store.delete_file(f"{base}/{name}")
            yield pa.record_batch([pa.array([len(names)], pa.int64())], names=["n"])

    return remove


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes of the files that lie there; none of them is opened."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def current(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes of the files of the current version, by its manifest."""
    version = spark.read.json(f"{folder}/.content/current").head()["version"]
    return spark.read.parquet(f"{folder}/.content/versions/{version}").distinct()


def faults(spark: SparkSession, folder: str) -> DataFrame:
    """name, fault: files of the current version that are missing or of another size, and files of none."""
    there = listing(spark, folder).withColumnRenamed("bytes", "found")
    met = current(spark, folder).join(there, "name", "full")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("bytes").isNull(), "stale").when(F.col("found") != F.col("bytes"), "changed")
    return met.select("name", fault.alias("fault")).where("fault is not null")


def write(files: DataFrame, folder: str) -> dict[str, int]:
    """Makes the files (name, body) the current version, and then removes those that are none of it any more.

    Returns how many were written, were there already, and were removed.
    """
    spark = files.sparkSession
    spark.dataSource.register(ContentFiles)
    uri = qualified(spark, folder)
    version = uuid.uuid4().hex
    rows = files.select("name", F.col("body").cast("binary").alias("body"))
    rows.write.format("content_files").mode("append").option("version", version).save(uri)
    now = spark.read.json(f"{uri}/.content/current").head()
    stale = listing(spark, uri).join(current(spark, uri), "name", "left_anti").select("name")
    removed = stale.mapInArrow(_removing(uri), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    return {"written": now["written"], "kept": now["kept"], "removed": removed}
