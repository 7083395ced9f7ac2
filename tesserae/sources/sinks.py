"""Publishing: staged bundles with a manifest last, partitions of every category, CSV and JSON exports, shards."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.scratch import numbered, written
from tesserae.sources import content

#: Entries of a file of aliases.
ALIASES_A_FILE = 10_000

EXPORT_COLUMNS = ("id", "title", "description", "category", "kind", "domain", "language", "license", "sourceName", "sourceUrl", "tags", "colors", "access", "verifiedAt", "preview", "analysis", "code")


def write_json(path: str, value, compact: bool = True) -> None:
    """A file that is there in whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, separators=(",", ":") if compact else None, indent=None if compact else 2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


#: Columns by which single rows of a part are looked up.
KEYS = {"items": "id", "aliases": "alias", "originals": "id"}


def write_part(df: DataFrame, path: str, key: str | None) -> None:
    """Parquet; a key's values are in a Bloom filter of each row group, so a lookup reads the groups that may have it.

    Filters have the size that a row group's own values ask for, up to Parquet's bound of a megabyte.
    """
    out = df.write.mode("overwrite")
    if key is not None:
        out = out.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    out.parquet(path)


def publish(parts: dict[str, DataFrame], path: str, version: str) -> None:
    """Writes every part under ``path``/``version``; readers go by the manifest, which comes last."""
    spark = next(iter(parts.values())).sparkSession
    for name, df in parts.items():
        write_part(df, f"{path}/{version}/{name}", KEYS.get(name))
    spark.createDataFrame([(version, sorted(parts))], "version string, parts array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def published(spark, path: str) -> str:
    """The folder of the version that the manifest names."""
    from tesserae.sources.scans import Unavailable

    try:
        return f"{path}/{spark.read.json(f'{path}/manifest').head()['version']}"
    except Exception as e:
        raise Unavailable(path) from e


def export_cells(items: DataFrame) -> DataFrame:
    """The export's columns as text: nested values as JSON, no cell that a spreadsheet would run."""
    there = dict(items.dtypes)
    cells = []
    for name in EXPORT_COLUMNS:
        if name not in there:
            cells.append(F.lit("").alias(name))
        elif there[name].startswith(("array", "struct", "map")):
            cells.append(F.coalesce(F.to_json(name), F.lit("")).alias(name))
        else:
            cells.append(F.coalesce(T.formula_guarded(F.col(name).cast("string")), F.lit("")).alias(name))
    return items.orderBy("id").select(*cells)


def write_csv(items: DataFrame, path: str) -> None:
    export_cells(items).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_aliases(aliases: DataFrame, path: str, updated: str, version: int = 1) -> None:
    """One JSON object {version, updatedAt, aliases}, its entries in order of the aliases; written an entry at a time.

    The file is for readers that load it whole; where it is too large for them, ``write_alias_files`` is the one to use.
    """
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(f'{{"version":{version},"updatedAt":{json.dumps(updated)},"aliases":{{')
        for i, r in enumerate(aliases.orderBy("alias").select("alias", "item_id").toLocalIterator()):
            f.write(("," if i else "") + f"{json.dumps(r['alias'], ensure_ascii=False)}:{json.dumps(r['item_id'], ensure_ascii=False)}")
        f.write("}}")
    os.replace(f"{path}.new", path)


def alias_files(aliases: DataFrame) -> DataFrame:
    """first, last, name, body: the aliases in order, in JSON objects of at most ALIASES_A_FILE entries each.

    An alias given twice, or null, is an error. Entries are numbered by ranges, so none but a file's own are gathered.
    """
    placed = numbered(aliases.select("alias", "item_id"), ["alias", "item_id"], "at").withColumn("file", F.floor(F.col("at") / ALIASES_A_FILE))
    whole = placed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("alias", "item_id"))).alias("r"))
    rows = whole.select(F.element_at("r.alias", 1).alias("first"), F.element_at("r.alias", -1).alias("last"), F.to_json(F.map_from_entries("r")).alias("body"))
    return rows.select("first", "last", F.concat(F.sha2("body", 256), F.lit(".json")).alias("name"), "body")


def write_alias_files(aliases: DataFrame, folder: str) -> dict[str, int]:
    """The aliases as files named by content, written by tasks; ``folder``/index says which file has which range."""
    files = written(alias_files(aliases), "aliases")
    counts = content.write(files, f"{folder}/files")
    files.select("first", "last", "name").repartitionByRange("first").sortWithinPartitions("first").write.mode("overwrite").parquet(f"{folder}/index")
    return counts


def alias_target(spark: SparkSession, folder: str, alias: str) -> str | None:
    """The entry that an alias names, from the one file whose range has it."""
    own = spark.read.parquet(f"{folder}/index").where((F.col("first") <= alias) & (F.col("last") >= alias)).head()
    if own is None:
        return None
    [text] = spark.read.text(f"{folder}/files/{own['name']}", wholetext=True).head()
    return json.loads(text).get(alias)


def digest_text(stats: dict) -> str:
    """A short summary of counts for people and models."""
    lines = ["# Catalog", "", f"Items: {stats.get('total', 0)}", f"Sources: {stats.get('sources', 0)}", f"Updated: {stats.get('updated_at', '')}"]
    for field in ("category", "kind", "license"):
        if stats.get(field):
            lines += ["", f"## {field}", *(f"- {k}: {n}" for k, n in sorted(stats[field].items()))]
    return "\n".join(lines) + "\n"
