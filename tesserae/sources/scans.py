"""Bounded scans: JSON arrays, payloads, images, pinned files and line ranges."""

from __future__ import annotations

import json
import re
import struct
import zlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.functions import arrow

INPUT_BYTES, CATALOG_BYTES, IMAGE_BYTES = 100 << 20, 128 << 20, 4 << 20
MAGIC = b"MLZ1\x00"


class Unavailable(FileNotFoundError):
    """What should be read is not there."""


def json_rows(spark: SparkSession, path: str, schema: str, most: int = INPUT_BYTES, missing_ok: bool = True) -> DataFrame:
    """Rows of a JSON array file with ``row_order``; larger files and what is no array are errors, a missing file is empty."""
    try:
        files = spark.read.format("binaryFile").load(path)
        files.schema  # noqa: B018
    except AnalysisException as e:
        if not missing_ok:
            raise Unavailable(path) from e
        return spark.createDataFrame([], f"{schema}, row_order long")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    guarded = F.when(F.col("length") > most, F.raise_error(F.lit("the input is too large")).cast("string")).when(~F.trim(text).startswith("["), F.raise_error(F.lit("the input is no array")).cast("string")).otherwise(text)
    rows = files.select(F.posexplode(F.from_json(guarded, f"array<struct<{_colons(schema)}>>", {"mode": "FAILFAST"})).alias("row_order", "r"))
    return rows.select("r.*", F.col("row_order").cast("long").alias("row_order"))


def _colons(schema: str) -> str:
    """A column list as struct fields: only the first blank of each top-level field becomes a colon."""
    depth, out, field = 0, [], ""
    for c in schema + ",":
        depth += c in "<(" or -(c in ">)")
        if c == "," and not depth:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            field = ""
        else:
            field += c
    return ",".join(out)


def bundle(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part of a published catalog."""
    try:
        return spark.read.parquet(f"{path}/{part}")
    except AnalysisException as e:
        raise Unavailable(f"{path}/{part}") from e


def _strict(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is given twice")
    return out


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("a number is too large")
    return value


def _no(text: str):
    raise ValueError(f"{text} is no JSON")


def pack_payload(record: dict) -> bytes:
    body = json.dumps(record, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()
    packed = MAGIC + zlib.compress(body, 6)
    if len(body) > vocab.PAYLOAD_BYTES or len(packed) > vocab.PAYLOAD_BYTES:
        raise ValueError("the payload is too large")
    return packed


def unpack_payload(data: bytes | str) -> dict:
    """A record from its packed form or from JSON text; damaged, trailing, oversized or sloppy payloads are errors."""
    if isinstance(data, str):
        body = data.encode()
    else:
        if len(data) > vocab.PAYLOAD_BYTES or not data.startswith(MAGIC):
            raise ValueError("not a payload")
        reader = zlib.decompressobj()
        try:
            body = reader.decompress(data[len(MAGIC) :], vocab.PAYLOAD_BYTES + 1)
        except zlib.error as e:
            raise ValueError("a damaged payload") from e
        if not reader.eof or reader.unused_data or reader.unconsumed_tail:
            raise ValueError("a truncated, oversized or trailed payload")
    if len(body) > vocab.PAYLOAD_BYTES:
        raise ValueError("the payload is too large")
    try:
        record = json.loads(body, object_pairs_hook=_strict, parse_float=_number, parse_constant=_no)
    except (UnicodeDecodeError, RecursionError) as e:
        raise ValueError("not readable") from e
    if not isinstance(record, dict):
        raise ValueError("no object")
    return record


@arrow("struct<payload:string,error:string>")
def unpacked(payloads: pd.Series) -> pd.DataFrame:
    """The payload as JSON text, or what is wrong with it."""
    rows = []
    for p in payloads:
        try:
            rows.append((json.dumps(unpack_payload(p), ensure_ascii=False, separators=(",", ":")), None))
        except (ValueError, TypeError) as e:
            rows.append((None, str(e)[:200] or "error"))
    return pd.DataFrame(rows, columns=["payload", "error"])


@arrow("binary")
def packed(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: pack_payload(json.loads(p)), na_action="ignore")


def jpeg_size(body: bytes) -> tuple[int, int]:
    """Width and height from the frame header of an 8-bit baseline, extended or progressive JPEG."""
    if not 4 <= len(body) <= IMAGE_BYTES or body[:2] != b"\xff\xd8" or body[-2:] != b"\xff\xd9":
        raise ValueError("no JPEG, or too large")
    at = 2
    while at + 4 <= len(body):
        if body[at] != 0xFF:
            raise ValueError("no marker where one must be")
        kind = body[at + 1]
        if kind == 0xFF:  # padding
            at += 1
            continue
        if kind == 1 or 0xD0 <= kind <= 0xD8:  # markers without a segment
            at += 2
            continue
        (size,) = struct.unpack_from(">H", body, at + 2)
        if kind in (0xD9, 0xDA) or size < 2 or at + 2 + size > len(body):
            break
        if 0xC0 <= kind <= 0xC2:
            depth, high, wide = struct.unpack_from(">BHH", body, at + 4)
            if depth != 8 or not high or not wide:
                raise ValueError("not an 8-bit picture")
            return wide, high
        at += 2 + size
    raise ValueError("no frame header")


@arrow("struct<width:int,height:int,error:string>")
def jpeg_header(bodies: pd.Series) -> pd.DataFrame:
    rows = []
    for b in bodies:
        try:
            rows.append((*jpeg_size(b), None))
        except (ValueError, struct.error) as e:
            rows.append((None, None, str(e) or "error"))
    return pd.DataFrame(rows, columns=["width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})


def below(path: Column, folder: str) -> Column:
    """A file's path as it is below the folder, whatever its store is called."""
    plain = re.sub(r"^[a-z]+:/+", "/", folder.rstrip("/"))
    return F.regexp_extract(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), rf"{re.escape(plain)}/(.*)$", 1)


def images(spark: SparkSession, folder: str, records: DataFrame) -> DataFrame:
    """Records (path below the folder, width, height, sha256) with ``error``, null where the file is just that picture."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= IMAGE_BYTES)
    found = files.select(below(F.col("path"), folder).alias("_name"), F.sha2("content", 256).alias("_sha"), jpeg_header("content").alias("_h"))
    met = records.join(found, F.col("path") == F.col("_name"), "left")
    error = (
        F.when(F.col("_name").isNull(), "no file").when(F.col("_h.error").isNotNull(), F.col("_h.error")).when(F.col("_sha") != F.col("sha256"), "another digest")
        .when((F.col("_h.width") != F.col("width")) | (F.col("_h.height") != F.col("height")), "another size").when(~F.col("width").between(32, 1024) | ~F.col("height").between(32, 1024), "size out of bounds")
    )
    return met.withColumn("error", error).drop("_name", "_sha", "_h")


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1, both included) with their ends."""
    lines = F.split(text, r"(?<=\n)")
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "")


def extracted(sources: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pieces (id, name, first, last, sha256) with ``code``, those lines of the source (name, content), or ``error``."""
    met = pieces.join(sources.select("name", F.decode("content", "UTF-8").alias("_text")), "name", "left")
    code = line_range(F.col("_text"), F.col("first"), F.col("last"))
    there = F.size(F.split(F.col("_text"), r"(?<=\n)")) >= F.col("last")
    error = F.when(F.col("_text").isNull(), "no file").when(~there | (F.col("first") < 1) | (F.col("last") < F.col("first")), "no such lines").when(F.sha2(code, 256) != F.col("sha256"), "another digest")
    return met.withColumn("error", error).withColumn("code", F.when(F.col("error").isNull(), code)).drop("_text")


def rebuilt(pieces: DataFrame, repairs: DataFrame) -> DataFrame:
    """id, fault of repairs (id, code) that are not just their pieces (id, place, code) of pinned sources, in order."""
    made = pieces.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda p: p["code"]), "").alias("made"), F.count_if(F.col("code").isNull()).alias("lost"))  # the pieces of one component
    met = repairs.select("id", "code").join(made, "id", "left")
    fault = F.when(F.col("made").isNull(), "no source").when(F.col("lost") > 0, "a piece is lost").when(F.col("made") != F.col("code"), "not as in the source")
    return met.select("id", fault.alias("fault")).where("fault is not null")


def pinned_files(spark: SparkSession, folder: str, pins: DataFrame) -> DataFrame:
    """Pins (name, sha256) with the file's content, or ``error``."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    met = pins.join(files, "name", "left")
    return met.withColumn("error", F.when(F.col("content").isNull(), "no file").when(F.sha2("content", 256) != F.col("sha256"), "another digest"))
