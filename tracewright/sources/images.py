"""Image shards: an index with file and row, headers of PNG files, bytes of chosen rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The chosen columns with ``image_shard`` (file name) and ``image_row`` (row in the file); images aren't read."""
    df = spark.read.parquet(path)
    return df.select(*columns, F.col("_metadata.file_name").alias("image_shard"), F.col("_metadata.row_index").alias("image_row"))


def png_header(raw: bytes | None) -> tuple[int, int, bytes | None] | None:
    """Width, height and colour profile of a PNG; None for other data."""
    if not raw or raw[:8] != b"\x89PNG\r\n\x1a\n" or len(raw) < 33:
        return None
    width, height = struct.unpack(">II", raw[16:24])
    at, icc = 8, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I", raw[at : at + 4])[0], raw[at + 4 : at + 8]
        if kind == b"iCCP":
            body = raw[at + 8 : at + 8 + size]
            try:
                icc = zlib.decompress(body[body.index(b"\0") + 2 :])
            except (ValueError, zlib.error):
                icc = None
        if kind in (b"IDAT", b"IEND"):
            break
        at += 12 + size
    return width, height, icc


def headers(df: DataFrame, key: str, image: str) -> DataFrame:
    """``key, width, height, icc``; nulls where the bytes are no PNG."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [png_header(x) or (None, None, None) for x in f[image]]
            out = pd.DataFrame(got, columns=["width", "height", "icc"]).astype({"width": "Int32", "height": "Int32"})
            out.insert(0, key, f[key].to_numpy())
            yield out

    return df.select(key, image).mapInPandas(run, f"{key} {kind}, width int, height int, icc binary")


def pick(spark: SparkSession, path: str, shard: str, rows: list[int], image: str = "image") -> DataFrame:
    """Bytes of given rows of one file."""
    df = spark.read.parquet(path).select(image, F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("image_row"))
    return df.where((F.col("f") == shard) & F.col("image_row").isin(rows)).drop("f")
