"""Helpers shared by the training-data operators: table access, written
intermediate tables, ASCII text rules and bounded bitmaps."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: The white space of every text rule here: blank, \t, \n, \v, \f, \r.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[ \t-\r]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage,
    survives lost executors and keeps column pruning for later readers."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them has
    been written itself, so a lost executor does not need them."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is.  ``lower`` does the
    same for pure ASCII and is much faster than ``translate``."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_words(c: Column) -> Column:
    """The maximal runs without white space, in order."""
    trimmed = F.btrim(c, F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS + "+"))


def md5_long(c: Column) -> Column:
    """The first 60 bits of the md5 of a value's text (null: the text 'null')."""
    text = F.coalesce(c.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


# ---- bitmaps of a fixed size, built by Spark and broadcast as a prefilter ----

BITMAP_BITS = 1 << 24


def bitmap(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits (2 MB by default, whatever the input) with the
    bit ``value mod bits`` set for every value.  Spark merges it with a map-side
    combine; at most bits / 32768 rows of 4 KB reach the driver."""
    spot = F.pmod(F.col(column), F.lit(bits))
    rows = (hashes.where(F.col(column).isNotNull())
            .groupBy(F.bitmap_bucket_number(spot).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")))
    out = np.zeros(bits // 8 + 4096, dtype=np.uint8)
    for r in rows.collect():  # value v is bit (v - 1) mod 32768 of bucket (v - 1) // 32768 + 1
        at = int(r["bucket"]) * 4096
        out[at:at + 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def bitmap_bits(n: int) -> int:
    """The size of a bitmap of n values: 16 bits each, at most 2^28 (32 MB); beyond that
    more values pass by chance."""
    return 1 << min(max((16 * n).bit_length(), 16), 28)


def in_bitmap(bits_array: np.ndarray, values: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    """Whether each signed 64-bit value may be in a bitmap made by ``bitmap``."""
    spot = np.mod(values.astype(np.int64), bits)
    bucket = np.where(spot > 0, (spot - 1) // 32768 + 1, 0)
    pos = np.where(spot > 0, (spot - 1) % 32768, 0)
    return (bits_array[bucket * 4096 + (pos >> 3)] >> (pos & 7).astype(np.uint8)) & 1 == 1
