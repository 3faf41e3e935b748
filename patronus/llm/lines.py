"""Line deduplication: first occurrences by a range-partitioned stream of line
hashes, returned as compressed keep bitmaps per document.

1. One scan turns every text into narrow rows (two 64-bit hashes of the line's
   key, document, position); keys shorter than ``min_chars`` never take part.
   Equal keys of one document become one row.
2. Very frequent hashes are found in one pass with at most 1 / ``support``
   counters (no key above that share is missed).  For these few, the smallest
   document comes from a map-side combined minimum and is broadcast (bounded by
   1 / ``support`` rows), so a line in a third of all documents is never one
   task's work.
3. All other rows are range-partitioned by hash and sorted by (hash, document):
   the first row of each hash is streamed along its run, and every row of a later
   document is dropped.
4. Dropped positions return to their document as runs of kept lines, a
   run-length compressed bitmap: no text is moved.  ``apply_bitmaps`` cuts texts.

Defined results: a null or empty text is one empty line; null document ids count
as one document after all others; rows with the same id are one document for the
rule, while each row gets its own bitmap; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WS, ascii_lower, text_or_empty, written


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def text_hash(c: Column) -> list[Column]:
    """128 bits as two longs: the same hash from two starts."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def line_rows(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, t1, t2, pos, h1, h2): a row per line with a long enough key; t1 and t2
    tell rows with the same document id apart."""
    t = text_or_empty(text)
    lines = df.select(F.col(key).alias("doc"), *[h.alias(n) for h, n in zip(text_hash(t), ("t1", "t2"), strict=True)],
                      F.posexplode(F.split(t, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "t1", "t2", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    return keyed.select("doc", "t1", "t2", "pos", *[h.alias(n) for h, n in zip(text_hash(F.col("k")), ("h1", "h2"), strict=True)])


def dropped_lines(rows: DataFrame, support: float = 1e-3) -> DataFrame:
    """The rows of ``line_rows`` whose line an earlier document holds."""
    after = lambda doc, first: F.coalesce(doc > first, F.lit(False)) | (doc.isNull() & first.isNotNull())
    often = rows.stat.freqItems(["h1"], support).select(F.explode("h1_freqItems").alias("h1"))
    hot = rows.join(F.broadcast(often), "h1").groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.lit(1).alias("hot"))
    hot = written(hot.groupBy("h1").agg(F.collect_list(F.struct("h2", "first")).alias("firsts")), "line-hot")
    split = rows.join(F.broadcast(hot), "h1", "left")
    of_hot = split.where(F.col("firsts").isNotNull()).withColumn("first", F.get(F.filter(
        "firsts", lambda x: x["h2"] == F.col("h2")), F.lit(0))["first"])
    cold = split.where(F.col("firsts").isNull())
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    stream = cold.repartitionByRange(parts, "h1", "h2")
    run = Window.partitionBy("h1", "h2").orderBy(F.col("doc").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    of_cold = stream.withColumn("first", F.first("doc").over(run))
    cols = ["doc", "t1", "t2", "pos", "first"]
    both = of_hot.select(*cols).unionByName(of_cold.select(*cols))
    return both.where(after(F.col("doc"), F.col("first"))).drop("first")


def keep_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, t1, t2, n_dropped, kept): documents that lose lines, with their kept
    lines as sorted runs ``array<struct<start, len>>``; the last run is open
    (len null) since lines after the last dropped one are all kept."""
    rows = written(line_rows(df, key, text, min_chars), "line-rows")
    gone = dropped_lines(rows).groupBy("doc", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    before = lambda i: F.coalesce(F.get(F.col("gone"), i - 1), F.lit(-1))
    runs = F.transform("gone", lambda p, i: F.struct((before(i) + 1).alias("start"), (p - before(i) - 1).alias("len")))
    closed = F.filter(runs, lambda r: r["len"] > 0)
    last = F.array(F.struct((F.element_at("gone", -1) + 1).alias("start"), F.lit(None).cast("int").alias("len")))
    return gone.select("doc", "t1", "t2", F.size("gone").cast("long").alias("n_dropped"), F.concat(closed, last).alias("kept"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``text`` cut to its kept lines, ``n_lines`` (before) and
    ``n_dropped``.  Bitmaps are narrow: they are the hashed side of the join, so
    texts are moved once and not sorted."""
    t = text_or_empty(text)
    cols = [c for c in df.columns if c not in (text, "n_lines", "n_dropped")]
    left = df.select(F.struct(*cols).alias("in"), t.alias("t"), F.col(key).alias("k"),
                     *[h.alias(n) for h, n in zip(text_hash(t), ("l1", "l2"), strict=True)])
    both = left.join(bitmaps.hint("shuffle_hash"), F.col("k").eqNullSafe(F.col("doc")) & (F.col("l1") == F.col("t1")) & (
        F.col("l2") == F.col("t2")), "left")
    both = both.withColumn("lines", F.split("t", "\n", -1))
    size = F.size("lines")
    parts = F.transform("kept", lambda r: F.slice("lines", r["start"] + 1, F.coalesce(r["len"], size - r["start"])))
    cut = F.when(F.col("kept").isNull(), F.col("t")).otherwise(F.array_join(F.flatten(parts), "\n"))
    return both.select("in.*", cut.alias(text), size.cast("long").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
