"""Benchmark decontamination by winnowing.

Both sides are cut into words; of every ``WINDOW - K + 1`` consecutive k-gram
hashes the least is a fingerprint, so any span of ``WINDOW`` shared words holds
a fingerprint of both sides.  Items shorter than a window have one fingerprint,
the hash of all their words, and the texts are asked for runs of these lengths.

1. Benchmark fingerprints become a bitmap of fixed size (2 MB), broadcast.
2. One pass over the texts computes fingerprints, keeps those in the bitmap and
   emits them with the words around them (8 before, 12 after).
3. Spark joins them with the benchmark's fingerprints, and each hit is extended
   word by word: every window around it that equals the item's is a match.  The
   words themselves are compared, so hash collisions cannot add a match.
4. Matches are made distinct before items are looked up by window, so an item
   repeated a thousand times costs nothing per position.

Defined results: null or empty texts have no words and no hits; items without
words have no windows; a null item_id marks words but is not listed; rows equal
in id and text share their matches; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LETTERS, Block, blocks, grams, signed
from .shared import bitmap, in_bitmap, text_or_empty, written

WINDOW, K = 13, 5
SIDE = WINDOW - K  # words a window can reach beyond a k-gram, on either side

_FOUND = "doc {key}, t1 long, t2 long, n_words long, size int, print long, pos int, words array<string>"


def fingerprints(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(word position, k-gram hash) of all fingerprints of a block's documents:
    in every window the k-grams with the least hash, ties included."""
    g, reach = grams(block.hashes, K), WINDOW - K + 1
    n = len(g) - reach + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0]
    least = g[:n].copy()
    for i in range(1, reach):
        np.minimum(least, g[i:i + n], out=least)
    end = np.repeat(block.ptr[1:], np.diff(block.ptr))  # of each word's document
    whole = np.arange(n) + WINDOW <= end[:n]
    chosen = np.zeros(len(g), dtype=bool)
    for i in range(reach):
        chosen[i:i + n] |= whole & (g[i:i + n] == least)
    at = np.flatnonzero(chosen)
    return at, g[at]


def short_runs(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash) of every run of ``size`` words inside a document."""
    g = grams(block.hashes, size)
    end = np.repeat(block.ptr[1:], np.diff(block.ptr))[:len(g)]
    at = np.flatnonzero(np.arange(len(g)) + size <= end)
    return at, g[at]


def around(block: Block, doc: int, at: int, size: int, pad: str) -> list[str]:
    """The words a match at ``at`` can reach: the run itself for short items."""
    if size < WINDOW:
        return [block.word(i) for i in range(at, at + size)]
    lo, hi = block.ptr[doc], block.ptr[doc + 1]
    return [block.word(i) if lo <= i < hi else pad for i in range(at - SIDE, at + WINDOW)]


def _benchmark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for b in blocks(batch.column(1), LETTERS):
            counts = np.diff(b.ptr)
            at, prints = fingerprints(b)
            docs = np.searchsorted(b.ptr, at, "right") - 1
            items = batch.column(0).slice(b.lo, b.hi - b.lo).to_pylist()
            out += [(items[d], WINDOW, p, around(b, d, a, WINDOW, "\x02"), [])
                    for d, a, p in zip(docs, at, signed(prints), strict=True)]
            for d in np.flatnonzero(counts):
                size, words = min(int(counts[d]), WINDOW), [b.word(i) for i in range(b.ptr[d], b.ptr[d + 1])]
                if size < WINDOW:
                    out.append((items[d], size, int(signed(grams(b.hashes[b.ptr[d]:b.ptr[d + 1]], size))[0]), words, []))
                wins = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]
                out.append((items[d], size, None, [], wins))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([
            pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
            pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.list_(pa.string()))],
            names=["item", "size", "print", "words", "windows"])


def benchmark_index(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, size, print, words, windows) of all items: fingerprints with the
    words around them, and one row per item with its windows."""
    kind = benchmark.schema[key].dataType.simpleString()
    rows = benchmark.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        _benchmark_rows, f"item {kind}, size int, print long, words array<string>, windows array<string>")
    return written(rows, "bench-index")


def _searcher(bits, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            key_type = batch.schema.field(0).type
            for b in blocks(batch.column(3), LETTERS):
                part = batch.slice(b.lo, b.hi - b.lo)
                n = b.hi - b.lo
                yield _rows(part, np.arange(n), key_type, np.diff(b.ptr), [WINDOW] * n, [None] * n, [None] * n, [None] * n)
                for size in sizes:
                    at, prints = fingerprints(b) if size == WINDOW else short_runs(b, size)
                    prints = signed(prints)
                    hit = in_bitmap(table, prints)
                    at, prints = at[hit], prints[hit]
                    docs = np.searchsorted(b.ptr, at, "right") - 1
                    for i in range(0, len(at), 4096):  # rows carry words: keep batches small
                        j = slice(i, i + 4096)
                        yield _rows(part, docs[j], key_type, [None] * len(at[j]), [size] * len(at[j]), prints[j],
                                    at[j] - b.ptr[docs[j]], [around(b, d, a, size, "\x01") for d, a in zip(docs[j], at[j], strict=True)])
    return run


def _rows(part, docs, key_type, n_words, size, prints, pos, words) -> pa.RecordBatch:
    take = pa.array(docs, pa.int64())
    return pa.RecordBatch.from_arrays(
        [part.column(i).take(take) for i in range(3)] + [
            pa.array(n_words, pa.int64()), pa.array(size, pa.int32()), pa.array(prints, pa.int64()),
            pa.array(pos, pa.int32()), pa.array(words, pa.list_(pa.string()))],
        names=["doc", "t1", "t2", "n_words", "size", "print", "pos", "words"])


def matches(found: DataFrame, index: DataFrame) -> DataFrame:
    """(doc, t1, t2, start, len, window): every window match, extended from the
    joined fingerprints; rows are distinct."""
    hits = found.where(F.col("print").isNotNull())
    prints = index.where(F.col("print").isNotNull()).select("size", "print", F.col("words").alias("item_words")).distinct()
    both = hits.join(prints, ["size", "print"])
    same = lambda s: F.slice("words", s + 1, F.lit(WINDOW)) == F.slice("item_words", s + 1, F.lit(WINDOW))
    long = F.transform(F.filter(F.sequence(F.lit(0), F.lit(SIDE)), same), lambda s: F.struct(
        (F.col("pos") - SIDE + s).alias("start"), F.concat_ws(" ", F.slice("words", s + 1, F.lit(WINDOW))).alias("window")))
    short = F.when(F.col("words") == F.col("item_words"), F.array(F.struct(
        F.col("pos").alias("start"), F.concat_ws(" ", "words").alias("window"))))
    spans = F.when(F.col("size") == WINDOW, long).otherwise(short)
    return both.select("doc", "t1", "t2", F.col("size").alias("len"), F.explode(spans).alias("m")).select(
        "doc", "t1", "t2", "len", "m.*").distinct()


def covered(spans: Column) -> Column:
    """The number of words in a union of (start, len) spans."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.sort_array(spans), state, lambda a, x: F.struct(
        F.greatest(a["end"], x["start"] + x["len"]).alias("end"),
        (a["n"] + F.greatest(x["start"] + x["len"] - F.greatest(a["end"], x["start"]), F.lit(0))).cast("long").alias("n")),
        lambda a: a["n"])


NEW = ("n_words", "n_hit", "n_items", "items", "contaminated")


def search(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """Every (doc, t1, t2) row of ``df`` with ``n_words``, ``n_hit``, ``n_items`` and
    ``items`` (their ids as sorted strings); t1, t2 are hashes of the text."""
    spark = df.sparkSession
    index = benchmark_index(benchmark, item, item_text)
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # at most WINDOW rows
    bits = spark.sparkContext.broadcast(bitmap(index, "print"))
    t = text_or_empty(text)
    kind = df.schema[key].dataType.simpleString()
    found = written(df.select(F.col(key).alias("doc"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2"), t.alias("t"))
                    .mapInArrow(_searcher(bits, sizes), _FOUND.format(key=kind)), "bench-found")
    hit = written(matches(found, index), "bench-matches")
    per = ["doc", "t1", "t2"]
    words = hit.groupBy(*per).agg(covered(F.collect_set(F.struct("start", "len"))).alias("n_hit"))
    windows = index.select(F.col("item").cast("string").alias("item"), F.explode("windows").alias("window")).distinct()
    items = hit.select(*per, "window").distinct().join(windows, "window").groupBy(*per).agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    docs = found.where(F.col("n_words").isNotNull()).select(*per, "n_words")
    for part, cols in ((words, ["n_hit"]), (items, ["items"])):
        right = part.select(*[F.col(c).alias(f"r_{c}") for c in per], *cols)
        docs = docs.join(right, F.col("doc").eqNullSafe(F.col("r_doc")) & (F.col("t1") == F.col("r_t1")) & (
            F.col("t2") == F.col("r_t2")), "left").drop(*[f"r_{c}" for c in per])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return docs.select(*per, "n_words", n_hit.alias("n_hit"), F.size(F.coalesce("items", F.array().cast("array<string>"))).cast(
        "long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of ``df`` that are not contaminated, with the columns that came in.
    Only contaminated ids are joined back (an anti join)."""
    bad = search(df, benchmark, key, text, **names).where("contaminated").select("doc", "t1", "t2").distinct()
    t = text_or_empty(text)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(key).alias("k"), F.xxhash64(t).alias("h1"),
                     F.xxhash64(F.lit(1), t).alias("h2"))
    left = rows.join(bad, F.col("k").eqNullSafe(F.col("doc")) & (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")), "left_anti")
    return left.select("row.*")
