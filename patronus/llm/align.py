"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both token lists of a text cover the same bytes; where tokens of both end at one
byte, a group closes.  Long stretches are one to one, so the ends of one list equal
the other's at a fixed shift of the index: slices of both arrays are compared at that
shift, doubling while they are equal and halving down to the first end that differs.
The irregular group found there is walked token by token, and its size updates the
shift.

Stages.  (1) Per text: encode, align, digest the groups; a row keeps the different
linked id pairs with how often each is linked (written).  (2) An id pair's count is
the number of texts that hold it: numpy counts inside tasks, summed by Spark
(written), and the highest count of each A id, at most one row per entry of the
vocabulary.  (3) Per text: sums over its links.  The ``FREQUENT`` most common pairs
are broadcast (a table of fixed size); what misses it is joined on the pair, and the
common pairs, which would be hot keys, never are.

Defined results: a text that is null, empty, or whose joined tokens differ from it on
either side has no tokens, no groups and an empty ``groups``; repeated rows are
texts of their own; null ids pass through; an empty table has no rows; texts are
encoded whole, in slices of few rows, and one text's tokens must fit a task; columns
but ``keep`` are not read, and of these one named like a new column gives way.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, written

FREQUENT = 1 << 18  # pairs broadcast: 17 bytes each
_NEW = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")


def byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable Latin-1
    stands for itself, all other bytes follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {chr(b): b for b in printable}, 0x100
    for b in range(256):
        if chr(b) not in out or out[chr(b)] != b:
            out[chr(spare)] = b
            spare += 1
    return out


def settled() -> re.Pattern:
    """Texts of characters whose class (letter, number, white space, other) has been the
    same in all Unicode versions since 3.2, so that all libraries cut them alike."""
    def kind(db, c: str) -> str:
        k = db.category(c)
        return "?" if k in ("Cn", "Cc", "Cf") else k[0] if k[0] in "LNZ" else "other"
    spans, lo = [], None
    for cp in range(0x20, 0x10000):
        good = cp < 0x7F or (k := kind(unicodedata, chr(cp))) != "?" and k == kind(unicodedata.ucd_3_2_0, chr(cp))
        if good and lo is None:
            lo = cp
        if not good and lo is not None:
            spans.append((lo, cp - 1))
            lo = None
    return re.compile("[\n\t\r" + "".join(f"{re.escape(chr(x))}-{re.escape(chr(y))}" for x, y in spans) + "]*")


class ByteLevel:
    """Tokens of a ``tokenizers`` file with a byte-level vocabulary.

    Where the file's n-th merge makes its n-th new entry, merging by entry number gives
    the same tokens; ``tiktoken`` does that several times faster and takes the texts whose
    characters are ``settled``.  All other texts go to ``tokenizers``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        of = byte_level()
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.fast, self.plain = self._fast(path), settled()

    def _fast(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre, model = file["pre_tokenizer"], file["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        regular = (pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and file["normalizer"] is None
                   and not model["ignore_merges"] and all(model["vocab"][x + y] == 256 + n for n, (x, y) in enumerate(merges)))
        ranks = {self.bytes[i]: i for i in model["vocab"].values() if i < 256 + len(merges)}
        return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if regular else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        fast = [self.fast is not None and self.plain.fullmatch(t) is not None for t in texts]
        slow = iter(self.lib.encode_batch_fast([" " + t for t, f in zip(texts, fast, strict=True) if not f], add_special_tokens=False))
        return [self.fast.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) if f else np.array(next(slow).ids, np.int64)
                for t, f in zip(texts, fast, strict=True)]


class Pieces:
    """Tokens of a sentencepiece file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.lib.get_piece_size()):
            piece = self.lib.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.lib.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.lib.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _sides(a_path: str, b_path: str) -> tuple:
    """Loaded once per worker: the tokenizers, their entries' sizes and shown ids."""
    sides = ByteLevel(a_path), Pieces(b_path)
    return (sides, [np.array([len(x) for x in s.bytes]) for s in sides],
            [np.array([str(i) for i in range(len(s.bytes))], dtype=object) for s in sides])


def group_ends(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of two arrays of rising token ends with the same last end close,
    as numbers of tokens of both."""
    n, m, i, j, inner = len(ea), len(eb), 0, 0, []
    ea, eb = ea.tolist(), eb.tolist()
    while i < n:
        width = 8
        while (x := ea[i:i + width]) and x == eb[j:j + width]:  # at the shift j - i: doubled while all ends agree
            i += width
            j += width
            width <<= 1
        if i >= n:
            break
        while width := width >> 1:  # and halved down to the first that differs
            if (x := ea[i:i + width]) == eb[j:j + width] and x:
                i += width
                j += width
        if i >= n:
            break
        p, q, x, y = i, j, ea[i], eb[j]
        while x != y:  # an irregular group: the side that is behind goes on
            if x < y:
                p += 1
                x = ea[p]
            else:
                q += 1
                y = eb[q]
        inner += i, p, j, q
        i, j = p + 1, q + 1
    inner = np.array(inner, np.int64).reshape(-1, 4).T

    def closing(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """All tokens but those of irregular groups before their last ones."""
        step = np.zeros(size + 1, np.int64)
        step[first] += 1
        step[last] -= 1
        return np.flatnonzero(step[:-1].cumsum() == 0) + 1
    return closing(n, inner[0], inner[1]), closing(m, inner[2], inner[3])


def _links(a: np.ndarray, b: np.ndarray, gi: np.ndarray, gj: np.ndarray, large: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(different linked pairs, rising, and how often each is linked).  A large group's
    links are its different A ids times its different B ids, not all occurrences."""
    si, sj = np.concatenate([[0], gi[:-1]]), np.concatenate([[0], gj[:-1]])
    di, dj = gi - si, gj - sj
    n = di * dj
    one, some = n == 1, np.flatnonzero((n > 1) & (n <= large))
    size = n[some]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(dj[some], size)
    at_a, at_b = np.repeat(si[some], size) + within // wide, np.repeat(sj[some], size) + within % wide
    keys = np.concatenate([a[si[one]] << 32 | b[sj[one]], a[at_a] << 32 | b[at_b]])
    times = None
    for g in np.flatnonzero(n > large):
        ua, ca = np.unique(a[si[g]:gi[g]], return_counts=True)
        ub, cb = np.unique(b[sj[g]:gj[g]], return_counts=True)
        times = np.concatenate([np.ones(len(keys), np.int64) if times is None else times, np.outer(ca, cb).ravel()])
        keys = np.concatenate([keys, (ua[:, None] << 32 | ub).ravel()])
    if times is None:
        keys.sort()
    else:
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys))) if times is None else np.add.reduceat(times, first)


def _shown(a: np.ndarray, b: np.ndarray, gi: np.ndarray, gj: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the groups' ids, already as texts."""
    out = np.empty(2 * (len(a) + len(b)), dtype=object)
    out[1::2] = ","
    ga, gb = np.repeat(gj - np.diff(gj, prepend=0), np.diff(gi, prepend=0)), np.repeat(gi, np.diff(gj, prepend=0))
    out[2 * (np.arange(len(a)) + ga)] = a
    out[2 * (np.arange(len(b)) + gb)] = b
    out[2 * (gi - 1 + gj - np.diff(gj, prepend=0)) + 1] = "|"
    out[2 * (gj - 1 + gi) + 1] = ";"
    return "".join(out[:-1].tolist())


def _aligner(a_path: str, b_path: str, whole: bool, at_once: int = 64, at_most: int = 1 << 20):
    def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
        lo, held, size = 0, [], 0
        for k in range(0, len(texts), at_once):
            for t in texts.slice(k, at_once).to_pylist():
                held.append(t or "")
                size += len(held[-1])
                if size > at_most or len(held) == at_once:
                    yield lo, held
                    lo, held, size = lo + len(held), [], 0
        if held:
            yield lo, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (sides, sizes, names), serial = _sides(a_path, b_path), TaskContext.get().partitionId() << 40
        none = (0, 0, 0, 0, "", "", np.zeros(0, np.int64), np.zeros(0, np.int64))

        def row(text: str, a: np.ndarray, b: np.ndarray) -> tuple:
            full = b" " + text.encode()
            if not text or any(b"".join(map(s.bytes.__getitem__, x.tolist())) != full for s, x in zip(sides, (a, b), strict=True)):
                return none
            gi, gj = group_ends(*(z[x].cumsum() for z, x in zip(sizes, (a, b), strict=True)))
            keys, times = _links(a, b, gi, gj)
            groups = _shown(names[0][a], names[1][b], gi, gj)
            return (len(a), len(b), len(gi), int(times.sum()), hashlib.sha256(groups.encode()).hexdigest(), groups if whole else "", keys, times)
        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                rows = list(map(row, texts, *(s.encode(texts) for s in sides)))
                numbers, (sha, groups), (keys, times) = (zip(*[r[x] for r in rows], strict=True) for x in (slice(0, 4), slice(4, 6), slice(6, 8)))
                at = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
                columns = [pa.array(serial + np.arange(len(rows))), batch.column(0).slice(lo, len(rows)),
                           *[pa.array(x, pa.int64()) for x in numbers], pa.array(sha, pa.string()),
                           pa.ListArray.from_arrays(at, pa.array(np.concatenate(keys))),
                           pa.ListArray.from_arrays(at, pa.array(np.concatenate(times)))]
                serial += len(rows)
                if whole:
                    columns.append(pa.array(groups, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "in", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                                                                 "pairs", "times", *(["groups"] if whole else [])])
    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): in how many of the texts seen; a text lists a pair once."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        size += len(held[-1])
        if size > 1 << 22:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _summer(frequent):
    """Sums over the links of frequent pairs, and the other pairs as lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = frequent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                lists, rows = batch.column("pairs"), batch.num_rows
                keys = lists.flatten().to_numpy(zero_copy_only=False)
                times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
                row = lists.value_parent_indices().to_numpy(zero_copy_only=False) if hasattr(lists, "value_parent_indices") else np.zeros(0, int)
                at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
                there = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                held, links = at[there], times[there]
                count_sum, n_best = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                np.add.at(count_sum, row[there], n[held] * links)
                np.add.at(n_best, row[there], links * best[held])
                left = np.concatenate([[0], np.cumsum(np.bincount(row[~there], minlength=rows))])
                offsets = pa.array(left, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("row"), pa.array(n_best), pa.array(count_sum), pa.ListArray.from_arrays(offsets, pa.array(keys[~there])),
                    pa.ListArray.from_arrays(offsets, pa.array(times[~there]))], names=["row", "n_best", "count_sum", "pairs", "times"])
    return run


def align_texts(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None, whole: bool = False,
                frequent: int = FREQUENT) -> DataFrame:
    """The columns ``keep`` (default: all but the text) of every row with ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` and,
    if ``whole``, the text of the groups, ``a1,a2|b1;a3|b2,b3``."""
    spark = df.sparkSession
    kept = [c for c in (keep if keep is not None else df.columns) if c not in _NEW and c != text]
    row = F.struct(*kept) if kept else F.struct(F.lit(None).alias("none"))
    rows = df.select(row.alias("in"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["in"].dataType.simpleString()
    texts = written(rows.mapInArrow(_aligner(a_path, b_path, whole), (
        f"row long, in {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
        + (", groups string" if whole else ""))), "align-texts")
    counts = written(texts.select("pairs").mapInArrow(_counter, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    a_id = F.shiftright("pair", 32)
    top = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))  # at most one row per entry of A
    marked = written(counts.join(F.broadcast(top), a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "align-pairs")
    often = marked.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().sort_by("pair")
    table = tuple(often[c].to_numpy() for c in ("pair", "n", "best"))
    sums = written(texts.select("row", "pairs", "times").mapInArrow(
        _summer(spark.sparkContext.broadcast(table)), "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), "align-sums")
    rare = sums.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    rare = rare.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    more = rare.join(marked, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best2"), F.sum(F.col("n") * F.col("times")).alias("sum2"))
    more = written(sums.select("row", "n_best", "count_sum").join(more, "row", "left").select(
        "row", (F.col("n_best") + F.coalesce("best2", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("sum2", F.lit(0))).alias("count_sum")), "align-totals")
    release(counts, marked, sums)
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if whole else [])]
    return texts.drop("pairs", "times").join(more, "row").select(*[F.col("in").getField(c).alias(c) for c in kept], *new)
