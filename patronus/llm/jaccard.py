"""Near duplicates by word shingles: a Jaccard join with PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct ``SHINGLE``-word
shingles.  Sets with similarity of 75 % or more differ in at most (x + y) / 7
elements (x, y: their sizes, at most 4 : 3 apart).

Signatures.  Sizes fall into bands [4^i, 4^(i+1)); a set belongs to the scheme of
its band and, if it can be the smaller partner of a set of the next band, to
that one's too.  A scheme partitions the feature domain by hash; the one-part
subsets that are not empty are enumerated in one global order (common ones last)
and the first H + 1 become signatures, H being the most elements by which a
partner may differ.  At most H parts differ, so the first part on which two
similar sets agree is among the first H + 1 of both: they share a signature.
Two similar sets can miss each other only where neither fills more than H parts;
sets that fill so few (tiny ones, mostly) add the first x - ceil(0.75 x) + 1 of
their shingles, of which similar sets share one.  No pair is lost.

Skew.  Copies of a set are one node, dropped before the shuffle.  Shingles held
by very many sets are found in a first pass (per task the most common ones,
summed, a bounded table) and come last in the order: only a text made mostly of
common passages needs signatures of them, and these are dealt out by a salt.

Links.  Round one pairs each set with the least and the greatest set of each of its
signatures, keeps what sizes and sketches allow, and compares exactly: first, for
each set, the pair that shares most signatures, then the pairs whose ends that did
not bring together.  What is similar forms components.  Signatures whose other
sets then all lie in one component are closed.  The sets of those left meet by the
component of their signature's least set: every set outside of that component with all
others, once for all signatures they share, in chunks of numpy arrays.  Sketches (8 to
16 bits per element; bits that differ come from elements that differ) bound a pair
there, and only what passes becomes a row and is compared exactly, on the shingles
of these sets alone.  Pairs inside a component are never formed.

Defined results: with fewer words than a shingle, the whole sequence is one
element; null or empty texts have no set and link with nothing; null ids link
but never name a component; rows with the same id are separate nodes of equal or
different sets; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import BETWEEN_SPACES, blocks, grams, mix, signed
from .shared import bitmap, bitmap_bits, in_bitmap, release, written

SHINGLE = 5
NEED, OF = 75, 100  # similar: OF * intersection >= NEED * union
SMALL = 9  # log of the bits of the sketch that all sets have
HOT_TABLE = 1 << 17  # most common shingles, at most (1 MB)
HOT_COUNT = 24       # a common shingle is in so many sets at least
_U = np.uint64


def shingle_sets(texts) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every text of a batch."""
    for b in blocks(texts, BETWEEN_SPACES):
        g = grams(b.hashes, SHINGLE)
        for d in range(b.hi - b.lo):
            a, e = b.ptr[d], b.ptr[d + 1]
            if e - a >= SHINGLE:
                yield b.lo + d, np.unique(g[a:e - SHINGLE + 1])
            else:
                yield b.lo + d, grams(b.hashes[a:e], int(e - a)) if e > a else g[:0]


def set_id(s: np.ndarray) -> int:
    """64 bits that name a set (equal sets, equal ids; two of n different sets
    share one with a chance of about n * n / 2^65)."""
    return int(signed(mix(np.array([np.add.reduce(mix(s ^ _U(0x5BF03635)), dtype=_U) + _U(len(s))], dtype=_U)))[0])


def most_differences(x: int) -> int:
    """The most elements in which a set of x and a similar one differ."""
    return (x + x * OF // NEED) * (OF - NEED) // (OF + NEED)


def schemes(x: int) -> list[int]:
    """The bands (exponents of 4) whose schemes a set of x elements is in."""
    band = (x.bit_length() - 1) // 2
    return [band, band + 1] if x * OF // NEED >= 4 ** (band + 1) else [band]


def parts_of(band: int) -> int:
    return max(64, 2 * 4 ** band)


def signatures(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, whether of common shingles only) of a set; ``common`` is a sorted
    array of hashes that come last in the global order."""
    keys, hots, x, short = [], [], len(s), False
    at = np.searchsorted(common, s) if len(common) else None
    is_common = common[np.minimum(at, len(common) - 1)] == s if len(common) else np.zeros(x, dtype=bool)
    mixed, most = mix(s ^ _U(0x1B873593)), most_differences(x)
    for band in schemes(x):
        part = (s >> _U(32)) * _U(parts_of(band)) >> _U(32)  # rises with the hash: parts are runs
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        key = mix(np.add.reduceat(mixed, first) ^ mix(part[first] + (_U(band + 1) << _U(40))))
        hot = np.logical_and.reduceat(is_common, first)
        if len(key) > most:
            rank = (key >> _U(1)) | (hot.astype(_U) << _U(63))
            chosen = np.argpartition(rank, most)[:most + 1]
            key, hot = key[chosen], hot[chosen]
        else:
            short = True
        keys.append(key)
        hots.append(hot)
    if short:
        n = x - -(-x * NEED // OF) + 1
        rank = (mixed >> _U(1)) | (is_common.astype(_U) << _U(63))
        chosen = np.argsort(rank)[:n]
        keys.append(mix(mixed[chosen] ^ _U(0x2545F491)))
        hots.append(is_common[chosen])
    return np.concatenate(keys), np.concatenate(hots)


def sketch(s: np.ndarray, log: int) -> np.ndarray:
    """Occupied places of a hash table of 2^log places."""
    bits = np.zeros(1 << log, dtype=np.uint8)
    bits[(mix(s) >> _U(64 - log)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def band_log(band: int) -> int:
    """For a band's sets, 4 bits per element at its lower end and 1 at its upper."""
    return max(SMALL, 2 * band + 2)


class _Seen:
    """Set ids of late: repeated sets of a task are emitted once.  Bounded; what it
    forgets is only emitted again."""

    def __init__(self, most: int = 1 << 18):
        self.most, self.ids = most, set()

    def new(self, i: int) -> bool:
        if i in self.ids:
            return False
        if len(self.ids) >= self.most:
            self.ids.clear()
        self.ids.add(i)
        return True


_SURVEY = "doc {key}, n long, id long, band int, small array<long>, own array<long>, next array<long>, shingle long, count long"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its set's size, id, band and sketches (a small one, that of the band,
    and that of the next if the set is in both); per about two million shingles the most common."""
    longs = pa.list_(pa.int64())

    def counted() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        top = np.argsort(-n, kind="stable")[:4096]
        top = top[n[top] > 1]
        none = [None] * len(top)
        return row(none, none, none, none, none, none, none, signed(h[top]), n[top])

    def row(*columns) -> pa.RecordBatch:
        kinds = (key_type, pa.int64(), pa.int64(), pa.int32(), longs, longs, longs, pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                          names=["doc", "n", "id", "band", "small", "own", "next", "shingle", "count"])
    seen, held, size = _Seen(), [], 0
    key_type = pa.int64()
    for whole in batches:
        key_type = whole.schema.field(0).type
        for i in range(0, whole.num_rows, 1024):
            batch = whole.slice(i, 1024)
            n, ident, band, small, own, following = [], [], [], [], [], []
            for _, s in shingle_sets(batch.column(1)):
                n.append(len(s))
                of = schemes(len(s)) if len(s) else []
                ident.append(set_id(s) if of else None)
                band.append(of[0] if of else None)
                small.append(sketch(s, SMALL) if of else None)
                own.append(sketch(s, band_log(of[0])) if of else None)
                following.append(sketch(s, band_log(of[1])) if len(of) > 1 else None)
                if of and seen.new(ident[-1]):
                    held.append(s)
                    size += len(s)
                if size > 1 << 21:
                    yield counted()
                    held, size = [], 0
            yield row(batch.column(0), n, ident, band, small, own, following, [None] * len(n), [None] * len(n))
    if held:
        yield counted()


def _signer(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, keys, ids, hots, size = common.value, _Seen(), [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(ids)),
                pa.array(np.concatenate(hots).astype(np.int32))], names=["sig", "id", "hot"])
        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                if len(s) and seen.new(i := set_id(s)):
                    key, hot = signatures(s, table)
                    keys.append(key)
                    ids.append(np.full(len(key), i, np.int64))
                    hots.append(hot)
                    size += len(key)
                if size > 1 << 18:
                    yield out()
                    keys, ids, hots, size = [], [], [], 0
        if keys:
            yield out()
    return run


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, salt, id): the distinct ones whose signature several sets
    have, with its least and greatest set and their number, and all of common signatures,
    without these (other salts may hold their partners).  The run a batch ends in is
    carried on; of a common signature's, its last row."""
    hold, gone = None, False
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(rows[0]):
            continue
        sig, ident, salt = rows if hold is None else (np.concatenate(x) for x in zip(hold, rows, strict=True))
        run = np.concatenate([[True], (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])])
        new = np.concatenate([[True], run[1:] | (ident[1:] != ident[:-1])])
        sig, ident, salt, run = (x[new] for x in (sig, ident, salt, run))
        last = np.flatnonzero(run)[-1]
        now = len(sig) if salt[last] else last
        yield _runs(sig[:now], ident[:now], salt[:now], run[:now], gone)
        keep, gone = (now - 1, True) if salt[last] else (last, False)
        hold = sig[keep:], ident[keep:], salt[keep:]
    if hold is not None and not gone:
        yield _runs(*hold, np.arange(len(hold[0])) == 0, False)


def _runs(sig: np.ndarray, ident: np.ndarray, salt: np.ndarray, run: np.ndarray, gone: bool) -> pa.RecordBatch:
    """What ``_shared_only`` emits of whole runs; ``gone``: but for the first row."""
    start = np.flatnonzero(run)
    n = np.diff(np.append(start, len(sig)))
    of = np.repeat(np.arange(len(start)), n)
    go = (n[of] > 1) | (salt > 0)
    if gone:
        go[:1] = False
    of, dealt = of[go], salt[go] > 0
    ends = (ident[start[of]], ident[start[of] + n[of] - 1], n[of])
    return pa.RecordBatch.from_arrays([pa.array(sig[go]), pa.array(ident[go]), *[pa.array(x, pa.int64(), mask=dealt) for x in ends]],
                                      names=["sig", "id", "least", "most", "n"])


def _nodes(wanted_ids, wanted_docs, bits: int, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, seen = wanted_ids.value, wanted_docs.value, _Seen()
        for batch in batches:
            rows, size = [], 0
            near = in_bitmap(docs, batch.column(0).to_numpy(zero_copy_only=False), bits)
            texts = batch.column(1).take(pa.array(np.flatnonzero(near)))
            for _, s in shingle_sets(texts):
                if len(s) and in_bitmap(ids, np.array([i := set_id(s)]), bits)[0] and seen.new(i):
                    rows.append((i, s))
                    size += len(s)
                if size > 1 << 18:
                    yield make(rows)
                    rows, size = [], 0
            if rows:
                yield make(rows)
    return run


def _node_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([signed(s) for _, s in rows], pa.list_(pa.int64()))],
                                      names=["id", "shingles"])


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """Occupied places of a hash table of 8 to 16 places per element, by the low bits, so
    that the table of half the size is the two halves together."""
    log = max(6, (8 * len(s) - 1).bit_length())
    bits = np.zeros(1 << log, dtype=np.uint8)
    bits[(mix(s) & _U((1 << log) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(_U)


def _sketch_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([i for i, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()),
        pa.array([wide_sketch(s).tobytes() for _, s in rows], pa.binary())], names=["id", "n", "bits"])


def _halved(words: np.ndarray, to: int) -> np.ndarray:
    while words.shape[1] > to:
        half = words.shape[1] // 2
        words = words[:, :half] | words[:, half:]
    return words


def _close_pairs(outer, every):
    """(a, b) of different labels whose sizes and sketches allow similarity: a of ``outer``,
    b of ``every``; two outer sets are one pair.  Sets meet in runs of like sizes.  A group
    of one chunk comes whole in ``every``, its outer sets among the others."""
    if every.num_rows and every.column("whole")[0].as_py():
        outer = every.filter(pc.invert(every.column("main")))
    oi, ol, on, ob = (outer.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "n", "bits"))
    ei, el, en, eb = (every.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "n", "bits"))
    main = every.column("main").to_numpy(zero_copy_only=False)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(en, kind="stable")
    ei, el, en, main = ei[order], el[order], en[order], main[order]
    lengths = np.array([len(x) for x in eb[order]]) // 8 if len(ei) else np.zeros(0, int)
    tables = {w: np.frombuffer(b"".join(eb[order][lengths == w]), _U).reshape(-1, w) for w in np.unique(lengths)}
    place = np.zeros(len(ei), np.int64)
    for w in tables:
        place[lengths == w] = np.arange((lengths == w).sum())
    for i, label, n, b in zip(oi, ol, on, ob, strict=True):
        lo, hi = np.searchsorted(en, -(-n * NEED // OF)), np.searchsorted(en, n * OF // NEED, "right")
        if lo == hi:
            continue
        mine = np.frombuffer(b, _U).reshape(1, -1)
        for w, table in tables.items():
            rows = np.flatnonzero(lengths[lo:hi] == w) + lo
            rows = rows[(el[rows] != label) & (main[rows] | (ei[rows] > i))]
            for at in range(0, len(rows), 4096):
                some = rows[at:at + 4096]
                to = min(w, mine.shape[1])
                differ = np.bitwise_count(_halved(table[place[some]], to) ^ _halved(mine, to)).sum(1, dtype=np.int64)
                some = some[(OF + NEED) * differ <= (OF - NEED) * (en[some] + n)]
                out_a.append(np.full(len(some), i))
                out_b.append(ei[some])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def across(rest: DataFrame, sketches: DataFrame, chunk: int = 4096) -> DataFrame:
    """Pairs (a, b) of sets that an open signature holds in different components, as far as
    sizes and sketches allow.  rest: (main, id, label), the sets of all open signatures
    whose least one's component is ``main``; sets outside of it meet all others, once,
    whatever the number of signatures they share.  Large groups are dealt out in chunks."""
    counts = rest.groupBy("main").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") != F.col("main")).alias("outer"))
    size = lambda c: F.greatest(F.ceil(F.col(c) / chunk), F.lit(1)).cast("int")
    counts = counts.select(F.col("main").alias("key"), size("outer").alias("I"), size("rows").alias("J"))
    # dealt out and written before the sketches come: only the last shuffle has these
    rows = written(rest.join(counts, F.col("main") == F.col("key")).select(
        "key", "id", "label", (F.col("label") == F.col("main")).alias("main"), "I", "J"), "jaccard-rows")
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = (F.col("I") == 1) & (F.col("J") == 1)
    outer = rows.where(~F.col("main") & ~whole).select("key", of("I").alias("i"), all_of("J").alias("j"), "id", "label").join(sketches, "id")
    every = rows.select(F.col("key").alias("key2"), all_of("I").alias("i2"), of("J").alias("j2"), "id", "label", "main", whole.alias("whole")).join(sketches, "id")
    every = every.select(*[F.col(c).alias(c) for c in every.columns])
    met = outer.groupBy("key", "i", "j").cogroup(every.groupBy("key2", "i2", "j2")).applyInArrow(_close_pairs, "a long, b long")
    return met.distinct()


def _allowed(ka: Column, kb: Column) -> Column:
    """Whether sizes and a sketch of sides a and b allow similarity (never false for a
    similar pair)."""
    differ = F.aggregate(F.zip_with(ka, kb, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    na, nb = F.col("n_a"), F.col("n_b")
    near = OF * F.least(na, nb) >= NEED * F.greatest(na, nb)
    return F.when(near, (OF + NEED) * differ <= (OF - NEED) * (na + nb)).otherwise(False)


def _side(brief: DataFrame, s: str, *columns: str) -> DataFrame:
    return brief.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])


def possible(pairs: DataFrame, brief: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) that the sketches allow: first the small ones, then those
    of the band both are in.  The pairs left by the first are written: where they are few,
    the large sketches need no shuffle."""
    columns = pairs.columns
    pairs = pairs.join(_side(brief, "a", "n", "small"), "a").join(_side(brief, "b", "n", "small"), "b").where(
        _allowed(F.col("small_a"), F.col("small_b"))).select(*columns)
    pairs = written(pairs, "jaccard-possible")
    full = ("n", "band", "own", "next")
    pairs = pairs.join(_side(brief, "a", *full), "a").join(_side(brief, "b", *full), "b")
    ka = F.when(F.col("band_a") >= F.col("band_b"), F.col("own_a")).otherwise(F.col("next_a"))
    kb = F.when(F.col("band_b") >= F.col("band_a"), F.col("own_b")).otherwise(F.col("next_b"))
    return pairs.where(_allowed(ka, kb)).select(*columns)


def similar(pairs: DataFrame, df: DataFrame, brief: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar, compared exactly.  Only the sets that
    occur are read from the texts again.  The set of b goes to a's."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    nodes = written(sets_again(wanted, df, brief, key, text, _node_batch, "id long, shingles array<long>"), "jaccard-nodes")
    node = lambda s: nodes.select(F.col("id").alias(s), F.col("shingles").alias(f"s{s}"))
    both = pairs.join(node("b"), "b").join(node("a"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    out = written(both.where(OF * common >= NEED * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct(), "jaccard-links")
    release(nodes)
    return out


def sets_again(wanted: DataFrame, df: DataFrame, brief: DataFrame, key: str, text: str, make, schema: str) -> DataFrame:
    """``make`` of the sets ``wanted`` (id), read from the texts again.  Two bitmaps pick
    them, and a few others by chance; those that join nothing do no harm.  They have 16
    bits a set, at most 2^28 (32 MB): beyond 10^8 sets more pass by chance."""
    spark = df.sparkSession
    wanted = written(wanted.join(brief.select("id", "doc"), "id"), "jaccard-wanted")
    bits = bitmap_bits(wanted.count())
    maps = [spark.sparkContext.broadcast(bitmap(wanted, c, bits)) for c in ("id", "doc")]
    texts = df.select(F.xxhash64(F.col(key)), F.col(text).cast("string"))
    return texts.mapInArrow(_nodes(*maps, bits, make), schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of all nodes of undirected edges (a, b): the least id reachable.
    Large-star and small-star steps, each a minimum and a join, until the edges
    stay the same; they then are stars around the least ids."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where(F.col("v") < F.col("u"))
        # written, so that the join below is between two shuffled sides and a hot node can be split
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        linked = both.where(F.col("v") > F.col("u")) if large else both
        out = linked.join(least, "u").select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = written(edges.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = mark(edges)
    while True:
        edges = written(star(star(edges, True), False), "edges")
        if (now := mark(edges)) == state:
            break
        state = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(
        edges.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())


def sets_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(doc, n, id, band, small, own, next) of every row, and the sorted common shingles."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.col(text).cast("string"))
    survey = written(rows.mapInArrow(_survey, _SURVEY.format(key=kind)), "jaccard-survey")
    often = survey.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("count").alias("count")).where(
        F.col("count") >= HOT_COUNT).orderBy(F.desc("count"), "shingle").limit(HOT_TABLE).select("shingle")
    common = np.sort(np.array([r[0] for r in often.collect()], dtype=np.int64).view(_U))
    return survey.where(F.col("n").isNotNull()).select("doc", "n", "id", "band", "small", "own", "next"), common


def links(df: DataFrame, sets: DataFrame, common: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): similar pairs of different sets, enough of them to connect all that
    are connected by similar pairs."""
    spark = df.sparkSession
    share = spark.sparkContext.broadcast
    texts = df.select(F.col(text).cast("string"))
    salt = F.when(F.col("hot") == 1, 1 + F.pmod("id", F.lit(64))).otherwise(0).cast("int")
    signed_sets = texts.mapInArrow(_signer(share(common)), "sig long, id long, hot int").select("sig", "id", salt.alias("salt"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = written(signed_sets.repartition(parts, "sig", "salt").sortWithinPartitions("sig", "salt", "id").mapInArrow(
        _shared_only, "sig long, id long, least long, most long, n long"), "jaccard-shared")
    # only the signatures dealt out by a salt are still to be brought together
    dealt = shared.where(F.col("n").isNull()).select("sig", "id")
    ends = dealt.groupBy("sig").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where(
        F.col("least") != F.col("most"))
    dealt = written(dealt.join(ends, "sig"), "jaccard-dealt")
    groups = shared.where(F.col("n").isNotNull()).unionByName(dealt)
    brief = sets.join(groups.select("id").distinct(), "id", "left_semi").groupBy("id").agg(
        F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("n", "band", "small", "own", "next")])
    brief = written(brief.withColumn("doc", F.xxhash64("doc")), "jaccard-brief")
    # round one: each set with the least and the greatest set of its signatures, first the one that shares most
    ordered = [F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")]
    pairs = groups.select("id", F.explode(F.array("least", "most")).alias("pivot")).where(F.col("id") != F.col("pivot")).groupBy(
        "id", "pivot").agg(F.count(F.lit(1)).alias("times")).select("id", "pivot", "times", *ordered)
    close = written(possible(pairs, brief), "jaccard-close")
    best = close.groupBy("id").agg(F.max_by("pivot", F.struct("times", "pivot")).alias("pivot")).select(*ordered).distinct()
    best = written(best, "jaccard-best")
    linked = similar(best, df, brief, key, text)

    def side_labels(labels: DataFrame, column: str) -> DataFrame:
        return labels.select(F.col("id").alias(column), F.col("label").alias(f"label_{column}"))

    labels = components(linked)
    left = close.select("a", "b").distinct().join(best, ["a", "b"], "left_anti").join(side_labels(labels, "a"), "a", "left").join(
        side_labels(labels, "b"), "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    left = written(left, "jaccard-left")
    linked = linked.unionByName(similar(left, df, brief, key, text))
    release(close)
    # round two: of what is open still, the sets outside the least one's component with all others
    labels = components(linked)
    labelled = groups.where((F.col("n") > 3) & (F.col("id") != F.col("least")) & (F.col("id") != F.col("most"))).join(
        labels, "id", "left").join(side_labels(labels, "least"), "least", "left").select(
        "sig", "id", F.coalesce("label", "id").alias("label"), F.coalesce("label_least", "least").alias("main"))
    sorts = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("sig")
    rest = written(labelled.join(sorts, "sig").select("main", "id", "label").distinct(), "jaccard-open")
    sketches = written(sets_again(rest.select("id").distinct(), df, brief, key, text, _sketch_batch, "id long, n long, bits binary"), "jaccard-sketches")
    more = written(across(rest, sketches).join(best.unionByName(left), ["a", "b"], "left_anti"), "jaccard-second")
    release(shared, dealt, sketches)
    return linked.unionByName(similar(more, df, brief, key, text))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, id, component) for every row of ``df``: the size and id of its set and
    the least document id reachable by similar pairs."""
    sets, common = sets_of(df, key, text)
    labels = components(links(df, sets, common, key, text))
    named = sets.where(F.col("n") > 0).groupBy("id").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n_docs"))
    named = written(named.join(labels, "id", "left").select("id", "first", "n_docs", F.coalesce("label", "id").alias("label")), "jaccard-named")
    # only components of several documents need a lookup
    least = named.groupBy("label").agg(F.min("first").alias("component"), F.sum("n_docs").alias("docs")).where(F.col("docs") > 1)
    by_id = named.select("id", "label").join(least, "label").select("id", "component")
    return sets.join(by_id, "id", "left").select("doc", "n", "id", F.coalesce("component", "doc").alias("component"))


def one_per_group(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays: that with the least id (a null id is later than
    any other; of rows equal in id that with the least text hash, of rows equal in both
    one).  Every row is judged by its own text; rows without words stay, all of them.
    The columns are those that came in."""
    mark = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    near = near_duplicates(df.select(mark.alias("mark"), F.col(text).alias("text")), "mark", "text").where(F.col("n") > 0)
    verdicts = near.groupBy("doc").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("component"))
    once = F.col("component") == F.col("doc")
    verdicts = written(verdicts.where(~once | (F.col("rows") > 1)).select(F.col("doc").alias("judged"), once.alias("once")), "jaccard-verdicts")
    row = F.struct(*df.columns).alias("row")
    # a bitmap tells rows that surely stay, so that only the others' texts are shuffled
    bits = bitmap_bits(verdicts.count())
    judged = df.sparkSession.sparkContext.broadcast(bitmap(verdicts.select(F.xxhash64("judged").alias("hash")), "hash", bits))
    maybe = F.pandas_udf(lambda h: pd.Series(in_bitmap(judged.value, h.to_numpy(), bits)), "boolean")
    rows = df.select(row, mark.alias("mark")).withColumn("maybe", maybe(F.xxhash64("mark")))
    sure, open_rows = rows.where(~F.col("maybe")).select("row"), rows.where("maybe").select("row", "mark")
    kept = sure.unionByName(open_rows.join(verdicts, F.col("mark") == F.col("judged"), "left_anti").select("row"))
    twice = open_rows.join(verdicts.where("once"), F.col("mark") == F.col("judged"), "left_semi")
    # few rows; written, so that the two sides of the union share no plan
    one = written(twice.groupBy("mark").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"), "jaccard-once")
    return kept.unionByName(one).select("row.*")
