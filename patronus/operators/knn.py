"""Exact k-nearest-neighbour search (Euclidean) over median cells.

Reference rows are cut into cells.  Coordinates that nearly always have one of two values
(one-hot columns) come first: rows that agree in them are a group, rows with other values
or a rare combination are one more.  Cells of two groups are a whole step apart, while a
median cut leaves no space between its sides.  In a group a binary tree splits, level by
level, on the coordinate of the widest spread at its median.  Groups and cuts are fitted
on a bounded keyed sample (``SAMPLE_PER_CELL`` rows a cell wanted, at least ``LEAST_SAMPLE``;
some ``2 ** MAX_DEPTH`` cells at most); every row is put into its cell and the boxes of
cells and groups are those of all rows, so the sample decides speed only.  No row of a
cell is nearer than its box:

1. round 1 searches the cell whose box is nearest to the query in the nearest group, and the
   next nearest where that has too few rows, which gives an upper bound r_k on its k-th
   distance (∞ if < k candidates);
2. round 2 adds exactly the other cells whose boxes are within r_k, so the result is
   exact; of their rows only those within r_k leave a task.  Cells are looked at only in
   groups whose box is within r_k.

With ``zero_alone`` a query that has neighbours at distance 0 gets these only: all that the
vote (``knn_vote``) takes.  Rows that are reference rows themselves need no others.

Inside a cell, query and reference rows are cut into hash chunks of at most
``slab_rows`` rows (per-cell counts, a table of ≤ cells rows), so a hot cell
(many equal points) is split over many tasks; each (cell, query chunk,
reference chunk) group meets in one ``cogroup`` task where numpy keeps only
the k best per query row, a block of ``BLOCK`` queries at a time.  The shuffle into
these groups has a task per ``TASK_ROWS`` rows, so a task holds a few groups however
many there are.  A final ``row_number`` per query merges the candidates.  Ties in
distance are broken by the reference id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 12
SAMPLE_PER_CELL, LEAST_SAMPLE = 16, 4096
CELL_ROWS = 1024       # wanted in a cell, where 2 ** MAX_DEPTH of them suffice
RARE = 1 / 128         # the least share of a group's own
PAIRS = 1 << 20        # (query, cell) pairs looked at at a time
TASK_ROWS = 32_768
BLOCK = 128


def _local_topk(k: int, exclude_self: bool, chunk: int = BLOCK, zero_alone: bool = False):
    def fn(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": pd.Series([], dtype="int64"), "rid": pd.Series([], dtype="int64"),
                              "dist": pd.Series([], dtype="float64"), "rlabel": pd.Series([], dtype="int32")})
        if q.empty or r.empty:
            return empty
        qx = np.vstack(q["qx"].to_numpy()).astype(np.float64)
        rx = np.vstack(r["rx"].to_numpy()).astype(np.float64)
        qid, within = q["qid"].to_numpy(), np.square(q["rk"].to_numpy())
        rid = r["rid"].to_numpy()
        rl = r["rlabel"].to_numpy()
        order = np.argsort(rid, kind="stable")
        rx, rid, rl = rx[order], rid[order], rl[order]
        r2 = (rx * rx).sum(1)
        out = []
        for s in range(0, len(qx), chunk):
            a = qx[s:s + chunk]
            a2 = (a * a).sum(1)
            d2 = a @ rx.T
            d2 *= -2.0
            d2 += a2[:, None]
            d2 += r2
            np.maximum(d2, 0.0, out=d2)
            if exclude_self:
                d2[qid[s:s + chunk][:, None] == rid[None, :]] = np.inf
            # every candidate within a hair of the k-th squared distance and of the query's
            # bound, so ties and rounding of the expansion cannot drop a true neighbour
            hair = 1e-12 * (1.0 + a2 + r2.max())
            thr = within[s:s + chunk] * (1 + 1e-9) + hair
            if zero_alone:  # equal rows need no search for the k-th distance
                rows, cols = np.nonzero(d2 <= hair[:, None])
                same = np.unique(rows[(a[rows] == rx[cols]).all(1)])
                thr[same] = hair[same]
            many = np.flatnonzero(np.count_nonzero(d2 <= thr[:, None], axis=1) > k)
            if len(many):
                kth = np.partition(d2[many], k - 1, axis=1)[:, k - 1]
                thr[many] = np.minimum(thr[many], kth * (1 + 1e-9) + hair[many])
            rows, cols = np.nonzero((d2 <= thr[:, None]) & np.isfinite(d2))
            diff = a[rows] - rx[cols]
            dist = np.sqrt((diff * diff).sum(1))
            # exact order: by row, distance, reference id; keep k per row
            o = np.lexsort((rid[cols], dist, rows))
            rows, cols, dist = rows[o], cols[o], dist[o]
            first = np.searchsorted(rows, rows, side="left")
            keep = (np.arange(len(rows)) - first) < k
            if zero_alone:
                keep &= (dist == 0) | (dist[first] > 0)
            rows, cols, dist = rows[keep], cols[keep], dist[keep]
            out.append(pd.DataFrame({"qid": qid[s:s + chunk][rows], "rid": rid[cols],
                                     "dist": dist, "rlabel": rl[cols].astype("int32")}))
        return pd.concat(out, ignore_index=True) if out else empty
    return fn


def _chunked_topk(qs: DataFrame, rs: DataFrame, k: int, exclude_self: bool, slab_rows: int, zero_alone: bool = False) -> DataFrame:
    """qs: (qid, qx, rk, s) — a query row once per cell it must search, rk the distance
    beyond which no neighbour counts; rs: (rid, rx, rlabel, s).  Both are written frames.
    Returns candidate (qid, rid, dist, rlabel)."""
    qn = qs.groupBy("s").agg(F.count(F.lit(1)).alias("nq"))
    rn = rs.groupBy("s").agg(F.count(F.lit(1)).alias("nr"))
    # ≤ number of cells rows
    sizes = [(c["s"], c["nq"], c["nr"], max(1, math.ceil(c["nq"] / slab_rows)), max(1, math.ceil(c["nr"] / slab_rows)))
             for c in qn.join(rn, "s").collect()]
    tasks = max(1, math.ceil(sum(nq * rc_n + nr * qc_n for _, nq, nr, qc_n, rc_n in sizes) / TASK_ROWS))
    names, table = ["s", "nq", "nr", "qc_n", "rc_n"], np.array(sizes, dtype=np.int32).reshape(-1, 5)
    ch = F.broadcast(qs.sparkSession.createDataFrame(pa.table(dict(zip(names, table.T, strict=True)))).drop("nq", "nr"))
    qrep = (qs.join(ch, "s")
              .withColumn("qc", F.pmod(F.xxhash64("qid"), F.col("qc_n")).cast("int"))
              .withColumn("rc", F.explode(F.sequence(F.lit(0), F.col("rc_n") - 1))))
    rrep = (rs.join(ch, "s")
              .withColumn("rc", F.pmod(F.xxhash64("rid"), F.col("rc_n")).cast("int"))
              .withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("qc_n") - 1))))
    group = ["s", "qc", "rc"]
    return (qrep.select(*group, "qid", "qx", "rk").repartition(tasks, *group).groupBy(*group)
                .cogroup(rrep.select(*group, "rid", "rx", "rlabel").repartition(tasks, *group).groupBy(*group))
                .applyInPandas(_local_topk(k, exclude_self, zero_alone=zero_alone),
                               schema="qid long, rid long, dist double, rlabel int"))


def _best(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "rid")
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def split_tree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, cut) of the inner nodes of a binary tree, the children of node i
    being 2i + 1 and 2i + 2; rows above the cut go right."""
    coord, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    rows = {0: np.arange(len(x))}
    for node in range(len(cut)):
        at = rows.pop(node)
        if len(at):
            coord[node] = np.ptp(x[at], axis=0).argmax()
            cut[node] = np.quantile(x[at, coord[node]], 0.5, method="lower")
        above = x[at, coord[node]] > cut[node]
        rows[2 * node + 1], rows[2 * node + 2] = at[~above], at[above]
    return coord, cut


def leaves(x: np.ndarray, coord: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The cell of every row."""
    node = np.zeros(len(x), np.int64)
    for _ in range(int(len(cut) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), coord[node]] > cut[node])
    return node - len(cut)


class Groups:
    """Groups of rows by their two-valued coordinates and a tree of median cuts in each, from a
    sample; ``cell_of`` gives every row its cell, ``first`` the first cell of each group."""

    def __init__(self, x: np.ndarray, depth: int):
        self.two, self.values = [], []
        for j in range(x.shape[1] if len(x) else 0):
            values, n = np.unique(x[:, j], return_counts=True)
            top = np.sort(values[np.argsort(-n, kind="stable")[:2]])
            if len(values) > 1 and n[np.argsort(-n, kind="stable")[:2]].sum() >= 0.9 * len(x) and len(self.two) < 62:
                self.two.append(j)
                self.values.append(top)
        codes = self._codes(x)
        found, n = np.unique(codes[codes >= 0], return_counts=True)
        self.codes = found[n >= RARE * len(x)]
        at = self._group(codes)
        self.trees, self.first = [], [0]
        for g in range(len(self.codes) + 1):
            share = (at == g).mean() if len(x) else 1.0
            levels = max(0, math.ceil(math.log2(share * (1 << depth)))) if share else 0
            self.trees.append(split_tree(x[at == g], levels))
            self.first.append(self.first[-1] + (1 << levels))

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """The combination of the two-valued coordinates; −1 where one has another value."""
        out, known = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for bit, (j, (low, high)) in enumerate(zip(self.two, self.values, strict=True)):
            out |= (x[:, j] == high).astype(np.int64) << bit
            known &= (x[:, j] == high) | (x[:, j] == low)
        return np.where(known, out, -1)

    def _group(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code; the last group is that of all others."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, len(self.codes))

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(x), np.int32), self._group(self._codes(x))
        for g in np.unique(at):
            out[at == g] = self.first[g] + leaves(x[at == g], *self.trees[g])
        return out


class RefCells:
    """Reference rows with their cell, and the cells' boxes; reusable
    for several query frames against the same reference."""

    def __init__(self, ref: DataFrame, rid: str, vec: str = "x", rlabel: str = "label", slab_rows: int = 4096):
        r = ref.select(F.col(rid).cast("long").alias("rid"), F.col(vec).alias("rx"),
                       F.col(rlabel).cast("int").alias("rlabel"))
        n = r.count()
        self.slab_rows = slab_rows
        self.depth = 0 if n <= slab_rows else min(MAX_DEPTH, math.ceil(math.log2(n / min(slab_rows, CELL_ROWS))))
        if not self.depth:
            self.rs = r.withColumn("s", F.lit(0)).checkpoint(eager=True)
            return
        share = min(1.0, max(LEAST_SAMPLE, SAMPLE_PER_CELL << self.depth) / n)
        part = F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < share * (1 << 30)
        sample = r.where(part).select("rx").toArrow()
        sample = sample if sample.num_rows else r.select("rx").limit(1).toArrow()
        d = len(sample.column("rx")[0])
        groups = Groups(sample.column("rx").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d), self.depth)
        self.rs = r.withColumn("s", _cell(groups)("rx")).checkpoint(eager=True)
        sides = [f(F.col("rx")[i]) for f in (F.min, F.max) for i in range(d)]
        boxes = self.rs.groupBy("s").agg(F.array(*sides).alias("box"), F.count(F.lit(1)).alias("n")).orderBy("s").collect()   # some 2 ** MAX_DEPTH rows
        box = np.array([b["box"] for b in boxes], dtype=np.float64)
        self.boxes = Boxes(np.array([b["s"] for b in boxes], dtype=np.int32), np.array([b["n"] for b in boxes]), box[:, :d], box[:, d:], np.array(groups.first))

    def visits(self, q: DataFrame, k: int, rest: bool) -> DataFrame:
        """(qid, qx, rk, s): the cells to search for q (qid, qx, rk): the nearest ones that have
        k rows, or with ``rest`` all others within rk."""
        return q.mapInArrow(_visits(self.boxes, k, rest), "qid long, qx array<double>, rk double, s int").checkpoint(eager=True)


def _cell(groups: Groups):
    @F.pandas_udf("int")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(groups.cell_of(np.vstack(x.to_numpy())) if len(x) else np.zeros(0, np.int32))
    return cell


class Boxes:
    """The boxes of the cells that have rows, and those of their groups."""

    def __init__(self, cells: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray):
        self.cells, self.sizes, self.low, self.high = cells, sizes, low, high
        group = np.searchsorted(first, cells, "right")
        self.start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        self.end = np.append(self.start[1:], len(cells))
        self.group_low, self.group_high = np.minimum.reduceat(low, self.start), np.maximum.reduceat(high, self.start)
        #: the coordinates in which the boxes of a group differ
        self.varying = [np.flatnonzero((low[a:e] != low[a]).any(0) | (high[a:e] != high[a]).any(0)) for a, e in zip(self.start, self.end, strict=True)]

    @staticmethod
    def away(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The squared distance of every row from every box."""
        out = np.zeros((len(x), len(low)))
        for i in range(x.shape[1]):
            c = x[:, i, None]
            beyond = np.maximum(low[:, i] - c, c - high[:, i])
            np.maximum(beyond, 0.0, out=beyond)
            beyond *= beyond
            out += beyond
        return out

    def of_group(self, x: np.ndarray, g: int) -> np.ndarray:
        """``away`` from the cells of a group."""
        low, high = self.low[self.start[g]:self.end[g]], self.high[self.start[g]:self.end[g]]
        alike = np.ones(x.shape[1], bool)
        alike[self.varying[g]] = False
        out = self.away(x[:, ~alike], low[:, ~alike], high[:, ~alike])
        out += self.away(x[:, alike], low[:1, alike], high[:1, alike])
        return out

    def nearest(self, x: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place of a cell): round 1's cells, k rows in them where there are as many."""
        rows, places = [], []
        for g in np.unique(group):
            here = np.flatnonzero(group == g)
            for part in np.array_split(here, max(1, math.ceil(len(here) * (self.end[g] - self.start[g]) / PAIRS))):
                rows.append(part)
                places.append(self.start[g] + self.of_group(x[part], g).argmin(1))
        rows, places = np.concatenate(rows), np.concatenate(places)
        short = np.flatnonzero(self.sizes[places] < k)
        full = np.setdiff1d(np.arange(len(rows)), short)
        out = [(rows[full], places[full])]
        for part in np.array_split(short, max(1, math.ceil(len(short) * len(self.cells) / PAIRS))):
            order = np.argsort(self.away(x[rows[part]], self.low, self.high), axis=1, kind="stable")
            before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
            r, c = np.nonzero(before < k)
            out.append((rows[part][r], order[r, c]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def within(self, x: np.ndarray, away: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place of a cell): all cells whose box is within a row's limit; away: of the groups."""
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in range(len(self.start)):
            here = np.flatnonzero(np.sqrt(away[:, g]) <= limit)
            for part in np.array_split(here, max(1, math.ceil(len(here) * (self.end[g] - self.start[g]) / PAIRS))):
                r, c = np.nonzero(np.sqrt(self.of_group(x[part], g)) <= limit[part, None])
                rows.append(part[r])
                places.append(self.start[g] + c)
        return np.concatenate(rows), np.concatenate(places)


def _visits(boxes: Boxes, k: int, rest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("qx").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            away = boxes.away(x, boxes.group_low, boxes.group_high)
            rows, at = boxes.nearest(x, away.argmin(1), k)
            if rest:
                limit = batch.column("rk").to_numpy(zero_copy_only=False) * (1 + 1e-9) + 1e-12
                seen = rows * len(boxes.cells) + at
                rows, at = boxes.within(x, away, limit)
                new = ~np.isin(rows * len(boxes.cells) + at, seen)
                rows, at = rows[new], at[new]
            for p in range(0, len(rows), 8192):
                take = pa.array(rows[p:p + 8192])
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(take), batch.column("qx").take(take),
                                                  batch.column("rk").take(take), pa.array(boxes.cells[at[p:p + 8192]])],
                                                 names=["qid", "qx", "rk", "s"])
    return run


def _bounded(q: DataFrame, found: DataFrame, k: int, zero_alone: bool = False) -> DataFrame:
    """(qid, qx, rk): the distance within which further neighbours must lie."""
    rk = found.groupBy("qid").agg(F.max("dist").alias("rk"), F.count(F.lit(1)).alias("got"), F.min("dist").alias("least"))
    known = F.when(F.lit(zero_alone) & (F.col("least") == 0), F.lit(0.0)).when(F.col("got") >= k, F.col("rk"))
    return q.join(rk, "qid", "left").select("qid", "qx", known.otherwise(F.lit(math.inf)).alias("rk"))


def knn(query: DataFrame, ref: DataFrame | None, k: int, qid: str, rid: str, vec: str = "x",
        rlabel: str = "label", slab_rows: int = 4096, exclude_self: bool = False,
        prepared: RefCells | None = None, zero_alone: bool = False) -> DataFrame:
    """(qid, rid, dist, rlabel, rank) — the k nearest ref rows per query row; with
    ``zero_alone`` only those at distance 0 where there are any.

    ``vec`` is an array<double> column present in both frames; ``prepared``
    reuses the reference cells of an earlier call."""
    prep = prepared or RefCells(ref, rid, vec, rlabel, slab_rows)
    q = query.select(F.col(qid).cast("long").alias("qid"), F.col(vec).alias("qx"))

    def search(qs: DataFrame) -> DataFrame:
        return _chunked_topk(qs, prep.rs, k, exclude_self, prep.slab_rows, zero_alone)

    def best(cands: DataFrame) -> DataFrame:
        if not zero_alone:
            return _best(cands, k)
        least = F.min("dist").over(Window.partitionBy("qid").orderBy("dist", "rid"))
        return _best(cands.withColumn("least", least), k).where("dist = 0 or least > 0").drop("least")
    if not prep.depth:
        return best(search(q.select("*", F.lit(math.inf).alias("rk"), F.lit(0).alias("s")).checkpoint(eager=True))).checkpoint(eager=True)
    first = best(search(prep.visits(q.withColumn("rk", F.lit(math.inf)), k + exclude_self, rest=False))).checkpoint(eager=True)
    more = search(prep.visits(_bounded(q, first, k, zero_alone), k + exclude_self, rest=True))
    return best(first.drop("rank").unionByName(more))


def searched_share(query: DataFrame, prep: RefCells, k: int, qid: str, vec: str = "x") -> float:
    """The share of all (query, reference) pairs whose distance the search computes."""
    sizes = prep.rs.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    total = query.count() * prep.rs.count()
    if not prep.depth or not total:
        return 1.0
    q = query.select(F.col(qid).cast("long").alias("qid"), F.col(vec).alias("qx"))
    near = prep.visits(q.withColumn("rk", F.lit(math.inf)), k, rest=False)
    first = _best(_chunked_topk(near, prep.rs, k, False, prep.slab_rows), k).checkpoint(eager=True)
    seen = near.select("s").unionByName(prep.visits(_bounded(q, first, k), k, rest=True).select("s"))
    return seen.join(F.broadcast(sizes), "s").agg(F.sum("n")).first()[0] / total


def knn_vote(neighbours: DataFrame) -> DataFrame:
    """Distance-weighted vote per query row: P(1) = Σ y/d / Σ 1/d; when some
    neighbours are at distance 0 only they vote (equally)."""
    zero = F.col("dist") == 0
    g = neighbours.groupBy("qid").agg(
        F.sum(F.when(zero, 1.0).otherwise(0.0)).alias("z"),
        F.sum(F.when(zero, F.col("rlabel").cast("double")).otherwise(0.0)).alias("zy"),
        F.sum(F.when(~zero, 1.0 / F.col("dist"))).alias("w"),
        F.sum(F.when(~zero, F.col("rlabel") / F.col("dist"))).alias("wy"))
    p1 = F.when(F.col("z") > 0, F.col("zy") / F.col("z")).otherwise(F.col("wy") / F.col("w"))
    return g.select("qid", p1.alias("score"), (p1 > 0.5).cast("int").alias("prediction"))
