"""Exact token counts with a two-tier lookup of pre-token lengths.

A sentencepiece BPE model whose pieces hold a word-start mark only in front, and
no line end inside, encodes each pre-token on its own: a run of blanks with the
characters up to the next blank or line end, or a line end with the characters
after it.  A text's count is the sum over its pre-tokens, so nothing but their
lengths is needed.

Tier one: a first pass counts pre-tokens in every task and emits the task's most
common ones; their sums over all tasks give the most frequent of the corpus, at
most ``table_size``.  Their lengths are encoded once and broadcast (about 1 MB).
Tier two: what misses is encoded in the worker and kept in a bounded cache.
Pre-tokens are never shuffled for counting, and the tables change only the speed.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings
are ordinary text; rows are counted one by one; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

TABLE = 1 << 15
CACHE = 1 << 17
LONGEST = 64  # characters of a pre-token that is worth keeping
PER_TASK = 1 << 12
_RUNS = re.compile(r"\n[^ \n]*| +[^ \n]*")


def load(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_splits(sp) -> None:
    """Raises unless the model encodes pre-tokens on their own."""
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if "\n" in piece or "▁" in piece.lstrip("▁") or sp.is_unused(i):
            raise ValueError(f"pre-tokens of this model are not independent: piece {piece!r}")
    for text in ("a\n b  c", " a ", "é\tx", "Ａ①ﬁ x"):
        if sp.decode(sp.encode(text)) != text.removeprefix(" ") and sp.decode(sp.encode(text)) != text:
            raise ValueError("this model changes texts before encoding them")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first blank (the model puts one in
    front of every text).  A line end stays in front of its pre-token."""
    if "▁" in text:  # the mark itself reads as a blank
        text = text.replace("▁", " ")
    if "  " in text or text[:1] == " ":
        return [x if x[0] == "\n" or x[:2] == "  " else x[1:] for x in _RUNS.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def length(sp, token: str) -> int:
    """Tokens of one pre-token: a blank alone is one token, and a text that starts
    with a line end has the model's blank in front."""
    if not token:
        return 1
    if token[0] == "\n":
        return len(sp.encode(token)) - 1
    return len(sp.encode(token[1:] if token[0] == " " else token))


class Lengths(dict):
    """Lengths by pre-token; misses are encoded and kept, up to ``CACHE`` of them."""

    def __init__(self, sp, frequent: dict[str, int]):
        super().__init__(frequent)
        self.sp, self.frequent = sp, frequent

    def __missing__(self, token: str) -> int:
        n = length(self.sp, token)
        if len(token) <= LONGEST:
            if len(self) >= len(self.frequent) + CACHE:
                self.clear()
                self.update(self.frequent)
            self[token] = n
        return n

    def total(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


def _texts(column: pa.Array, at_once: int = 256) -> Iterator[str]:
    for i in range(0, len(column), at_once):
        for x in column.slice(i, at_once).to_pylist():
            yield x or ""


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in _texts(batch.column(0)):
            if text:
                seen.update(pre_tokens(text))
            if len(seen) > 1 << 18:  # what is rare so far is let go: only the most common matter
                seen = Counter(dict(seen.most_common(1 << 16)))
    top = [(t, n) for t, n in seen.most_common(PER_TASK) if len(t) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                     names=["token", "n"])


def frequent_lengths(df: DataFrame, path: str, text: str = "text", table_size: int = TABLE) -> dict[str, int]:
    """The lengths of the corpus's most frequent pre-tokens, at most ``table_size``."""
    rows = df.select(F.col(text).cast("string")).mapInArrow(_common, "token string, n long").groupBy("token").agg(
        F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(table_size)
    sp = load(path)
    return {r["token"]: length(sp, r["token"]) for r in rows.collect()}


def _counter(path: str, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(load(path), table.value)
        for batch in batches:
            n = [lengths.total(x) for x in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["row", "n_tokens"])
    return run


def count_tokens(df: DataFrame, path: str, text: str = "text", table_size: int = TABLE, keep: list[str] | None = None,
                 limit: int = 4096) -> DataFrame:
    """The columns ``keep`` (default: all) of every row with ``n_bytes``, ``n_tokens``
    and ``over_limit``."""
    check_splits(load(path))
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, path, text, table_size))
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in (keep or df.columns) if c not in new]
    t = text_or_empty(text)
    rows = df.select(F.struct(F.struct(*kept).alias("in"), F.octet_length(t).cast("long").alias("n_bytes")).alias("row"), t.alias("t"))
    counted = rows.mapInArrow(_counter(path, table), f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long")
    return counted.select("row.in.*", "row.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
