r"""Fill-in-the-middle by repeated captures: one ``fullmatch`` of ``(unit)*`` keeps
every repetition, so ``match.ends(1)`` gives the number of units and both cuts.

The units of a text are its lines with their line ends, ``[^\n]*\n|[^\n]+``.  Draws
come from sha256(``seed:id``): its first four groups of eight hex digits pick the
two cuts, whether the text stays plain, and the order of the three parts.  The prefix
ends after the smaller drawn number of units and the middle after the larger.

    plain  text
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

A text that is empty or holds one of the three marks stays plain, so the parts of a
transformed text are exactly what stands between the marks (``restored``).

Defined results: a null text is empty; a null id draws as an empty one; repeated
rows are transformed alike, one by one; an empty table has no rows; texts are
matched whole, whatever their length (memory: the text and one number per line);
columns but ``keep`` are not read, and of these one named like a new column gives way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = regex.compile(r"([^\n]*\n|[^\n]+)*")
_NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


def transform_text(text: str, ident: str, rate: int, spm_rate: int, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    draw = hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(draw[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _run(rate: int, spm_rate: int, seed: int, at_once: int = 128):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, at_once):
                batch = whole.slice(lo, at_once)
                out = [transform_text(t, i, rate, spm_rate, seed)
                       for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                n, form, first, second, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()), pa.array(text, pa.string())], names=["row", *_NEW])
    return run


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 100, spm_rate: int = 50, seed: int = 7,
                   keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) of every row with ``n``,
    ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    kept = [c for c in (keep if keep is not None else df.columns) if c not in _NEW and c != text]
    row = F.struct(*kept) if kept else F.struct(F.lit(None).alias("none"))
    rows = df.select(row.alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(_run(rate, spm_rate, seed), f"row {rows.schema['row'].dataType.simpleString()}, n long, form string, "
                          "prefix_chars long, middle_chars long, output string")
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *_NEW)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(
        F.concat(part[2], part[3], part[1]))
