"""Quality rules: a table of thresholds compiled into one projection.

Every figure and every verdict is a built-in Spark expression over the row: no
user function, no shuffle.  A rule says which share of which base a document
may have at most or must have at least; ``RULES`` is compiled by ``verdict``
into a single boolean column in whole numbers, so no rounding enters.

Defined results: a null or empty text has no words, fails ``n_words >= 10`` and
is not kept; repeated rows are judged one by one; extra columns pass through
(names of this module's figures are replaced).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, WS_CLASS, split_words, text_or_empty

#: Frequent function words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in is was that for it with as his on be at by had not are but from or have an they which one you "
    "were her all she there would their we him been has when who will no more if out so a this "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an er hat aus bei nach "
    "de la le et les des en un une du que est dans pour qui sur pas plus au par ne se ce il "
    "el los las y del por con para como su al lo pero sus no"
).split()

#: (rule, counted, percent, "max" or "min", base, allowance): counted must be at most / at least that percent of
#: the base; the allowance, in hundredths, is in the document's favour, so that short clean texts pass.
RULES = (
    ("few words", "n_words", 1000, "min", "one", 0),
    ("short words", "word_chars", 200, "min", "n_words", 0),
    ("long words", "word_chars", 2000, "max", "n_words", 0),
    ("symbols", "n_symbols", 30, "max", "n_words", 100),
    ("shouting", "n_bangs", 50, "max", "n_words", 300),
    ("stop words", "n_stop_words", 6, "min", "n_words", 180),
    ("repeated lines", "n_dup_lines", 50, "max", "n_lines", 0),
    ("repeated windows", "n_repeat_words", 20, "max", "n_words", 0),
)

FIGURES = ("n_words", "word_chars", "n_symbols", "n_bangs", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def figures(df: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """Adds ``FIGURES`` (long) to every row.

    ``n_repeat_words``: equal 64-bit hashes of word windows show which texts may
    repeat at all; only for those the windows themselves are sorted and compared,
    so a collision cannot change the figure.
    """
    rest = F.col("n") - window + 1
    at = lambda a, i, k: F.get(F.col(a), i + F.lit(k))
    out = df.select(F.struct(*df.columns).alias("row"), text_or_empty(text).alias("t"))
    out = out.withColumn("words", split_words(F.col("t")))
    out = out.withColumn("n", F.size("words"))
    out = out.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    out = out.withColumn("win", F.when(rest < 2, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice("h", F.lit(1), F.greatest(rest, F.lit(0))),
        lambda h, i: F.xxhash64(h, *[at("h", i, k) for k in range(1, window)]))))
    again = F.size(F.array_distinct("win")) < F.size("win")
    out = out.withColumn("text_win", F.when(again, F.sort_array(F.transform(
        F.slice("words", F.lit(1), F.greatest(rest, F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", w, *[at("words", i, k) for k in range(1, window)]).alias("s"), i.alias("i"))))))
    out = out.withColumn("starts", F.when(F.col("text_win").isNotNull(), F.sort_array(F.transform(F.filter(
        "text_win", lambda p, k: (p["s"] == at("text_win", k, -1)["s"]) | (p["s"] == at("text_win", k, 1)["s"])),
        lambda p: p["i"]))))
    covered = F.aggregate(
        F.transform("starts", lambda p, k: F.least(F.lit(window), F.coalesce(at("starts", k, 1) - p, F.lit(window)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != ""))
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in FIGURES], *[c.alias(k) for k, c in {
        "n_words": F.col("n").cast("long"),
        "word_chars": F.length(F.regexp_replace("t", WS_CLASS + "+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long"),
        "n_bangs": F.length(F.regexp_replace("t", "[^!]+", "")).cast("long"),
        "n_stop_words": F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("starts").isNull(), F.lit(0).cast("long")).otherwise(covered),
    }.items()])


def rule(counted: str, percent: int, kind: str, base: str, allowance: int) -> Column:
    have, bound = F.col(counted) * 100, (F.lit(1) if base == "one" else F.col(base)) * percent
    return have <= bound + allowance if kind == "max" else have + allowance >= bound


def verdict(rules=RULES) -> Column:
    """All rules of the table as one boolean expression."""
    return reduce(lambda a, b: a & b, [rule(*r[1:]) for r in rules], F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """All rows with ``FIGURES``, ``base_failed`` and ``kept``."""
    return figures(df.drop("base_failed", "kept"), text).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules))


def keep_good(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass, with exactly the columns that came in.

    The filter also asks for a row id, a column that is not deterministic: the
    optimizer then leaves it above the projections.  Pushed down, it would repeat
    the splitting of the text for each word.
    """
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("text"))
    judged = judge(packed, "text", rules).select("row", "kept", F.monotonically_increasing_id().alias("id"))
    return judged.where(F.col("kept") & (F.col("id") >= 0)).select("row.*")
