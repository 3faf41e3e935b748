"""Keyed, partition-independent randomness.

A row's random draw is a pure function of (key, seed, stream), so results
do not depend on partitioning, task order or retries — unlike ``rand(seed)``.
The same expression is written in the SQL oracle, so samples, splits, folds
and label noise can be checked exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO32 = 4294967296.0


def keyed_hex(key: Column, seed: int, stream: str | None = None) -> Column:
    tag = f":{seed}" if stream is None else f":{seed}:{stream}"
    return F.md5(F.concat(key.cast("string"), F.lit(tag)))


def keyed_uniform(key: Column, seed: int, stream: str | None = None) -> Column:
    """Uniform in [0, 1) from the first 32 bits of md5(key:seed[:stream])."""
    h = F.substring(keyed_hex(key, seed, stream), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(_TWO32)


def keyed_normal(key: Column, seed: int, std: float = 1.0) -> Column:
    """N(0, std) by Box–Muller over two keyed uniforms (shifted off zero)."""
    u1 = keyed_uniform(key, seed, "n1") + F.lit(2.0 ** -33)
    u2 = keyed_uniform(key, seed, "n2")
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return z * F.lit(float(std))


def sql_keyed_uniform(key_sql: str, seed: int, stream: str | None = None) -> str:
    """The same draw in DuckDB SQL (used by the oracle strings)."""
    tag = f":{seed}" if stream is None else f":{seed}:{stream}"
    return (f"(CAST(('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || '{tag}'), 1, 8))"
            f"::BIGINT AS DOUBLE) / 4294967296.0)")


def sql_keyed_normal(key_sql: str, seed: int, std: float = 1.0) -> str:
    u1 = f"({sql_keyed_uniform(key_sql, seed, 'n1')} + {2.0 ** -33!r})"
    u2 = sql_keyed_uniform(key_sql, seed, "n2")
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}) * {float(std)!r})"
