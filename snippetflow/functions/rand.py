"""Seeded, partition-independent uniforms.

``uniform(seed, *keys)`` = first 13 hex digits of ``md5("seed:key1:key2...")``
divided by 16^13.  It depends only on the row's keys, never on partitioning
or task order, so a recomputed task yields the same value and DuckDB can
reproduce it exactly (``('0x'||substr(md5(s),1,13))::BIGINT::DOUBLE / 16^13``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(16 ** 13)


def _as_col(k) -> Column:
    return F.col(k) if isinstance(k, str) else k


def seed_key(seed, *keys) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[_as_col(k).cast("string") for k in keys])


def uniform(seed, *keys) -> Column:
    """Double in [0, 1) derived from md5 of the seed and the key columns."""
    h = F.substring(F.md5(seed_key(seed, *keys)), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(SCALE)


def sql_uniform(seed, *key_sql: str) -> str:
    """The same value as DuckDB SQL text (for oracle queries)."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return (f"CAST(CAST(('0x' || substr(md5(concat_ws(':', {parts})), 1, 13)) AS BIGINT) AS DOUBLE)"
            f" / 4503599627370496.0::DOUBLE")
