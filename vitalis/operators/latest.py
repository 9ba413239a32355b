"""The row that stands for a key among its versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_version(df: DataFrame, keys: list[str], at: str = "_lake_timestamp", columns: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest timestamp, and of several the greatest in its other columns.

    Aggregated partially before the shuffle, so a hot key costs one row per task. Null timestamps come first. A null
    key is a key like any other. columns: those to keep besides keys and timestamp; all others if not given.
    """
    rest = columns if columns is not None else [c for c in df.columns if c not in (*keys, at)]
    row = F.struct(F.col(f"`{at}`").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    best = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max(row).alias("__row"))
    return best.select(*[F.col(f"`{k}`") for k in keys], F.col("__row.t").alias(at), *[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(rest)])
