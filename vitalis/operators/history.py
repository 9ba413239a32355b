"""Ranked histories, previous-value joins and averages within intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalis.functions.semantics import newest_first, oldest_first


def ranked(df: DataFrame, keys: list[str], time: str = "time", act: str = "act_id", rank: str = "rocky", oldest: str | None = None) -> DataFrame:
    """Recency rank within keys; rows of one act tie, and leave gaps. With oldest, also the rank from the other end."""
    w = Window.partitionBy(*keys)
    out = df.withColumn(rank, F.rank().over(w.orderBy(*newest_first(time, act))).cast("long"))
    if oldest:
        out = out.withColumn(oldest, F.rank().over(w.orderBy(*oldest_first(time, act))).cast("long"))
    return out


def latest_of(df: DataFrame, keys: list[str], time: str = "time", act: str = "act_id") -> DataFrame:
    """Rows of rank 1; the rank limit is pushed below the shuffle, so each task sends only its own best rows."""
    return ranked(df, keys, time, act).where("rocky = 1").drop("rocky")


def before_each(df: DataFrame, keys: list[str], how: str = "inner", rank: str = "rocky") -> DataFrame:
    """Each row with the rows one rank older in the same keys, whose columns get the prefix prev_."""
    older = df.select(*[F.col(c).alias(f"prev_{c}") for c in df.columns])
    on = [F.col(k) == F.col(f"prev_{k}") for k in keys] + [F.col(f"prev_{rank}") == F.col(rank) + 1]
    return df.join(older, on, how)


def average_between(spans: DataFrame, values: DataFrame, key: str, ids: list[str], low: Column, high: Column, name: str) -> DataFrame:
    """(ids..., name): of each span the mean of the values of its key in [low, high], rounded; spans without one are left out."""
    v = values.select(F.col(key).alias("__key"), F.col("time").alias("__at"), F.col("pq_value").alias("__v"))
    met = spans.join(v, (F.col(key) == F.col("__key")) & (F.col("__at") >= low) & (F.col("__at") <= high))
    return met.groupBy(*ids).agg(F.round(F.sum("__v") / F.count("__v"), 2).cast("double").alias(name))


def periods(spark, as_of: str, count: int, months: int) -> DataFrame:
    """(period, from_date, to_date): consecutive periods back from as_of; both ends belong to a period."""
    back = lambda n: F.expr(f"cast(add_months(date'{as_of}', cast({n} as int)) as timestamp_ntz)")
    return spark.range(count).select(F.col("id").alias("period"), back(f"-{months} * (id + 1)").alias("from_date"), back(f"-{months} * id").alias("to_date"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], decimals: int) -> DataFrame:
    """(keys..., a column per share): exact percentiles, interpolated between neighbouring values; nulls don't count.

    Equal values are counted before the shuffle. The distinct values of a group are sorted and streamed with a running
    count, so no task holds a group; from each only the values at the two places around a share are kept.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    total = counted.groupBy(*keys).agg(F.sum("__n").alias("__total")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__total")
    upto = counted.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    placed = upto.join(total, same)
    columns = []
    for name, share in shares.items():
        at = (F.col("__total") - 1) * share
        of = lambda place: F.max(F.when((F.col("__upto") - F.col("__n") <= place) & (place < F.col("__upto")), F.col(value)))
        low, high, rest = of(F.floor(at)), of(F.ceil(at)), F.max(at - F.floor(at))
        columns.append(F.round(low + (high - low) * rest, decimals).alias(name))
    return placed.groupBy(*keys).agg(*columns)
