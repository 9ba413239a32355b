"""Research tables: pseudonyms, attribute rows, features up to an event, wide tables, re-identification risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pseudonym(key: Column, salt: str) -> Column:
    """One-way pseudonym; the salt is a secret that is never stored with the data."""
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def pivoted(rows: DataFrame, keys: list[str], category: str, value: str, order: str, categories: list) -> DataFrame:
    """One row per key with a column per listed category: the value that comes last in order. Others are ignored."""
    w = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    grouped = rows.where(F.col(category).isin(categories)).groupBy(*keys)
    return grouped.agg(*[F.max(F.when(F.col(category) == c, w))["v"].alias(str(c)) for c in categories])


def event_times(rows: DataFrame, events: DataFrame, key: str, default: str) -> DataFrame:
    """rows with t0: the time of each event of its key (several events, several copies), the default day without one."""
    e = events.select(F.col(key).alias("__key"), F.col("time").alias("__t0"))
    out = rows.join(e, F.col(key) == F.col("__key"), "left")
    return out.withColumn("t0", F.coalesce("__t0", F.lit(default).cast("timestamp_ntz"))).drop("__key", "__t0")


def closest_before(rows: DataFrame, keys: list[str], value: str, act: str = "act_id") -> DataFrame:
    """Per key and t0 the value closest before t0, with how many values there are and the greatest of them."""
    before = rows.where(F.col("time") <= F.col("t0"))
    before = before.withColumn("days", F.extract(F.lit("DAY"), F.col("t0") - F.col("time")).cast("long"))
    w = Window.partitionBy(*keys, "t0")
    ranked = before.select(
        "*", F.rank().over(w.orderBy(F.col("days").asc_nulls_last(), F.col(act).asc_nulls_last())).alias("near"), F.count(F.lit(1)).over(w).alias("n"), F.max(value).over(w).alias("most")
    )
    return ranked.where("near = 1").drop("near")


def risk_classes(rows: DataFrame, quasi: list[str]) -> DataFrame:
    """Classes of equal quasi-identifiers (nulls are equal) with their size fk and prosecutor risk 1/fk."""
    return rows.groupBy(*quasi).agg(F.count(F.lit(1)).alias("fk")).withColumn("risk", 1.0 / F.col("fk"))


def share_at_risk(rows: DataFrame, quasi: list[str], threshold: float) -> DataFrame:
    """(num, denom, perc): rows in classes whose risk is above the threshold, of all rows, as a rounded percentage."""
    classes = risk_classes(rows, quasi)
    out = classes.agg(F.coalesce(F.sum(F.when(F.col("risk") > threshold, F.col("fk"))), F.lit(0)).alias("num"), F.coalesce(F.sum("fk"), F.lit(0)).alias("denom"))
    return out.withColumn("perc", F.bround(F.try_divide(F.col("num").cast("double"), F.col("denom").cast("double")) * 100, 0))
