"""Attribute-value rows into wide tables, by characteristic sets.

Entities are grouped by the exact set of attributes they have (their signature). Each signature gets a dense table with
just its attributes; the tables are put together by name, and attributes that a table lacks become nulls. The maps of
all entities are written once, partitioned by signature, so each dense table reads only its own files; a signature that
a third of the entities have is spread over as many files as its size needs. Where there are more signatures than a plan
should have tables, neighbouring ones in their order share a dense table with the columns of them all.

Defined results: for an attribute the latest row decides, also when its value is null (the attribute then is in the
signature and null in the table); of several rows at the same time the one with the greatest value. Rows with a null
entity column belong to no entity. Rows with a null attribute only say that the entity is there. Clashing names: the
attributes' columns must differ from the entity's; otherwise an error is raised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.session import bounded_rows, scratch

#: Attributes of all entities together; each becomes a column.
MOST_ATTRIBUTES = 2_000
#: Different signatures, at most; the driver sees each once.
MOST_SIGNATURES = 100_000
#: Dense tables of a plan.
MOST_TABLES = 256


def entity_maps(df: DataFrame, entity: list[str], key: str, value: str, at: str) -> DataFrame:
    """(entity..., attributes map<key, value>): the latest value of each attribute of each entity."""
    for e in entity:
        df = df.where(F.col(e).isNotNull())
    newest = F.max(F.struct(F.col(at).alias("t"), F.col(value).alias("v"))).alias("__newest")
    each = df.groupBy(*entity, key).agg(newest)
    pair = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("k"), F.col("__newest.v").alias("v")))
    return each.groupBy(*entity).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("attributes"))


def wide_table(df: DataFrame, entity: list[str], key: str, value: str, at: str, attributes: list[str] | None = None) -> DataFrame:
    """One row per entity with a column per attribute; only the given attributes, or all there are."""
    spark = df.sparkSession
    if attributes is not None:
        df = df.withColumn(key, F.when(F.col(key).isin(attributes), F.col(key)))
    maps = entity_maps(df, entity, key, value, at)
    path = scratch(spark, "wide")
    signed = maps.withColumn("__signature", F.md5(F.concat_ws("\u0001", F.map_keys("attributes"))))
    signed.hint("rebalance", "__signature").write.partitionBy("__signature").parquet(path)
    stored = spark.read.schema(signed.schema).parquet(path)  # also where there is nothing to read a schema from
    sets = bounded_rows(stored.groupBy("__signature").agg(F.first(F.map_keys("attributes")).alias("keys")), MOST_SIGNATURES, "sets of attributes")
    every = attributes or sorted({k for r in sets for k in r["keys"]})
    if clash := set(every) & set(entity):
        raise ValueError(f"attributes are named like the entity's columns: {sorted(clash)}")
    if len(every) > MOST_ATTRIBUTES:
        raise ValueError(f"more than {MOST_ATTRIBUTES} attributes")
    sets.sort(key=lambda r: (r["keys"], r["__signature"]))
    together = max(1, -(-len(sets) // MOST_TABLES))

    def dense(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.select(*entity, *[F.col("attributes")[k].alias(k) for k in keys])

    tables = []
    for at in range(0, len(sets), together):
        some = sets[at : at + together]
        of = F.col("__signature").isin([r["__signature"] for r in some])
        tables.append(dense(stored.where(of), sorted({k for r in some for k in r["keys"]})))
    empty = dense(stored.limit(0), every)
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables, empty)
    return whole.select(*entity, *every)
