"""Entity resolution of a batch against the clusters so far: exact closure over shared identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.operators.graph import components_by_minimum
from vitalis.session import cut


def exploded(records: DataFrame) -> DataFrame:
    """(_id, root, extension) of all identifiers; equal extensions under different roots differ."""
    return records.select("_id", F.explode("id").alias("x")).select("_id", "x.root", "x.extension").where("extension is not null").distinct()


def matched(new: DataFrame, known: DataFrame, match: str = "hash") -> DataFrame:
    """(_id, cluster, twin): the accepted record each new one joins: shared identifier, and the same hash unless match is 'id'.

    Of several the one with the smallest cluster, then the smallest id.
    """
    old = exploded(known).join(known.select("_id", "_id_cluster", "_record_hash"), "_id")
    keys = ["root", "extension", *(["_record_hash"] if match == "hash" else [])]
    # an identifier that very many accepted records share is one row here, so the join gives no pairs of records
    old = old.groupBy(*keys).agg(F.min(F.struct(F.col("_id_cluster").alias("cluster"), F.col("_id").alias("twin"))).alias("least")).select(*keys, "least.cluster", "least.twin")
    met = exploded(new).join(new.select("_id", "_record_hash"), "_id").join(old, keys)
    best = met.groupBy("_id").agg(F.min(F.struct("cluster", "twin")).alias("b"))
    return best.select("_id", "b.cluster", "b.twin")


def clustered(new: DataFrame) -> DataFrame:
    """(_id, cluster): records linked directly or indirectly by identifiers; the master is the heaviest, then smallest id.

    An identifier links its records to the smallest among them, so its links are as many as its records.
    """
    each = exploded(new)
    least = each.groupBy("root", "extension").agg(F.min("_id").alias("least"))
    links = each.join(least, ["root", "extension"]).where("_id <> least").select(F.col("_id").alias("a"), F.col("least").alias("b"))
    found = components_by_minimum(links, new.select("_id"))
    heavy = new.select(F.col("_id").alias("node"), F.struct((-F.coalesce("_record_weight", F.lit(0))).alias("w"), F.col("_id").alias("i")).alias("o"))
    masters = found.join(heavy, "node").groupBy("component").agg(F.min("o").alias("m"))
    return found.join(masters, "component").select(F.col("node").alias("_id"), F.col("m.i").alias("cluster"))


def resolve(new: DataFrame, known: DataFrame | None = None, match: str = "hash") -> DataFrame:
    """(_id, _id_cluster, dedup_new_id): instructions for a batch.

    Records that match accepted ones take their cluster and are replaced by the match. The others are clustered, and in
    a cluster equal hashes are replaced by the heaviest of them, then the smallest id. A master or keeper is never replaced.
    """
    new = cut(new)
    met = None
    rest = new
    if known is not None:
        met = cut(matched(new, known, match))
        rest = new.join(met.select("_id"), "_id", "left_anti")
    groups = clustered(rest)
    placed = rest.join(groups, "_id").select("_id", "cluster", F.col("_record_hash").alias("hash"), F.coalesce("_record_weight", F.lit(0)).alias("weight"))
    first = F.min_by("_id", F.struct(F.col("_id") != F.col("cluster"), -F.col("weight"), "_id"))
    keepers = placed.groupBy("cluster", "hash").agg(first.alias("keeper")).withColumnsRenamed({"cluster": "__cluster", "hash": "__hash"})
    keep = placed.join(keepers, (F.col("cluster") == F.col("__cluster")) & F.col("hash").eqNullSafe(F.col("__hash"))).select("_id", "cluster", "keeper")
    out = keep.select("_id", F.col("cluster").alias("_id_cluster"), F.when(F.col("keeper") != F.col("_id"), F.col("keeper")).alias("dedup_new_id"))
    if met is not None:
        out = out.unionByName(met.select("_id", F.col("cluster").alias("_id_cluster"), F.col("twin").alias("dedup_new_id")))
    return out


def applied(records: DataFrame, instructions: DataFrame) -> DataFrame:
    """The records that stay, with their cluster."""
    gone = instructions.where("dedup_new_id is not null").select("_id")
    i = instructions.select("_id", F.col("_id_cluster").alias("__cluster"))
    kept = records.join(gone, "_id", "left_anti").join(i, "_id", "left")
    old = F.col("_id_cluster") if "_id_cluster" in records.columns else F.lit(None).cast("long")
    return kept.withColumn("_id_cluster", F.coalesce("__cluster", old)).drop("__cluster")


def rewritten(df: DataFrame, fk: str, instructions: DataFrame) -> DataFrame:
    """A foreign key becomes the cluster; <fk>_original the record that stands for the one it pointed to."""
    i = instructions.select(F.col("_id").alias("__id"), F.col("_id_cluster").alias("__cluster"), F.col("dedup_new_id").alias("__kept"))
    out = df.join(i, F.col(fk) == F.col("__id"), "left")
    original = F.coalesce(F.col("__kept"), F.col(f"{fk}_original") if f"{fk}_original" in df.columns else F.col(fk))
    return out.withColumn(f"{fk}_original", original).withColumn(fk, F.coalesce("__cluster", fk)).drop("__id", "__cluster", "__kept")


def broken_rules(instructions: DataFrame) -> DataFrame:
    """Instructions that replace a master, or by a record that is itself replaced; empty if all is well."""
    gone = instructions.where("dedup_new_id is not null")
    masters = gone.join(instructions.select(F.col("_id_cluster").alias("_id")).distinct(), "_id", "left_semi")
    chained = gone.join(gone.select(F.col("_id").alias("dedup_new_id")), "dedup_new_id", "left_semi").select(*gone.columns)
    return masters.select(*gone.columns).unionByName(chained).distinct()
