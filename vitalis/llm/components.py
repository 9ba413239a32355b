"""One group id for all records linked directly or indirectly: alternating large-star and small-star edge rewrites.

Each rewrite is a partial aggregation (the smallest neighbour of a vertex) and a join of the edges with it; no vertex's
neighbours are ever gathered in one place, and hot vertices are split by the skew handling of the join. After each pair
of rewrites, vertices that have a single edge left, to a smaller vertex, are set aside with it: no path leads through
them, so the rest stays linked as it was and keeps its minimum. A finished star thus leaves the edges at once, and later
rounds only see what isn't finished; they end when no edge is left. A vertex set aside has the group of the vertex its
edge led to. Rounds are cut by reliable checkpoints.

Defined results: a link with a null end, or of a record to itself, links nothing; records without links are groups of
their own; repeated links count once; no links give each record its own id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.session import cut, discard

#: Rounds whose large star is stored before it is read several times.
ROUNDS_STORED = 2
#: Vertices set aside in a round, up to which they are broadcast (16 bytes each); more are joined by a shuffle.
FEW = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex sends its larger neighbours to the smallest vertex around it; edges may repeat."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex sends its smaller neighbours, and itself, to the smallest of them; a is the larger end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> DataFrame:
    """(a, b, settled): whether the edge is the only one of its larger end."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("n")).unionByName(edges.select(F.col("b").alias("v"), F.lit(2).alias("n")))
    inner = ends.groupBy("v").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("v").alias("a"), F.lit(False).alias("settled"))
    return edges.join(inner, "a", "left").select("a", "b", F.coalesce("settled", F.lit(True)).alias("settled"))


def components(links: DataFrame, records: DataFrame | None = None, most_rounds: int = 200) -> DataFrame:
    """(record_id, group_id) from links (a, b); records (record_id) adds those that may have no link."""
    ends = links.select("a", "b").where("a is not null and b is not null")
    named = ends.select(F.col("a").alias("record_id")).unionByName(ends.select(F.col("b").alias("record_id")))
    if records is not None:
        named = named.unionByName(records.select("record_id").where("record_id is not null"))
    left = ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tied: list[DataFrame] = []  # (v, w) of each round: vertices set aside, and what they were tied to
    again = True
    while again:
        if len(tied) == most_rounds:
            raise RuntimeError(f"edges are left after {most_rounds} rounds")
        large = _large_star(left)
        # what the first rounds move is much; in the later ones a job costs more than moving the little that is left again
        large = cut(large) if len(tied) < ROUNDS_STORED else large
        edges = cut(_settled(_small_star(large)))
        if len(tied) < ROUNDS_STORED:
            discard(large)
        left = edges.where("not settled").select("a", "b")
        aside = edges.where("settled").select(F.col("a").alias("v"), F.col("b").alias("w"))
        n = edges.agg(F.count_if(~F.col("settled")), F.count_if("settled")).head()
        tied.append(F.broadcast(aside) if n[1] <= FEW else aside)
        again = n[0] > 0
    # what a vertex was tied to may itself have been set aside, in a later round
    groups = reduce(DataFrame.unionByName, tied).withColumnsRenamed({"v": "record_id", "w": "group_id"})
    for aside in tied[1:]:
        groups = groups.join(aside, F.col("group_id") == F.col("v"), "left").select("record_id", F.coalesce("w", "group_id").alias("group_id"))
    return named.distinct().join(groups, "record_id", "left").select("record_id", F.coalesce("group_id", "record_id").alias("group_id"))


def instruction_groups(instructions: DataFrame) -> DataFrame:
    """(record_id, group_id) of all records that match instructions name; ids are positive, other values name no record."""
    named = F.array_distinct(F.filter(F.array("_id", "_id_cluster", "dedup_new_id"), lambda x: x > 0))
    rows = instructions.select(named.alias("r")).where("size(r) > 0").distinct()
    # a row of k records gives k-1 links; a row of one gives that record with itself, which links nothing
    pairs = rows.select(F.col("r")[0].alias("a"), F.explode(F.when(F.size("r") > 1, F.slice("r", 2, 3)).otherwise(F.col("r"))).alias("b"))
    return components(pairs)
