"""Closures over edges, by frontier joins; each round is cut by a reliable checkpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalis.functions.semantics import subsumes
from vitalis.session import cut


def closure(edges: DataFrame, starts: DataFrame, source: str, target: str, most_rounds: int = 1000) -> DataFrame:
    """(start, reached): everything reachable from each start, itself included. Cycles end, and each pair comes once.

    Null ends of edges lead nowhere. Only the pairs found last are joined again.
    """
    e = edges.select(F.col(source).alias("__from"), F.col(target).alias("__to")).where("__from is not null and __to is not null").distinct()
    frontier = cut(starts.select(F.col(starts.columns[0]).alias("start"), F.col(starts.columns[0]).alias("reached")).where("start is not null").distinct())
    parts, seen = [frontier], frontier
    for _ in range(most_rounds):
        step = frontier.join(e, F.col("reached") == F.col("__from")).select("start", F.col("__to").alias("reached")).distinct()
        frontier = cut(step.join(seen, ["start", "reached"], "left_anti"))
        if frontier.isEmpty():
            return seen
        parts.append(frontier)
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
    raise RuntimeError(f"not closed after {most_rounds} rounds")


#: Levels of conduction after which pairs that were there before are taken out.
LEVELS_UNCHECKED = 4


def conduct_context(participations: DataFrame, relations: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """New participations that context conduction gives the acts below, with the original's id in origin.

    participations: _id, act, role, context_control_code, origin, and what else is conducted with them (type, function,
    time, negation and the like: every other column); relations: source, target, conduction. Seeds are participations
    with a control code that are original or propagating, and whose original is there; they pass over conducting
    relations, beyond the first only if propagating, never to their own act nor to the act of their original. An act that
    has the same participation already gets none; a null role is the same as none. Each pair of seed and act comes once,
    so cycles end; only pairs are carried from level to level, and the other columns are joined at the end.
    """
    code = F.col("context_control_code")
    own = [c for c in participations.columns if c not in ("_id", "act", "origin")]
    seed = participations.where(code.isNotNull() & (F.col("origin").isNull() | subsumes("propagating", code)))
    of = participations.select(F.col("_id").alias("__of"), F.col("act").alias("__first"))
    seed = cut(seed.withColumn("__origin", F.coalesce("origin", "_id")).join(of, F.col("__origin") == F.col("__of")))
    edges = relations.where("conduction").select(F.col("source").alias("__from"), F.col("target").alias("__to")).distinct()
    start = seed.select("_id", subsumes("propagating", code).alias("__on"), "__first", "act")
    frontier, levels = start, [start.select("_id", "act")]
    for level in range(1, most_rounds + 1):
        some = frontier if level == 1 else frontier.where("__on")
        step = some.join(edges, F.col("act") == F.col("__from")).where(F.col("__to") != F.col("__first"))
        step = step.select("_id", "__on", "__first", F.col("__to").alias("act")).distinct()
        if level % LEVELS_UNCHECKED == 0:  # repeated pairs do no harm, but on a cycle they never end
            step = step.join(reduce(DataFrame.unionByName, levels), ["_id", "act"], "left_anti")
        frontier = cut(step)
        if frontier.isEmpty():
            break
        levels.append(frontier.select("_id", "act"))
    else:
        raise RuntimeError(f"not conducted after {most_rounds} levels")
    reached = reduce(DataFrame.unionByName, levels[1:], levels[0].limit(0)).withColumnRenamed("act", "__act")
    found = reached.distinct().join(seed.drop("origin"), "_id").where("act <> __act").select(F.col("__act").alias("act"), *own, F.col("__origin").alias("origin")).distinct()
    there = participations.select(*[F.col(c).alias(f"__{c}") for c in ("act", *own)])
    same = (F.col("act") == F.col("__act")) & (F.col("role") == F.col("__role"))
    for c in own:
        if c != "role":
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return found.join(there, same, "left_anti")


def components_by_minimum(edges: DataFrame, nodes: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component): label propagation of the smallest id, with each label replaced by its own label's label."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both)
    labels = cut(nodes.select(F.col(nodes.columns[0]).alias("node"), F.col(nodes.columns[0]).alias("component")).distinct())
    for _ in range(most_rounds):
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(around, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", "m").alias("next"))
        jump = step.select(F.col("node").alias("__n"), F.col("next").alias("__j"))
        after = step.join(jump, F.col("next") == F.col("__n"), "left").select("node", "component", F.least("next", "__j").alias("next"))
        after = cut(after)
        changed = after.where("next <> component").limit(1).count()
        labels = after.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def row_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Consecutive row ids in an order, without a global sort in one task: ranks in range partitions plus offsets."""
    parted = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    offset = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    offsets = sizes.select("__part", "__first", offset.alias("__before"))
    return parted.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__part", "__at", "__first", "__before")
