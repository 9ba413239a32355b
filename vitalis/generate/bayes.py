"""Synthetic records from Bayesian networks, as columns over spark.range: each variable is one expression of its parents.

Draws are hashes of a record's key, the seed and the variable, so a record has the same values on any partitioning, in
any order and in every run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(keys: list[Column], seed: int, name: str) -> Column:
    """A number in (0, 1) that belongs to a key, a seed and a variable."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)), F.lit(name))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def normal(keys: list[Column], seed: int, name: str) -> Column:
    """A standard normal number, by the method of Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(keys, seed, f"{name}#1"))) * F.cos(2 * math.pi * uniform(keys, seed, f"{name}#2"))


@dataclass
class Discrete:
    """A table of probabilities: rows of (values of the parents..., value, probability)."""

    name: str
    rows: list[tuple]
    parents: list[str] = field(default_factory=list)

    def expression(self) -> Column:
        """The value at which the uniform number of column __u falls, among the rows that fit the parents; null if none fits."""
        n = len(self.parents)
        by: dict[tuple, list[tuple]] = {}
        for r in self.rows:
            by.setdefault(tuple(r[:n]), []).append((r[n], float(r[n + 1])))
        out = F.lit(None)
        for given, options in by.items():
            total, upto, pick = sum(p for _, p in options), 0.0, None
            for value, p in options:
                if p <= 0:
                    continue
                upto += p / total
                pick = F.when(F.col("__u") < upto, F.lit(value)) if pick is None else pick.when(F.col("__u") < upto, F.lit(value))
            if pick is None:
                continue
            pick = pick.otherwise(F.lit([v for v, p in options if p > 0][-1]))
            fits = F.lit(True)
            for name, v in zip(self.parents, given):
                fits = fits & (F.col(name) == F.lit(v))
            out = F.when(fits, pick).otherwise(out)
        return out


@dataclass
class Numeric:
    """intercept + sum of coefficient times parent + sd times a standard normal number."""

    name: str
    intercept: float
    sd: float
    coefficients: dict[str, float] = field(default_factory=dict)

    @property
    def parents(self) -> list[str]:
        return list(self.coefficients)

    def expression(self) -> Column:
        """The mean, and column __z times the standard deviation."""
        mean = F.lit(self.intercept)
        for name, c in self.coefficients.items():
            mean = mean + F.col(name).cast("double") * c
        return mean + F.col("__z") * self.sd


def read_discrete(name: str, spec: dict) -> Discrete:
    """From lists: Var1 or name and the parents' values, and Freq."""
    own = "Var1" if "Var1" in spec else name
    parents = [k for k in spec if k not in (own, "Freq")]
    return Discrete(name, list(zip(*(spec[p] for p in parents), spec[own], spec["Freq"])), parents)


def read_numeric(name: str, spec: dict) -> Numeric:
    return Numeric(name, spec.get("(Intercept)", 0.0), spec.get("sd", 0.0), {k: v for k, v in spec.items() if k not in ("(Intercept)", "sd")})


def clean_code(name: str) -> str:
    for prefix in ("pq_", "cd_", "nr_of_"):
        name = name.removeprefix(prefix)
    return name.replace(".", "-")


def ordered(variables: list) -> list:
    """Parents before children; a cycle is an error."""
    left, out, known = list(variables), [], set()
    names = {v.name for v in variables}
    while left:
        ready = [v for v in left if all(p in known or p not in names for p in v.parents)]
        if not ready:
            raise ValueError("the network has a cycle")
        out += ready
        known |= {v.name for v in ready}
        left = [v for v in left if v not in ready]
    return out


def sample(base: DataFrame, variables: list, seed: int = 0, evidence: dict | None = None, key: list[str] | None = None) -> DataFrame:
    """base with a column per variable; evidence fixes values of some. Columns of base may be parents; key names those
    that tell its records apart, all if none are given."""
    out, keys = base, [F.col(c) for c in key or base.columns]
    for v in ordered(variables):
        if evidence and v.name in evidence:
            out = out.withColumn(v.name, F.lit(evidence[v.name]))
        elif isinstance(v, Discrete):
            out = out.withColumn("__u", uniform(keys, seed, v.name)).withColumn(v.name, v.expression()).drop("__u")
        else:
            out = out.withColumn("__z", normal(keys, seed, v.name)).withColumn(v.name, v.expression()).drop("__z")
    return out


def sum_of_gaussians(keys: list[Column], means: list[float], sigmas: list[float], weights: list[float], seed: int) -> Column:
    """A weighted sum of normal numbers, cut to whole ones from 0."""
    total = F.lit(0.0)
    for k, (m, s, w) in enumerate(zip(means, sigmas, weights)):
        total = total + w * (normal(keys, seed, f"sum {k}") * s + m)
    return F.greatest(F.lit(0), F.floor(total)).cast("long")


def organizations(spark: SparkSession, care_groups: int, low: int = 10, high: int = 60, practices: int = 5, seed: int = 0) -> DataFrame:
    """(_id, parent, level): care groups, the organisations below each, and the practices below those."""
    top = spark.range(1, care_groups + 1).select(F.col("id").alias("_id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level"))
    count = lambda a, b, s: (F.lit(a) + F.floor(uniform([F.col("_id")], s, "parts") * (b - a))).cast("int")
    mid = top.select(F.col("_id").alias("parent"), F.explode(F.sequence(F.lit(1), count(low, high, seed) + 1)).alias("k"))
    mid = mid.select((F.col("parent") * 1_000 + F.col("k")).alias("_id"), "parent", F.lit(1).alias("level"))
    leaf = mid.select(F.col("_id").alias("parent"), F.explode(F.sequence(F.lit(1), count(0, practices, seed + 1) + 1)).alias("k"))
    leaf = leaf.select((F.col("parent") * 1_000 + F.col("k")).alias("_id"), "parent", F.lit(2).alias("level"))
    return top.unionByName(mid).unionByName(leaf)


def masked(df: DataFrame, columns: list[str], missing: float, key: str, seed: int = 0) -> DataFrame:
    """Values left out at random; a row never loses all of them."""
    drop = {c: uniform([F.col(key)], seed, c) < missing for c in columns}
    kept = {c: F.when(~d, F.col(c)) for c, d in drop.items()}
    one = F.floor(uniform([F.col(key)], seed, "kept") * len(columns)).cast("int")
    marked = df.select("*", *[kept[c].alias(f"__{c}") for c in columns])
    none = F.coalesce(*[F.when(F.col(f"__{c}").isNotNull(), 1) for c in columns]).isNull()
    out = marked.select(*[c for c in df.columns if c not in columns], *[F.when(none & (one == k), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for k, c in enumerate(columns)])
    return out.select(*df.columns)


def visits(patients: DataFrame, key: str, per_age: dict[int, int], birth: str, until: str, seed: int = 0) -> DataFrame:
    """Examination dates: for each year of age so many, at random days of that year, before a last day."""
    table = F.create_map(*[F.lit(x) for k, n in per_age.items() for x in (k, n)])
    rows = patients.select("*", F.explode(F.map_keys(table)).alias("age")).withColumn("n", F.element_at(table, F.col("age")))
    rows = rows.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    day = F.date_add(F.add_months(F.col(birth), F.col("age") * 12), F.floor(uniform([F.col(key), F.col("age"), F.col("k")], seed, "day") * 365).cast("int"))
    return rows.withColumn("exam_date", day).where(F.col("exam_date") <= F.lit(until).cast("date")).drop("n", "k")
