"""Clinical predicates and arithmetic whose meaning differs between engines, stated once."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_first(time: str, key: str) -> list[Column]:
    """Order of recency ranks: time descending with nulls first, then id descending."""
    return [F.col(time).desc_nulls_first(), F.col(key).desc_nulls_first()]


def oldest_first(time: str, key: str) -> list[Column]:
    return [F.col(time).asc_nulls_last(), F.col(key).asc_nulls_last()]


def truncated_percent(part: Column, whole: Column) -> Column:
    """part / whole as a percentage cut after two decimals; exact, as it is done in integers. Null for an empty whole."""
    p, w = part.cast("long"), F.nullif(whole.cast("long"), F.lit(0))
    return ((p * 10000 - F.pmod(p * 10000, w)) / w).cast("long").cast("double") / 100


def integer_ratio(part: Column, whole: Column) -> Column:
    """The quotient of two whole numbers without its fraction; null for 0 below."""
    p, w = part.cast("long"), F.nullif(whole.cast("long"), F.lit(0))
    return ((p - F.pmod(p, w)) / w).cast("long")


def within(time: Column, low: Column, high: Column) -> Column:
    """Whether an interval holds a point; an open end holds everything after the start."""
    return (low <= time) & (high.isNull() | (time <= high))


def all_listed(ids: Column, listed: list[dict]) -> Column:
    """Whether every element of an array of structs is among the listed ones, where a missing member asks nothing.

    Null arrays are not, empty ones are.
    """

    def one(x: Column) -> Column:
        hit = F.lit(False)
        for item in listed:
            same = F.lit(True)
            for name in ("root", "extension", "dataType"):
                same = same & (x[name].isNull() | (F.lit(item[name]) == x[name]) if name in item else x[name].isNull())
            hit = hit | same
        return hit

    return ids.isNotNull() & F.forall(ids, one)


def with_root(ids: Column, root: str) -> Column:
    """The extensions of the identifiers with a root."""
    return F.transform(F.filter(ids, lambda x: x["root"] == root), lambda x: x["extension"])


#: fixed values: context control codes below each concept, itself included
SUBSUMED = {"propagating": ("AP", "OP"), "non_propagating": ("AN", "ON"), "additive": ("AN", "AP"), "overriding": ("ON", "OP")}


def subsumes(concept: str, code: Column) -> Column:
    return code.isin(*SUBSUMED[concept])


def contained(inner: Column, outer: Column) -> Column:
    """Whether all elements of one array are in another."""
    return F.size(F.array_except(inner, outer)) == 0


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """A repeatable sample by key: the same rows on every engine, partitioning and run."""
    word = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("long")
    return df.where(word < int(Decimal(str(fraction)) * (1 << 32)))


def oid_of(urn: Column) -> Column:
    return F.regexp_replace(urn, "^urn:oid:", "")


def compact_time(text: Column) -> Column:
    """A date-time without its punctuation."""
    return F.translate(text, "-T:", "")


def telecom_use(use: Column, system: Column) -> Column:
    return (
        F.when((use == "home") & (system == "phone"), "HP").when(use == "home", "H").when(use == "work", "WP")
        .when(use == "mobile", "MC").when(use == "old", "OLD")
    )


def interval_bounds(text: Column) -> Column:
    """struct<low, high> of texts such as <5, >5, 1-2 and 1,5."""
    clean = F.regexp_replace(F.trim(text), ",", ".")
    number = r"(\d+(?:\.\d+)?)"
    value = lambda pattern, k: F.nullif(F.regexp_extract(clean, pattern, k), F.lit("")).try_cast("decimal(18,6)")
    both, below, above, one = rf"^{number}\s*-\s*{number}$", rf"^<=?\s*{number}$", rf"^>=?\s*{number}$", rf"^{number}$"
    return F.struct(F.coalesce(value(both, 1), value(above, 1), value(one, 1)).alias("low"), F.coalesce(value(both, 2), value(below, 1), value(one, 1)).alias("high"))
