"""Preprocessing of a staged batch: denormalised columns, weights and hashes, deduplication, original ids, id ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def denormalised(acts: DataFrame) -> DataFrame:
    """Typed columns of nested ones: code, identifier extensions, the parts of a quantity, parts of the time."""
    out = acts
    have = set(acts.columns)
    if "code" in have and acts.schema["code"].dataType.typeName() == "struct":
        out = out.withColumns({"_code_code": F.col("code.code"), "_code_codesystem": F.col("code.codeSystem")})
    if "id" in have:
        out = out.withColumn("_id_extension", F.transform("id", lambda x: x["extension"]))
    if "value_pq" in have:
        out = out.withColumns({"_value_pq_value": F.col("value_pq.value"), "_value_pq_unit": F.col("value_pq.unit")})
    if "effective_time" in have:
        low, high = F.col("effective_time.low"), F.col("effective_time.high")
        out = out.withColumns({"_effective_time_low": low, "_effective_time_high": high})
        out = out.withColumns({"_effective_time_low_year": F.year(low), "_effective_time_low_month": F.month(low), "_effective_time_low_day": F.dayofmonth(low)})
    return out


def weighted(df: DataFrame, update: Column, id_col: str, name_col: str, links: list[str], others: list[str]) -> DataFrame:
    """Adds _record_weight: 2000 for updates, 1000 with ids, 100 with a name and per linked entity, 1 per other value."""
    has = lambda c: F.col(c).isNotNull().cast("int")
    ids = (F.size(F.coalesce(F.col(id_col), F.array().cast(df.schema[id_col].dataType))) > 0).cast("int")
    weight = 2000 * F.coalesce(update, F.lit(False)).cast("int") + 1000 * ids + 100 * has(name_col)
    for c in links:
        weight = weight + 100 * has(c)
    for c in others:
        weight = weight + has(c)
    return df.withColumn("_record_weight", weight)


#: fixed values: what counts for the weight of a kind of record besides its identifiers and name (1 each), and what links it (100 each)
_OF_ROLES = "nullFlavor realmCode typeId templateId classCode code negationInd addr telecom statusCode effectiveTime certificateText confidentialityCode quantity priorityNumber positionNumber".split()
WEIGHED = {
    "Organization": ([], "nullFlavor realmCode typeId templateId classCode determinerCode code quantity desc statusCode existenceTime telecom riskCode handlingCode addr standardIndustryClassCode".split()),
    "Role": (["player", "scoper"], _OF_ROLES),
    "Patient": (["player", "scoper"], [*_OF_ROLES, "veryImportantPersonCode"]),
    "LicensedEntity": (["player", "scoper"], [*_OF_ROLES, "recertificationTime"]),
}
#: fixed values: those that say nothing about the thing itself, and so aren't part of the hash
NO_CONTENT = ("realmCode", "typeId", "templateId")


def weighted_and_hashed(df: DataFrame, kind: str) -> DataFrame:
    """df with _record_weight and _record_hash as records of a kind have them; columns that it lacks count as null."""
    links, others = WEIGHED[kind]
    full = df.withColumns({c: F.lit(None).cast("string") for c in ["name", *links, *others] if c not in df.columns})
    heavy = weighted(full, F.col("_mif").startswith("TZDU"), "id", "name", links, others)
    return hashed(heavy, ["name", *[c for c in others if c not in NO_CONTENT]]).select(*df.columns, "_record_weight", "_record_hash")


def hashed(df: DataFrame, columns: list[str], name: str = "_record_hash") -> DataFrame:
    """Adds a hash of the content; ids and foreign keys are no content and must not be among the columns."""
    return df.withColumn(name, F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def deduplicated(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(_id, kept): of the entities with equal keys the smallest _id is kept; keys compare null-safe."""
    least = entities.groupBy(*keys).agg(F.min("_id").alias("kept"))
    same = F.lit(True)
    right = least.select("kept", *[F.col(k).alias(f"__{k}") for k in keys])
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return entities.join(right, same).select("_id", "kept")


def repointed(df: DataFrame, fk: str, mapping: DataFrame, old: str = "_id", new: str = "kept") -> DataFrame:
    """df with a foreign key that points to what replaced its target; the former value stays in <fk>_original."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    original = f"{fk}_original"
    before = F.coalesce(F.col(original), F.col(fk)) if original in df.columns else F.col(fk)
    out = df.join(m, F.col(fk) == F.col("__old"), "left")
    return out.withColumn(original, before).withColumn(fk, F.coalesce("__new", fk)).drop("__old", "__new")


def orphans(df: DataFrame, fk: str, targets: DataFrame, key: str = "_id") -> DataFrame:
    return df.where(F.col(fk).isNotNull()).join(targets.select(F.col(key).alias(fk)), fk, "left_anti")


def with_ids(df: DataFrame, start: int, end: int, name: str = "_id") -> DataFrame:
    """Disjoint ids from a range given to this batch: partition number and row number within; too small a range is an error on use."""
    at = F.monotonically_increasing_id()
    per = (end - start) // max(1, df.rdd.getNumPartitions())
    part, row = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    return df.withColumn(name, F.when(row < per, F.lit(start) + part * per + row).otherwise(F.raise_error(F.lit("the id range is used up"))))


class IdRanges:
    """Disjoint ranges of ids that batches take and give back."""

    def __init__(self, count: int = 4096, bits: int = 63):
        size = (1 << bits) // count
        self.free = [(k * size + 1, (k + 1) * size) for k in range(count)]

    def take(self) -> tuple[int, int]:
        if not self.free:
            raise LookupError("no id range is left")
        return self.free.pop(0)

    def give_back(self, start: int, end: int) -> None:
        if start <= end:
            self.free.append((start, end))
