"""Observations of documents: attribute rows to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions import json_values as J
from vitalis.operators.characteristic import wide_table

ATTRIBUTES = ["code", "statuscode", "value", "negationind", "effectivetime"]


def whole_number(text):
    return text.try_cast("decimal(38,6)").cast("long")


def observations(rows: DataFrame) -> DataFrame:
    """(row_id, number, code, status_code, value_type, value_text, negation, time_low): a row per observation named in row_name.

    Missing values are empty strings. Rows whose row_name lacks row_id or number name no observation.
    """
    named = rows.select(
        whole_number(F.get_json_object("row_name", "$.row_id")).alias("row_id"),
        whole_number(F.get_json_object("row_name", "$.number")).alias("number"),
        F.lower(F.trim("key")).alias("key"),
        "value",
        "_lake_timestamp",
    )
    wide = wide_table(named, ["row_id", "number"], "key", "value", "_lake_timestamp", ATTRIBUTES)
    heads = wide.select("row_id", "number", *[J.head(a).alias(a) for a in ATTRIBUTES])
    parts = heads.select("row_id", "number", *[J.parsed(a).alias(a) for a in ATTRIBUTES])
    code, status, value, negation, time = (F.col(a) for a in ATTRIBUTES)
    kind = F.trim(value["of"]["dataType"])
    inner = F.coalesce(value["of"]["value"], value["plain"])
    text = (
        F.when(kind.isin("PQ", "INT", "REAL", "MO"), J.plain_number(inner))
        .when(kind.isin("CD", "CV", "CE", "CO", "CS"), J.coded(value))
        .when(kind == "BL", F.coalesce(J.truth(inner), F.trim(inner)))
        .otherwise(F.trim(inner))
    )
    out = {
        "code": J.coded(code), "status_code": J.coded(status), "value_type": kind, "value_text": text,
        "negation": J.truth(F.coalesce(negation["plain"], negation["of"]["value"])), "time_low": J.low_of_time(time),
    }
    return parts.select("row_id", "number", *[F.coalesce(c, F.lit("")).alias(n) for n, c in out.items()])
