"""Values of clinical JSON attributes, whichever way they are written: one object or an array of one, objects or plain values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


MEMBERS = "code string, dataType string, value string, low string"


def head(doc: str | Column) -> Column:
    """The first element of an array, anything else as it is."""
    return F.coalesce(F.get_json_object(doc, "$[0]"), F.col(doc) if isinstance(doc, str) else doc)


def parsed(one: str | Column) -> Column:
    """The members of an object that head() gave, as struct of MEMBERS; and what stands there instead of an object, as plain."""
    text = F.get_json_object(one, "$")
    plain = F.when(~F.ltrim(text).rlike(r"^[{\[]") & (text != "null"), text)
    return F.struct(F.from_json(one, MEMBERS).alias("of"), plain.alias("plain"))


def coded(p: Column) -> Column:
    """The code of a coded value, or the plain text where the code stands by itself."""
    return F.trim(F.coalesce(p["of"]["code"], p["plain"]))


def plain_number(text: Column) -> Column:
    """A number with a decimal point and no trailing zeros; text that is no number stays as it is."""
    trimmed = F.trim(text)
    number = F.replace(trimmed, F.lit(","), F.lit(".")).try_cast("decimal(38,12)").cast("string")
    point = F.when(number.contains("."), F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", "")).otherwise(number)
    return F.coalesce(point, trimmed)


def truth(text: Column) -> Column:
    """true, false or null from the texts of booleans, 0 and 1."""
    lower = F.lower(F.trim(text))
    return F.when(lower.isin("true", "1", "t", "yes"), "true").when(lower.isin("false", "0", "f", "no"), "false")


def timestamp_digits(text: Column) -> Column:
    """yyyyMMddHHmmss of a point in time of any precision; missing parts are zero, fractions and zone offset are dropped."""
    part = F.regexp_extract(text, r"^\s*(\d{4}(?:-?\d{2}){0,2}(?:[T ]?\d{2}(?::?\d{2}){0,2})?)", 1)
    digits = F.regexp_replace(part, r"\D", "")
    return F.when(digits != "", F.rpad(digits, 14, "0"))


def low_of_time(p: Column) -> Column:
    """Of an interval its low, of a point in time the point."""
    low = p["of"]["low"]
    inner = F.when(F.ltrim(low).startswith("{"), F.get_json_object(low, "$.value")).otherwise(low)
    return timestamp_digits(F.coalesce(inner, p["of"]["value"], p["plain"]))
