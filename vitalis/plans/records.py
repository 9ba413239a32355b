"""Queries over nested documents and quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.operators import nested, units
from vitalis.operators.latest import latest_version
from vitalis.plans.observations import observations
from vitalis.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return observations(table(spark, d, "document_of_patient_sample"))


def document_nodes(docs: DataFrame) -> DataFrame:
    """(row_id, path, parent_path, rim_name, pre, post) of all RIM objects in the latest document of each id; ids that are null name no document."""
    newest = latest_version(docs.where("id is not null"), ["id"], columns=["document"])
    nodes = nested.node_table(newest, "id", "document", "_rimname")
    return nodes.withColumnsRenamed({"id": "row_id", "type": "rim_name"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return document_nodes(table(spark, d, "document_template")).select("row_id", "path", "parent_path", "rim_name")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Sections and the observations at any depth in them, linked by interval containment."""
    nodes = document_nodes(table(spark, d, "document_template"))
    tables = nested.type_tables(nodes, ["Section", "Observation"], "rim_name")
    return nested.link(tables["Section"], tables["Observation"], "row_id")


def quantities(acts: DataFrame, reference: DataFrame) -> DataFrame:
    """Decoded quantities of the latest version of every observation whose code the reference lists."""
    kept = ["rim_class", "code", "effective_low", "_value_pq_value", "_value_pq_unit", "value_text"]
    newest = latest_version(acts.where("_id is not null"), ["_id"], columns=kept).where("rim_class = 'Observation'")
    read = units.read_quantities(newest, reference, "_id", "code", "_value_pq_value", "_value_pq_unit", "value_text", "effective_low")
    return units.common_units(read, reference)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = quantities(table(spark, d, "act"), table(spark, d, "unit_reference")).where("stated")
    return found.select(F.col("id").alias("act_id"), "unit", "value_scaled")


def p5_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every quantity with a number, also those whose unit only the series tells."""
    found = quantities(table(spark, d, "act"), table(spark, d, "unit_reference")).where("decoded_unit is not null")
    return found.select(F.col("id").alias("act_id"), "code", "decoded_unit", "stated", "unit", "value_scaled")


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_links, p5_found, p5_decoded)}
SQL: dict[str, str] = {
    "p2_found": r"""
        WITH named AS (SELECT CAST(json_extract_string(row_name, '$.row_id') AS BIGINT) AS row_id, CAST(json_extract_string(row_name, '$.number') AS BIGINT) AS number, lower(trim(key)) AS key, value, _lake_timestamp FROM document_of_patient_sample),
        latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, number, key ORDER BY _lake_timestamp DESC NULLS LAST, value DESC NULLS LAST) AS k FROM named) WHERE k = 1),
        heads AS (SELECT row_id, number, key, CASE WHEN json_type(value) = 'ARRAY' THEN json_extract(value, '$[0]') ELSE CAST(value AS JSON) END AS j FROM latest),
        parts AS (SELECT *, json_extract_string(j, '$.code') AS code, json_extract_string(j, '$.dataType') AS kind, json_extract_string(j, '$.value') AS v, CASE WHEN json_type(j) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(j, '$') END AS plain,
            coalesce(json_extract_string(j, '$.low.value'), CASE WHEN json_type(json_extract(j, '$.low')) = 'VARCHAR' THEN json_extract_string(j, '$.low') END) AS low FROM heads),
        texts AS (SELECT *, trim(coalesce(v, plain)) AS t, trim(replace(coalesce(v, plain), ',', '.')) AS n FROM parts),
        typed AS (SELECT row_id, number, key, trim(coalesce(code, plain)) AS coded, kind, lower(trim(coalesce(plain, v))) AS flag, regexp_replace(regexp_extract(coalesce(low, v, plain), '^\s*(\d{4}(?:-?\d{2}){0,2}(?:[T ]?\d{2}(?::?\d{2}){0,2})?)', 1), '\D', '', 'g') AS digits,
            CASE WHEN kind IN ('PQ', 'INT', 'REAL') THEN CASE WHEN regexp_matches(n, '\.') THEN regexp_replace(regexp_replace(n, '0+$', ''), '\.$', '') ELSE n END WHEN kind IN ('CD', 'CV', 'CE') THEN trim(code) WHEN kind = 'BL' THEN lower(t) ELSE t END AS text FROM texts)
        SELECT row_id, number, coalesce(max(coded) FILTER (key = 'code'), '') AS code, coalesce(max(coded) FILTER (key = 'statuscode'), '') AS status_code, coalesce(max(kind) FILTER (key = 'value'), '') AS value_type, coalesce(max(text) FILTER (key = 'value'), '') AS value_text,
            coalesce(max(CASE flag WHEN '1' THEN 'true' WHEN '0' THEN 'false' ELSE flag END) FILTER (key = 'negationind'), '') AS negation, coalesce(max(CASE WHEN digits <> '' THEN rpad(digits, 14, '0') END) FILTER (key = 'effectivetime'), '') AS time_low
        FROM typed GROUP BY row_id, number""",
    "p4_found": r"""
        WITH one AS (SELECT id, document FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _lake_timestamp DESC NULLS LAST, document DESC NULLS LAST) AS k FROM document_template WHERE id IS NOT NULL) WHERE k = 1),
        opened AS (SELECT id, CASE WHEN json_valid(document) THEN CASE WHEN json_type(document) = 'VARCHAR' THEN json_extract_string(document, '$') ELSE document END END AS doc FROM one),
        nodes AS (SELECT o.id AS row_id, t.id AS n, t.parent AS up, replace(t.fullkey, '"', '') AS path, CASE WHEN t.type = 'OBJECT' AND json_type(json_extract(t.value, '$._rimname')) = 'VARCHAR' THEN nullif(json_extract_string(t.value, '$._rimname'), '') END AS rim_name FROM opened o, json_tree(CASE WHEN json_valid(doc) THEN doc END) t)
        SELECT row_id, path, coalesce((SELECT arg_max(p.path, length(p.path)) FROM nodes p WHERE p.row_id = nodes.row_id AND p.rim_name IS NOT NULL AND length(p.path) < length(nodes.path) AND starts_with(nodes.path, p.path) AND substr(nodes.path, length(p.path) + 1, 1) IN ('.', '[')), '') AS parent_path, rim_name
        FROM nodes WHERE rim_name IS NOT NULL""",
}
SQL["p4_links"] = (
    SQL["p4_found"].rsplit("SELECT row_id, path, coalesce", 1)[0]
    + "SELECT o.row_id, o.path AS outer_path, i.path AS inner_path FROM nodes o JOIN nodes i USING (row_id) WHERE o.rim_name = 'Section' AND i.rim_name = 'Observation' AND starts_with(i.path, o.path) AND substr(i.path, length(o.path) + 1, 1) IN ('.', '[')"
)
