"""Staging, resolution, consent, research tables and single operators, over views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.functions import semantics as S
from vitalis.operators import consent, graph, history, research, resolution, staging
from vitalis.plans import records
from vitalis.plans.observations import observations as document_observations
from vitalis.session import table
from vitalis.sources import rim_views as V
from vitalis.sources.rim_views import with_views

SALT = "not-a-secret-in-tests"


def q17_pseudonym(spark: SparkSession, d: str) -> DataFrame:
    return V.patients(spark, d).select(F.col("_id").alias("ptnt_id"), research.pseudonym(F.col("_id"), SALT).alias("pseudonym"))


def _base_values(spark: SparkSession, d: str) -> DataFrame:
    """(ptnt_id, act_id, code, time, number, text): observations, and birth and gender of persons, as attribute rows."""
    o = V.observations(spark, d).select("ptnt_id", "act_id", "code", "time", F.col("pq_value").cast("double").alias("number"), F.col("coded_value").cast("string").alias("text"))
    p = V.persons(spark, d)
    none = F.lit(None)
    born = p.select(F.col("_id").alias("ptnt_id"), none.cast("long").alias("act_id"), F.lit("184099003").alias("code"), F.col("birth_date").cast("timestamp_ntz").alias("time"), none.cast("double").alias("number"), F.col("birth_date").cast("string").alias("text"))
    gender = p.select(F.col("_id").alias("ptnt_id"), none.cast("long").alias("act_id"), F.lit("263495000").alias("code"), F.col("birth_date").cast("timestamp_ntz").alias("time"), none.cast("double").alias("number"), F.col("gender").alias("text"))
    return o.unionByName(born).unionByName(gender)


def q18_base_values(spark: SparkSession, d: str) -> DataFrame:
    """Attribute rows of a repeatable sample of patients."""
    sample = S.hash_sample(V.patients(spark, d).select(F.col("_id").alias("ptnt_id")), "ptnt_id", 0.3, 250502)
    return _base_values(spark, d).join(sample, "ptnt_id", "left_semi")


def q20_features(spark: SparkSession, d: str) -> DataFrame:
    """Whether each observation states its finding: its code's truth and its negation agree on no; and the age in years."""
    a = table(spark, d, "act").where("rim_class = 'Observation'")
    said = F.when(F.col("status_code") == "completed", True).when(F.col("status_code") == "active", False)
    age = F.lit(2024) - F.year("effective_low")
    return a.select("_id", "_lake_timestamp", (said == ~F.col("negation_ind")).cast("int").alias("has_finding"), age.cast("long").alias("age_in_years"))


def _positives(spark: SparkSession, d: str) -> DataFrame:
    return V.observations(spark, d).where("code = 'purchase' and pq_value > 100").select("ptnt_id", "time")


TABULAR = ["click", "error", "signup", "view"]


def q21_tabular(spark: SparkSession, d: str) -> DataFrame:
    """One row per patient and event time: of each code the value closest before, its age in days, number and greatest value."""
    rows = research.event_times(V.observations(spark, d).withColumn("x", F.col("pq_value").cast("double")).where(F.col("code").isin(TABULAR)), _positives(spark, d), "ptnt_id", "2024-01-31")
    near = research.closest_before(rows, ["ptnt_id", "code"], "x")
    of = lambda c, v: F.max(F.when(F.col("code") == c, F.col(v)))
    columns = [of(c, v).cast(t).alias(f"{c}_{n}") for c in TABULAR for v, n, t in (("x", "value", "double"), ("days", "days", "long"), ("n", "n", "long"), ("most", "most", "double"))]
    return near.groupBy("ptnt_id", "t0").agg(*columns)


def crosstab_last(spark: SparkSession, d: str) -> DataFrame:
    """A column per listed code with its last coded value by time and act; codes that aren't listed are left out."""
    o = V.observations(spark, d).withColumn("place", F.struct("time", "act_id"))
    return research.pivoted(o, ["ptnt_id"], "code", "coded_value", "place", ["click", "view", "absent"])


def _quasi(spark: SparkSession, d: str) -> DataFrame:
    latest = history.latest_of(V.observations(spark, d).where("code = 'signup'"), ["ptnt_id"]).select("ptnt_id", F.col("coded_value").alias("smok_lv"))
    p = V.persons(spark, d).select(F.col("_id").alias("ptnt_id"), "gender", F.floor((2024 - F.year("birth_date")) / 10).cast("long").alias("age_decade"))
    return p.join(latest, "ptnt_id", "left")


QUASI = ["age_decade", "gender", "smok_lv"]


def q22_risk_classes(spark: SparkSession, d: str) -> DataFrame:
    """The ten smallest classes of equal quasi-identifiers; ties are decided by the identifiers."""
    order = [F.col("fk"), *[F.col(c).asc_nulls_last() for c in QUASI]]
    return research.risk_classes(_quasi(spark, d), QUASI).orderBy(*order).limit(10).select(*QUASI, "fk", F.round("risk", 6).alias("risk"))


def q22_share_at_risk(spark: SparkSession, d: str) -> DataFrame:
    return research.share_at_risk(_quasi(spark, d), QUASI, 0.05).select(F.col("num").cast("long").alias("num"), F.col("denom").cast("long").alias("denom"), "perc")


def q23_json_probe(spark: SparkSession, d: str) -> DataFrame:
    """Observations from documents by code, type of value and status."""
    o = document_observations(table(spark, d, "document_of_patient_sample"))
    return o.groupBy("code", "value_type", "status_code").agg(F.count(F.lit(1)).alias("n"))


def dedup_org(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as organisations that are one if nation and first account digit agree; roles point to what is kept."""
    o = table(spark, d, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_nationkey").alias("mif"), F.floor(F.col("s_acctbal") / 1000).cast("long").alias("ext"))
    kept = staging.deduplicated(o, ["mif", "ext"])
    roles = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("role_id"), F.col("l_suppkey").alias("scoper")).distinct()
    return staging.repointed(roles, "scoper", kept).select("role_id", "scoper", "scoper_original")


def weight_hash(spark: SparkSession, d: str) -> DataFrame:
    """Record weights, and per content hash how many records and the least of them."""
    r = table(spark, d, "resolution_a").select("_id", "_mif", "id", "name", "birth_time", "gender", "addr", "telecom")
    w = staging.weighted(r, F.col("_mif").startswith("TZDU"), "id", "name", [], ["_mif", "birth_time", "gender", "addr", "telecom"])
    h = staging.hashed(w, ["name", "birth_time", "gender", "addr", "telecom"])
    same = h.groupBy("_record_hash").agg(F.count(F.lit(1)).alias("alike"), F.min("_id").alias("first"), F.max("_record_weight").alias("heaviest"))
    return same.select("first", "alike", F.col("heaviest").cast("long").alias("heaviest"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Act relationships: each order below the one of half its key; finished orders don't conduct context."""
    return table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 2).cast("long").alias("source"), F.col("o_orderkey").alias("target"), (F.col("o_orderstatus") != "F").alias("conduction"))


def act_descend(spark: SparkSession, d: str) -> DataFrame:
    """All acts below the urgent open orders; the root's relation to itself is a cycle."""
    starts = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").select("o_orderkey")
    return graph.closure(_tree(spark, d), starts, "source", "target")


def conduct_context(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    code = F.when(F.col("o_orderpriority") == "1-URGENT", "AP").when(F.col("o_orderpriority") == "2-HIGH", "OP").when(F.col("o_orderpriority") == "3-MEDIUM", "AN").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "ON")
    p = o.select(F.col("o_orderkey").alias("_id"), F.col("o_orderkey").alias("act"), F.col("o_custkey").alias("role"), F.lit("RCT").alias("type_code"), code.alias("context_control_code"), F.lit(None).cast("long").alias("origin"))
    return graph.conduct_context(p, _tree(spark, d)).select("act", "role", "context_control_code", "origin")


def _er_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ident = lambda root, e: F.struct(F.lit(root).alias("root"), e.cast("long").cast("string").alias("extension"))
    ids = F.when((k % 8).between(2, 5), F.array(ident("A", F.floor(k / 4)), ident("B", F.floor((k + 2) / 4)))).otherwise(F.array(ident("A", F.floor(k / 4))))
    weight = 1000 + F.when(F.col("c_acctbal") > 5000, 100).otherwise(0)
    return table(spark, d, "customer").select(k.alias("_id"), ids.alias("id"), weight.alias("_record_weight"), F.col("c_mktsegment").alias("_record_hash"))


def er_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Cluster of every record, and the record that replaces it."""
    return resolution.resolve(_er_records(spark, d))


def er_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Orders per cluster, after their customers became clusters."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("role"))
    out = resolution.rewritten(o, "role", resolution.resolve(_er_records(spark, d)))
    return out.groupBy("role").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("role_original").alias("records"))


def _consents(spark: SparkSession, d: str):
    """Six acts per customer: consent document, body, section, directive, diagnosis, action; codes and negation vary."""
    c = table(spark, d, "customer").select((F.col("c_custkey") * 10).alias("k"), F.col("c_custkey").alias("patient_id"), "c_mktsegment", "c_acctbal", "c_nationkey")
    kinds = [("Document", "DOCCLIN", "57016-8"), ("Act", "DOCBODY", ""), ("Act", "DOCSECT", "57016-6"), ("Act", "ACT", "HRESCH"), ("Observation", "OBS", "8319008"), ("Observation", "OBS", "IDSCL")]
    each = F.array(*[F.struct((F.col("k") + i).alias("_id"), F.lit(r).alias("rim_class"), F.lit(cl).alias("class_code"), F.lit(co).alias("code")) for i, (r, cl, co) in enumerate(kinds)])
    acts = c.select(F.explode(each).alias("x"), "c_mktsegment", "c_acctbal", "c_nationkey").select("x.*", "c_mktsegment", "c_acctbal", "c_nationkey")
    acts = acts.withColumn("code", F.when((F.col("code") == "57016-8") & (F.col("c_mktsegment") == "BUILDING"), "other").otherwise(F.col("code")))
    acts = acts.withColumn("value_code", F.concat(F.lit("CP-"), F.col("c_nationkey").cast("string"))).withColumn("negation_ind", F.col("c_acctbal") < 0)
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (3, 5)]
    relations = c.select(F.explode(F.array(*[F.struct((F.col("k") + a).alias("source"), (F.col("k") + b).alias("target")) for a, b in pairs])).alias("x")).select("x.*")
    return acts, relations, c.select(F.col("k").alias("act"), "patient_id")


def optout(spark: SparkSession, d: str) -> DataFrame:
    return consent.opt_outs(*_consents(spark, d))


def secure_view(spark: SparkSession, d: str) -> DataFrame:
    """Observations per code that are left when acts of opted-out care provisions are hidden."""
    links = V.observations(spark, d).join(V.patients(spark, d).select(F.col("_id").alias("ptnt_id"), "scoper"), "ptnt_id")
    links = links.select("act_id", F.concat(F.lit("CP-"), F.col("scoper").cast("string")).alias("care_provision"), F.col("ptnt_id").alias("patient_id"))
    tables = consent.SecureTables({"observation": V.observations(spark, d)}, links, optout(spark, d), {"observation": "act_id"})
    return tables.read("observation").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("pq_value").cast("double").alias("total"))


def sample_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.hash_sample(table(spark, d, "customer"), "c_custkey", 0.1, 42).select("c_custkey")


def setops(spark: SparkSession, d: str) -> DataFrame:
    """Union of distinct rows, all rows, and what is only in one side."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"))
    both = a.union(b).distinct().select(F.lit("distinct").alias("op"), "n")
    every = a.unionAll(b).groupBy("n").count().where("count > 40").select(F.lit("often").alias("op"), "n")
    return both.unionByName(every)


def topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def template_match(spark: SparkSession, d: str) -> DataFrame:
    """Acts whose templates are all listed: nulls drop out, empty arrays stay, subclasses too."""
    listed = [{"root": "2.999.31.4.2.1", "extension": "1", "dataType": "II"}]
    a = table(spark, d, "act").where(S.all_listed(F.col("template_id"), listed))
    return a.groupBy("rim_class").agg(F.count(F.lit(1)).alias("n"))


def scan_only(spark: SparkSession, d: str) -> DataFrame:
    """Base rows of acts without and with subclasses."""
    a = table(spark, d, "act").select("rim_class", "class_code")
    only = a.where("rim_class = 'Act'").select(F.lit("only").alias("scan"), "class_code")
    return only.unionByName(a.select(F.lit("all").alias("scan"), "class_code")).groupBy("scan", "class_code").agg(F.count(F.lit(1)).alias("n"))


def unit_compare(spark: SparkSession, d: str) -> DataFrame:
    """Quantities above a limit in their code's common unit, whichever listed unit they are in."""
    a = table(spark, d, "act").select("_id", F.trim("code").alias("code"), F.col("_value_pq_value").alias("v"), F.trim("_value_pq_unit").alias("unit"))
    u = table(spark, d, "unit_reference").select("code", "unit", "common_unit", F.col("factor").cast("double").alias("f"), F.col("shift").cast("double").alias("s"))
    met = a.join(u, ["code", "unit"])  # a fixed table; its size decides whether it is broadcast
    value = F.round(F.col("v").cast("double") * F.col("f") + F.col("s"), 3)
    return met.where(value > 100).groupBy("code", "common_unit").agg(F.count(F.lit(1)).alias("n"))


def denormalise(spark: SparkSession, d: str) -> DataFrame:
    """Typed columns of nested ones: extensions of identifiers and parts of the time."""
    a = table(spark, d, "act").select("_id", "id", F.struct(F.col("code").alias("code"), F.col("codesystem").alias("codeSystem")).alias("code"), F.struct(F.col("effective_low").alias("low"), F.col("effective_high").alias("high")).alias("effective_time"))
    n = staging.denormalised(a)
    return n.groupBy("_code_code", "_effective_time_low_year", "_effective_time_low_month").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("_id_extension")[0]).alias("first_extension")).select(F.col("_code_code").alias("code"), F.col("_effective_time_low_year").cast("long").alias("y"), F.col("_effective_time_low_month").cast("long").alias("m"), "n", "first_extension")


def id_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of clusters' records that share an identifier, counted per root: arrays that overlap, by exploding and joining on equality."""
    r = table(spark, d, "resolution_a").where("_id_cluster is not null").select("_id", "id").distinct()
    e = resolution.exploded(r)
    per = e.groupBy("root", "extension").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("root").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.max("n").alias("most"))


def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the log that name a stored person, in their lowest batch; the others stay in the log."""
    log = table(spark, d, "append_id").where("schema_name = 'rim2011' and table_name = 'Person'")
    first = log.groupBy("id").agg(F.min("batch_no").cast("long").alias("batch_no"))
    known = first.join(table(spark, d, "resolution_a").select(F.col("_id").alias("id")), "id", "left_semi").groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))
    left = first.join(table(spark, d, "resolution_a").select(F.col("_id").alias("id")), "id", "left_anti").groupBy("batch_no").agg(F.count(F.lit(1)).alias("left_over"))
    return known.join(left, "batch_no", "left").withColumn("left_over", F.coalesce("left_over", F.lit(0)))


def row_number_all(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive numbers over a whole table in an order, without sorting it in one task."""
    return graph.row_ids(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_id")


def message_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval texts to bounds, OIDs without their prefix, and compact times, from literal rows."""
    rows = spark.createDataFrame([("<5", "urn:oid:2.999.1", "2010-10-10T00:00:00"), (">7,5", "2.999.2", "2011-01-02"), ("1-2,5", "urn:oid:2.999.3", None), ("x", None, "")], "t string, o string, s string")
    b = S.interval_bounds(F.col("t"))
    return rows.select("t", b["low"].cast("double").alias("low"), b["high"].cast("double").alias("high"), S.oid_of(F.col("o")).alias("oid"), S.compact_time(F.col("s")).alias("compact"))


_ER = """k AS (SELECT c_custkey AS _id, 1000 + CASE WHEN c_acctbal > 5000 THEN 100 ELSE 0 END AS w, c_mktsegment AS h FROM customer),
    ids AS (SELECT c_custkey AS _id, 'A' || (c_custkey // 4) AS e FROM customer UNION ALL SELECT c_custkey, 'B' || ((c_custkey + 2) // 4) FROM customer WHERE c_custkey % 8 BETWEEN 2 AND 5),
    reach AS (SELECT _id, _id AS seen FROM k UNION SELECT reach._id, y._id FROM reach JOIN ids x ON x._id = reach.seen JOIN ids y ON y.e = x.e),
    comp AS (SELECT _id, min(seen) AS c FROM reach GROUP BY _id),
    ranked AS (SELECT k._id, k.h, k.w, first_value(k._id) OVER (PARTITION BY c ORDER BY w DESC, k._id) AS cluster FROM k JOIN comp USING (_id)),
    er AS (SELECT _id, cluster AS _id_cluster, nullif(first_value(_id) OVER (PARTITION BY cluster, h ORDER BY CASE WHEN _id = cluster THEN 0 ELSE 1 END, w DESC, _id), _id) AS dedup_new_id FROM ranked)"""
_TREE = "tree AS (SELECT o_orderkey // 2 AS source, o_orderkey AS target, o_orderstatus <> 'F' AS conduction FROM orders)"
_OPT = "opt AS (SELECT c_custkey AS patient_id, 'CP-' || c_nationkey AS care_provision FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal < 0)"
_BASE = """base AS (SELECT ptnt_id, act_id, code, time, CAST(pq_value AS DOUBLE) AS number, CAST(coded_value AS VARCHAR) AS text FROM observations
    UNION ALL SELECT _id, NULL, '184099003', CAST(birth_date AS TIMESTAMP), NULL, CAST(birth_date AS VARCHAR) FROM persons
    UNION ALL SELECT _id, NULL, '263495000', CAST(birth_date AS TIMESTAMP), NULL, gender FROM persons)"""
_QUASI = """lv AS (SELECT ptnt_id, coded_value AS smok_lv FROM (SELECT *, rank() OVER (PARTITION BY ptnt_id ORDER BY time DESC NULLS FIRST, act_id DESC NULLS FIRST) AS rocky FROM observations WHERE code = 'signup') WHERE rocky = 1),
    q AS (SELECT (2024 - year(birth_date)) // 10 AS age_decade, gender, smok_lv FROM persons LEFT JOIN lv ON lv.ptnt_id = persons._id),
    cl AS (SELECT age_decade, gender, smok_lv, count(*) AS fk FROM q GROUP BY ALL)"""
_SAMPLE = "CAST(('0x' || substr(md5({k} || '-{s}'), 1, 8)) AS BIGINT) < {n}"

QUERIES = {
    f.__name__: f
    for f in (
        q17_pseudonym, q18_base_values, q20_features, q21_tabular, crosstab_last, q22_risk_classes, q22_share_at_risk, q23_json_probe, dedup_org, weight_hash, act_descend, conduct_context,
        er_resolve, er_rewrite, optout, secure_view, sample_hash, setops, topk, template_match, scan_only, unit_compare, denormalise, id_overlap, change_log, row_number_all, message_interval,
    )
}

SQL = {
    "q17_pseudonym": f"SELECT c_custkey AS ptnt_id, sha256('{SALT}' || c_custkey) AS pseudonym FROM customer",
    "q18_base_values": with_views("observations persons", f"{_BASE} SELECT * FROM base WHERE " + _SAMPLE.format(k="ptnt_id", s="250502", n=int(0.3 * (1 << 32)))),
    "q20_features": "SELECT _id, _lake_timestamp, CAST((CASE WHEN status_code = 'completed' THEN true WHEN status_code = 'active' THEN false END) = (NOT negation_ind) AS INTEGER) AS has_finding, 2024 - year(effective_low) AS age_in_years FROM act WHERE rim_class = 'Observation'",
    "q21_tabular": with_views("observations", """pos AS (SELECT ptnt_id, time AS t0 FROM observations WHERE code = 'purchase' AND pq_value > 100),
        r AS (SELECT o.ptnt_id, o.code, o.time, o.act_id, CAST(pq_value AS DOUBLE) AS x, coalesce(t0, TIMESTAMP '2024-01-31') AS t0 FROM observations o LEFT JOIN pos ON pos.ptnt_id = o.ptnt_id WHERE code IN ('click', 'error', 'signup', 'view')),
        b AS (SELECT *, (epoch_us(t0) - epoch_us(time)) // 86400000000 AS days FROM r WHERE time <= t0),
        k AS (SELECT *, rank() OVER (PARTITION BY ptnt_id, code, t0 ORDER BY days, act_id) AS near, count(*) OVER (PARTITION BY ptnt_id, code, t0) AS n, max(x) OVER (PARTITION BY ptnt_id, code, t0) AS most FROM b)
        SELECT ptnt_id, t0, """ + ", ".join(f"max(CASE WHEN code = '{c}' THEN {v} END) AS {c}_{n}" for c in TABULAR for v, n in (("x", "value"), ("days", "days"), ("n", "n"), ("most", "most"))) + " FROM k WHERE near = 1 GROUP BY ptnt_id, t0"),
    "crosstab_last": with_views("observations", """SELECT ptnt_id, arg_max(coded_value, struct_pack(t := time, a := act_id)) FILTER (code = 'click') AS click, arg_max(coded_value, struct_pack(t := time, a := act_id)) FILTER (code = 'view') AS view, CAST(NULL AS BIGINT) AS absent
        FROM observations WHERE code IN ('click', 'view', 'absent') GROUP BY ptnt_id"""),
    "q22_risk_classes": with_views("observations persons", f"{_QUASI} SELECT age_decade, gender, smok_lv, fk, round(CAST(1 AS DOUBLE) / fk, 6) AS risk FROM cl ORDER BY fk, age_decade NULLS LAST, gender NULLS LAST, smok_lv NULLS LAST LIMIT 10"),
    "q22_share_at_risk": with_views("observations persons", f"{_QUASI} SELECT CAST(sum(CASE WHEN CAST(1 AS DOUBLE) / fk > 0.05 THEN fk ELSE 0 END) AS BIGINT) AS num, CAST(sum(fk) AS BIGINT) AS denom, round_even(CAST(sum(CASE WHEN CAST(1 AS DOUBLE) / fk > 0.05 THEN fk ELSE 0 END) AS DOUBLE) / sum(fk) * 100, 0) AS perc FROM cl"),
    "q23_json_probe": f"SELECT code, value_type, status_code, count(*) AS n FROM ({records.SQL['p2_found']}) GROUP BY code, value_type, status_code",
    "dedup_org": "WITH k AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey, CAST(floor(s_acctbal / 1000) AS BIGINT)) AS kept FROM supplier) SELECT DISTINCT l_orderkey AS role_id, coalesce(kept, l_suppkey) AS scoper, l_suppkey AS scoper_original FROM lineitem LEFT JOIN k ON k.s_suppkey = l_suppkey",
    "weight_hash": """SELECT min(_id) AS first, count(*) AS alike, CAST(max(CASE WHEN _mif LIKE 'TZDU%' THEN 2000 ELSE 0 END + CASE WHEN len(id) > 0 THEN 1000 ELSE 0 END + CASE WHEN name IS NOT NULL THEN 100 ELSE 0 END
        + (_mif IS NOT NULL)::INT + (birth_time IS NOT NULL)::INT + (gender IS NOT NULL)::INT + (addr IS NOT NULL)::INT + (telecom IS NOT NULL)::INT) AS BIGINT) AS heaviest FROM resolution_a GROUP BY name, birth_time, gender, addr, telecom""",
    "act_descend": f"WITH RECURSIVE {_TREE}, down AS (SELECT o_orderkey AS start, o_orderkey AS reached FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' UNION SELECT start, target FROM down JOIN tree ON source = reached) SELECT start, reached FROM down",
    "conduct_context": f"""WITH RECURSIVE {_TREE}, p AS (SELECT o_orderkey AS _id, o_custkey AS role, CASE o_orderpriority WHEN '1-URGENT' THEN 'AP' WHEN '2-HIGH' THEN 'OP' WHEN '3-MEDIUM' THEN 'AN' WHEN '4-NOT SPECIFIED' THEN 'ON' END AS c FROM orders),
        w AS (SELECT _id AS origin, role, c, _id AS act, [_id] AS way, 0 AS level FROM p WHERE c IS NOT NULL UNION ALL SELECT origin, role, c, target, list_append(way, target), level + 1 FROM w JOIN tree ON source = act AND conduction WHERE (level = 0 OR c IN ('AP', 'OP')) AND NOT list_contains(way, target))
        SELECT DISTINCT act, role, c AS context_control_code, origin FROM w WHERE level > 0 AND NOT EXISTS (SELECT 1 FROM p WHERE p._id = w.act AND p.role IS NOT DISTINCT FROM w.role AND p.c IS NOT DISTINCT FROM w.c)""",
    "er_resolve": f"WITH RECURSIVE {_ER} SELECT * FROM er",
    "er_rewrite": f"WITH RECURSIVE {_ER} SELECT _id_cluster AS role, count(*) AS orders, count(DISTINCT coalesce(dedup_new_id, o_custkey)) AS records FROM orders JOIN er ON er._id = o_custkey GROUP BY _id_cluster",
    "optout": f"WITH {_OPT} SELECT * FROM opt",
    "secure_view": with_views("observations patients", f"{_OPT} SELECT code, count(*) AS n, CAST(sum(pq_value) AS DOUBLE) AS total FROM observations JOIN patients ON patients._id = ptnt_id WHERE NOT EXISTS (SELECT 1 FROM opt WHERE opt.patient_id = ptnt_id AND opt.care_provision = 'CP-' || scoper) GROUP BY code"),
    "sample_hash": "SELECT c_custkey FROM customer WHERE " + _SAMPLE.format(k="c_custkey", s="42", n=int(0.1 * (1 << 32))),
    "setops": "SELECT 'distinct' AS op, n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'often', n FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY n HAVING count(*) > 40",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "template_match": """SELECT rim_class, count(*) AS n FROM act WHERE template_id IS NOT NULL AND len(list_filter(template_id, lambda x: NOT ((x.root IS NULL OR x.root = '2.999.31.4.2.1') AND (x.extension IS NULL OR x.extension = '1') AND (x."dataType" IS NULL OR x."dataType" = 'II')))) = 0 GROUP BY rim_class""",
    "scan_only": "SELECT 'only' AS scan, class_code, count(*) AS n FROM act WHERE rim_class = 'Act' GROUP BY class_code UNION ALL SELECT 'all', class_code, count(*) FROM act GROUP BY class_code",
    "unit_compare": "SELECT u.code, common_unit, count(*) AS n FROM act JOIN unit_reference u ON trim(act.code) = u.code AND trim(_value_pq_unit) = u.unit WHERE round(CAST(_value_pq_value AS DOUBLE) * CAST(factor AS DOUBLE) + CAST(shift AS DOUBLE), 3) > 100 GROUP BY u.code, common_unit",
    "denormalise": "SELECT code, year(effective_low) AS y, month(effective_low) AS m, count(*) AS n, min(id[1].extension) AS first_extension FROM act GROUP BY ALL",
    "id_overlap": "WITH r AS (SELECT DISTINCT _id, id FROM resolution_a WHERE _id_cluster IS NOT NULL), e AS (SELECT DISTINCT _id, x.root AS root, x.extension AS extension FROM (SELECT _id, unnest(id) AS x FROM r) WHERE x.extension IS NOT NULL), p AS (SELECT root, extension, count(*) AS n FROM e GROUP BY root, extension) SELECT root, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs, max(n) AS most FROM p GROUP BY root",
    "change_log": "WITH f AS (SELECT id, CAST(min(batch_no) AS BIGINT) AS batch_no FROM append_id WHERE schema_name = 'rim2011' AND table_name = 'Person' GROUP BY id) SELECT batch_no, count(*) FILTER (id IN (SELECT _id FROM resolution_a)) AS n, count(*) FILTER (id NOT IN (SELECT _id FROM resolution_a)) AS left_over FROM f GROUP BY batch_no",
    "row_number_all": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id FROM orders",
    "message_interval": "SELECT * FROM (VALUES ('<5', CAST(NULL AS DOUBLE), CAST(5 AS DOUBLE), '2.999.1', '20101010000000'), ('>7,5', 7.5, NULL, '2.999.2', '20110102'), ('1-2,5', 1, 2.5, '2.999.3', NULL), ('x', NULL, NULL, NULL, '')) t(t, low, high, oid, compact)",
}


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Clinical documents and broken messages through the streaming pipeline: how many were loaded and quarantined."""
    from vitalis.session import scratch
    from vitalis.sources.files import message_stream
    from vitalis.streaming.ingest import Pipeline

    at = scratch(spark, "ingest")
    docs = table(spark, d, "act").where("_id is not null")
    root = F.when(F.col("rim_class") == "Document", "ClinicalDocument").when(F.col("rim_class") == "Act", "PatientUpdate").otherwise("Unknown")
    body = F.concat(F.lit("<v3:"), root, F.lit(' xmlns:v3="urn:hl7-org:v3"><id extension="'), F.col("_id").cast("string"), F.lit('"/>'), F.when(F.col("status_code") == "active", "").otherwise(F.concat(F.lit("</v3:"), root, F.lit(">"))))
    docs.select(body.alias("value")).write.text(f"{at}/in")
    lines = spark.readStream.format("text").load(f"{at}/in")
    p = Pipeline(spark, f"{at}/good", f"{at}/bad", f"{at}/state")
    p.start(lines.select(F.col("value").alias("payload"), F.lit("ingress.hl7v3.test").alias("routing_key"))).awaitTermination()
    good = spark.read.parquet(f"{at}/good").groupBy(F.col("content_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    bad = spark.read.parquet(f"{at}/bad").groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad)


def bn_sample(spark: SparkSession, d: str) -> DataFrame:
    """Smoking and blood pressure drawn for each person, by gender and age; the draws of a seed are the same again."""
    from vitalis.generate.bayes import Discrete, Numeric, sample

    p = V.persons(spark, d).select("_id", "gender", (2024 - F.year("birth_date")).alias("age"))
    smoking = Discrete("smoking", [("F", "yes", 0.2), ("F", "no", 0.8), ("M", "yes", 0.3), ("M", "no", 0.7)], ["gender"])
    drawn = sample(p, [Numeric("pressure", 100.0, 10.0, {"age": 0.5}), smoking], seed=7, key=["_id"])
    return drawn.withColumn("pressure", F.round("pressure", 6)).withColumn("age", F.col("age").cast("long"))


QUERIES |= {f.__name__: f for f in (stream_ingest, bn_sample)}
SQL["stream_ingest"] = """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN status_code = 'active' THEN 'validation' WHEN rim_class = 'Document' THEN 'CDA_R2' WHEN rim_class = 'Act' THEN 'TZDU_IN000003UV' ELSE 'internal' END AS kind FROM act) GROUP BY kind"""
_U = lambda name: f"((CAST('0x' || substr(md5(_id || '|7|{name}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"
SQL["bn_sample"] = with_views("persons", f"""p AS (SELECT _id, gender, 2024 - year(birth_date) AS age FROM persons)
    SELECT *, round(100 + 0.5 * age + 10 * sqrt(-2 * ln({_U("pressure#1")})) * cos(2 * pi() * {_U("pressure#2")}), 6) AS pressure, CASE WHEN {_U("smoking")} < CASE gender WHEN 'F' THEN 0.2 ELSE 0.3 END THEN 'yes' ELSE 'no' END AS smoking FROM p""")
