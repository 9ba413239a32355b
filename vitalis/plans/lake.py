"""Batches against the lake, messages, generated records and stored tables: one query per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.functions import semantics as S
from vitalis.generate import bayes
from vitalis.operators import consent, resolution, staging
from vitalis.operators.latest import latest_version
from vitalis.session import scratch, table
from vitalis.sources import files
from vitalis.sources import rim_views as V
from vitalis.sources.rim_views import with_views
from vitalis.streaming import ingest

# --- entity resolution of appended records against accepted ones ---------------------------------------------------


def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(new, known): the latest version of each record, without and with a cluster."""
    columns = ["_id_cluster", "id", "_record_hash", "_record_weight"]
    rows = latest_version(table(spark, d, "resolution_a").where("_id is not null"), ["_id"], columns=columns)
    return rows.where("_id_cluster is null").drop("_id_cluster"), rows.where("_id_cluster is not null")


def er_batch(spark: SparkSession, d: str) -> DataFrame:
    """Instructions for the appended records: those that share an identifier and the hash with an accepted one are replaced by it."""
    new, known = _batch(spark, d)
    return resolution.resolve(new, known)


def er_applied(spark: SparkSession, d: str) -> DataFrame:
    """Appended records that stay, by the number that stays in their cluster; and whether any rule is broken."""
    new, known = _batch(spark, d)
    instructions = resolution.cut(resolution.resolve(new, known))
    kept = resolution.applied(new, instructions).groupBy("_id_cluster").agg(F.count(F.lit(1)).alias("kept"))
    broken = resolution.broken_rules(instructions).agg(F.count(F.lit(1)).alias("broken"))
    return kept.groupBy("kept").agg(F.count(F.lit(1)).alias("clusters")).crossJoin(F.broadcast(broken))  # one row


# --- links from acts to care provisions ----------------------------------------------------------------------------


def _provision_tables(spark: SparkSession, d: str):
    """A document of four acts per customer, with a service event of two identifiers; a provision per nation names the same two in the other order."""
    c = table(spark, d, "customer").select((F.col("c_custkey") * 10).alias("k"), F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").cast("string").alias("n"))
    both = lambda n, *roots: F.array(*[F.struct(F.lit(r).alias("root"), n.alias("extension")) for r in roots])
    edges = [(0, 1, "COMP"), (1, 2, "COMP"), (2, 3, "COMP"), (0, 9, "DOC")]
    relations = c.select(F.explode(F.array(*[F.struct((F.col("k") + a).alias("source"), (F.col("k") + b).alias("target"), F.lit(t).alias("type_code")) for a, b, t in edges])).alias("x")).select("x.*")
    events = c.select((F.col("k") + 9).alias("_id"), both(F.col("n"), "2.999.1", "2.999.2", "2.999.1").alias("id"))
    provisions = table(spark, d, "nation").select(both(F.col("n_nationkey").cast("string"), "2.999.2", "2.999.1").alias("id"), F.concat(F.lit("CP-"), F.col("n_nationkey").cast("string")).alias("code"))
    return c.select(F.col("k").alias("_id"), "patient_id"), relations, events, provisions


def act_provisions(spark: SparkSession, d: str) -> DataFrame:
    """Every act below a document with the care provision the document is of; identifiers are compared as sets."""
    return consent.provision_links(*_provision_tables(spark, d))


# --- messages ------------------------------------------------------------------------------------------------------


def _fhir(spark: SparkSession, d: str) -> DataFrame:
    """(payload, routing_key): an organization per supplier and a patient per customer."""
    of = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    use = F.when(F.col("s_suppkey") % 2 == 0, "home").otherwise("work")
    organization = of('<Organization xmlns="http://hl7.org/fhir"><identifier><system value="urn:oid:2.999.7"/><value value="', key, '"/></identifier><name value="', F.col("s_name"), '"/><telecom><system value="phone"/><value value="0', key, '"/><use value="', use, '"/></telecom><partOf><reference value="Organization/', nation, '"/></partOf></Organization>')
    key = F.col("c_custkey").cast("string")
    gender = F.when(F.col("c_custkey") % 2 == 0, "female").otherwise("male")
    patient = of('<Patient xmlns="http://hl7.org/fhir"><identifier><system value="urn:oid:2.999.8"/><value value="', key, '"/></identifier><name><family value="', F.col("c_name"), '"/><given value="A"/></name><birthDate value="1950-02-0', F.col("c_custkey") % 9 + 1, '"/><gender value="', gender, '"/>'
        '<identifier><system value="urn:oid:2.999.9"/><value value="P', key, '"/><period><start value="2010-05-21T00:00:00"/></period><assigner><extension url="i"><valueIdentifier><system value="urn:oid:2.999.10"/><value value="', F.col("c_nationkey").cast("string"), '"/></valueIdentifier></extension></assigner></identifier>'
        '<address><line value="Road ', key, '"/><city value="Town"/><zip value="1234AB"/></address><careProvider><extension url="i"><valueIdentifier><system value="urn:oid:2.999.11"/><value value="G', key, '"/></valueIdentifier></extension><extension url="r"><valueString value="GP"/></extension>'
        '<extension url="t"><valueDateTime value="2013-05-21T00:00:00"/></extension></careProvider></Patient>')
    return s.select(organization.alias("payload"), F.lit("in.fhir").alias("routing_key")).unionByName(c.select(patient.alias("payload"), F.lit("in.fhir").alias("routing_key")))


def fhir_updates(spark: SparkSession, d: str) -> DataFrame:
    """Updates of organizations and patients from FHIR messages, routed and classified on the way."""
    m = ingest.classified(_fhir(spark, d)).where("error is null")
    o = m.where("root = 'Organization'").select("content_type", ingest.fhir_organization(F.col("payload")).alias("x"))
    p = m.where("root = 'Patient'").select("content_type", ingest.fhir_person(F.col("payload")).alias("x"))
    first, policy, giver = F.col("x.id")[0], F.col("x.policy_holder")[0], F.col("x.care_giver")[0]
    none = F.lit(None).cast("string")
    o = o.select("content_type", first["root"].alias("root"), first["extension"].alias("extension"), "x.name", F.col("x.telecom")[0]["use"].alias("use"), "x.part_of", *[none.alias(n) for n in ("birth_time", "gender", "street", "policy", "policy_low", "insurer", "care_giver", "care_code", "care_low")])
    p = p.select("content_type", first["root"].alias("root"), first["extension"].alias("extension"), "x.name", none.alias("use"), none.alias("part_of"), "x.birth_time", "x.gender", F.col("x.addr")[0]["street"].alias("street"), policy["id"]["extension"].alias("policy"), policy["low"].alias("policy_low"), policy["insurer"]["extension"].alias("insurer"), giver["id"]["extension"].alias("care_giver"), giver["code"].alias("care_code"), giver["low"].alias("care_low"))
    return o.unionByName(p)


def message_counters(spark: SparkSession, d: str) -> DataFrame:
    """Messages, documents and characters by kind of content, of acts sent as messages; those in error don't count."""
    a = table(spark, d, "act").where("_id is not null")
    root = F.when(F.col("rim_class") == "Document", "ClinicalDocument").when(F.col("rim_class") == "Act", "PatientUpdate").otherwise("Unknown")
    key = F.when(F.col("mood_code") == "EVN", "in.hl7v3.x").otherwise("in.other")
    sent = a.select(F.concat(F.lit("<"), root, F.lit('><id extension="'), F.col("_id").cast("string"), F.lit('"/></'), root, F.lit(">")).alias("payload"), key.alias("routing_key"))
    return ingest.counters(ingest.classified(sent).where("error is null"))


def message_errors(spark: SparkSession, d: str) -> DataFrame:
    """Acts sent as messages of which some have no route, a root that nobody knows, or no end: their errors as XML, read again."""
    a = table(spark, d, "act").where("_id is not null")
    root = F.when(F.col("rim_class") == "Document", "ClinicalDocument").otherwise("Unknown")
    end = F.when(F.col("status_code") == "active", F.lit("")).otherwise(F.concat(F.lit("</"), root, F.lit(">")))
    key = F.when(F.col("mood_code") == "EVN", "in.hl7v3.x").otherwise("in.other")
    sent = a.select(F.concat(F.lit("<"), root, F.lit('><id a="1 &lt; 2"/>'), end).alias("payload"), key.alias("routing_key"))
    failed = ingest.classified(sent).where("error is not null").select(ingest.envelope(F.col("error.type"), F.col("error.reason"), F.col("payload")).alias("e"))
    x = F.from_xml("e", "type string, reason string, source string")
    return failed.select(x["type"].alias("type"), x["reason"].alias("reason"), x["source"].startswith("<").alias("whole")).groupBy("type", "reason", "whole").agg(F.count(F.lit(1)).alias("n"))


def weight_hash_entities(spark: SparkSession, d: str) -> DataFrame:
    """Weights of organizations, patients and licensed entities, and how many differ in content."""
    ident = lambda k: F.when(k % 4 != 0, F.array(F.struct(F.lit("R").alias("root"), k.cast("string").alias("extension"))))
    mif = lambda k: F.when(k % 3 == 0, "TZDU_MT000001UV").otherwise("POCD_MT000040")
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    o = s.select(ident(F.col("s_suppkey")).alias("id"), mif(F.col("s_suppkey")).alias("_mif"), "s_name", F.col("s_nationkey").cast("string").alias("code")).withColumnRenamed("s_name", "name")
    p = c.select(ident(F.col("c_custkey")).alias("id"), mif(F.col("c_custkey")).alias("_mif"), F.col("c_custkey").alias("player"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("scoper"), F.col("c_mktsegment").alias("code"), F.lit("t").alias("typeId"))
    e = s.select(ident(F.col("s_suppkey")).alias("id"), mif(F.col("s_suppkey")).alias("_mif"), F.col("s_suppkey").alias("player"), F.when(F.col("s_acctbal") > 0, "2020").alias("recertificationTime"))
    out = None
    for kind, df in (("Organization", o), ("Patient", p), ("LicensedEntity", e)):
        one = staging.weighted_and_hashed(df, kind).groupBy(F.lit(kind).alias("kind"), F.col("_record_weight").cast("long").alias("weight")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_record_hash").alias("contents"))
        out = one if out is None else out.unionByName(one)
    return out


def stream_poison(spark: SparkSession, d: str) -> DataFrame:
    """Regions as messages of which one makes the load fail: it alone is set aside, the others are loaded."""
    at = scratch(spark, "poison")
    r = table(spark, d, "region")
    r.select(F.concat(F.lit('<ClinicalDocument name="'), "r_name", F.lit('"/>')).alias("value")).write.text(f"{at}/in")
    poison = F.col("payload").contains("EUROPE")
    load = lambda m: m.select("content_type", F.when(poison, F.raise_error(F.lit("no such region"))).otherwise(F.length("payload")).cast("long").alias("size"))
    p = ingest.Pipeline(spark, f"{at}/good", f"{at}/bad", f"{at}/state", load=load)
    p.start(spark.readStream.format("text").load(f"{at}/in").select(F.col("value").alias("payload"), F.lit("in.hl7v3").alias("routing_key"))).awaitTermination()
    good = spark.read.schema("content_type string, size long").parquet(f"{at}/good").select(F.lit("loaded").alias("what"), F.col("size"))
    bad = spark.read.schema("type string, reason string, source string").parquet(f"{at}/bad").select(F.col("type").alias("what"), F.length("source").cast("long").alias("size"))
    return good.unionByName(bad)


# --- generated records ---------------------------------------------------------------------------------------------


def gen_organizations(spark: SparkSession, d: str) -> DataFrame:
    """Organisations and practices below 20 care groups."""
    return bayes.organizations(spark, 20, seed=5)


def gen_visits(spark: SparkSession, d: str) -> DataFrame:
    """Two visits in the year of age 60 and one at 70, at random days, up to a last day."""
    p = V.persons(spark, d).select("_id", "birth_date")
    return bayes.visits(p, "_id", {60: 2, 61: 0, 70: 1}, "birth_date", "2020-06-30", seed=3).groupBy("age", F.year("exam_date").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.max("exam_date").cast("string").alias("last"))


def gen_masked(spark: SparkSession, d: str) -> DataFrame:
    """Names, nations and balances of customers with 40 % of the values left out; no row loses all of them."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal")
    return bayes.masked(c, ["c_name", "c_nationkey", "c_acctbal"], 0.4, "c_custkey", seed=9)


def gen_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Practice sizes per supplier from a weighted sum of normal numbers."""
    s = table(spark, d, "supplier").select("s_suppkey")
    return s.select("s_suppkey", bayes.sum_of_gaussians([F.col("s_suppkey")], [900.0, 2500.0], [200.0, 600.0], [0.7, 0.3], seed=4).alias("patients"))


# --- stored tables and files ---------------------------------------------------------------------------------------


def versioned_table(spark: SparkSession, d: str) -> DataFrame:
    """A table that is written, appended to, partly deleted and emptied; a version that is current is read whole."""
    t = files.VersionedTable(spark, scratch(spark, "table"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    seen = []
    for name, change in (("written", lambda: t.write(n)), ("appended", lambda: t.append(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(9).alias("r")))), ("deleted", lambda: t.delete(table(spark, d, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("r")), ["r"])), ("emptied", t.truncate)):
        change()
        seen.append(t.read().agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("total")))
    return seen[0].union(seen[1]).union(seen[2]).union(seen[3])


def analysed_table(spark: SparkSession, d: str) -> DataFrame:
    """Orders per customer stored as a table of the catalogue with statistics, and read through a view."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    files.analysed(o, "orders_per_customer", scratch(spark, "catalogue")).createOrReplaceTempView("frequent_customers")
    return spark.sql("SELECT orders, count(*) AS customers FROM frequent_customers GROUP BY orders")


def unit_file(spark: SparkSession, d: str) -> DataFrame:
    """Units of codes through a CSV file with a header; rows without a code are left out."""
    at = scratch(spark, "units")
    u = table(spark, d, "unit_reference").select("code", "unit").unionByName(table(spark, d, "unit_reference").select(F.lit(None).cast("string").alias("code"), "unit"))
    u.write.csv(at, header=True)
    return files.unit_table(spark, at)


def message_files(spark: SparkSession, d: str) -> DataFrame:
    """A directory of documents, each file one message of several lines."""
    at = scratch(spark, "messages")
    n = table(spark, d, "nation").select(F.concat(F.lit("<n>"), "n_name", F.lit("</n>")).alias("value"), "n_regionkey")
    n.repartition(1).sortWithinPartitions("value").write.partitionBy("n_regionkey").text(at)
    m = files.messages(spark, f"{at}/*")
    return m.select(F.length("payload").cast("long").alias("characters"), (F.size(F.split("payload", "\n")) - 1).cast("long").alias("lines"))


def id_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders and parts numbered from two ranges: how many ids, how many different, and whether they lie in their range."""
    ranges, out = staging.IdRanges(count=16, bits=40), None
    for name, key in (("orders", "o_orderkey"), ("part", "p_partkey")):
        start, end = ranges.take()
        ids = staging.with_ids(table(spark, d, name).select(key), start, end)
        one = ids.agg(F.lit(name).alias("name"), F.count("_id").alias("n"), F.count_distinct("_id").alias("different"), F.bool_and(F.col("_id").between(start, end)).alias("inside"))
        out = one if out is None else out.unionByName(one)
    return out


# --- single functions ----------------------------------------------------------------------------------------------


def id_root_filter(spark: SparkSession, d: str) -> DataFrame:
    """Extensions under one root, and whether all identifiers of a record are among those its cluster's master has."""
    rows = latest_version(table(spark, d, "resolution_a").where("_id is not null"), ["_id"], columns=["_id_cluster", "id", "_id_extension"]).where("_id_cluster is not null")
    master = rows.where("_id = _id_cluster").select("_id_cluster", F.col("_id_extension").alias("of_master"))
    met = rows.join(master, "_id_cluster")
    return met.select("_id", F.array_join(S.with_root(F.col("id"), "2.999.31.3.4"), " ").alias("extensions"), S.contained(F.col("_id_extension"), F.col("of_master")).alias("contained"))


def bool_over(spark: SparkSession, d: str) -> DataFrame:
    """Whether any, and whether all, observations of a code in a year are negated; the groups are few, so they are aggregated and joined back."""
    o = table(spark, d, "act").where("rim_class = 'Observation' and _id is not null").select("_id", "code", F.year("effective_low").cast("long").alias("y"), "negation_ind", "_lake_timestamp")
    of = o.groupBy(F.col("code").alias("c"), F.col("y").alias("z")).agg(F.bool_or("negation_ind").alias("any_negated"), F.bool_and("negation_ind").alias("all_negated"))
    met = o.join(of, F.col("code").eqNullSafe(F.col("c")) & F.col("y").eqNullSafe(F.col("z")))
    return met.groupBy("code", "y", "any_negated", "all_negated").agg(F.count(F.lit(1)).alias("n"))


def json_build(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects built from columns, merged with others whose members win, and taken apart again."""
    c = table(spark, d, "customer")
    base = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    extra = F.to_json(F.struct(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_mktsegment").alias("segment")))
    as_map = lambda j: F.from_json(j, "map<string,string>")
    merged = F.map_concat(F.map_filter(as_map(base), lambda k, v: ~F.array_contains(F.map_keys(as_map(extra)), k)), as_map(extra))
    each = c.select("c_custkey", F.explode(F.from_json(F.to_json(merged), "map<string,string>")).alias("member", "value"))
    return each.select("c_custkey", "member", "value")


QUERIES = {
    f.__name__: f
    for f in (
        er_batch, er_applied, act_provisions, fhir_updates, message_counters, message_errors, weight_hash_entities, stream_poison, gen_organizations, gen_visits, gen_masked, gen_sizes, versioned_table, analysed_table, unit_file,
        message_files, id_ranges, id_root_filter, bool_over, json_build,
    )
}


def _uniform(keys: str, seed: int, name: str) -> str:
    return f"((CAST('0x' || substr(md5({keys} || '|{seed}|{name}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"


def _normal(keys: str, seed: int, name: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(keys, seed, name + '#1')})) * cos(2 * pi() * {_uniform(keys, seed, name + '#2')}))"


_LATEST_A = """one AS (SELECT _id, _id_cluster, id, _id_extension, _record_hash, _record_weight FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY _lake_timestamp DESC NULLS LAST) AS k FROM resolution_a WHERE _id IS NOT NULL) WHERE k = 1)"""
_ER_BATCH = f"""{_LATEST_A}, new AS (SELECT * FROM one WHERE _id_cluster IS NULL), known AS (SELECT * FROM one WHERE _id_cluster IS NOT NULL),
    ids AS (SELECT DISTINCT _id, x.root AS root, x.extension AS e FROM (SELECT _id, unnest(id) AS x FROM one) WHERE x.extension IS NOT NULL),
    met AS (SELECT n._id, min(struct_pack(c := k._id_cluster, t := k._id)) AS b FROM new n JOIN ids i ON i._id = n._id JOIN ids j ON j.root IS NOT DISTINCT FROM i.root AND j.root IS NOT NULL AND j.e = i.e JOIN known k ON k._id = j._id AND k._record_hash = n._record_hash GROUP BY n._id),
    rest AS (SELECT * FROM new WHERE _id NOT IN (SELECT _id FROM met)), near AS (SELECT DISTINCT a._id AS x, b._id AS y FROM ids a JOIN ids b ON a.root = b.root AND a.e = b.e JOIN rest r ON r._id = a._id JOIN rest s ON s._id = b._id),
    reach AS (SELECT _id, _id AS seen FROM rest UNION SELECT reach._id, y FROM reach JOIN near ON x = seen), comp AS (SELECT _id, min(seen) AS c FROM reach GROUP BY _id),
    ranked AS (SELECT r._id, r._record_hash AS h, coalesce(r._record_weight, 0) AS w, first_value(r._id) OVER (PARTITION BY c ORDER BY coalesce(r._record_weight, 0) DESC, r._id) AS cluster FROM rest r JOIN comp USING (_id)),
    er AS (SELECT _id, cluster AS _id_cluster, nullif(first_value(_id) OVER (PARTITION BY cluster, h ORDER BY CASE WHEN _id = cluster THEN 0 ELSE 1 END, w DESC, _id), _id) AS dedup_new_id FROM ranked UNION ALL SELECT _id, b.c, b.t FROM met)"""

SQL = {
    "er_batch": f"WITH RECURSIVE {_ER_BATCH} SELECT * FROM er",
    "er_applied": f"WITH RECURSIVE {_ER_BATCH}, kept AS (SELECT _id_cluster, count(*) AS kept FROM er WHERE dedup_new_id IS NULL GROUP BY _id_cluster) SELECT kept, count(*) AS clusters, CAST(0 AS BIGINT) AS broken FROM kept GROUP BY kept",
    "act_provisions": "SELECT c_custkey * 10 + x AS act_id, 'CP-' || c_nationkey AS care_provision, c_custkey AS patient_id FROM customer, (VALUES (0), (1), (2), (3), (9)) t(x)",
    "fhir_updates": """SELECT 'TZDU_IN000001UV' AS content_type, '2.999.7' AS root, CAST(s_suppkey AS VARCHAR) AS extension, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'HP' ELSE 'WP' END AS use, 'Organization/' || s_nationkey AS part_of, NULL AS birth_time, NULL AS gender, NULL AS street, NULL AS policy, NULL AS policy_low, NULL AS insurer, NULL AS care_giver, NULL AS care_code, NULL AS care_low FROM supplier
        UNION ALL SELECT 'TZDU_IN000003UV', '2.999.8', CAST(c_custkey AS VARCHAR), 'A ' || c_name, NULL, NULL, '1950020' || (c_custkey % 9 + 1), CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END, 'Road ' || c_custkey, 'P' || c_custkey, '20100521000000', CAST(c_nationkey AS VARCHAR), 'G' || c_custkey, 'GP', '20130521000000' FROM customer""",
    "message_counters": """SELECT CASE rim_class WHEN 'Document' THEN 'CDA_R2' ELSE 'TZDU_IN000003UV' END AS content_type, count(*) AS messages, CAST(sum(length(CAST(_id AS VARCHAR)) + CASE rim_class WHEN 'Document' THEN 55 ELSE 49 END) AS BIGINT) AS characters, count(*) FILTER (rim_class = 'Document') AS documents
        FROM act WHERE _id IS NOT NULL AND mood_code = 'EVN' AND rim_class IN ('Document', 'Act') GROUP BY rim_class""",
    "message_errors": """SELECT CASE WHEN mood_code IS DISTINCT FROM 'EVN' THEN 'unrouted' WHEN status_code = 'active' THEN 'validation' ELSE 'internal' END AS type, CASE WHEN mood_code IS DISTINCT FROM 'EVN' THEN 'no route for in.other' WHEN status_code = 'active' THEN 'not well-formed' ELSE 'unknown root element Unknown' END AS reason, true AS whole, count(*) AS n
        FROM act WHERE _id IS NOT NULL AND (mood_code IS DISTINCT FROM 'EVN' OR status_code = 'active' OR rim_class IS DISTINCT FROM 'Document') GROUP BY ALL""",
    "weight_hash_entities": """WITH s AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 2000 ELSE 0 END + CASE WHEN s_suppkey % 4 <> 0 THEN 1000 ELSE 0 END AS w, * FROM supplier), c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 2000 ELSE 0 END + CASE WHEN c_custkey % 4 <> 0 THEN 1000 ELSE 0 END AS w, * FROM customer)
        SELECT 'Organization' AS kind, CAST(w + 101 AS BIGINT) AS weight, count(*) AS n, count(DISTINCT s_name || s_nationkey) AS contents FROM s GROUP BY w UNION ALL SELECT 'Patient', CAST(w + 102 + CASE WHEN c_nationkey > 5 THEN 100 ELSE 0 END AS BIGINT) AS v, count(*), count(DISTINCT c_mktsegment) FROM c GROUP BY v
        UNION ALL SELECT 'LicensedEntity', CAST(w + 100 + CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS BIGINT) AS v, count(*), count(DISTINCT s_acctbal > 0) FROM s GROUP BY v""",
    "stream_poison": """SELECT CASE WHEN r_name = 'EUROPE' THEN 'load' ELSE 'loaded' END AS what, CAST(length('<ClinicalDocument name="' || r_name || '"/>') AS BIGINT) AS size FROM region""",
    "gen_organizations": f"""WITH top AS (SELECT CAST(range AS BIGINT) AS _id FROM range(1, 21)), mid AS (SELECT _id * 1000 + k AS _id, _id AS parent FROM (SELECT _id, unnest(range(1, CAST(10 + floor({_uniform("_id", 5, "parts")} * 50) AS BIGINT) + 2)) AS k FROM top)),
        leaf AS (SELECT _id * 1000 + k AS _id, _id AS parent FROM (SELECT _id, unnest(range(1, CAST(floor({_uniform("_id", 6, "parts")} * 5) AS BIGINT) + 2)) AS k FROM mid))
        SELECT _id, CAST(NULL AS BIGINT) AS parent, 0 AS level FROM top UNION ALL SELECT _id, parent, 1 FROM mid UNION ALL SELECT _id, parent, 2 FROM leaf""",
    "gen_visits": with_views("persons", f"""a(age, k) AS (VALUES (60, 1), (60, 2), (70, 1)), v AS (SELECT age, CAST(birth_date + to_months(age * 12) + to_days(CAST(floor({_uniform("_id || '|' || age || '|' || k", 3, "day")} * 365) AS INTEGER)) AS DATE) AS x FROM persons, a)
        SELECT age, year(x) AS y, count(*) AS n, CAST(max(x) AS VARCHAR) AS last FROM v WHERE x <= DATE '2020-06-30' GROUP BY ALL"""),
    "gen_masked": f"""WITH m AS (SELECT *, {_uniform("c_custkey", 9, "c_name")} < 0.4 AS a, {_uniform("c_custkey", 9, "c_nationkey")} < 0.4 AS b, {_uniform("c_custkey", 9, "c_acctbal")} < 0.4 AS c, CAST(floor({_uniform("c_custkey", 9, "kept")} * 3) AS INTEGER) AS one FROM customer)
        SELECT c_custkey, CASE WHEN NOT a OR (b AND c AND one = 0) THEN c_name END AS c_name, CASE WHEN NOT b OR (a AND c AND one = 1) THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey, CASE WHEN NOT c OR (a AND b AND one = 2) THEN c_acctbal END AS c_acctbal FROM m""",
    "gen_sizes": f"SELECT s_suppkey, CAST(greatest(0, floor(0.7 * ({_normal('s_suppkey', 4, 'sum 0')} * 200 + 900) + 0.3 * ({_normal('s_suppkey', 4, 'sum 1')} * 600 + 2500))) AS BIGINT) AS patients FROM supplier",
    "versioned_table": """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), a AS (SELECT * FROM n UNION ALL SELECT s_nationkey, 9 FROM supplier), x AS (SELECT * FROM a WHERE r NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))
        SELECT 'written' AS step, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM n UNION ALL SELECT 'appended', count(*), CAST(sum(k) AS BIGINT) FROM a UNION ALL SELECT 'deleted', count(*), CAST(sum(k) AS BIGINT) FROM x UNION ALL SELECT 'emptied', 0, 0""",
    "analysed_table": "SELECT orders, count(*) AS customers FROM (SELECT count(*) AS orders FROM orders GROUP BY o_custkey) GROUP BY orders",
    "unit_file": "SELECT code, unit FROM unit_reference",
    "message_files": "SELECT CAST(sum(length(n_name) + 8) AS BIGINT) AS characters, count(*) AS lines FROM nation GROUP BY n_regionkey",
    "id_ranges": "SELECT 'orders' AS name, count(*) AS n, count(*) AS different, true AS inside FROM orders UNION ALL SELECT 'part', count(*), count(*), true FROM part",
    "id_root_filter": f"WITH {_LATEST_A}, k AS (SELECT * FROM one WHERE _id_cluster IS NOT NULL) SELECT k._id, coalesce(array_to_string(list_transform(list_filter(k.id, lambda x: x.root = '2.999.31.3.4'), lambda x: x.extension), ' '), CASE WHEN k.id IS NOT NULL THEN '' END) AS extensions, list_has_all(m._id_extension, k._id_extension) AS contained FROM k JOIN k m ON m._id = k._id_cluster",
    "bool_over": """WITH o AS (SELECT code, year(effective_low) AS y, bool_or(negation_ind) OVER w AS any_negated, bool_and(negation_ind) OVER w AS all_negated FROM act WHERE rim_class = 'Observation' AND _id IS NOT NULL WINDOW w AS (PARTITION BY code, year(effective_low)))
        SELECT code, y, any_negated, all_negated, count(*) AS n FROM o GROUP BY ALL""",
    "json_build": """WITH m AS (SELECT c_custkey, json_merge_patch(json_object('id', c_custkey, 'name', c_name), json_object('name', 'C-' || c_custkey, 'segment', c_mktsegment)) AS j FROM customer)
        SELECT c_custkey, unnest(json_keys(j)) AS member, json_extract_string(j, '$.' || unnest(json_keys(j))) AS value FROM m""",
}
