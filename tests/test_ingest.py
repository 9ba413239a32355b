import pytest
from pyspark.sql import functions as F

from vitalis.generate import bayes
from vitalis.sources.files import VersionedTable, message_stream, messages
from vitalis.streaming.ingest import Pipeline, classified, fhir_organization, fhir_person, unresolved

CDA = '<?xml version="1.0"?><v3:ClinicalDocument xmlns:v3="urn:hl7-org:v3"><id extension="1"/></v3:ClinicalDocument>'


def test_messages_are_classified(spark):
    data = [(CDA, "ingress.hl7v3.x"), ("<Patient xmlns='urn'><id value='1'/></Patient>", "ingress.fhir.x"), ("<Strange/>", "ingress.hl7v3.x"), ("no xml", "ingress.hl7v3.x"), ("<ClinicalDocument>", "ingress.hl7v3.x"), (CDA, "other"), (None, "ingress.hl7v3.x"), (CDA, None)]
    out = [(r["content_type"], r["error"]["type"] if r["error"] else None) for r in classified(spark.createDataFrame(data, "payload string, routing_key string")).collect()]
    assert out[0] == ("CDA_R2", None) and out[1] == ("TZDU_IN000003UV", None)
    assert [e for _, e in out[2:]] == ["internal", "validation", "validation", "unrouted", "validation", "unrouted"]


def test_pipeline_loads_or_quarantines_every_message(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(7):
        (source / f"{k}.xml").write_text(CDA if k % 3 else "<broken")
    p = Pipeline(spark, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state")
    stream = message_stream(spark, str(source), files_at_once=3).withColumn("routing_key", F.lit("a.hl7v3.b"))
    p.start(stream).awaitTermination()
    assert (p.sent, p.loaded, p.quarantined) == (7, 4, 3)
    assert spark.read.parquet(f"{tmp_path}/good").count() == 4
    (source / "8.xml").write_text(CDA)
    p.start(stream).awaitTermination()
    assert p.sent == 8 and messages(spark, str(source)).count() == 8


def test_a_failing_load_quarantines_its_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.xml").write_text(CDA)
    p = Pipeline(spark, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state", load=lambda df: df.select(F.raise_error(F.lit("no")).alias("x")))
    p.start(message_stream(spark, str(source)).withColumn("routing_key", F.lit("a.hl7v3.b"))).awaitTermination()
    assert (p.loaded, p.quarantined) == (0, 1)


def test_fhir_updates(spark):
    x = '<Organization xmlns="http://hl7.org/fhir"><identifier><system value="urn:oid:2.999.5"/><value value="77"/></identifier><name value="Clinic"/><telecom><system value="phone"/><value value="012"/><use value="home"/></telecom><telecom><use value="work"/><value value="034"/></telecom><partOf><reference value="Organization/9"/></partOf></Organization>'
    o = spark.createDataFrame([(x,)], "p string").select(fhir_organization(F.col("p")).alias("o")).select("o.*")
    r = o.head()
    assert (r["id"][0]["root"], r["id"][0]["extension"], r["name"], r["part_of"]) == ("2.999.5", "77", "Clinic", "Organization/9")
    assert [t["use"] for t in r["telecom"]] == ["HP", "WP"]
    assert unresolved(o, "part_of", spark.createDataFrame([("Organization/1",)], "k string"), "k").count() == 1
    y = '<Patient xmlns="http://hl7.org/fhir"><identifier><system value="2.999.6"/><value value="8"/></identifier><name><family value="Doe"/><given value="J"/></name><birthDate value="2010-10-10"/><gender value="female"/></Patient>'
    r = spark.createDataFrame([(y,)], "p string").select(fhir_person(F.col("p")).alias("o")).select("o.*").head()
    assert (r["name"], r["birth_time"], r["gender"], r["scoper"]) == ("J Doe", "20101010", "F", None)


def test_fhir_patient_and_practitioner_in_full(spark):
    extension = lambda of: f'<extension url="x"><valueIdentifier><system value="urn:oid:2.999.1"/><value value="{of}"/></valueIdentifier></extension>'
    x = (
        '<Patient xmlns="http://hl7.org/fhir"><identifier><system value="urn:oid:2.999.2"/><value value="77"/></identifier><identifier><system value="urn:oid:2.999.3"/><value value="P1"/><period><start value="2010-05-21T00:00:00"/></period>'
        f'<assigner>{extension("I1")}<reference value="Organization/5"/></assigner></identifier><name><use value="usual"/><family value="Doe"/><given value="Ann"/></name><name><use value="maiden"/><family value="Roe"/></name>'
        '<telecom><system value="email"/><value value="a@b.example"/><use value="home"/></telecom><telecom><system value="phone"/><value value="06"/><use value="mobile"/></telecom><gender><coding><code value="F"/></coding></gender><birthDate value="1951-09-09T00:00:00"/>'
        '<address><line value="Road 1"/><city value="TOWN"/><zip value="1234AB"/><period><start value="2013-05-21T00:00:00"/></period></address>'
        f'<careProvider>{extension("G1")}<extension url="r"><valueString value="GP"/></extension><extension url="t"><valueDateTime value="2013-05-21T00:00:00"/></extension></careProvider><managingOrganization><reference value="Organization/9"/></managingOrganization></Patient>'
    )
    y = '<Practitioner xmlns="http://hl7.org/fhir"><identifier><system value="urn:oid:2.999.4"/><value value="8"/></identifier><name><family value="Poe"/></name><specialty><coding><code value="specialist"/></coding></specialty></Practitioner>'
    r, q = (row["o"] for row in spark.createDataFrame([(1, x), (2, y)], "k int, p string").select("k", fhir_person(F.col("p")).alias("o")).orderBy("k").collect())
    assert [tuple(i) for i in r["id"]] == [("2.999.2", "77")] and r["name"] == "Ann Doe" and [t["use"] for t in r["telecom"]] == ["H", "MC"]
    assert (r["birth_time"], r["gender"], r["scoper"]) == ("19510909000000", "F", "Organization/9")
    assert [tuple(a) for a in r["addr"]] == [("Road 1", "TOWN", "1234AB", "20130521000000")]
    h, g = r["policy_holder"][0], r["care_giver"][0]
    assert (h["id"]["extension"], h["low"], h["insurer"]["extension"]) == ("P1", "20100521000000", "I1") and (g["code"], g["low"], g["id"]["extension"]) == ("GP", "20130521000000", "G1")
    assert q["qualification"] == ["specialist"] and q["policy_holder"] in ([], None) and q["name"] == "Poe"


def test_poison_messages_are_set_aside_alone(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(12):
        (source / f"{k}.xml").write_text(f'<ClinicalDocument n="{k}"/>' if k else "<broken")
    bad = F.col("payload").contains('"3"') | F.col("payload").contains('"7"')
    load = lambda df: df.select(F.when(bad, F.raise_error(F.lit("cannot be loaded"))).otherwise(F.col("payload")).alias("payload"))
    p = Pipeline(spark, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state", load=load)
    df = messages(spark, str(source)).withColumn("routing_key", F.lit("a.hl7v3.b"))
    p.batch(df, 1)
    assert (p.sent, p.loaded, p.quarantined) == (12, 9, 3)
    p.batch(df, 1)  # run again after a failure: replaced, not added
    assert spark.read.schema("payload string").parquet(f"{tmp_path}/good").count() == 9
    aside = spark.read.parquet(f"{tmp_path}/bad").collect()
    assert sorted(r["type"] for r in aside) == ["load", "load", "validation"] and all("cannot be loaded" in r["reason"] for r in aside if r["type"] == "load")


def test_failures_of_the_machines_set_nothing_aside(spark, tmp_path):
    def full(df):
        raise OSError("No space left on device")

    p = Pipeline(spark, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state", load=full)
    with pytest.raises(OSError):
        p.batch(spark.createDataFrame([(CDA, "a.hl7v3.b")], "payload string, routing_key string"), 1)
    assert p.sent == 0 and not (tmp_path / "bad").exists()


def test_draws_do_not_depend_on_partitions(spark):
    base = spark.range(200).withColumn("age", F.lit(40))
    number = bayes.Numeric("x", 100.0, 5.0, {"age": 0.5})
    one, many = (sorted(map(tuple, bayes.sample(b, [number], 3, key=["id"]).collect())) for b in (base.coalesce(1), base.repartition(7)))
    assert one == many and abs(sum(r[2] for r in one) / 200 - 120) < 1.5


def test_versioned_tables(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    assert t.read() is None
    t.write(spark.range(5))
    t.append(spark.range(5, 8))
    t.delete(spark.range(2), ["id"])
    assert sorted(r["id"] for r in t.read().collect()) == [2, 3, 4, 5, 6, 7]


def test_sampling(spark):
    base = spark.range(20_000)
    child = bayes.read_discrete("smokes", {"smokes": ["y", "n", "y", "n"], "sex": ["F", "F", "M", "M"], "Freq": [0.2, 0.8, 0.6, 0.4]})
    root = bayes.read_discrete("sex", {"Var1": ["F", "M", "X"], "Freq": [1, 1, 0]})
    number = bayes.read_numeric("pressure", {"(Intercept)": 100.0, "sd": 5.0, "age": 0.5})
    out = bayes.sample(base.withColumn("age", F.lit(40)), [child, number, root], seed=3)
    share = {r["sex"]: r["s"] for r in out.groupBy("sex").agg(F.avg((F.col("smokes") == "y").cast("int")).alias("s")).collect()}
    assert set(share) == {"F", "M"} and abs(share["F"] - 0.2) < 0.02 and abs(share["M"] - 0.6) < 0.02
    assert abs(out.agg(F.avg("pressure")).head()[0] - 120) < 0.3
    assert bayes.sample(base, [root], 1, {"sex": "M"}).select("sex").distinct().head()[0] == "M"
    with pytest.raises(ValueError):
        bayes.ordered([bayes.Numeric("a", 0, 1, {"b": 1}), bayes.Numeric("b", 0, 1, {"a": 1})])
    assert bayes.clean_code("pq_a.b") == "a-b"


def test_generated_rows(spark):
    orgs = bayes.organizations(spark, 2, seed=1)
    levels = {r["level"]: r["count"] for r in orgs.groupBy("level").count().collect()}
    assert levels[0] == 2 and 22 <= levels[1] <= 120 and levels[2] >= levels[1]
    assert orgs.select("_id").distinct().count() == orgs.count()
    full = spark.range(500).select("id", F.lit(1).alias("a"), F.lit(2).alias("b"))
    some = bayes.masked(full, ["a", "b"], 0.9, "id", 1)
    assert some.columns == full.columns and some.where("a is null and b is null").count() == 0 and some.where("a is null").count() > 100
    people = spark.createDataFrame([(1, "1950-01-01")], "i long, b string").withColumn("b", F.to_date("b"))
    v = bayes.visits(people, people.columns[0], {50: 3, 51: 0, 90: 2}, "b", "2010-01-01")
    assert v.count() == 3 and v.columns == ["i", "b", "age", "exam_date"]


def test_gate_has_hysteresis():
    from vitalis.streaming.flow import Gate

    g = Gate(4)
    assert all(g.sent() for _ in range(4)) and not g.sent()
    assert not g.done() and not g.done() and not g.done() and g.done()
    assert g.in_flight == 1


def test_counters_of_a_stream(spark, tmp_path):
    import time

    from vitalis.streaming.flow import Counters

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.xml").write_text(CDA)
    c = Counters()
    spark.streams.addListener(c)
    try:
        message_stream(spark, str(source)).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if c.batches:
                break
            time.sleep(0.2)
        assert c.read()["rows"] == 1 and c.read()["batches"] == 0
    finally:
        spark.streams.removeListener(c)


def test_rows_that_break_the_schema_document(spark, tmp_path):
    from vitalis.sources.files import unit_table, xml_rows

    (tmp_path / "e.xsd").write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="error"><xs:complexType><xs:sequence><xs:element name="type" type="xs:string"/><xs:element name="n" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    (tmp_path / "m.xml").write_text("<all><error><type>a</type><n>1</n></error><error><type>b</type><n>x</n></error></all>")
    out = xml_rows(spark, f"{tmp_path}/m.xml", "error", "type string, n string", f"{tmp_path}/e.xsd").cache()
    assert [(r["type"], r["_corrupt_record"] is None) for r in out.collect()][0] == ("a", True)
    assert out.where("_corrupt_record is not null").count() == 1
    (tmp_path / "u.csv").write_text("code,unit\nA,kg\n,m\n")
    assert [tuple(r) for r in unit_table(spark, f"{tmp_path}/u.csv").collect()] == [("A", "kg")]
