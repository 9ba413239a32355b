"""Messages to warehouse rows: route, validate, classify, transform and load, with a quarantine for what fails.

All per-message steps are column expressions on one stream; a micro-batch is loaded by foreachBatch, in which good and
bad rows are told apart and both written, so loaded + quarantined = sent. A batch's number names its output, so a batch
that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalis.functions.semantics import compact_time, oid_of, telecom_use
from vitalis.session import cut, discard, remove

#: fixed values: root element names and the content they announce
CONTENT_TYPES = {"ClinicalDocument": "CDA_R2", "OrganizationUpdate": "TZDU_IN000001UV", "PractitionerUpdate": "TZDU_IN000002UV", "PatientUpdate": "TZDU_IN000003UV"}
FHIR_ROOTS = ("Organization", "Practitioner", "Patient")


def root_name(payload: Column) -> Column:
    """The local name of the root element; null where the text is no XML."""
    name = F.regexp_extract(payload, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    return F.when(name != "", name)


def content_type(root: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in CONTENT_TYPES.items():
        out = F.when(root == name, kind).otherwise(out)
    return out


def route(routing_key: Column) -> Column:
    """hl7v3 or fhir by a part of the routing key; null is unrouted."""
    return F.when(routing_key.rlike(r"(^|\.)hl7v3(\.|$)"), "hl7v3").when(routing_key.rlike(r"(^|\.)fhir(\.|$)"), "fhir")


def well_formed(payload: Column) -> Column:
    """Whether the text is XML, as far as the parser can read it."""
    parsed = F.from_xml(payload, "_corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    closed = payload.rlike(r"(?s)(?:</(?:[\w.-]+:)?[\w.-]+\s*>|/>)\s*$")
    return parsed["_corrupt_record"].isNull() & closed


def classified(messages: DataFrame) -> DataFrame:
    """messages (payload, routing_key) with ingress_ts, route, root, content_type, and an error (type and reason) where one is found."""
    m = messages.withColumn("ingress_ts", F.current_timestamp()).withColumn("route", route(F.col("routing_key"))).withColumn("root", root_name(F.col("payload")))
    m = m.withColumn("content_type", F.when(F.col("route") == "fhir", F.when(F.col("root").isin(*FHIR_ROOTS), F.concat(F.col("root"), F.lit("Update")))).otherwise(F.col("root")))
    m = m.withColumn("content_type", content_type(F.col("content_type")))
    error = (
        F.when(F.col("route").isNull(), F.struct(F.lit("unrouted").alias("type"), F.concat(F.lit("no route for "), F.coalesce("routing_key", F.lit("null"))).alias("reason")))
        .when(F.col("root").isNull() | ~well_formed(F.col("payload")), F.struct(F.lit("validation").alias("type"), F.lit("not well-formed").alias("reason")))
        .when(F.col("content_type").isNull(), F.struct(F.lit("internal").alias("type"), F.concat(F.lit("unknown root element "), F.col("root")).alias("reason")))
    )
    return m.withColumn("error", error)


ORGANIZATION = "identifier array<struct<system:struct<_value:string>,value:struct<_value:string>>>, name struct<_value:string>, telecom array<struct<system:struct<_value:string>,value:struct<_value:string>,use:struct<_value:string>>>, partOf struct<reference:struct<_value:string>>"


def fhir_organization(payload: Column) -> Column:
    """The update of an organization: identifiers with plain OIDs, telecoms with use codes, and what it is part of."""
    return _once(F.from_xml(payload, ORGANIZATION, {"attributePrefix": "_"}), _organization)


def _once(parsed: Column, build: Callable[[Column], Column]) -> Column:
    """build(parsed), where the text is parsed once and not for each member that is asked for."""
    return F.transform(F.array(parsed), build)[0]


def _organization(x: Column) -> Column:
    ids = F.transform(x["identifier"], lambda i: F.struct(oid_of(i["system"]["_value"]).alias("root"), i["value"]["_value"].alias("extension")))
    tel = F.transform(x["telecom"], lambda t: F.struct(telecom_use(t["use"]["_value"], t["system"]["_value"]).alias("use"), t["value"]["_value"].alias("value")))
    return F.struct(ids.alias("id"), x["name"]["_value"].alias("name"), tel.alias("telecom"), x["partOf"]["reference"]["_value"].alias("part_of"))


_V = "struct<_value:string>"
_ID = f"struct<system:{_V},value:{_V}>"
_EXTENSION = f"array<struct<valueIdentifier:{_ID},valueString:{_V},valueDateTime:{_V}>>"
PERSON = (
    f"identifier array<struct<system:{_V},value:{_V},period:struct<start:{_V}>,assigner:struct<extension:{_EXTENSION}>>>, name array<struct<family:array<{_V}>,given:array<{_V}>>>, telecom array<struct<system:{_V},value:{_V},use:{_V}>>, "
    f"birthDate {_V}, gender struct<_value:string,coding:array<struct<code:{_V}>>>, address array<struct<line:array<{_V}>,city:{_V},zip:{_V},period:struct<start:{_V}>>>, "
    f"careProvider array<struct<extension:{_EXTENSION}>>, managingOrganization struct<reference:{_V},extension:{_EXTENSION}>, specialty array<struct<coding:array<struct<code:{_V}>>>>"
)


def _extension(owner: Column, member: str) -> Column:
    """The first extension's value of a kind; extensions are told apart by what they hold."""
    return F.filter(owner["extension"], lambda e: e[member].isNotNull())[0][member]


def fhir_person(payload: Column) -> Column:
    """The update of a patient or practitioner, with addresses, policies (identifiers that an insurer assigned) and care givers."""
    return _once(F.from_xml(payload, PERSON, {"attributePrefix": "_"}), _person)


def _person(x: Column) -> Column:
    ident = lambda i: F.struct(oid_of(i["system"]["_value"]).alias("root"), i["value"]["_value"].alias("extension"))
    since = lambda of: compact_time(of["period"]["start"]["_value"]).alias("low")
    part = lambda p: F.transform(x["name"][0][p], lambda v: v["_value"])
    policies = F.transform(F.filter(x["identifier"], lambda i: i["assigner"].isNotNull()), lambda i: F.struct(ident(i).alias("id"), since(i), ident(_extension(i["assigner"], "valueIdentifier")).alias("insurer")))
    givers = F.transform(x["careProvider"], lambda c: F.struct(_extension(c, "valueString")["_value"].alias("code"), compact_time(_extension(c, "valueDateTime")["_value"]).alias("low"), ident(_extension(c, "valueIdentifier")).alias("id")))
    return F.struct(
        F.transform(F.filter(x["identifier"], lambda i: i["assigner"].isNull()), ident).alias("id"),
        F.concat_ws(" ", part("given"), part("family")).alias("name"),
        F.transform(x["telecom"], lambda t: F.struct(telecom_use(t["use"]["_value"], t["system"]["_value"]).alias("use"), t["value"]["_value"].alias("value"))).alias("telecom"),
        compact_time(x["birthDate"]["_value"]).alias("birth_time"),
        F.coalesce(x["gender"]["coding"][0]["code"]["_value"], F.upper(F.substring(x["gender"]["_value"], 1, 1))).alias("gender"),
        F.transform(x["address"], lambda a: F.struct(F.array_join(F.transform(a["line"], lambda v: v["_value"]), " ").alias("street"), a["city"]["_value"].alias("city"), a["zip"]["_value"].alias("postal_code"), since(a))).alias("addr"),
        policies.alias("policy_holder"),
        givers.alias("care_giver"),
        F.transform(x["specialty"], lambda q: q["coding"][0]["code"]["_value"]).alias("qualification"),
        x["managingOrganization"]["reference"]["_value"].alias("scoper"),
    )


def envelope(kind: Column, reason: Column, source: Column) -> Column:
    """An error as XML: its type, the reason, and the message it is about."""
    plain = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = [F.concat(F.lit(f"<{n}>"), plain(c), F.lit(f"</{n}>")) for n, c in (("type", kind), ("reason", reason), ("source", source))]
    return F.concat(F.lit("<error>"), *parts, F.lit("</error>"))


def unresolved(updates: DataFrame, reference: str, targets: DataFrame, key: str) -> DataFrame:
    """Updates whose reference names nothing known: those must fail."""
    return updates.where(F.col(reference).isNotNull()).join(targets.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def counters(loaded: DataFrame) -> DataFrame:
    """Messages, documents among them and their size, per content type."""
    return loaded.groupBy("content_type").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("payload")).alias("characters"), F.count(F.when(F.col("content_type") == "CDA_R2", 1)).alias("documents"))


#: Failures of the machines, not of the messages: the batch is not loaded and not set aside, but tried again.
_NOT_THE_DATA = re.compile("No space left|ExecutorLost|FetchFailed|OutOfMemory|Connection refused|SparkContext was shut down|Job .* cancelled")
#: How often a failing part of a batch is halved; messages that are together even then are set aside together.
MOST_HALVINGS = 24


class Pipeline:
    """Loads a stream of messages into folders of good and bad rows.

    A batch whose load fails is halved, by a hash of the messages, until the messages that fail are alone; they are set
    aside with the reason, and the others are loaded. A message that fails costs as many loads as the batch has halvings.
    """

    def __init__(self, spark: SparkSession, good: str, bad: str, checkpoint: str, load: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.good, self.bad, self.checkpoint, self.load = spark, good, bad, checkpoint, load
        self.sent = self.loaded = self.quarantined = 0

    def batch(self, df: DataFrame, number: int) -> None:
        # stored, as it may be read again and again, and the time of ingress must not change
        rows = cut(classified(df).withColumn("batch_no", F.lit(number)).withColumn("__hash", F.xxhash64("payload", "routing_key")))
        try:
            remove(self.spark, f"{self.good}/batch={number}")  # of an earlier run of the same batch
            poison = self._load(rows.where("error is null"), f"{self.good}/batch={number}")
            error = F.col("error")
            for condition, reason in poison:
                error = F.when(condition & F.col("error").isNull(), F.struct(F.lit("load").alias("type"), F.lit(reason).alias("reason"))).otherwise(error)
            rows_judged = rows.withColumn("error", error)
            failed = rows_judged.where("error is not null").select(F.col("error.type").alias("type"), F.col("error.reason").alias("reason"), F.col("payload").alias("source"))
            failed.write.mode("overwrite").parquet(f"{self.bad}/batch={number}")
            sent, bad = rows_judged.agg(F.count(F.lit(1)), F.count("error")).head()
            self.sent, self.quarantined, self.loaded = self.sent + sent, self.quarantined + bad, self.loaded + sent - bad
        finally:
            discard(rows)

    def _load(self, fine: DataFrame, path: str, depth: int = 0, part: str = "0", here: Column | None = None) -> list[tuple[Column, str]]:
        """Loads what it can, and gives (condition, reason) of what it can't."""
        some = fine if here is None else fine.where(here)
        plain = some.drop("__hash", "error")
        try:
            out = self.load(plain) if self.load else plain.select("payload", "routing_key", "ingress_ts", "content_type")
            out.write.mode("overwrite").parquet(f"{path}/part={part}")
            return []
        except Exception as e:
            if _NOT_THE_DATA.search(str(e)):
                raise
            remove(self.spark, f"{path}/part={part}")
            if depth == MOST_HALVINGS or some.select("__hash").distinct().limit(2).count() < 2:
                return [(F.lit(True) if here is None else here, str(e)[:500])]
        found = []
        for bit in (0, 1):
            half = F.expr(f"shiftright(__hash, {depth}) & 1") == bit
            found += self._load(fine, path, depth + 1, part + str(bit), half if here is None else here & half)
        return found

    def start(self, messages: DataFrame) -> StreamingQuery:
        """Works off what is there in micro-batches, then ends; called again it goes on where it stopped."""
        return messages.writeStream.foreachBatch(self.batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
