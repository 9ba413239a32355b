"""Consent: opt-outs from documents, links from acts to care provisions, and reads that hide what is opted out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.operators.graph import closure

#: fixed values: codes along the chain from a consent document to what it opts out of
CONSENT_DOCUMENT, CONSENT_SECTION, DIRECTIVE, DISCLOSE, DIAGNOSIS = "57016-8", "57016-6", "HRESCH", "IDSCL", "8319008"


def opt_outs(acts: DataFrame, relations: DataFrame, subjects: DataFrame) -> DataFrame:
    """(patient_id, care_provision), distinct: negated disclosure actions of consent documents.

    acts: _id, rim_class, class_code, code, value_code, negation_ind; relations: source, target; subjects: act, patient_id.
    """
    act = lambda p, *conditions: acts.where(conditions[0]).select(F.col("_id").alias(f"{p}_id"), *([F.col("value_code").alias("care_provision")] if p == "diagnosis" else []))
    edge = lambda a, b: relations.select(F.col("source").alias(f"{a}_id"), F.col("target").alias(f"{b}_id"))
    docs = act("doc", (F.col("rim_class") == "Document") & (F.col("code") == CONSENT_DOCUMENT))
    chain = docs.join(subjects.select(F.col("act").alias("doc_id"), "patient_id"), "doc_id")
    steps = [
        ("doc", "body", F.col("class_code") == "DOCBODY"),
        ("body", "section", F.col("code") == CONSENT_SECTION),
        ("section", "directive", F.col("code") == DIRECTIVE),
    ]
    for a, b, condition in steps:
        chain = chain.join(edge(a, b), f"{a}_id").join(act(b, condition), f"{b}_id").select(f"{b}_id", "patient_id")
    chain = chain.distinct()
    diagnosis = edge("directive", "diagnosis").join(act("diagnosis", F.col("code") == DIAGNOSIS), "diagnosis_id").select("directive_id", "care_provision")
    action = edge("directive", "action").join(act("action", (F.col("code") == DISCLOSE) & F.col("negation_ind")), "action_id").select("directive_id")
    return chain.join(diagnosis, "directive_id").join(action, "directive_id", "left_semi").select("patient_id", "care_provision").distinct()


def provision_links(documents: DataFrame, relations: DataFrame, service_events: DataFrame, provisions: DataFrame) -> DataFrame:
    """(act_id, care_provision, patient_id), distinct: every act below a document with the provision the document is of.

    documents: _id, patient_id; relations: source, target, type_code; service_events and provisions: _id, id (array),
    and code of the provision. Identifier sets are compared as sets.
    """
    below = closure(relations, documents.select("_id"), "source", "target")
    as_set = F.to_json(F.array_sort(F.array_distinct("id")))
    events = relations.where("type_code = 'DOC'").join(service_events.select(F.col("_id").alias("target"), as_set.alias("ids")), "target").select(F.col("source").alias("_id"), "ids")
    of = events.join(provisions.select(as_set.alias("ids"), F.col("code").alias("care_provision")), "ids")
    return below.join(of, F.col("start") == F.col("_id")).join(documents.select(F.col("_id").alias("start"), "patient_id"), "start").select(F.col("reached").alias("act_id"), "care_provision", "patient_id").distinct()


def visible(acts: DataFrame, links: DataFrame, opted_out: DataFrame, key: str = "_id") -> DataFrame:
    """acts without those that belong to a provision its patient opted out of."""
    hidden = links.join(opted_out, ["patient_id", "care_provision"], "left_semi").select(F.col("act_id").alias(key)).distinct()
    return acts.join(hidden, key, "left_anti")


class SecureTables:
    """Table access for readers who may not see opted-out acts: every read goes through the policy."""

    def __init__(self, tables: dict[str, DataFrame], links: DataFrame, opted_out: DataFrame, protected: dict[str, str]):
        self._tables, self._links, self._out, self._protected = tables, links, opted_out, protected

    def read(self, name: str) -> DataFrame:
        df = self._tables[name]
        return visible(df, self._links, self._out, self._protected[name]) if name in self._protected else df
