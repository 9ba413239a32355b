import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sqlcheck import DATA, compare  # noqa: E402

from vitalis.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


#: what tells the rows of a query without SQL apart
KEYS = {"p3_fused": ["id_cluster", "field"], "p7_found": ["id"], "p7_clusters": ["id"], "p7_appended": ["id"], "p8_ids": ["doc_id"], "p9_containers": ["doc_id", "piece"], "p10_found": ["doc_id"], "p10_statistics": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        # what several groups have in common shows only in more than the smallest tables
        compare(spark, queries.QUERIES[name], queries.SQL[name], DATA.parent / "sf0.01" if name == "p3_found" else None)
        return
    rows = queries.QUERIES[name](spark, str(DATA)).collect()
    assert rows and len({tuple(r[k] for k in KEYS[name]) for r in rows}) == len(rows)


def test_a_batch_appended_to_the_stored_history_is_as_in_the_replay(spark):
    replay = {r["id"]: (r["id_cluster"], r["known"]) for r in queries.p7_clusters(spark, str(DATA)).where("batch_no = 1").collect()}
    assert {r["id"]: (r["id_cluster"], r["known"]) for r in queries.p7_appended(spark, str(DATA)).collect()} == replay and replay


def test_kinds_agree_with_labels_that_were_held_out(spark):
    """Weights from half of the labels, agreement with the other half; labels that contradict each other are left out."""
    from pyspark.sql import functions as F

    from vitalis.llm import quality
    from vitalis.session import table

    d = str(DATA.parent / "sf0.1")
    labels = table(spark, d, "quality_labels").groupBy("doc_id").agg(F.min("kind").alias("kind"), F.max("kind").alias("other")).where("kind = other")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    described = quality.describe(table(spark, d, "documents"), table(spark, d, "common_words"))
    scored = quality.score(described, labels.where(part == 0).select("doc_id", "kind"), with_tails=False).withColumnRenamed("kind", "found")
    rows = scored.join(labels.where(part == 1), "doc_id").select("kind", "found").collect()
    other = [r for r in rows if r["kind"] != "prose"]
    assert sum(r["kind"] == r["found"] for r in rows) >= 0.9 * len(rows) and sum((r["found"] != "prose") for r in other) >= 0.85 * len(other)
