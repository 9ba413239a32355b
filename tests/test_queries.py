import pytest
from sqlcheck import DATA, compare

import __spark_entry__
from vitalis.plans import registry

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


#: what tells the rows of a query without SQL apart
KEYS = {"p5_found": "act_id", "p5_decoded": "act_id"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.SQL:
        compare(spark, registry.QUERIES[name], registry.SQL[name])
        return
    rows = registry.QUERIES[name](spark, str(DATA)).collect()
    assert rows and len({r[KEYS[name]] for r in rows}) == len(rows)


def test_quantities_are_in_the_unit_of_their_code(spark):
    acts = {r["_id"]: r["code"].strip() for r in spark.read.parquet(f"{DATA}/act.parquet").where("_id is not null and code is not null").select("_id", "code").collect()}
    common = {r["code"]: r["common_unit"] for r in spark.read.parquet(f"{DATA}/unit_reference.parquet").collect()}
    found = {r["act_id"]: (r["unit"], r["value_scaled"]) for r in registry.QUERIES["p5_found"](spark, str(DATA)).collect()}
    assert all(u == common[acts[i]] for i, (u, _) in found.items())
    decoded = {r["act_id"]: (r["unit"], r["value_scaled"], r["stated"]) for r in registry.QUERIES["p5_decoded"](spark, str(DATA)).collect()}
    assert {i: x[:2] for i, x in decoded.items() if x[2]} == found


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
