import itertools
import os
import random
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.functions import json_values as J
from vitalis.functions import semantics as S
from vitalis.functions.quantities import Conversion, Reader, decimal_of
from vitalis.operators import graph, history, nested, research, resolution, staging, units
from vitalis.operators.characteristic import wide_table
from vitalis.operators.latest import latest_version

T = datetime


def rows(df, *columns):
    return sorted([tuple(r[c] for c in (columns or df.columns)) for r in df.collect()], key=str)


# --- wide tables ---------------------------------------------------------------------------------------------------


def eav(spark, data):
    return spark.createDataFrame(data, "e long, k string, v string, t long, extra string")


def test_wide_table_has_every_entity_and_attribute(spark):
    data = [(1, "a", "x", 1, ""), (1, "a", "y", 2, ""), (1, "b", "1", 1, ""), (2, "b", "2", 1, ""), (2, "b", "2", 1, ""), (3, None, "z", 1, ""), (None, "a", "q", 1, ""), (4, "a", "old", 1, ""), (4, "a", None, 2, "")]
    out = wide_table(eav(spark, data), ["e"], "k", "v", "t")
    assert rows(out, "e", "a", "b") == rows(spark.createDataFrame([(1, "y", "1"), (2, None, "2"), (3, None, None), (4, None, None)], "e long, a string, b string"))


def test_wide_table_of_listed_attributes_and_empty_tables(spark):
    out = wide_table(eav(spark, [(1, "a", "x", 1, ""), (1, "c", "y", 1, "")]), ["e"], "k", "v", "t", ["a", "b"])
    assert rows(out) == [(1, "x", None)]
    assert wide_table(eav(spark, []), ["e"], "k", "v", "t", ["a"]).columns == ["e", "a"]
    assert wide_table(eav(spark, []), ["e"], "k", "v", "t", ["a"]).count() == 0


def test_wide_table_refuses_clashing_names(spark):
    with pytest.raises(ValueError):
        wide_table(eav(spark, [(1, "e", "x", 1, "")]), ["e"], "k", "v", "t")


def test_wide_table_with_more_signatures_than_tables(spark):
    rng = random.Random(1)
    data, want = [], {}
    for e in range(150):
        keys = [k for k in "pqrstuvw" if rng.random() < 0.5]
        want[e] = {k: f"{e}{k}" for k in keys}
        data += [(e, k, f"{e}{k}", 1, "") for k in keys] or [(e, None, None, 1, "")]
    out = wide_table(eav(spark, data), ["e"], "k", "v", "t")
    assert {r["e"]: {k: r[k] for k in "pqrstuvw" if r[k] is not None} for r in out.collect()} == want


def test_latest_version_ties_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "z", 0), (None, "n", 5), (2, "c", None)], "k long, v string, t long")
    assert rows(latest_version(df, ["k"], "t")) == rows(spark.createDataFrame([(1, 1, "b"), (None, 5, "n"), (2, None, "c")], "k long, t long, v string"))


def test_json_values(spark):
    data = [('{"code": "A"}',), ('[{"code": "B"}]',), ('"C"',), ("null",), ("[null]",), ("[]",), (None,), ('["D"]',), ("{broken",)]
    df = spark.createDataFrame(data, "j string").select(J.parsed(J.head("j")).alias("p")).select(J.coded(F.col("p")).alias("c"))
    assert [r["c"] for r in df.collect()][:5] == ["A", "B", "C", None, None]
    numbers = spark.createDataFrame([("109,59",), ("71.00",), ("170",), ("1E2",), ("-0.50",), ("abc",), (" ",)], "t string").select(J.plain_number(F.col("t")).alias("n"))
    assert [r["n"] for r in numbers.collect()] == ["109.59", "71", "170", "100", "-0.5", "abc", ""]
    times = spark.createDataFrame([("20110808",), ("201806200817",), ("20190811120321.25+0100",), ("2014",), ("2019-08-11T12:03:21Z",), ("",), (None,)], "t string").select(J.timestamp_digits(F.col("t")).alias("n"))
    assert [r["n"] for r in times.collect()] == ["20110808000000", "20180620081700", "20190811120321", "20140000000000", "20190811120321", None, None]


# --- nested documents ----------------------------------------------------------------------------------------------


def test_nodes_of_documents(spark):
    docs = [
        (1, '{"_rimname": "A", "x": {"y": [{"_rimname": "B"}, 3, {"z": {"_rimname": "C"}}]}, "_n": null}'),
        (2, '"{\\"_rimname\\": \\"Wrapped\\"}"'), (3, "{broken"), (4, None), (5, ""), (6, '[{"_rimname": ""}, {"_rimname": 5}, {"_rimname": "D"}]'), (7, '{"_rimname": "N", "v": NaN}'), (8, '{"t": "{\\"_rimname\\": \\"text\\"}"}'),
    ]
    out = nested.node_table(spark.createDataFrame(docs, "id long, d string"), "id", "d", "_rimname")
    assert rows(out, "id", "path", "parent_path", "type") == [(1, "$", "", "A"), (1, "$.x.y[0]", "$", "B"), (1, "$.x.y[2].z", "$", "C"), (2, "$", "", "Wrapped"), (6, "$[2]", "", "D")]


def test_containment_is_nesting():
    rng = random.Random(3)

    def doc(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([1, "x", None, [], {}])
        return {f"k{i}": doc(depth - 1) for i in range(rng.randint(0, 3))} if rng.random() < 0.6 else [doc(depth - 1) for _ in range(rng.randint(0, 3))]

    for _ in range(50):
        nodes = nested.label(doc(6))
        parents = nested.nearest_enclosing([(n.pre, n.post) for n in nodes])
        for n, p in zip(nodes, parents):
            assert (nodes[p] if p >= 0 else None) is n.around
        assert [n.pre for n in nodes] == sorted(n.pre for n in nodes)


def test_deep_documents_need_no_recursion():
    text = '{"a":[' * 30_000 + "1" + "]}" * 30_000
    doc, there = nested.parse(text)
    assert there and len(nested.label(doc)) == 60_001
    for bad in ("", "[1,]", "{1:2}", '{"a" 1}', "[1 2]", "[1]]", "[", '{"a":', "tru", "01"):
        with pytest.raises(ValueError):
            nested.parse_deep(bad)


def test_links_by_intervals(spark):
    docs = [(1, '{"_rimname": "S", "o": {"_rimname": "O", "s": {"_rimname": "S", "o": {"_rimname": "O"}}}}')]
    nodes = nested.node_table(spark.createDataFrame(docs, "id long, d string"), "id", "d", "_rimname")
    t = nested.type_tables(nodes, ["S", "O"])
    assert rows(nested.link(t["S"], t["O"], "id")) == [(1, "$", "$.o"), (1, "$", "$.o.s.o"), (1, "$.o.s", "$.o.s.o")]


# --- quantities ----------------------------------------------------------------------------------------------------

GLUCOSE = Reader([Conversion("mmol/l", "mmol/l", Decimal(1), Decimal(0), 2), Conversion("mg/dl", "mmol/l", Decimal("0.0555"), Decimal(0), 2)])
HEIGHT = Reader([Conversion("cm", "cm", Decimal(1), Decimal(0), 1), Conversion("[in_i]", "cm", Decimal("2.54"), Decimal(0), 1), Conversion("[ft_i]", "cm", Decimal("30.48"), Decimal(0), 1)])


@pytest.mark.parametrize(
    "reader, value, unit, text, want",
    [
        (GLUCOSE, Decimal("5.5"), "MMOL / L", None, [("5.5", "mmol/l")]),
        (GLUCOSE, Decimal("99"), "unk", "all values mg per dl", [("99", "mg/dl")]),
        (GLUCOSE, None, "167mg/dl", "seated", [("167", "mg/dl")]),
        (GLUCOSE, None, None, "controle 3e kwartaal: glucose 8,3mmol/l", [("8.3", "mmol/l")]),
        (GLUCOSE, Decimal("174"), "min", "second reading", None),
        (GLUCOSE, Decimal("174"), None, "sample of 2 tubes", None),
        (GLUCOSE, None, "mmol/l", "not measured", None),
        (GLUCOSE, None, None, None, None),
        (HEIGHT, None, None, "body height 5 ft 3 in", [("5", "[ft_i]"), ("3", "[in_i]")]),
        (HEIGHT, None, "", "body height 5' 8\"", [("5", "[ft_i]"), ("8", "[in_i]")]),
        (HEIGHT, Decimal("170"), "?", "in cm volgens lab", [("170", "cm")]),
        (HEIGHT, Decimal("67"), "", "unit: in", [("67", "[in_i]")]),
    ],
)
def test_reading_quantities(reader, value, unit, text, want):
    parts, stated = reader.read(value, unit, text)
    assert stated == (want is not None)
    if want:
        assert [(str(n), u) for n, u in parts] == want


def test_conversion_rounds_half_up():
    assert HEIGHT.common([(Decimal(5), "[ft_i]"), (Decimal(3), "[in_i]")]) == ("cm", 1600)
    assert GLUCOSE.common([(Decimal("1.005"), "mmol/l")]) == ("mmol/l", 101)
    assert GLUCOSE.common([(Decimal("-1.005"), "mmol/l")]) == ("mmol/l", -100)
    assert [str(decimal_of(t)) for t in ("1,5", "1.234,5", "1,234.5", "1.234.567")] == ["1.5", "1234.5", "1234.5", "1234567"]


def test_units_decoded_from_the_series(spark):
    ref = spark.createDataFrame([("G", "mmol/l", "mmol/l", Decimal("1"), Decimal("0"), 2), ("G", "mg/dl", "mmol/l", Decimal("0.0555"), Decimal("0"), 2)], "code string, unit string, common_unit string, factor decimal(20,10), shift decimal(20,10), decimals int")
    rng = random.Random(5)
    data, truth = [], {}
    for k in range(400):
        level, mg = rng.uniform(4.5, 7), rng.random() < 0.4
        stated = rng.random() < 0.3
        truth[k] = "mg/dl" if mg else "mmol/l"
        data.append((k, " G ", T(2020, 1, 1 + k % 28), Decimal(f"{level / 0.0555 if mg else level:.3f}"), truth[k] if stated else None, None))
    data += [(1000, "H", None, Decimal(1), "mmol/l", None), (1001, "G", None, None, None, "refused"), (1002, None, None, Decimal(1), "mmol/l", None)]
    df = spark.createDataFrame(data, "i long, code string, at timestamp_ntz, v decimal(18,6), u string, t string")
    out = units.common_units(units.read_quantities(df, ref, "i", "code", "v", "u", "t", "at"), ref).collect()
    assert sorted(r["id"] for r in out) == [*range(400), 1001]
    by = {r["id"]: r for r in out}
    assert by[1001]["decoded_unit"] is None and by[1001]["value_scaled"] is None
    silent = units.common_units(units.read_quantities(df.where("i < 9").withColumn("u", F.lit(None).cast("string")), ref, "i", "code", "v", "u", "t", "at"), ref).collect()
    assert len(silent) == 9 and all(r["decoded_unit"] is None and not r["stated"] for r in silent)  # nothing is stated for the code
    assert all(by[k]["decoded_unit"] == u for k, u in truth.items() if by[k]["stated"])
    assert sum(by[k]["decoded_unit"] == u for k, u in truth.items()) >= 390
    empty = units.common_units(units.read_quantities(df.limit(0), ref, "i", "code", "v", "u", "t", "at"), ref)
    assert empty.count() == 0


def _masked(spark):
    """Acts of the test tables with 3 of 10 stated units hidden, and what was hidden."""
    from vitalis.operators.latest import latest_version
    from vitalis.session import table

    d = "/root/testdata/sf0.01"
    ref = table(spark, d, "unit_reference")
    newest = latest_version(table(spark, d, "act").where("_id is not null"), ["_id"], columns=["rim_class", "code", "effective_low", "_value_pq_value", "_value_pq_unit", "value_text"])
    read = units.read_quantities(newest.where("rim_class = 'Observation'"), ref, "_id", "code", "_value_pq_value", "_value_pq_unit", "value_text", "effective_low")
    hidden = (F.pmod(F.xxhash64("id"), F.lit(10)) < 3) & (F.size("numbers") == 1)
    truth = {r["id"]: r["u"] for r in read.where(F.col("stated") & hidden).select("id", F.col("units")[0].alias("u")).collect()}
    masked = read.withColumn("stated", F.col("stated") & ~hidden)
    return masked.withColumn("units", F.when(F.col("stated"), F.col("units")).otherwise(F.transform("units", lambda x: F.lit(None).cast("string")))), ref, truth


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_hidden_units_are_decoded_alike_for_any_partitioning(spark):
    masked, ref, truth = _masked(spark)
    found = []
    for n in (1, 24):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found.append({r["id"]: r["decoded_unit"] for r in units.common_units(masked, ref).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] and len(truth) > 500
    assert sum(found[0][k] == u for k, u in truth.items()) >= 0.95 * len(truth)


def test_path_of_units_against_all_paths():
    rng = np.random.default_rng(3)
    model = units.Model(HEIGHT, 5.1, 0.1, np.array([[9, 1, 1], [1, 5, 1], [2, 1, 4], [11, 7, 6]]))
    n = 5
    emitted = rng.integers(-9_000_000, 0, (n, 3))
    first, last = model.moves[3], np.array([0, units.NEVER, units.NEVER])
    score = lambda p: first[p[0]] + sum(emitted[i, k] for i, k in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:])) + last[p[-1]]
    best = max(itertools.product(range(3), repeat=n), key=score)
    assert tuple(model.path(first, emitted, last)) == best
    # the same in two parts, chained over their border
    squares = [(0, model.begin(emitted[:2]).ravel().tolist()), (1, model.begin(emitted[2:]).ravel().tolist())]
    free = max(itertools.product(range(3), repeat=n), key=lambda p: score(p) - last[p[-1]])
    assert units._chained(squares, 3) == {0: (3, free[1]), 1: (free[1], free[-1])}


def test_numbers_in_documents_of_any_depth_and_length(spark):
    deep = lambda n, inner: '{"a":' * n + inner + "}" * n
    inner = '{"_rimname": 5, "b": {"_rimname": "Act"}}'
    docs = [(1, deep(3000, inner)), (2, deep(20_000, inner)), (3, '{"_rimname": "Act", "n": ' + "9" * 5000 + "}"), (4, deep(20_000, '{"_rimname": "Act", "n": ' + "9" * 5000 + "}"))]
    out = nested.node_table(spark.createDataFrame(docs, "id long, d string"), "id", "d", "_rimname").collect()
    assert sorted((r["id"], r["type"], r["path"][-2:]) for r in out) == [(1, "Act", ".b"), (2, "Act", ".b"), (3, "Act", "$"), (4, "Act", ".a")]


# --- semantics -----------------------------------------------------------------------------------------------------


def test_exact_percentages_and_ratios(spark):
    df = spark.createDataFrame([(29, 100), (2, 3), (0, 5), (5, 0), (7, 2)], "c long, t long").select(S.truncated_percent(F.col("c"), F.col("t")).alias("p"), S.integer_ratio(F.col("c"), F.col("t")).alias("r"))
    assert [(r["p"], r["r"]) for r in df.collect()] == [(29.0, 0), (66.66, 0), (0.0, 0), (None, None), (350.0, 3)]


def test_template_containment(spark):
    listed = [{"root": "r", "extension": "1", "dataType": "II"}]
    df = spark.createDataFrame([(1, [("r", "1", "II")]), (2, []), (3, None), (4, [("r", "2", "II")]), (5, [("r", None, None)]), (6, [("r", "1", "II"), ("q", "1", "II")])], "i long, t array<struct<root:string,extension:string,dataType:string>>")
    assert [r["i"] for r in df.where(S.all_listed(F.col("t"), listed)).orderBy("i").collect()] == [1, 2, 5]


def test_ranks_tie_and_nulls_come_first(spark):
    df = spark.createDataFrame([(1, 10, None), (1, 11, T(2020, 1, 1)), (1, 11, T(2020, 1, 1)), (1, 12, T(2019, 1, 1))], "k long, act_id long, time timestamp_ntz")
    out = history.ranked(df, ["k"], oldest="drago")
    assert rows(out, "act_id", "rocky", "drago") == [(10, 1, 4), (11, 2, 2), (11, 2, 2), (12, 4, 1)]
    assert history.before_each(out.drop("drago"), ["k"]).count() == 2  # the tied pair has no row of rank 3 before it


def test_interval_and_hash_sample(spark):
    df = spark.range(2000)
    a = S.hash_sample(df, "id", 0.1, 7)
    assert rows(a) == rows(S.hash_sample(df.repartition(7), "id", 0.1, 7)) and 120 < a.count() < 280
    w = spark.createDataFrame([(1, 0, 2), (3, 0, 2), (3, 0, None), (None, 0, 2)], "t long, l long, h long").select(S.within(F.col("t"), F.col("l"), F.col("h")).alias("w"))
    assert [r["w"] for r in w.collect()][:3] == [True, False, True]


# --- graphs --------------------------------------------------------------------------------------------------------


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5), (4, None)], "s long, t long")
    out = graph.closure(e, spark.createDataFrame([(1,), (4,), (9,), (None,)], "i long"), "s", "t")
    assert rows(out) == [(1, 1), (1, 2), (1, 3), (1, 4), (4, 4), (9, 9)]


def test_context_conduction(spark):
    p = spark.createDataFrame([(1, 10, 7, "RCT", "AP", None), (2, 10, 8, "AUT", "AN", None), (3, 10, 9, "LOC", None, None), (4, 11, 7, "RCT", "AP", None)], "_id long, act long, role long, type_code string, context_control_code string, origin long")
    r = spark.createDataFrame([(10, 11, True), (11, 12, True), (12, 10, True), (10, 13, False)], "source long, target long, conduction boolean")
    out = graph.conduct_context(p, r)
    assert rows(out, "act", "role", "origin") == [(11, 8, 2), (12, 7, 1), (12, 7, 4)]


def test_conduction_starts_from_conducted_participations_too(spark):
    """A conducted seed goes on below, but not to the act of its original; what else it has goes with it."""
    columns = "_id long, act long, role long, type_code string, context_control_code string, origin long, negation boolean"
    p = spark.createDataFrame([(1, 10, 7, "RCT", "AP", None, True), (2, 11, 7, "RCT", "AP", 1, None), (3, 11, 8, "RCT", "AN", 1, None), (4, 20, 9, "AUT", "OP", 99, None), (5, 12, None, "AUT", "AN", None, None), (6, 13, None, "AUT", "AN", None, None)], columns)
    r = spark.createDataFrame([(11, 10, True), (11, 12, True), (12, 13, True), (13, 10, True), (20, 21, True)], "source long, target long, conduction boolean")
    out = graph.conduct_context(p, r)
    assert rows(out, "act", "role", "origin", "negation") == [(10, None, 6, None), (12, 7, 1, None), (13, 7, 1, None), (13, None, 5, None)]


def test_row_ids_are_consecutive(spark):
    out = graph.row_ids(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")), ["x"]).orderBy("x").collect()
    assert [r["row_id"] for r in out] == list(range(1, 1001))


# --- resolution ----------------------------------------------------------------------------------------------------

IDS = "array<struct<root:string,extension:string>>"


def fixture(spark, data):
    return spark.createDataFrame([(i, [("R", str(x)) for x in ids], w, h) for i, ids, w, h in data], f"_id long, id {IDS}, _record_weight int, _record_hash string")


def test_resolution_of_two_batches(spark):
    names = dict(zip("abcdefghij", range(1, 11)))
    data = [("a", [1, 2, 5], 3201, "H0"), ("b", [1], 1101, "H1"), ("c", [5], 1001, "H0"), ("d", [6], 1001, "H0"), ("e", [4, 3, 7], 3301, "H1"), ("f", [4, 3, 7], 1001, "H0"), ("g", [3], 1101, "H1"), ("h", [4], 1001, "H0"), ("i", [8], 3201, "H0"), ("j", [8, 9], 1001, "H0")]
    first = fixture(spark, [(names[n], *r) for n, *r in data])
    done = resolution.resolve(first)
    back = {v: k for k, v in names.items()}
    assert {back[r["_id"]]: back[r["_id_cluster"]] for r in done.collect()} == dict(a="a", b="a", c="a", d="d", e="e", f="e", g="e", h="e", i="i", j="i")
    assert {back[r["_id"]]: back[r["dedup_new_id"]] for r in done.where("dedup_new_id is not null").collect()} == dict(c="a", g="e", h="f", j="i")
    assert resolution.broken_rules(done).count() == 0
    known = resolution.applied(first, done)
    assert sorted(back[r["_id"]] for r in known.collect()) == list("abdefi")
    second = fixture(spark, [(21, [5], 1101, "H2"), (22, [4], 1001, "H0"), (23, [11], 1001, "H0")])
    by_hash = {r["_id"]: (r["_id_cluster"], r["dedup_new_id"]) for r in resolution.resolve(second, known).collect()}
    assert by_hash == {21: (21, None), 22: (names["e"], names["f"]), 23: (23, None)}
    by_id = {r["_id"]: r["_id_cluster"] for r in resolution.resolve(second, known, match="id").collect()}
    assert by_id[21] == names["a"]


def test_equal_extensions_of_other_roots_differ(spark):
    df = spark.createDataFrame([(1, [("R", "1")], 1, "x"), (2, [("S", "1")], 1, "x"), (3, None, 1, "x"), (4, [("R", None)], 1, "x")], f"_id long, id {IDS}, _record_weight int, _record_hash string")
    assert rows(resolution.resolve(df), "_id", "_id_cluster") == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_weights_and_id_ranges(spark):
    df = spark.createDataFrame([(1, "TZDU", [("a",)], "n", None), (2, "POCD", [], None, "x"), (3, None, None, None, None)], "i long, mif string, id array<struct<e:string>>, name string, o string")
    out = staging.weighted(df, F.col("mif").startswith("TZDU"), "id", "name", [], ["o"])
    assert [r["_record_weight"] for r in out.orderBy("i").collect()] == [3100, 1, 0]
    ranges = staging.IdRanges(count=4, bits=10)
    a, b = ranges.take(), ranges.take()
    assert a[1] < b[0]
    ids = [r["_id"] for r in staging.with_ids(spark.range(100, numPartitions=3), *a).collect()]
    assert len(set(ids)) == 100 and a[0] <= min(ids) and max(ids) <= a[1]


def test_risk(spark):
    df = spark.createDataFrame([(1, None)] * 30 + [(2, "F")] * 2, "a long, g string")
    r = research.share_at_risk(df, ["a", "g"], 0.05).head()
    assert (r["num"], r["denom"], r["perc"]) == (2, 32, 6.0)
    assert research.share_at_risk(df.limit(0), ["a", "g"], 0.05).head()["perc"] is None
