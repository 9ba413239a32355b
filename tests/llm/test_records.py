import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vitalis.llm import components, segments, topn, truth

D = datetime


def rows(df, *columns):
    return sorted([tuple(r[c] for c in (columns or df.columns)) for r in df.collect()], key=str)


# --- top N ---------------------------------------------------------------------------------------------------------


def test_top_n_against_sorting(spark):
    rng = random.Random(1)
    data = [(rng.choice([0] * 5 + list(range(1, 40)) + [None]), rng.choice(["x", "y", None]), rng.choice([None, *range(20)]), k) for k in range(5000)]
    df = spark.createDataFrame(data, "g long, h string, score long, id long").repartition(6)
    out = topn.top_n(df, ["g", "h"], [F.col("score").desc_nulls_last(), F.col("id").asc()], 3)
    want, groups = set(), defaultdict(list)
    for r in data:
        if r[0] is not None and r[1] is not None:
            groups[r[:2]].append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[2] is None, -(r[2] or 0), r[3]))
        want |= {(*r, k + 1) for k, r in enumerate(g[:3])}
    assert set(map(tuple, out.select("g", "h", "score", "id", "rank").collect())) == want


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1, "z"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, None)], "g string, s long, `odd name` string")
    out = topn.top_n(df, ["g"], [F.col("s").desc_nulls_last()], 2)
    assert rows(out) == [("a", 1, "y", 1), ("a", 1, "z", 2), ("b", None, None, 1)]
    assert topn.top_n(df, ["g"], [F.col("s").desc()], 0).count() == 0
    assert topn.top_n(df.limit(0), ["g"], [F.col("s").desc()], 2).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df.withColumnRenamed("s", "rank"), ["g"], [F.col("rank").desc()], 2)


def test_freshest_examinations(spark):
    data = [
        (1, " ex-1", 10, D(2020, 1, 1), D(2021, 1, 1)), (1, "EX-1", 10, D(2019, 1, 1), D(2020, 1, 1)), (1, "Ex-1 ", 11, D(2020, 1, 1), D(2021, 1, 1)), (1, "EX-1", 12, None, D(2021, 1, 1)),
        (1, "EX-1", 13, D(2018, 1, 1), D(2021, 1, 1)), (None, "EX-1", 14, D(2022, 1, 1), D(2021, 1, 1)), (1, None, 15, D(2022, 1, 1), D(2021, 1, 1)), (1, " ", 16, D(2022, 1, 1), D(2021, 1, 1)), (2, "EX-1", 17, None, None), (2, "EX-1", 17, None, None),
    ]
    df = spark.createDataFrame(data, "peso_id long, code string, act_id long, effective_time_low timestamp_ntz, _lake_timestamp timestamp_ntz").withColumn("rocky", F.lit(99))
    assert rows(topn.freshest_examinations(df)) == [(1, "EX-1", 10, 2), (1, "EX-1", 11, 1), (1, "EX-1", 13, 3), (2, "EX-1", 17, 1)]


# --- components ----------------------------------------------------------------------------------------------------


def grouped(pairs, records):
    up = {r: r for r in records}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(up)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops"])
def test_components_against_union_find(spark, shape):
    rng = random.Random(2)
    pairs = {
        "chain": [(k, k + 1) for k in range(1, 120)],
        "star": [(1000, k) for k in range(1, 200)] + [(5, 5)],
        "random": [(rng.randint(1, 400), rng.randint(1, 400)) for _ in range(330)],
        "loops": [(1, 2), (2, 1), (1, 2), (3, 3), (2, 4), (4, 1)],
    }[shape]
    out = components.components(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(900,), (None,)], "record_id long"))
    assert set(map(tuple, out.collect())) == grouped(pairs, [900])


def test_instructions(spark):
    data = [(5, 3, None), (3, None, 2), (9, 9, 9), (7, 0, -1), (None, 8, 6), (None, None, None), (5, 3, None)]
    df = spark.createDataFrame(data, "_id long, _id_cluster long, dedup_new_id long")
    assert rows(components.instruction_groups(df)) == [(2, 2), (3, 2), (5, 2), (6, 6), (7, 7), (8, 6), (9, 9)]
    assert components.instruction_groups(df.limit(0)).count() == 0


# --- survivors -----------------------------------------------------------------------------------------------------

PERSON = "_id long, _id_cluster long, _record_weight int, name string, birth_time timestamp_ntz, addr string, telecom string, _lake_timestamp timestamp_ntz, _mif string"
VOTES = "kind string, votes array<struct<feed:string,pro:long,con:long>>, n long"


def _letters(k):
    """A word that is more than two edits from that of any other number below 676."""
    return chr(97 + k // 26 % 26) * 3 + chr(97 + k % 26) * 3 + (str(k // 676) if k >= 676 else "")


def _duplicates(n, filler="onbekend"):
    """n groups of two records; in every fourth the heavier record has a filler for a name. Names, dates and addresses that many persons share."""
    t, data = D(2020, 1, 1), []
    for c in range(n):
        name = "Jan Jansen" if c % 3 == 0 else f"Person {_letters(c)}"
        born = D(1950, 5, 5) if c % 3 == 1 else D(1901 + c % 99, 1 + c % 12, 1 + c % 28)
        addr = "Home 1, Town" if c % 3 == 2 else f"{_letters(c)} {c}, Town"
        for k in (0, 1):
            data.append((2 * c + k, c + 1, 2 - k, filler if c % 4 == 1 and not k else name, born, addr, f"06{c:08d}", t, "ab"[k]))
    return data


def test_survivors(spark):
    t = D(2020, 1, 1)
    data = _duplicates(40)
    data += [
        (9001, 901, 5, "Onbekend ", None, "", None, t, "a"), (9002, 901, 5, " Ann  Lee ", None, "Road 5, 1000 AB Town", " ", D(2019, 1, 1), "b"), (9003, 901, None, "Ann Leigh", D(1950, 2, 3), None, "0612345678", t, None),
        (9003, 901, 9, "old", None, None, None, D(2018, 1, 1), "a"), (9004, 902, 1, "Solo One", None, None, None, t, "a"), (9005, 903, 1, "onbekend", None, "", "", t, "a"), (9008, 903, 1, None, None, None, None, None, None), (9007, None, 1, "No Cluster", None, None, None, t, "b"),
    ]
    out = {r[0]: tuple(r) for r in truth.survivors(spark.createDataFrame(data, PERSON)).collect()}
    assert out[901] == (901, 9001, 9002, 9003, 9002, 9003) and out[903] == (903, 9005, 0, 0, 0, 0) and 902 not in out
    assert truth.survivors(spark.createDataFrame([], PERSON)).count() == 0


@pytest.mark.parametrize("n, filler", [(60, "onbekend"), (600, "John Smith"), (1500, "zzqx")])
def test_common_real_values_stay_and_fillers_of_any_look_go(spark, n, filler):
    """A name or an address that a third of all persons share is real; what is contradicted everywhere isn't, whatever it looks like."""
    data = _duplicates(n, filler)
    out = truth.survivors(spark.createDataFrame(data, PERSON))
    first = {g: i for i, g, w, *_ in data if w == 2}
    assert rows(out) == sorted([(g, i, i + (g % 4 == 2), i, i, i) for g, i in first.items()], key=str)


def test_without_the_model_fillers_stay(spark, monkeypatch):
    monkeypatch.setattr(truth.TwoSided, "odds", lambda self, kind, votes: F.lit(0.0))
    data = _duplicates(60)
    out = truth.survivors(spark.createDataFrame(data, PERSON))
    assert all(r["name_id"] == r["survivor_id"] for r in out.collect())


@pytest.mark.parametrize("few", [0, 10_000])
def test_model_recovers_quality(spark, few):
    rng = random.Random(3)
    quality = {"a": (0.95, 0.95), "b": (0.8, 0.9), "c": (0.7, 0.6)}
    seen, facts = defaultdict(int), []
    for _ in range(6000):
        true = rng.random() < 0.6
        votes = tuple((f, int(v), int(not v)) for f, (sen, spe) in quality.items() if rng.random() < 0.9 for v in [rng.random() < (sen if true else 1 - spe)])
        seen[votes] += 1
        facts.append((votes, true))
    patterns = spark.createDataFrame([("x", list(v), n) for v, n in seen.items()], VOTES)
    m = truth.TwoSided(0.8, 0.8, 0.5)
    m.fit(patterns, few)
    assert all(abs(m.feeds[f][k] - quality[f][k]) < 0.1 for f in quality for k in (0, 1)) and abs(m.classes["x"] - 0.6) < 0.1
    odds = {tuple(tuple(v) for v in r["votes"]): r["o"] for r in patterns.select("votes", m.odds(F.col("kind"), F.col("votes")).alias("o")).collect()}
    assert sum((odds[v] >= 0) == t for v, t in facts) > 0.9 * len(facts)


def test_verdicts_are_the_same_for_few_and_many_facts(spark):
    """From 1 to 1000 times the facts, with values in 10,000 groups, no verdict changes and none is near the edge."""
    real = [("name|0", [("a", 1, 0)], 300), ("name|0", [("b", 0, 1), ("a", 1, 0)], 40), ("name|13", [("a", 6000, 2500), ("b", 1500, 300)], 2), ("name|3", [("a", 7, 3)], 9)]
    bad = [("name|13", [("a", 30, 6000), ("b", 5, 2000)], 2), ("name|3", [("a", 0, 8)], 3), ("name|6", [("a", 1, 60), ("b", 0, 20)], 4)]
    for times in (1, 30, 1000):
        facts = spark.createDataFrame([(k, v, n * times) for k, v, n in real + bad], VOTES)
        m = truth.TwoSided().fit(facts)
        odds = [r[0] for r in facts.select(m.odds(F.col("kind"), F.col("votes"))).collect()]
        assert all(x > 1 for x in odds[: len(real)]) and all(x < -4.5 for x in odds[len(real) :])
        assert all(0.6 < sen and 0.9 < spe for sen, spe in m.feeds.values())


def test_fused_keeps_several_true_values(spark):
    t = D(2020, 1, 1)
    data = []
    for c in range(60):
        for k, feed in enumerate(("good", "fine", "bad")):
            data.append((10 * c + k, c, 1, f"Person {'Wrong' if feed == 'bad' else 'Right'} {chr(97 + c % 26)}{chr(97 + c // 26)}", D(1950, 1, 2), f"Road {c}, Town", f"06{c:08d}" if feed != "bad" else None, t, feed))
        data.append((10 * c + 5, c, 1, None, None, None, f"07{c:08d}", t, "good"))
        data.append((10 * c + 6, c, 1, None, None, None, f"07{c:08d}", t, "fine"))
        data += [(100_000 + 100 * c + k, c, 1, None, None, f"Road {c}, Town", None, t, f"feed {k}") for k in range(12)]  # feeds are never merged
    out = truth.fused(spark.createDataFrame(data, PERSON), F.col("_mif"))
    by = {(r["id_cluster"], r["field"]): r["values"] for r in out.collect()}
    assert by[3, "telecom"] == ["0600000003", "0700000003"] and by[3, "birth"] == ["1950-01-02"]
    assert all("right" in v[0] and len(v) == 1 for (c, f), v in by.items() if f == "name")


# --- segment index -------------------------------------------------------------------------------------------------


def test_only_placeholder_days_are_no_dates_of_birth(spark):
    days = {D(1900, 1, 1): True, D(1900, 7, 14): False, D(1800, 1, 1): True, D(1800, 3, 2): False, D(1901, 1, 1): False, D(9999, 12, 31): True, D(1111, 11, 11): True, D(1, 1, 1): True}
    df = spark.createDataFrame([(f"{d.year:04d}-{d.month:02d}-{d.day:02d}", bad) for d, bad in days.items()], "value string, bad boolean")
    assert all(r["found"] == r["bad"] for r in df.select("bad", segments.badly_shaped(F.lit("birth"), F.col("value")).alias("found")).collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i, *[0] * len(b)], row
        for j, y in enumerate(b, 1):
            row[j] = min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("tau", [0, 1, 2])
def test_index_finds_all_within_tau(spark, tau):
    rng = random.Random(tau)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    old, new = words[::2] + ["same"], words[1::2] + ["same", ""]
    index = segments.SegmentIndex(tau)
    index.append(spark.createDataFrame([("x", w) for w in old[:10]], "block string, s string"))
    index.append(spark.createDataFrame([("x", w) for w in old[5:]] + [("y", "same")], "block string, s string"), batch=1)
    out = index.probe(spark.createDataFrame([("x", w) for w in new] + [("x", None)], "block string, s string"))
    want = {("x", a, b, distance(a, b)) for a in new for b in old if a and distance(a, b) <= tau}
    assert set(map(tuple, out.select("block", "s", "other", "distance").collect())) == want and out.count() == len(want)


RECORD = "_id long, _id_cluster long, id array<struct<root:string,extension:string>>, name string, birth_time timestamp_ntz, gender string, addr string, telecom string, _lake_timestamp timestamp_ntz"


def test_batches_against_history(spark):
    t, b = D(2020, 1, 1), D(1950, 5, 5)
    ident = lambda *x: [("R", e) for e in x]
    data = [
        (1, 1, ident("0012345678"), "Ann Lee-Smith", b, "F", "Road 5, Town", "0612345678", t),
        (2, None, ident("12345-678"), "LEE, ANN", D(1950, 5, 15), "F", "Moved 9, City", None, t),  # rewritten, moved, date mistyped
        (3, None, ident("12345678"), "Bob Jones", D(1980, 1, 1), "M", "Else 1, City", None, t),  # the identifier is shared, the person another
        (4, None, ident("12345678"), None, None, None, None, None, t),  # reference only
        (5, None, None, "Ann Lee-Smith", b, "F", "road 5 town", None, t),  # no identifiers, equal details
        (6, None, ident("000000"), "Ann Lee-Smith", b, "F", None, None, t),  # a filler, and no address
        (7, None, ident("771177"), "Cara New", D(1990, 2, 2), "F", "New 1, City", None, t),
        (8, None, ident("771177", "881188"), "Cara Neww", D(1990, 2, 2), "F", None, None, t),
        (9, None, [("S", "12345678")], "Ann Lee-Smith", b, "F", "Road 5, Town", None, t),  # equal extension, other root
        (10, None, ident("881188"), "C. New", D(1990, 2, 2), None, None, None, t),
        (11, None, ident("12345678"), "Bob Jones", D(1980, 1, 1), "M", None, None, t),
        (12, None, ident("12345678"), "Ann Lee", b, "F", None, None, t),  # not logged
        (2, None, ident("999998"), "Old Version", None, None, None, None, D(2019, 1, 1)),
    ]
    log = spark.createDataFrame([(2, 1), (2, 3), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2), (8, 2), (9, 3), (10, 3), (11, 3), (99, 1), (None, 1), (1, 1)], "id long, batch_no long")
    df = spark.createDataFrame(data, RECORD)
    out = {r["id"]: (r["id_cluster"], r["known"]) for r in segments.append_batches(df, log).collect()}
    assert out == {2: (1, True), 3: (3, False), 4: (1, True), 5: (1, True), 6: (6, False), 7: (7, False), 8: (7, False), 9: (9, False), 10: (7, True), 11: (3, True)}
    assert segments.append_batches(df.limit(0), log).count() == 0
    assert segments.append_batches(df, log.limit(0)).count() == 0


def _mistyped():
    t, b = D(2020, 1, 1), D(1950, 5, 5)
    data = [
        (1, 1, [("R", "7120800012")], "Ann Lee", b, "F", "Road 5, Town", "0612345678", t),
        (2, None, [("R", "712080012")], "Ann Leeh", b, "F", None, None, t),  # a digit is missing, name, date and gender agree
        (3, None, [("R", "7120800013")], "Ann Lee", b, None, None, None, t),  # too little agrees for another identifier
        (4, None, [("R", "7120800013")], "Bob Jones", D(1980, 1, 1), "F", None, None, t),
        (5, None, [("S", "7120800012")], "Ann Lee", b, "F", None, None, t),
        (6, None, [("R", "7120800112")], "Ann Lee", b, "F", None, "0612345678", t),
    ]
    return data, [(k, 1 + (k == 6)) for k, *_ in data if k > 1]


def test_mistyped_identifiers_are_found_by_the_index(spark, monkeypatch):
    data, log = _mistyped()
    df, log = spark.createDataFrame(data, RECORD), spark.createDataFrame(log, "id long, batch_no long")
    known = lambda: {r["id"]: r["id_cluster"] for r in segments.append_batches(df, log).collect() if r["known"]}
    assert known() == {2: 1, 6: 1}
    probe = segments.SegmentIndex.probe
    monkeypatch.setattr(segments.SegmentIndex, "probe", lambda self, strings: probe(self, strings).where("distance = 0"))  # an equality join
    assert known() == {}


def test_batches_appended_to_a_stored_history(spark, tmp_path):
    """One batch after the other, each with what is stored of those before, gives what the replay of all gives."""
    data, log = _mistyped()
    t, b, ident = D(2020, 1, 1), D(1990, 2, 2), lambda *x: [("R", e) for e in x]
    data += [(10, None, ident("771177"), "Cara New", b, "F", "New 1, City", None, t), (11, None, ident("771177", "881188"), "Cara Neww", b, "F", None, None, t), (12, None, ident("881188"), "C. New", b, None, None, None, t), (13, None, None, "Cara New", b, None, "new 1 city", None, t)]
    log += [(10, 1), (11, 2), (12, 3), (13, 3)]
    df = spark.createDataFrame(data, RECORD)
    want = {r["id"]: (r["id_cluster"], r["known"]) for r in segments.append_batches(df, spark.createDataFrame(log, "id long, batch_no long")).collect()}
    assert want[12] == (10, True) and want[13] == (10, True)
    history, found = segments.accept_history(df, str(tmp_path / "history")), {}
    for k in (1, 2, 3):
        again = segments.History(spark, str(tmp_path / "history"))  # nothing but the folder is kept
        batch = df.where(F.col("_id").isin([i for i, n in log if n == k]))
        found |= {r["id"]: (r["id_cluster"], r["known"]) for r in segments.append_batch(again, batch, k).collect()}
    assert found == want and history.index().probe(spark.createDataFrame([("R", "88118")], "block string, s string")).count() == 1


def test_identifier_of_very_many_names(spark):
    t = D(2020, 1, 1)
    ident = [("R", "55667788")]
    data = [(k, k, ident, f"{_letters(k).title()} {_letters(675 - k).title()}", D(1900 + k % 100, 1 + k % 12, 3), "F", f"{_letters(k)} {k}, Town", None, t) for k in range(1, 131)]
    data += [(k, 7, ident, data[6][3], data[6][4], "F", data[6][6], None, t) for k in range(140, 145)]
    name, b = data[49][3], data[49][4]
    data += [
        (1001, None, ident, name + "x", b.replace(day=13), "F", "Moved 1, City", None, t),  # mistyped and moved
        (1002, None, ident, f"{name[0]}. {name.split()[1]}", None, "F", None, None, t),  # an initial, no date
        (1003, None, ident, None, b.replace(year=b.year + 1), None, None, None, t),  # no name, a year off
        (1004, None, ident, "Zoë Quite Other", D(2011, 11, 30), "M", None, None, t),
        (1005, None, ident, "Quite-Other, Zoe", D(2011, 11, 30), "M", None, None, t),
        (1006, None, ident, None, None, None, None, None, t),  # reference only: the person with most records
        (1007, None, ident, None, None, None, f"{_letters(50)} 50 town", None, t),
        (1008, None, ident, "Zoe Quite Other", D(2011, 11, 3), None, None, None, t),
    ]
    log = spark.createDataFrame([(k, 1) for k in range(1001, 1008)] + [(1008, 2)], "id long, batch_no long")
    out = {r["id"]: (r["id_cluster"], r["known"]) for r in segments.append_batches(spark.createDataFrame(data, RECORD), log).collect()}
    assert out == {1001: (50, True), 1002: (50, True), 1003: (50, True), 1004: (1004, False), 1005: (1004, False), 1006: (7, True), 1007: (50, True), 1008: (1004, True)}


def test_mistyped_identifiers_next_to_one_of_very_many_names(spark):
    t, wide = D(2020, 1, 1), [("R", "55667788")]
    data = [(k, k, wide, f"{_letters(k).title()} {_letters(675 - k).title()}", D(1900 + k % 100, 1 + k % 12, 3), "F", f"{_letters(k)} {k}, Town", None, t) for k in range(1, 106)]
    name, b = data[49][3], data[49][4]
    data += [
        (500, 500, [("R", "55667789")], "Cara New", D(2011, 11, 30), "F", None, None, t),
        (1001, None, [("R", "5566778")], name + "x", b.replace(day=13), "F", None, None, t),  # a digit of the common identifier is missing
        (1002, None, wide, "Cara Neww", D(2011, 11, 30), "F", None, None, t),  # the common identifier in place of the own one
        (1003, None, [("R", "5566778")], name, b, None, None, None, t),  # too little agrees for another identifier
    ]
    log = spark.createDataFrame([(k, 1) for k in (1001, 1002, 1003)], "id long, batch_no long")
    out = {r["id"]: (r["id_cluster"], r["known"]) for r in segments.append_batches(spark.createDataFrame(data, RECORD), log).collect()}
    # 1003 has the identifier of 1001, and its name and date of birth, so it comes with that person, though it isn't known itself
    assert out == {1001: (50, True), 1002: (500, True), 1003: (50, False)}


def test_the_way_of_comparing_does_not_change_the_result(spark, monkeypatch):
    rng = random.Random(5)
    names, births = ["Ann Lee", "A. Lee", "Bob Jones", "Maria de Vries", None], [D(1950, 5, 5), D(1950, 5, 31), D(1980, 1, 1), None]
    data, log = [], []
    for k in range(1, 71):
        ids = [("R", x) for x in rng.sample(["71208012", "7120801", "99887766", "5544332"], rng.choice([1, 1, 2, 3]))]
        old = rng.random() < 0.4
        data.append((k, max(1, k - rng.choice([0, 1, 7])) if old else None, ids, rng.choice(names), rng.choice(births), rng.choice(["F", "M", None]), rng.choice(["Road 5, Town", "Else 1, City", None]), rng.choice(["0612345678", None]), D(2020, 1, 1)))
        log += [] if old else [(k, rng.choice([1, 2]))]
    df, log, found = spark.createDataFrame(data, RECORD), spark.createDataFrame(log, "id long, batch_no long"), []
    for most in (4, 1000):
        monkeypatch.setattr(segments, "MOST_PAIRED", most)
        found.append({r["id"]: (r["id_cluster"], r["known"]) for r in segments.append_batches(df, log).collect()})
    assert found[0] == found[1] and len(found[0]) == log.count()


def test_blocking_keys_miss_no_agreeing_details(spark):
    rng = random.Random(4)
    names = ["Ann Lee", "An Leeh", "A. Lee", "Lee Ann", "Ann Lee-Smith", "Ann Smith", "Bob Jones", "Bo Jonas", "Maria de Vries", "Mariah Devries", "Vries", "Al", None, None]
    births = [D(1950, 5, 5), D(1950, 5, 31), D(1950, 6, 4), D(1951, 5, 5), D(1949, 5, 5), D(1950, 12, 3), D(1950, 3, 12), D(1905, 5, 5), D(1960, 5, 5), D(1999, 12, 31), D(2000, 12, 30), D(2000, 1, 31), None, None]
    data = [(k, None, [("R", "1234")], rng.choice(names), rng.choice(births), None, None, None, D(2020, 1, 1)) for k in range(150)]
    rows = segments._profiled(segments._keyed(segments.features(spark.createDataFrame(data, RECORD)).withColumn("batch", F.lit(1)))).cache()
    fits, _ = segments.agree("a", "b")
    pairs = lambda a, b, on: {tuple(r) for r in a.alias("a").join(b.alias("b"), on).where(fits & F.expr("a.kind & b.kind <> 0")).select("a.id", "b.id").collect()}
    on = segments._same_string("a", "b", "other", "key")
    every = pairs(rows, rows, F.lit(True))
    assert pairs(segments._blocking(rows, probe=True), segments._blocking(rows, probe=False), on) == every and len(every) < 150 * 150


def test_one_person_through_a_bridge(spark):
    t, ident = D(2020, 1, 1), [("R", "424242")]
    data = [
        (10, None, ident, None, D(1950, 5, 5), None, None, None, t),
        (11, None, ident, "Ann Lee", D(1950, 5, 5), None, None, None, t),
        (12, None, ident, "Ann Lee", D(1972, 11, 30), None, None, None, t),
        (13, None, ident, "Ann Lee", D(1972, 11, 30), None, None, None, t),
        (20, None, [("R", "525252")], None, None, None, None, None, t),  # says nothing, so it doesn't make one person of the next two
        (21, None, [("R", "525252")], "Ann Lee", D(1950, 5, 5), "F", None, None, t),
        (22, None, [("R", "525252")], "Bob Jones", D(1980, 1, 1), "M", None, None, t),
    ]
    log = spark.createDataFrame([(k, 2 if k == 13 else 1) for k, *_ in data], "id long, batch_no long")
    out = {r["id"]: r["id_cluster"] for r in segments.append_batches(spark.createDataFrame(data, RECORD), log).collect()}
    assert out == {10: 10, 11: 10, 12: 10, 13: 10, 20: 20, 21: 20, 22: 22}


def test_plans_do_not_grow_with_the_batches_before(spark, monkeypatch):
    data, _ = _mistyped()
    sizes, in_clusters = [], segments._in_clusters

    def spied(rows, clusters):
        sizes.append(0 if clusters is None else str(clusters._jdf.queryExecution().analyzed()).count("\n"))
        return in_clusters(rows, clusters)

    monkeypatch.setattr(segments, "_in_clusters", spied)
    log = spark.createDataFrame([(k, k) for k, *_ in data if k > 1][:3], "id long, batch_no long")
    segments.append_batches(spark.createDataFrame(data, RECORD), log)
    assert len(sizes) == 3 and sizes[1] == sizes[2] > 0
