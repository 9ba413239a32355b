"""Which values are true: a latent two-sided quality model of feeds, fitted by expectation-maximisation.

A fact is a value of a field, of one group of duplicates or of persons in general; feeds vote for it (they state it too)
or against it (they state only other things). Each feed has a sensitivity (how often it votes for true facts) and a
specificity (how often against false ones); both are inferred together with the facts' truth and with the share of true
facts in each class of them. Facts are judged one by one, so a field may keep several true values. Facts with equal votes
are alike: the model is fitted on vote patterns with their numbers, in Spark, and the driver sees one row per feed and
class in each round. So there is no limit on facts or patterns, and feeds are never merged.

It is used twice. fillers() asks of each value that several groups have in common whether it says anything about a
person: in each such group one of the other records votes. A filler is contradicted nearly everywhere; a name, a date or
an address that many persons share is confirmed by the other records of many of them, however many groups it is in. What
a value looks like doesn't count. fused() asks which values of each group are true, with all feeds that speak there.

Defined results: null and blank values are no facts; a value of one group only is kept, as nothing tells it from another
value of that person; a group of records without any real value has 0 as source of that field; repeated rows of a record
are its versions; equal ranks are decided by the smaller id; records without a feed are one feed.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalis.llm.topn import latest
from vitalis.session import bounded_rows, cut

#: Different feeds, and classes of facts, at most.
MOST_FEEDS, MOST_CLASSES = 10_000, 10_000
#: Patterns up to which the driver works on them itself, in place of a job a round; the result is the same.
FEW_PATTERNS = 20_000
#: Rounds of fitting at most, and the change of any quality under which it ends.
ROUNDS, STILL = 15, 1e-3
FIELDS = {"name": "name", "birth": "birth_time", "addr": "addr", "telecom": "telecom"}
#: Odds against a value from which it is a filler: dropping a real value is worse than keeping a filler.
CERTAIN = 50.0


class TwoSided:
    """Sensitivity and specificity of each feed, and the share of true facts of each class; fit() infers them from votes."""

    def __init__(self, sensitivity: float = 0.7, specificity: float = 0.95, share: float = 0.9, weight: float = 5.0, weight_of_class: float = 2.0):
        """The start values; they go on to count as so many votes of a feed, and facts of a class."""
        self.start = (sensitivity, specificity, share)
        self.weight, self.weight_of_class = weight, weight_of_class
        self.feeds: dict[str, tuple[float, float]] = {}
        self.classes: dict[str, float] = {}

    def odds(self, kind: Column, votes: Column) -> Column:
        """The logarithm of the odds for facts of a class, from votes array<struct<feed, pro, con>>."""
        pro = {f: math.log(sen / (1 - spe)) for f, (sen, spe) in self.feeds.items()}
        con = {f: math.log((1 - sen) / spe) for f, (sen, spe) in self.feeds.items()}
        of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,double>")
        pros, cons = of(pro), of(con)
        spoken = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v["pro"] * pros[v["feed"]] + v["con"] * cons[v["feed"]])
        return of({c: math.log(p / (1 - p)) for c, p in self.classes.items()})[kind] + spoken

    def _sums_here(self, patterns: list) -> dict[tuple[str, str], tuple]:
        """By class and feed the expected votes: for true facts, against them, for false ones, against those."""
        sums: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0] * 4)
        for kind, votes, n in patterns:
            p = self.classes[kind]
            odds = math.log(p / (1 - p))
            for feed, pro, con in votes:
                sen, spe = self.feeds[feed]
                odds += pro * math.log(sen / (1 - spe)) + con * math.log((1 - sen) / spe)
            t = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            for key, pro, con in [(("class", kind), 1, 0), *((("feed", f), a, b) for f, a, b in votes)]:
                for k, x in enumerate((n * t * pro, n * t * con, n * (1 - t) * pro, n * (1 - t) * con)):
                    sums[key][k] += x
        return sums

    def _sums_there(self, patterns: DataFrame) -> dict[tuple[str, str], tuple]:
        """The same by Spark."""
        truth = patterns.withColumn("t", 1 / (1 + F.exp(-self.odds(F.col("kind"), F.col("votes")))))
        each = truth.select("n", "t", F.explode(_spoken(F.lit(1), F.lit(0))).alias("x"))
        n, t, pro, con = F.col("n"), F.col("t"), F.col("x.pro"), F.col("x.con")
        sums = each.groupBy("x.of", "x.name").agg(F.sum(n * t * pro), F.sum(n * t * con), F.sum(n * (1 - t) * pro), F.sum(n * (1 - t) * con))
        return {(of, name): tuple(x) for of, name, *x in sums.collect()}

    def fit(self, patterns: DataFrame, few: int = FEW_PATTERNS) -> TwoSided:
        """patterns: (kind, votes, n), n facts of a class with the same votes. Up to few are worked on by the driver, more where they lie."""
        sen0, spe0, share0 = self.start
        here = [(k, [tuple(v) for v in votes], n) for k, votes, n in patterns.select("kind", "votes", "n").limit(few + 1).collect()]
        if len(here) <= few:
            names = {("class", k) for k, _, _ in here} | {("feed", f) for _, votes, _ in here for f, _, _ in votes}
        else:
            here = None
            spoken = patterns.select(F.explode(_spoken(F.lit(1), F.lit(0))).alias("x")).select("x.of", "x.name").distinct()
            names = {tuple(r) for r in bounded_rows(spoken, MOST_FEEDS + MOST_CLASSES, "feeds and classes")}
        self.classes = {n: share0 for of, n in names if of == "class"}
        self.feeds = {n: (sen0, spe0) for of, n in names if of == "feed"}
        inside = lambda x: min(max(x, 1e-6), 1 - 1e-6)
        for _ in range(ROUNDS):
            moved = 0.0
            for (of, name), (pt, ct, pf, cf) in (self._sums_there(patterns) if here is None else self._sums_here(here)).items():
                if of == "class":
                    new = inside((self.weight_of_class * share0 + pt) / (self.weight_of_class + pt + pf))
                    moved, self.classes[name] = max(moved, abs(new - self.classes[name])), new
                else:
                    sen, spe = inside((self.weight * sen0 + pt) / (self.weight + pt + ct)), inside((self.weight * spe0 + cf) / (self.weight + pf + cf))
                    moved = max(moved, abs(sen - self.feeds[name][0]), abs(spe - self.feeds[name][1]))
                    self.feeds[name] = (sen, spe)
            if moved < STILL:
                break
        return self


def _spoken(one: Column, none: Column) -> Column:
    """Of a pattern its class, as if it voted for it, and its votes: array<struct<of, name, pro, con>>."""
    of_class = F.struct(F.lit("class").alias("of"), F.col("kind").alias("name"), one.cast("long").alias("pro"), none.cast("long").alias("con"))
    return F.concat(F.array(of_class), F.transform("votes", lambda v: F.struct(F.lit("feed").alias("of"), v["feed"].alias("name"), v["pro"].alias("pro"), v["con"].alias("con"))))


def judge(facts: DataFrame, model: TwoSided | None = None) -> tuple[DataFrame, TwoSided]:
    """(facts with odds, the fitted model): facts have kind and votes."""
    facts = facts.withColumn("votes", F.array_sort("votes"))
    patterns = cut(facts.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")))
    model = (model or TwoSided()).fit(patterns)
    return facts.withColumn("odds", model.odds(F.col("kind"), F.col("votes"))), model


def written_alike(value: Column) -> Column:
    """A value in lower case with single blanks, without blanks around it; null if nothing is left."""
    text = F.lower(F.trim(F.regexp_replace(value, r"[\s ]+", " ")))
    return F.when(text != "", text)


def long_fields(records: DataFrame, keys: list[Column]) -> DataFrame:
    """(keys..., field, value): the fields of FIELDS that are not blank, written alike."""
    text = {f: F.date_format(F.col(c), "yyyy-MM-dd") if f == "birth" else F.col(c) for f, c in FIELDS.items()}
    each = F.array(*[F.struct(F.lit(f).alias("field"), written_alike(v).alias("value")) for f, v in text.items()])
    rows = records.select(*keys, F.explode(each).alias("x"))
    return rows.select(*[c for c in rows.columns if c != "x"], "x.field", "x.value").where("value is not null")


def gist(field: Column, value: Column) -> Column:
    """What of a value the same person's other records have in common with it: the longest word of a name or an address,
    the last eight digits of a telephone number, else the whole value."""
    words = F.filter(F.split(value, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    digits = F.substring(F.regexp_replace(value, r"\D", ""), -8, 8)
    own = F.when(field.isin("name", "addr"), longest).when((field == "telecom") & (digits != ""), digits)
    return F.coalesce(own, value)


def fillers(values: DataFrame, group: str, model: TwoSided | None = None) -> tuple[DataFrame, TwoSided]:
    """((field, value) of the values that say nothing about a person, the model): values has group, field, value and feed.

    Of the other records of a group that has the value one votes: for it, if its value has the same gist; else against
    it. Where several could, it is one that agrees. Values of a field are classed by the power of 2 of their groups.
    """
    rows = values.select(F.col(group).alias("g"), "field", "value", F.coalesce("feed", F.lit("")).alias("feed"), gist(F.col("field"), F.col("value")).alias("gist"))
    common = rows.groupBy("field", "value").agg(F.min("g").alias("least"), F.max("g").alias("most")).where("least <> most").select("field", "value")
    by_gist = rows.groupBy("g", "field", "gist").agg(F.count(F.lit(1)).alias("k"), F.min("feed").alias("first"), F.max("feed").alias("last"))
    around = by_gist.groupBy("g", "field").agg(F.min(F.struct("first", "gist")).alias("low"), F.max(F.struct("last", "gist")).alias("high"))
    asked = rows.join(common, ["field", "value"], "left_semi").select("g", "field", "value", "gist").distinct()
    met = asked.join(by_gist, ["g", "field", "gist"]).join(around, ["g", "field"])
    pro = F.col("k") > 1
    other = F.when(F.col("low.gist") != F.col("gist"), F.col("low.first")).when(F.col("high.gist") != F.col("gist"), F.col("high.last"))
    voter = F.when(pro, F.col("last")).otherwise(other)  # null: nobody else speaks
    said = met.select("field", "value", voter.alias("feed"), pro.cast("long").alias("pro"), (~pro & other.isNotNull()).cast("long").alias("con"))
    by_feed = said.groupBy("field", "value", "feed").agg(F.sum("pro").alias("pro"), F.sum("con").alias("con"), F.count(F.lit(1)).alias("n"))
    vote = F.when(F.col("feed").isNotNull(), F.struct("feed", "pro", "con"))
    facts = by_feed.groupBy("field", "value").agg(F.collect_list(vote).alias("votes"), F.sum("n").alias("n"))
    facts = facts.withColumn("kind", F.concat_ws("|", "field", F.floor(F.log2("n")).cast("string")))
    judged, model = judge(cut(facts), model)
    return judged.where(F.col("odds") < -math.log(CERTAIN)).select("field", "value"), model


def survivors(records: DataFrame, feed: Column | None = None) -> DataFrame:
    """(id_cluster, survivor_id, name_id, birth_id, addr_id, telecom_id): one row per _id_cluster of two or more records.

    Records rank by greater weight (missing is 0), later timestamp, smaller _id; a field comes from the first record
    that has a value which was not judged a filler. feed names the interface that a record came by, _mif if none is given.
    """
    kept = ["_id", "_id_cluster", "_record_weight", "_lake_timestamp", *FIELDS.values()]
    feed = F.col("_mif") if feed is None else feed
    rows = latest(records.where("_id is not null").select(*kept, feed.cast("string").alias("__feed")), "_id").where("_id_cluster is not null")
    # the greatest is the first; null timestamps are the least, and come last
    order = F.struct(F.coalesce("_record_weight", F.lit(0)).alias("w"), F.col("_lake_timestamp").alias("t"), (-F.col("_id")).alias("id"))
    rows = cut(rows.select("_id_cluster", order.alias("order"), F.col("__feed").alias("feed"), *FIELDS.values()))
    values = long_fields(rows, [F.col("_id_cluster"), F.col("order"), F.col("feed")])
    none, _ = fillers(values, "_id_cluster")
    real = values.join(none, ["field", "value"], "left_anti").select("_id_cluster", "order", "field")
    every = rows.select("_id_cluster", "order", F.lit("record").alias("field"))
    first = every.unionByName(real).groupBy("_id_cluster")
    best = first.agg(
        F.count(F.when(F.col("field") == "record", 1)).alias("n"),
        F.max("order").alias("survivor"),
        *[F.max(F.when(F.col("field") == f, F.col("order"))).alias(f) for f in FIELDS],
    ).where("n > 1")
    return best.select(
        F.col("_id_cluster").alias("id_cluster"), (-F.col("survivor.id")).alias("survivor_id"), *[F.coalesce(-F.col(f"{f}.id"), F.lit(0)).alias(f"{f}_id") for f in FIELDS]
    )


def fused(records: DataFrame, feed: Column) -> DataFrame:
    """(id_cluster, field, values): of each group and field every value that is judged true, the likeliest first.

    A feed votes for a value of a group if one of its records there states it, and against if it states only others;
    its sensitivity and specificity come from all groups.
    """
    rows = latest(records.where("_id is not null").select("_id", "_id_cluster", "_lake_timestamp", feed.cast("string").alias("__feed"), *FIELDS.values()), "_id")
    rows = cut(rows.where("_id_cluster is not null"))
    values = long_fields(rows, [F.col("_id_cluster"), F.coalesce("__feed", F.lit("")).alias("feed")])
    none, _ = fillers(values, "_id_cluster")
    values = values.join(none, ["field", "value"], "left_anti")
    said = cut(values.groupBy("_id_cluster", "field", "value", "feed").agg(F.count(F.lit(1)).alias("n")))
    by_fact = said.groupBy("_id_cluster", "field", "value").agg(F.collect_list("feed").alias("pro"), F.sum("n").alias("n"))
    by_group = said.groupBy("_id_cluster", "field").agg(F.collect_set("feed").alias("spoke"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    votes = F.transform("spoke", lambda f: F.struct(f.alias("feed"), F.when(F.array_contains("pro", f), one).otherwise(none).alias("pro"), F.when(F.array_contains("pro", f), none).otherwise(one).alias("con")))
    facts = by_fact.join(by_group, ["_id_cluster", "field"]).select("_id_cluster", "field", "value", "n", F.col("field").alias("kind"), votes.alias("votes"))
    judged, _ = judge(facts, TwoSided(0.8, 0.9, 0.5))
    likely = F.array_sort(F.collect_list(F.struct((-F.col("odds")).alias("t"), (-F.col("n")).alias("n"), F.col("value").alias("value"))))
    kept = judged.where("odds >= 0").groupBy("_id_cluster", "field").agg(likely.alias("l"))
    return kept.select(F.col("_id_cluster").alias("id_cluster"), "field", F.transform("l", lambda x: x["value"]).alias("values"))
