"""Changes over time, cohorts and patient properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.functions.semantics import integer_ratio
from vitalis.operators import history, research
from vitalis.sources import rim_views as V
from vitalis.sources.rim_views import AS_OF_EXAMS, with_views

DRUGS = ["purchase", "signup"]


def q10_prev_rank(spark: SparkSession, d: str) -> DataFrame:
    """Patients whose latest view value is high for their age and whose one before, within six months, is high or missing."""
    v = V.observations(spark, d).where("code = 'view'")
    r = history.ranked(v, ["ptnt_id"]).where("rocky <= 2")
    pairs = r.where("rocky = 1").alias("c").join(r.where("rocky = 2").alias("p"), (F.col("c.ptnt_id") == F.col("p.ptnt_id")) & (F.col("p.time") >= F.col("c.time") - F.expr("interval 6 month")), "left")
    people = V.persons(spark, d)
    rows = pairs.join(people, F.col("c.ptnt_id") == people["_id"])
    limit = F.when(F.col("birth_date") < F.lit("1960-01-01").cast("date"), 40.0).otherwise(60.0)
    high = (F.col("c.pq_value").cast("double") > limit) & (F.col("p.pq_value").isNull() | (F.col("p.pq_value").cast("double") > limit))
    flagged = rows.where(high).select(F.col("c.ptnt_id").alias("ptnt_id"), F.col("c.act_id").alias("act_id"), F.col("c.pq_value").cast("double").alias("value"), F.col("p.pq_value").cast("double").alias("before"))
    complications = history.latest_of(V.observations(spark, d), ["ptnt_id", "code"]).where("code <> 'view' and coded_value in (1, 2)").groupBy("ptnt_id").agg(F.count(F.lit(1)).alias("complications"))
    return flagged.join(complications, "ptnt_id", "left").withColumn("complications", F.coalesce("complications", F.lit(0)))


def q11_change_effect(spark: SparkSession, d: str) -> DataFrame:
    """Means of click values in the days before, between and after a change of a drug's coded value."""
    o = V.observations(spark, d)
    drugs = spark.createDataFrame([(c,) for c in DRUGS], "code string")
    h = history.ranked(o.join(F.broadcast(drugs), "code"), ["ptnt_id", "code"]).select("ptnt_id", "code", "act_id", "time", "coded_value", "rocky")
    changes = history.before_each(h, ["ptnt_id", "code"]).where("coded_value <> prev_coded_value").select("ptnt_id", "code", "act_id", "time", "coded_value", F.col("prev_time").alias("orig_time"), F.col("prev_coded_value").alias("orig_value"))
    clicks = o.where("code = 'click'")
    ids, at, orig, span = ["ptnt_id", "act_id"], F.col("time"), F.col("orig_time"), F.expr("interval 5 day")
    spans = changes.select("ptnt_id", "act_id", F.col("time").alias("c_time"), "orig_time")
    at = F.col("c_time")
    out = changes
    for low, high, name in ((orig - span, orig, "avg_before"), (orig, at, "avg_between"), (at, at + span, "avg_after")):
        out = out.join(history.average_between(spans, clicks, "ptnt_id", ids, low, high, name), ids, "left")
    return out.select("ptnt_id", "code", "act_id", "orig_time", "orig_value", "time", "coded_value", "avg_before", "avg_between", "avg_after")


def _active(spark: SparkSession, d: str, periods: DataFrame) -> DataFrame:
    """(org_id, period, total): patients whose end, if they have one, lies before the period's end.

    Ended patients are counted by day first, so the join with the few periods is small.
    """
    per = V.patients(spark, d).groupBy(F.col("scoper").alias("org_id"), "to_time").agg(F.count(F.lit(1)).alias("n"))
    met = per.join(F.broadcast(periods), F.col("to_time").isNull() | (F.col("to_time") < F.col("to_date")))  # six periods
    return met.groupBy("org_id", "period").agg(F.sum("n").alias("total"))


def q12_trend_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Examinations of each code per patient of an organisation and half-year, as whole quotients."""
    periods = history.periods(spark, AS_OF_EXAMS, 6, 6)
    total = _active(spark, d, periods)
    exams = V.examinations(spark, d)
    per_day = exams.join(V.patients(spark, d).select(F.col("_id").alias("ptnt_id"), F.col("scoper").alias("org_id")), "ptnt_id").groupBy("org_id", "code", "time").agg(F.count(F.lit(1)).alias("n"))
    hit = per_day.join(F.broadcast(periods), F.col("time").between(F.col("from_date"), F.col("to_date"))).groupBy("org_id", "code", "period").agg(F.sum("n").alias("c"))
    codes = exams.select("code").distinct()
    # organisations and periods by codes: dimensions of the report, far smaller than the facts
    grid = total.join(F.broadcast(periods), "period").crossJoin(codes)
    out = grid.join(hit, ["org_id", "code", "period"], "left")
    return out.select("org_id", "period", "code", F.col("from_date"), F.col("to_date"), F.col("total").cast("long").alias("total"), integer_ratio(F.coalesce("c", F.lit(0)), F.col("total")).alias("per_patient"))


def q13_latest_before(spark: SparkSession, d: str) -> DataFrame:
    """Per organisation and period: patients whose latest signup value before its end is 1, and who went from 1 to 2 in it."""
    periods = history.periods(spark, AS_OF_EXAMS, 6, 6)
    days = periods.select("period", (F.lit("2024-02-01").cast("timestamp_ntz") - F.expr("make_dt_interval(5) * (period + 1)")).alias("from_date"), (F.lit("2024-02-01").cast("timestamp_ntz") - F.expr("make_dt_interval(5) * period")).alias("to_date"))
    orgs = V.patients(spark, d).select(F.col("_id").alias("ptnt_id"), F.col("scoper").alias("org_id"))
    h = history.ranked(V.observations(spark, d).where("code = 'signup'"), ["ptnt_id"]).select("ptnt_id", "act_id", "time", "coded_value", "rocky")
    newest = h.join(F.broadcast(days), F.col("time") < F.col("to_date")).groupBy("period", "ptnt_id").agg(F.min("rocky").alias("rocky"))
    last = newest.join(h, ["ptnt_id", "rocky"]).join(orgs, "ptnt_id").join(F.broadcast(days), "period")
    before = h.select(F.col("ptnt_id").alias("b_ptnt"), (F.col("rocky") - 1).alias("b_rank"), F.col("coded_value").alias("b_value")).where("b_value = 1")
    smoking = last.where("coded_value = 1").groupBy("org_id", "period").agg(F.count(F.lit(1)).alias("ones"))
    ceased = last.where("coded_value = 2").where(F.col("time").between(F.col("from_date"), F.col("to_date"))).join(before, (F.col("ptnt_id") == F.col("b_ptnt")) & (F.col("rocky") == F.col("b_rank"))).groupBy("org_id", "period").agg(F.count(F.lit(1)).alias("changed"))
    total = _active(spark, d, days)
    out = total.join(smoking, ["org_id", "period"], "left").join(ceased, ["org_id", "period"], "left")
    ones, changed = F.coalesce("ones", F.lit(0)), F.coalesce("changed", F.lit(0))
    return out.select("org_id", "period", F.col("total").cast("long").alias("total"), ones.alias("ones"), (integer_ratio(ones, F.col("total")) * 100).alias("perc_ones"), changed.alias("changed"), (integer_ratio(changed, F.col("ones")) * 100).alias("perc_changed"))


def q14_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Patients with an urgent examination, or a high one, within the study's years."""
    e = V.examinations(spark, d).where(F.col("time").between(F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1999-12-31").cast("timestamp_ntz")))
    return e.where("code = '1-URGENT' or code = '2-HIGH'").select("ptnt_id").distinct()


def _properties(spark: SparkSession, d: str) -> DataFrame:
    cohort = q14_cohort(spark, d)
    return V.observations(spark, d).join(cohort, "ptnt_id", "left_semi")


def q15_props_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The cohort's latest values of three codes, one column each."""
    latest = history.latest_of(_properties(spark, d), ["ptnt_id", "code"]).withColumn("x", F.col("pq_value").cast("double"))
    return latest.groupBy("ptnt_id").pivot("code", ["click", "signup", "view"]).agg(F.max("x")).where("click is not null or signup is not null or view is not null")


def q16_risk_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The cohort's risk factors: values per day, and coded values as days a week."""
    latest = history.latest_of(_properties(spark, d).where("not (coded_value = 3)"), ["ptnt_id", "code"])
    x = F.col("pq_value").cast("double")
    days = F.when(F.col("coded_value") == 0, 0).when(F.col("coded_value") == 1, 2).when(F.col("coded_value") == 2, 4).when(F.col("coded_value") == 4, 5).cast("long")
    g = latest.groupBy("ptnt_id")
    return g.agg(F.max(F.when(F.col("code") == "click", F.round(x / 7, 2))).alias("click_daily"), F.max(F.when(F.col("code") == "view", days)).alias("view_days"), F.max(F.when(F.col("code") == "error", x)).alias("error"))


_RANK = "rank() OVER (PARTITION BY {} ORDER BY time DESC NULLS FIRST, act_id DESC NULLS FIRST) AS rocky"
_PERIODS = ", ".join(f"({k}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for k, (a, b) in enumerate([("2001-02-01", "2001-08-01"), ("2000-08-01", "2001-02-01"), ("2000-02-01", "2000-08-01"), ("1999-08-01", "2000-02-01"), ("1999-02-01", "1999-08-01"), ("1998-08-01", "1999-02-01")]))
_COHORT = "cohort AS (SELECT DISTINCT ptnt_id FROM exams WHERE time BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31' AND code IN ('1-URGENT', '2-HIGH'))"
# rounded half up in whole numbers, as the mean of decimals is
_AVG = "(SELECT CAST((CAST(sum(pq_value) * 100 AS BIGINT) * 2 + count(*)) // nullif(2 * count(*), 0) AS DOUBLE) / 100 FROM observations hb WHERE hb.code = 'click' AND hb.ptnt_id = mc.ptnt_id AND hb.time BETWEEN {} AND {}) AS {}"

QUERIES = {f.__name__: f for f in (q10_prev_rank, q11_change_effect, q12_trend_buckets, q13_latest_before, q14_cohort, q15_props_pivot, q16_risk_pivot)}

SQL = {
    "q10_prev_rank": with_views("observations persons", f"""r AS (SELECT *, {_RANK.format('ptnt_id')} FROM observations WHERE code = 'view'),
        lim AS (SELECT _id, CASE WHEN birth_date < DATE '1960-01-01' THEN 40.0 ELSE 60.0 END AS lim FROM persons),
        f AS (SELECT c.ptnt_id, c.act_id, CAST(c.pq_value AS DOUBLE) AS value, CAST(p.pq_value AS DOUBLE) AS before FROM r c LEFT JOIN r p ON p.ptnt_id = c.ptnt_id AND p.rocky = 2 AND p.time >= c.time - INTERVAL 6 MONTH JOIN lim ON lim._id = c.ptnt_id
            WHERE c.rocky = 1 AND CAST(c.pq_value AS DOUBLE) > lim AND (p.pq_value IS NULL OR CAST(p.pq_value AS DOUBLE) > lim)),
        k AS (SELECT ptnt_id, count(*) AS complications FROM (SELECT *, {_RANK.format('ptnt_id, code')} FROM observations) WHERE rocky = 1 AND code <> 'view' AND coded_value IN (1, 2) GROUP BY ptnt_id)
        SELECT f.*, coalesce(complications, 0) AS complications FROM f LEFT JOIN k USING (ptnt_id)"""),
    "q11_change_effect": with_views("observations", f"""h AS (SELECT *, {_RANK.format('ptnt_id, code')} FROM observations WHERE code IN ('purchase', 'signup')),
        mc AS (SELECT c.ptnt_id, c.code, c.act_id, p.time AS orig_time, p.coded_value AS orig_value, c.time, c.coded_value FROM h c JOIN h p ON p.ptnt_id = c.ptnt_id AND p.code = c.code AND p.rocky = c.rocky + 1 AND p.coded_value <> c.coded_value)
        SELECT mc.*, {_AVG.format("mc.orig_time - INTERVAL 5 DAY", "mc.orig_time", "avg_before")}, {_AVG.format("mc.orig_time", "mc.time", "avg_between")}, {_AVG.format("mc.time", "mc.time + INTERVAL 5 DAY", "avg_after")} FROM mc"""),
    "q12_trend_buckets": with_views("exams patients", f"""p(period, from_date, to_date) AS (VALUES {_PERIODS}),
        t AS (SELECT scoper AS org_id, period, count(*) AS total FROM patients JOIN p ON to_time IS NULL OR to_time < to_date GROUP BY scoper, period),
        e AS (SELECT scoper AS org_id, code, period, count(*) AS c FROM exams JOIN p ON time BETWEEN from_date AND to_date JOIN patients ON patients._id = ptnt_id GROUP BY scoper, code, period)
        SELECT t.org_id, CAST(t.period AS BIGINT) AS period, k.code, from_date, to_date, total, coalesce(c, 0) // total AS per_patient FROM t JOIN p USING (period) CROSS JOIN (SELECT DISTINCT code FROM exams) k LEFT JOIN e ON e.org_id = t.org_id AND e.period = t.period AND e.code = k.code"""),
    "q13_latest_before": with_views("observations patients", f"""p AS (SELECT period, TIMESTAMP '2024-02-01' - INTERVAL 5 DAY * (period + 1) AS from_date, TIMESTAMP '2024-02-01' - INTERVAL 5 DAY * period AS to_date FROM (VALUES (0), (1), (2), (3), (4), (5)) x(period)),
        t AS (SELECT scoper AS org_id, period, count(*) AS total FROM patients JOIN p ON to_time IS NULL OR to_time < to_date GROUP BY scoper, period),
        h AS (SELECT *, {_RANK.format('ptnt_id')} FROM observations WHERE code = 'signup'),
        n AS (SELECT period, ptnt_id, min(rocky) AS rocky FROM h JOIN p ON time < to_date GROUP BY period, ptnt_id),
        l AS (SELECT n.period, n.ptnt_id, n.rocky, h.time, h.coded_value, scoper AS org_id FROM n JOIN h ON h.ptnt_id = n.ptnt_id AND h.rocky = n.rocky JOIN patients ON patients._id = n.ptnt_id),
        o AS (SELECT org_id, period, count(*) AS ones FROM l WHERE coded_value = 1 GROUP BY org_id, period),
        c AS (SELECT l.org_id, l.period, count(*) AS changed FROM l JOIN p USING (period) JOIN h b ON b.ptnt_id = l.ptnt_id AND b.rocky = l.rocky + 1 AND b.coded_value = 1 WHERE l.coded_value = 2 AND l.time BETWEEN from_date AND to_date GROUP BY l.org_id, l.period)
        SELECT t.org_id, CAST(t.period AS BIGINT) AS period, total, coalesce(ones, 0) AS ones, coalesce(ones, 0) // total * 100 AS perc_ones, coalesce(changed, 0) AS changed, coalesce(changed, 0) // ones * 100 AS perc_changed FROM t LEFT JOIN o USING (org_id, period) LEFT JOIN c USING (org_id, period)"""),
    "q14_cohort": with_views("exams", _COHORT + " SELECT ptnt_id FROM cohort"),
    "q15_props_pivot": with_views("exams observations", f"""{_COHORT}, l AS (SELECT * FROM (SELECT *, {_RANK.format('ptnt_id, code')} FROM observations WHERE ptnt_id IN (SELECT ptnt_id FROM cohort)) WHERE rocky = 1 AND code IN ('click', 'signup', 'view'))
        SELECT ptnt_id, """ + ", ".join(f"max(CASE WHEN code = '{c}' THEN CAST(pq_value AS DOUBLE) END) AS {c}" for c in ("click", "signup", "view")) + " FROM l GROUP BY ptnt_id"),
    "q16_risk_pivot": with_views("exams observations", f"""{_COHORT}, l AS (SELECT * FROM (SELECT *, {_RANK.format('ptnt_id, code')} FROM observations WHERE ptnt_id IN (SELECT ptnt_id FROM cohort) AND NOT (coded_value = 3)) WHERE rocky = 1)
        SELECT ptnt_id, max(CASE WHEN code = 'click' THEN round(CAST(pq_value AS DOUBLE) / 7, 2) END) AS click_daily, CAST(max(CASE WHEN code = 'view' THEN CASE coded_value WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 4 THEN 5 END END) AS BIGINT) AS view_days, max(CASE WHEN code = 'error' THEN CAST(pq_value AS DOUBLE) END) AS error FROM l GROUP BY ptnt_id"""),
}
