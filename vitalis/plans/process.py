"""Process analysis, averages and extremes, over the clinical views of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.functions.semantics import truncated_percent, within
from vitalis.operators import history
from vitalis.operators.graph import closure
from vitalis.session import table
from vitalis.sources import rim_views as V
from vitalis.sources.rim_views import with_views

CHECKS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SINCE = "2000-08-01"
NUMERIC = ["click", "purchase", "signup", "view"]


def q01_exam_rank(spark: SparkSession, d: str) -> DataFrame:
    """Recency rank of each examination of a person and code system and code, over all rows as they are stored."""
    e = table(spark, d, "examinations_view").select("peso_id", "codesystem", "code", "act_id", F.col("effective_time_low").alias("time"))
    return history.ranked(e, ["peso_id", "codesystem", "code"])


def q01_exam_orders(spark: SparkSession, d: str) -> DataFrame:
    return history.ranked(V.examinations(spark, d), ["ptnt_id", "code"]).select("ptnt_id", "code", "act_id", "rocky")


def q02_obs_history(spark: SparkSession, d: str) -> DataFrame:
    o = history.ranked(V.observations(spark, d), ["ptnt_id", "code"], oldest="drago")
    return o.select("ptnt_id", "code", "act_id", F.col("pq_value").cast("double").alias("pq_value"), "rocky", "drago")


def _shares(groups: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """(key, total, check_1...): provisions per group, and the share of them whose patient's latest check of a kind is recent.

    groups: (ptnt_id, key, n) with n provisions each, so that neither side multiplies before it is aggregated. All kinds
    are counted in one pass.
    """
    total = groups.groupBy(key).agg(F.sum("n").alias("total"))
    counts = groups.join(latest, "ptnt_id").groupBy(key).agg(*[F.sum(F.when(F.col("code") == c, F.col("n") * F.col("m"))).alias(f"c{k}") for k, c in enumerate(CHECKS)])
    shares = [truncated_percent(F.coalesce(f"c{k}", F.lit(0)), F.col("total")).alias(f"check_{k + 1}") for k in range(len(CHECKS))]
    return total.join(counts, key, "left").select(F.col(key).cast("long").alias(key), F.col("total").cast("long").alias("total"), *shares)


def _recent(spark: SparkSession, d: str) -> DataFrame:
    """(ptnt_id, code, m): latest examinations of a code that are not older than the cut."""
    latest = history.latest_of(V.examinations(spark, d), ["ptnt_id", "code"]).where(F.col("time") >= F.lit(SINCE).cast("timestamp_ntz"))
    return latest.groupBy("ptnt_id", "code").agg(F.count(F.lit(1)).alias("m"))


def q03_process_by_org(spark: SparkSession, d: str) -> DataFrame:
    """Per organisation, which share of its active care provisions had each kind of check as latest one since the cut."""
    per = V.care_provisions(spark, d).groupBy("ptnt_id").agg(F.count(F.lit(1)).alias("n"))
    groups = per.join(V.patients(spark, d).select(F.col("_id").alias("ptnt_id"), F.col("scoper").alias("org_id")), "ptnt_id")
    return _shares(groups, _recent(spark, d), "org_id")


def q04_by_practitioner(spark: SparkSession, d: str) -> DataFrame:
    """The same per performer whose time with the care provision holds its start."""
    p = V.care_provisions(spark, d).join(V.performers(spark, d), "act_id").where(within(F.col("start_time"), F.col("low"), F.col("high")))
    groups = p.groupBy("ptnt_id", "role_id").agg(F.count(F.lit(1)).alias("n"))
    return _shares(groups, _recent(spark, d), "role_id")


def q05_by_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """The same per organisation and all that it is part of."""
    parts = V.organization_parts(spark, d)
    above = closure(parts, parts.select("child").unionByName(parts.select(F.col("parent").alias("child"))), "child", "parent")
    per = V.care_provisions(spark, d).groupBy("ptnt_id").agg(F.count(F.lit(1)).alias("n"))
    groups = per.join(V.patients(spark, d).select(F.col("_id").alias("ptnt_id"), F.col("scoper").alias("start")), "ptnt_id").join(above, "start")
    return _shares(groups.select("ptnt_id", F.col("reached").alias("org_id"), "n"), _recent(spark, d), "org_id")


def _recent_values(spark: SparkSession, d: str) -> DataFrame:
    latest = history.latest_of(V.observations(spark, d).where(F.col("code").isin(NUMERIC)), ["ptnt_id", "code"])
    return latest.join(V.patients(spark, d).select(F.col("_id").alias("ptnt_id"), F.col("scoper").alias("org_id")), "ptnt_id")


def _mean(value: str) -> F.Column:
    return F.sum(value).cast("double") / F.count(value)


def q06_avg_std(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation of the latest values of four codes per organisation, in one pass."""
    v = _recent_values(spark, d).withColumn("x", F.col("pq_value").cast("double"))
    each = []
    for c in NUMERIC:
        own = F.when(F.col("code") == c, F.col("pq_value"))
        each += [F.round(F.sum(own).cast("double") / F.count(own), 3).alias(f"avg_{c}"), F.round(F.stddev_samp(F.when(F.col("code") == c, F.col("x"))), 3).alias(f"std_{c}")]
    return v.groupBy("org_id").agg(*each)


def q07_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Each organisation's mean less the mean over all."""
    v = _recent_values(spark, d)
    each = [((F.sum(own).cast("double") / F.count(own)).alias(c)) for c in NUMERIC for own in [F.when(F.col("code") == c, F.col("pq_value"))]]
    all_of = v.agg(*each).select(*[F.col(c).alias(f"all_{c}") for c in NUMERIC])  # one row
    return v.groupBy("org_id").agg(*each).crossJoin(all_of).select("org_id", *[F.round(F.col(c) - F.col(f"all_{c}"), 3).alias(f"dev_{c}") for c in NUMERIC])


def q08_extremes_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Patients whose latest click or purchase, or mean view, lies outside fixed ranges, one column each."""
    o = V.observations(spark, d).where("code in ('click', 'purchase', 'view')").join(V.patients(spark, d).select(F.col("_id").alias("ptnt_id"), F.col("scoper").alias("org_id"), F.col("player").alias("peso_id")), "ptnt_id")
    means = o.groupBy("org_id", "ptnt_id", "code").agg(F.round(_mean("pq_value"), 3).alias("mean"))
    latest = history.latest_of(o, ["org_id", "ptnt_id", "code"]).join(means, ["org_id", "ptnt_id", "code"])
    x = F.col("pq_value").cast("double")
    value = F.when((F.col("code") == "click") & ~x.between(20, 60), x).when((F.col("code") == "purchase") & (x > 80), x).when((F.col("code") == "view") & ~F.col("mean").between(30, 70), F.col("mean"))
    rows = latest.withColumn("out", value).where("out is not null")
    wide = rows.groupBy("org_id", "ptnt_id", "peso_id").pivot("code", ["click", "purchase", "view"]).agg(F.max("out"))
    people = V.persons(spark, d).select(F.col("_id").alias("peso_id"), F.col("birth_date").cast("string").alias("birth_date"), "gender")
    return wide.join(people, "peso_id").select("org_id", "ptnt_id", "peso_id", "click", "purchase", "view", "birth_date", "gender")


def q09_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Patients below the 5th or above the 95th percentile of their own organisation."""
    o = V.observations(spark, d).where("code in ('click', 'view')").join(V.patients(spark, d).select(F.col("_id").alias("ptnt_id"), F.col("scoper").alias("org_id")), "ptnt_id")
    o = o.withColumn("x", F.col("pq_value").cast("double"))
    bounds = history.percentiles(o, ["org_id", "code"], "x", {"p5": 0.05, "p95": 0.95}, decimals=4)
    means = o.groupBy("org_id", "ptnt_id", "code").agg(F.round(_mean("pq_value"), 4).alias("mean"))
    latest = history.latest_of(o, ["org_id", "ptnt_id", "code"]).select("org_id", "ptnt_id", "code", "x")
    rows = latest.join(means, ["org_id", "ptnt_id", "code"]).join(bounds, ["org_id", "code"])
    flag = lambda code, test: F.max(F.when(F.col("code") == code, test).otherwise(False)).cast("int").cast("long")
    flags = rows.groupBy("org_id", "ptnt_id").agg(
        flag("click", F.col("x") > F.col("p95")).alias("click_high"), flag("click", F.col("x") < F.col("p5")).alias("click_low"),
        flag("view", F.col("mean") > F.col("p95")).alias("view_high"), flag("view", F.col("mean") < F.col("p5")).alias("view_low"),
    )
    return flags.where("click_high + click_low + view_high + view_low > 0")


_RECENT_SQL = f"""latest AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY ptnt_id, code ORDER BY time DESC NULLS FIRST, act_id DESC NULLS FIRST) AS rocky FROM exams) WHERE rocky = 1 AND time >= TIMESTAMP '{SINCE}'), """
_CHECKS_SQL = ", ".join(f"count(CASE WHEN code = '{c}' THEN 1 END) AS c{k + 1}" for k, c in enumerate(CHECKS))
_SHARES_SQL = ", ".join(f"CAST(coalesce(c{k}, 0) * 10000 // total AS DOUBLE) / 100 AS check_{k}" for k in range(1, 6))


def _shares_sql(views: str, pm: str, key: str, recursive: bool = False) -> str:
    body = f"""{_RECENT_SQL} {pm}, tot AS (SELECT {key}, count(*) AS total FROM pm GROUP BY {key}),
        cnt AS (SELECT {key}, {_CHECKS_SQL} FROM pm JOIN latest ON latest.ptnt_id = pm.ptnt_id GROUP BY {key})
        SELECT CAST(tot.{key} AS BIGINT) AS {key}, total, {_SHARES_SQL} FROM tot LEFT JOIN cnt ON cnt.{key} = tot.{key}"""
    return with_views(views, body, recursive)


_VALUES_SQL = "v AS (SELECT scoper AS org_id, o.* FROM (SELECT *, rank() OVER (PARTITION BY ptnt_id, code ORDER BY time DESC NULLS FIRST, act_id DESC NULLS FIRST) AS rocky FROM observations WHERE code IN ('click', 'purchase', 'signup', 'view')) o JOIN patients ON patients._id = o.ptnt_id WHERE rocky = 1)"

QUERIES = {f.__name__: f for f in (q01_exam_rank, q01_exam_orders, q02_obs_history, q03_process_by_org, q04_by_practitioner, q05_by_hierarchy, q06_avg_std, q07_deviation, q08_extremes_pivot, q09_percentile)}

SQL = {
    "q01_exam_rank": "SELECT peso_id, codesystem, code, act_id, effective_time_low AS time, rank() OVER (PARTITION BY peso_id, codesystem, code ORDER BY effective_time_low DESC NULLS FIRST, act_id DESC NULLS FIRST) AS rocky FROM examinations_view",
    "q01_exam_orders": with_views("exams", "SELECT ptnt_id, code, act_id, rank() OVER (PARTITION BY ptnt_id, code ORDER BY time DESC NULLS FIRST, act_id DESC NULLS FIRST) AS rocky FROM exams"),
    "q02_obs_history": with_views("observations", "SELECT ptnt_id, code, act_id, CAST(pq_value AS DOUBLE) AS pq_value, rank() OVER (PARTITION BY ptnt_id, code ORDER BY time DESC NULLS FIRST, act_id DESC NULLS FIRST) AS rocky, rank() OVER (PARTITION BY ptnt_id, code ORDER BY time ASC NULLS LAST, act_id ASC NULLS LAST) AS drago FROM observations"),
    "q03_process_by_org": _shares_sql("patients care_provisions exams", "pm AS (SELECT ptnt_id, scoper AS org_id FROM care_provisions JOIN patients ON patients._id = ptnt_id)", "org_id"),
    "q04_by_practitioner": _shares_sql("care_provisions performers exams", "pm AS (SELECT ptnt_id, role_id FROM care_provisions JOIN performers USING (act_id) WHERE low <= start_time AND (high IS NULL OR start_time <= high))", "role_id"),
    "q05_by_hierarchy": _shares_sql("patients care_provisions exams organization_parts", "above AS (SELECT child AS start, child AS reached FROM organization_parts UNION SELECT parent, parent FROM organization_parts UNION SELECT above.start, parent FROM above JOIN organization_parts ON child = reached), pm AS (SELECT ptnt_id, reached AS org_id FROM care_provisions JOIN patients ON patients._id = ptnt_id JOIN above ON above.start = scoper)", "org_id", True),
    "q06_avg_std": with_views("observations patients", _VALUES_SQL + " SELECT org_id, " + ", ".join(f"round(CAST(sum(CASE WHEN code = '{c}' THEN pq_value END) AS DOUBLE) / nullif(count(CASE WHEN code = '{c}' THEN 1 END), 0), 3) AS avg_{c}, round(stddev_samp(CASE WHEN code = '{c}' THEN CAST(pq_value AS DOUBLE) END), 3) AS std_{c}" for c in NUMERIC) + " FROM v GROUP BY org_id"),
    "q07_deviation": with_views("observations patients", _VALUES_SQL + ", a AS (SELECT " + ", ".join(f"CAST(sum(CASE WHEN code = '{c}' THEN pq_value END) AS DOUBLE) / nullif(count(CASE WHEN code = '{c}' THEN 1 END), 0) AS all_{c}" for c in NUMERIC) + " FROM v), g AS (SELECT org_id, " + ", ".join(f"CAST(sum(CASE WHEN code = '{c}' THEN pq_value END) AS DOUBLE) / nullif(count(CASE WHEN code = '{c}' THEN 1 END), 0) AS {c}" for c in NUMERIC) + " FROM v GROUP BY org_id) SELECT org_id, " + ", ".join(f"round({c} - all_{c}, 3) AS dev_{c}" for c in NUMERIC) + " FROM g, a"),
    "q08_extremes_pivot": with_views("observations patients persons", """o AS (SELECT scoper AS org_id, player AS peso_id, observations.* FROM observations JOIN patients ON patients._id = ptnt_id WHERE code IN ('click', 'purchase', 'view')),
        r AS (SELECT *, CAST(pq_value AS DOUBLE) AS x, rank() OVER (PARTITION BY org_id, ptnt_id, code ORDER BY time DESC NULLS FIRST, act_id DESC NULLS FIRST) AS rocky, round(CAST(sum(pq_value) OVER (PARTITION BY org_id, ptnt_id, code) AS DOUBLE) / count(*) OVER (PARTITION BY org_id, ptnt_id, code), 3) AS mean FROM o),
        s AS (SELECT org_id, ptnt_id, peso_id, code, CASE WHEN code = 'click' AND NOT x BETWEEN 20 AND 60 THEN x WHEN code = 'purchase' AND x > 80 THEN x WHEN code = 'view' AND NOT mean BETWEEN 30 AND 70 THEN mean END AS out FROM r WHERE rocky = 1)
        SELECT org_id, ptnt_id, peso_id, max(CASE WHEN code = 'click' THEN out END) AS click, max(CASE WHEN code = 'purchase' THEN out END) AS purchase, max(CASE WHEN code = 'view' THEN out END) AS view, CAST(birth_date AS VARCHAR) AS birth_date, gender
        FROM s JOIN persons ON persons._id = peso_id WHERE out IS NOT NULL GROUP BY org_id, ptnt_id, peso_id, birth_date, gender"""),
    "q09_percentile": with_views("observations patients", """o AS (SELECT scoper AS org_id, CAST(pq_value AS DOUBLE) AS x, observations.* FROM observations JOIN patients ON patients._id = ptnt_id WHERE code IN ('click', 'view')),
        b AS (SELECT org_id, code, round(quantile_cont(x, 0.05), 4) AS p5, round(quantile_cont(x, 0.95), 4) AS p95 FROM o GROUP BY org_id, code),
        m AS (SELECT org_id, ptnt_id, code, round(CAST(sum(pq_value) AS DOUBLE) / count(*), 4) AS mean FROM o GROUP BY org_id, ptnt_id, code),
        l AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY org_id, ptnt_id, code ORDER BY time DESC NULLS FIRST, act_id DESC NULLS FIRST) AS rocky FROM o) WHERE rocky = 1),
        f AS (SELECT l.org_id, l.ptnt_id, CAST(max(CASE WHEN l.code = 'click' AND x > p95 THEN 1 ELSE 0 END) AS BIGINT) AS click_high, CAST(max(CASE WHEN l.code = 'click' AND x < p5 THEN 1 ELSE 0 END) AS BIGINT) AS click_low,
            CAST(max(CASE WHEN l.code = 'view' AND mean > p95 THEN 1 ELSE 0 END) AS BIGINT) AS view_high, CAST(max(CASE WHEN l.code = 'view' AND mean < p5 THEN 1 ELSE 0 END) AS BIGINT) AS view_low
            FROM l JOIN m USING (org_id, ptnt_id, code) JOIN b USING (org_id, code) GROUP BY l.org_id, l.ptnt_id)
        SELECT * FROM f WHERE click_high + click_low + view_high + view_low > 0"""),
}
