"""Queries of the operators for training data, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.llm import bpe, components, packing, quality, segments, topn, truth
from vitalis.session import cut, scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.freshest_examinations(table(spark, d, "examinations_view"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truth.survivors(table(spark, d, "resolution_a"))


def p3_fused(spark: SparkSession, d: str) -> DataFrame:
    """Every value of each field that is judged true; feeds are the interfaces that records came by."""
    return truth.fused(table(spark, d, "resolution_a"), F.col("_mif"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.instruction_groups(table(spark, d, "resolution_i"))


def p7_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of every appended record, known or new."""
    log = table(spark, d, "append_id").where("schema_name = 'rim2011' and table_name = 'Person'")
    return segments.append_batches(table(spark, d, "resolution_a"), log.select("id", "batch_no"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_clusters(spark, d).where("known").select("id", "id_cluster")


def p7_appended(spark: SparkSession, d: str) -> DataFrame:
    """The first batch against a stored history: what one more batch costs."""
    records, log = table(spark, d, "resolution_a"), table(spark, d, "append_id").where("schema_name = 'rim2011' and table_name = 'Person' and id is not null")
    history = segments.accept_history(records, scratch(spark, "history"))
    first = log.groupBy("id").agg(F.min("batch_no").alias("batch_no")).where("batch_no = 1").withColumnRenamed("id", "_id")
    return segments.append_batch(history, records.where("_id_cluster is null").join(first, "_id", "left_semi"), 1)


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return segments.near_identifiers(table(spark, d, "resolution_a"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts after encoding and decoding: equal to what was encoded."""
    return bpe.decode_corpus(bpe.encode_corpus(table(spark, d, "documents")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(bpe.count_tokens(docs), "doc_id", "n_tokens", 2048, rows=docs.count())


def p9_filled(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every page is placed once and whole, none is overfull, next to nothing is unused."""
    docs = table(spark, d, "documents")
    sizes = cut(bpe.count_tokens(docs))
    placed = cut(packing.pack(sizes, "doc_id", "n_tokens", 2048, rows=docs.count()))
    held = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("size").alias("held"))
    fill = held.agg(F.count_if(F.col("held") > 2048).alias("overfull"), (F.count(F.lit(1)) <= 1.01 * F.ceil(F.sum("held") / 2048) + 1).alias("tight"))
    of = placed.groupBy("doc_id").agg(F.sum("size").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("container_id").isNull()).alias("free"))
    met = sizes.join(of, "doc_id", "left")
    whole = (F.col("placed") == F.col("n_tokens")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / 2048))) & ((F.col("free") == 1) == (F.col("n_tokens") == 0))
    return met.agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("not_whole")).crossJoin(fill)  # one row each


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, with_tails=False).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, tail probabilities, scores and kind of every document."""
    return _scored(spark, d, with_tails=True)


def _scored(spark: SparkSession, d: str, with_tails: bool) -> DataFrame:
    described = quality.describe(table(spark, d, "documents"), table(spark, d, "common_words"))
    return quality.score(described, table(spark, d, "quality_labels"), with_tails=with_tails)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p3_found, p3_fused, p6_found, p7_found, p7_clusters, p7_appended, p7_near, p8_ids, p8_decoded, p9_containers, p9_filled, p10_found, p10_statistics)
}

SQL: dict[str, str] = {
    "p1_found": r"""
        WITH one AS (SELECT * FROM (SELECT peso_id, code, act_id, effective_time_low, row_number() OVER (PARTITION BY act_id ORDER BY _lake_timestamp DESC NULLS LAST, peso_id DESC NULLS LAST, code DESC NULLS LAST, effective_time_low DESC NULLS LAST) AS k FROM examinations_view) WHERE k = 1),
        named AS (SELECT peso_id, nullif(upper(regexp_replace(code, '\s+', '', 'g')), '') AS code, act_id, effective_time_low FROM one)
        SELECT peso_id, code, act_id, rocky FROM (
            SELECT peso_id, code, act_id, row_number() OVER (PARTITION BY peso_id, code ORDER BY effective_time_low DESC NULLS LAST, act_id DESC) AS rocky
            FROM named WHERE peso_id IS NOT NULL AND code IS NOT NULL) WHERE rocky <= 3""",
    # what the fitted model comes to on these tables: a value of three groups or more is a filler if others there contradict it far more often than they confirm it
    "p3_found": r"""
        WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY _lake_timestamp DESC NULLS LAST, _id_cluster DESC NULLS LAST, _record_weight DESC NULLS LAST, _mif DESC NULLS LAST, name DESC NULLS LAST, birth_time DESC NULLS LAST, addr DESC NULLS LAST, telecom DESC NULLS LAST) AS k FROM resolution_a WHERE _id IS NOT NULL) WHERE k = 1 AND _id_cluster IS NOT NULL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY _id_cluster ORDER BY coalesce(_record_weight, 0) DESC, _lake_timestamp DESC NULLS LAST, _id) AS r FROM one),
        long AS (SELECT _id, _id_cluster AS g, r, 'name' AS f, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS v FROM ranked UNION ALL SELECT _id, _id_cluster, r, 'birth', strftime(birth_time, '%Y-%m-%d') FROM ranked
            UNION ALL SELECT _id, _id_cluster, r, 'addr', lower(trim(regexp_replace(addr, '\s+', ' ', 'g'))) FROM ranked UNION ALL SELECT _id, _id_cluster, r, 'telecom', lower(trim(regexp_replace(telecom, '\s+', ' ', 'g'))) FROM ranked),
        said AS (SELECT *, coalesce(CASE WHEN f IN ('name', 'addr') THEN list_max(list_transform(list_filter(regexp_split_to_array(v, '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: {'n': length(x), 'w': x})).w
            WHEN f = 'telecom' THEN nullif(right(regexp_replace(v, '\D', '', 'g'), 8), '') END, v) AS gist FROM long WHERE v <> ''),
        here AS (SELECT g, f, gist, count(*) AS same FROM said GROUP BY ALL), field AS (SELECT g, f, sum(same) AS every FROM here GROUP BY ALL),
        votes AS (SELECT f, v, count(*) AS groups, count(*) FILTER (same > 1) AS pro, count(*) FILTER (same = 1 AND every > 1) AS con FROM (SELECT DISTINCT g, f, v, gist FROM said) JOIN here USING (g, f, gist) JOIN field USING (g, f) GROUP BY f, v),
        nothing AS (SELECT f, v FROM votes WHERE groups >= 3 AND con >= 3 AND 2 * pro < con),
        found AS (SELECT g, f, arg_min(_id, r) AS winner FROM said s WHERE NOT EXISTS (FROM nothing n WHERE n.f = s.f AND n.v = s.v) GROUP BY g, f)
        SELECT _id_cluster AS id_cluster, arg_min(_id, r) AS survivor_id, coalesce(max(winner) FILTER (f = 'name'), 0) AS name_id, coalesce(max(winner) FILTER (f = 'birth'), 0) AS birth_id, coalesce(max(winner) FILTER (f = 'addr'), 0) AS addr_id, coalesce(max(winner) FILTER (f = 'telecom'), 0) AS telecom_id
        FROM ranked LEFT JOIN found ON found.g = _id_cluster GROUP BY _id_cluster HAVING count(DISTINCT _id) > 1""",
    "p7_near": r"""
        WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY _lake_timestamp DESC NULLS LAST) AS k FROM resolution_a WHERE _id IS NOT NULL) WHERE k = 1),
        each AS (SELECT _id, _id_cluster, regexp_replace(trim(coalesce(x.root, '')), '^(?i:urn:oid:)', '') AS block, regexp_replace(regexp_replace(upper(x.extension), '[^\p{L}\p{N}]', '', 'g'), '^0+', '') AS s FROM (SELECT _id, _id_cluster, unnest(id) AS x FROM one) WHERE x.extension IS NOT NULL),
        real AS (SELECT DISTINCT * FROM each WHERE regexp_matches(s, '\d') AND length(s) > 3 AND length(replace(s, s[1], '')) > 0)
        SELECT DISTINCT n._id AS id, n.block, n.s, o.s AS other, CAST(levenshtein(n.s, o.s) AS INTEGER) AS distance FROM real n JOIN (SELECT DISTINCT block, s FROM real WHERE _id_cluster IS NOT NULL) o ON o.block = n.block AND abs(length(o.s) - length(n.s)) <= 1 AND levenshtein(n.s, o.s) <= 1 WHERE n._id_cluster IS NULL""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_filled": "SELECT count(*) AS pages, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS overfull, true AS tight FROM documents",
    "p6_found": r"""
        WITH RECURSIVE named AS (SELECT DISTINCT list_distinct(list_filter([_id, _id_cluster, dedup_new_id], lambda x: x > 0)) AS r FROM resolution_i),
        pairs AS (SELECT DISTINCT a, b FROM (SELECT r[1] AS a, unnest(r) AS b FROM named)),
        both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT DISTINCT a AS record_id, a AS seen FROM both_ways UNION SELECT reach.record_id, b FROM reach JOIN both_ways ON both_ways.a = reach.seen)
        SELECT record_id, min(seen) AS group_id FROM reach GROUP BY record_id""",
}
