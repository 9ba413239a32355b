"""Per-document text statistics, their exact per-language ranks, and outlier scores from tail probabilities.

1. describe(): statistics of each whole text, in one narrow pass.
2. tails(): of every statistic the empirical probabilities of a value at most, and at least, as great among all documents
   of the language. The long form is sorted by range partitions (the id takes part, so a value that a third of the
   documents have is split too); each partition counts for itself, and what lies in the partitions before and after it is
   added. These offsets are one row per partition and (statistic, language) in it: their number is that of the partitions
   plus that of the groups, never that of the documents.
3. score(): an outlier score for each kind of page that isn't prose, and for prose: a weighted sum of -ln of the tail
   probabilities. The weights are fitted on a bounded sample of labelled documents; all else covers all documents.
4. A page is the kind with the greatest score; nothing but the scores decides.

Defined results: null, empty and blank texts have statistics of 0, no rank, no score, and are no case. Null language:
"und". Ids are unique; of repeated ones the tails are added up. Ties share the probabilities of the whole tie. Columns
other than the id, the text and the language are not read. Where no label can be used, no page has a kind.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.llm.bpe import texts_of
from vitalis.llm.textstats import NAMES, statistics
from vitalis.session import bounded_rows, cut, ship

#: The table of common words is sent to all executors; it may not have more rows than this.
MOST_COMMON_WORDS = 20_000
#: Labelled documents that the weights are fitted on, at most: those with the smallest hashes of their ids.
MOST_LABELS = 20_000
#: Rows of offsets, at most: partitions plus pairs of statistic and language.
MOST_OFFSETS = 1_000_000
#: -ln of the rarest tail probability that counts as such; rarer ones count alike, so scores mean the same in small and large corpora.
RAREST = 6.0
#: How strongly the fitted weights are held towards 0, in labelled documents.
HOLD = 5.0
KINDS = ("prose", "list", "table", "junk")


def language(col: str | F.Column) -> F.Column:
    """The primary subtag in lower case; "und" where there is none."""
    tag = F.lower(F.regexp_extract(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    return F.when(tag == "", "und").otherwise(tag)


def describe(docs: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, blank, n_words, ...): one row per document, with the statistics of textstats.NAMES."""
    ship(docs.sparkSession)
    words = {r[0].strip().lower() for r in bounded_rows(common.where("word is not null").select("word"), MOST_COMMON_WORDS, "common words")}
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(words))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = texts_of(batch.column(2))
            rows = [statistics(t, known) if t else [0.0] * len(NAMES) for t in texts]
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(NAMES))]
            blank = pa.array([not t or t.isspace() for t in texts], pa.bool_())
            yield pa.record_batch([batch.column(0), batch.column(1), blank, *columns], ["id", "lang", "blank", *NAMES])

    fields = [T.StructField("id", kind), T.StructField("lang", T.StringType()), T.StructField("blank", T.BooleanType())]
    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in NAMES])
    return docs.select(F.col(id_col), language(lang_col).alias("lang"), F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int, np.ndarray]]:
    """(stat, lang), begin, end and values of each run of rows of one group."""
    stat = batch.column(0).to_numpy(zero_copy_only=False)
    lang = batch.column(1).dictionary_encode()
    code = lang.indices.to_numpy(zero_copy_only=False)
    values = batch.column(2).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, (stat[1:] != stat[:-1]) | (code[1:] != code[:-1])]) if len(stat) else []
    for begin, end in zip(starts, [*starts[1:], len(stat)]):
        yield (int(stat[begin]), lang.dictionary[int(code[begin])].as_py()), int(begin), int(end), values[begin:end]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group in a partition: its rows there, its first and last value, and how many rows have these."""
    found: dict[tuple, list] = {}
    part = -1
    for batch in batches:
        if batch.num_rows:
            part = batch.column(4)[0].as_py()
        for key, _, _, v in _runs(batch):
            g = found.setdefault(key, [0, v[0], 0, v[0], 0])
            g[0] += len(v)
            g[2] += int((v == g[1]).sum())
            g[3], g[4] = v[-1], int((v == v[-1]).sum()) + (g[4] if g[3] == v[-1] else 0)
    rows = [(part, *key, *g) for key, g in found.items()]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]
    yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["part", "stat", "lang", "n", "first", "n_first", "last", "n_last"])


def _offsets(edges: list) -> dict[int, dict[tuple, tuple]]:
    """By partition and group: (rows before the partition, rows of the group, of its first value those before, of its last value those after)."""
    groups = defaultdict(list)
    for e in edges:
        groups[e["stat"], e["lang"]].append(e)
    out: dict[int, dict[tuple, tuple]] = defaultdict(dict)
    for key, parts in groups.items():
        parts.sort(key=lambda e: e["part"])
        total, before = sum(e["n"] for e in parts), 0
        same_before, held, count = [], None, 0  # rows of a partition's first value in the partitions before it
        for e in parts:
            same_before.append(count if held == e["first"] else 0)
            count = e["n_last"] + (count if held == e["last"] and e["first"] == e["last"] else 0)
            held = e["last"]
        same_after, held, count = [], None, 0
        for e in reversed(parts):
            same_after.append(count if held == e["last"] else 0)
            count = e["n_first"] + (count if held == e["first"] and e["first"] == e["last"] else 0)
            held = e["first"]
        for e, b, a in zip(parts, same_before, reversed(same_after)):
            out[e["part"]][key] = (before, total, e["first"], b, e["last"], a)
            before += e["n"]
    return dict(out)


def tails(values: DataFrame, id_col: str) -> DataFrame:
    """(id, stat, low, high): the shares of values of the same (stat, lang) that are at most, and at least, a row's v.

    values has one row (id, stat int, lang, v double) per observation; null values are not ranked.
    """
    spark = values.sparkSession
    ship(spark)
    rows = values.where("v is not null").select("stat", "lang", "v", F.col(id_col).alias("id"))
    ordered = rows.repartitionByRange("stat", "lang", "v", "id").sortWithinPartitions("stat", "lang", "v")
    ordered = cut(ordered.withColumn("part", F.spark_partition_id()))
    edges = ordered.mapInArrow(_edges, "part int, stat int, lang string, n long, first double, n_first long, last double, n_last long")
    sent = spark.sparkContext.broadcast(_offsets(bounded_rows(edges, MOST_OFFSETS, "offsets")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the rows; a tie's rows are held back as (id, number) until it ends, ids only."""
        known: dict | None = None
        group, seen, waiting, value = None, 0, [], None  # rows of the group so far, those of the tie under way, and its value

        def flush() -> pa.RecordBatch | None:
            if not waiting:
                return None
            ids = pa.concat_arrays(waiting)
            before, total, first, b, last, a = known[group]
            begin = before + seen - len(ids) - (b if value == first else 0)
            upto = before + seen + (a if value == last else 0)
            waiting.clear()
            n = len(ids)
            return batch_of(ids, np.full(n, group[0], np.int32), np.full(n, upto / total), np.full(n, (total - begin) / total))

        def batch_of(ids, stat, low, high) -> pa.RecordBatch:
            return pa.record_batch([ids, pa.array(stat, pa.int32()), pa.array(low), pa.array(high)], ["id", "stat", "low", "high"])

        for batch in batches:
            if batch.num_rows and known is None:
                known = sent.value[batch.column(4)[0].as_py()]
            for key, begin, end, v in _runs(batch):
                if key != group:
                    if (held := flush()) is not None:
                        yield held
                    group, seen, value = key, 0, None
                ids = batch.column(3).slice(begin, end - begin)
                cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                if value is not None and v[0] != value and (held := flush()) is not None:
                    yield held
                # the last tie of the run may go on in the next batch; the others but the first are whole
                if waiting or len(cuts) == 1:
                    stop = int(cuts[1]) if len(cuts) > 1 else len(v)
                    waiting.append(ids.slice(0, stop))
                    value, seen = v[0], seen + stop
                    if stop == len(v):
                        continue
                    yield flush()
                    cuts = cuts[1:]
                start, stop = int(cuts[0]), int(cuts[-1])
                if stop > start:
                    before, total, first, b, last, a = known[group]
                    n_tie = np.diff(cuts)
                    lower = before + seen + cuts[:-1] - start
                    below = lower - np.where(v[cuts[:-1]] == first, b, 0)
                    upto = lower + n_tie + np.where(v[cuts[:-1]] == last, a, 0)
                    low, high = np.repeat(upto / total, n_tie), np.repeat((total - below) / total, n_tie)
                    yield batch_of(ids.slice(start, stop - start), np.full(stop - start, group[0], np.int32), low, high)
                    seen += stop - start
                waiting.append(ids.slice(stop))
                value, seen = v[stop], seen + len(v) - stop
        if (held := flush()) is not None:
            yield held

    kind = values.schema[id_col].dataType.simpleString()
    return ordered.mapInArrow(place, f"id {kind}, stat int, low double, high double").withColumnRenamed("id", id_col)


def _depth(c: str) -> F.Column:
    return F.least(-F.log(c), F.lit(RAREST))


class Weights:
    """Weights of the tails of each statistic for each kind, by penalised multinomial regression on labelled documents."""

    def __init__(self, deep: np.ndarray, kinds: np.ndarray, rounds: int = 400):
        """deep: a row of -ln low, then -ln high, per document; kinds: the place of its label in KINDS."""
        mean, spread = deep.mean(0), deep.std(0)
        spread = np.where(spread > 0, spread, 1.0)
        x = np.hstack([(deep - mean) / spread, np.ones((len(deep), 1))])
        y = np.eye(len(KINDS))[kinds]
        n = len(x)
        held = np.full((x.shape[1], 1), HOLD / n)
        held[-1] = 0
        pace = 0.5 * np.linalg.norm(x, 2) ** 2 / n + HOLD / n
        w, at, t = np.zeros((x.shape[1], len(KINDS))), np.zeros((x.shape[1], len(KINDS))), 1.0
        for _ in range(rounds):  # accelerated gradient
            p = x @ at
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            new = at - (x.T @ (p - y) / n + held * at) / pace
            t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
            at = new + (t - 1) / t_new * (new - w)
            w, t = new, t_new
        absent = ~np.isin(np.arange(len(KINDS)), kinds)
        self.slope = w[:-1] / spread[:, None]
        self.base = w[-1] - mean @ self.slope - np.where(absent, 1e9, 0.0)  # a kind without labels is never the greatest


def _labelled(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, kind as number): documents whose labels don't contradict each other, at most MOST_LABELS of them."""
    known = labels.where(F.col("kind").isin(*KINDS) & F.col(id_col).isNotNull()).groupBy(id_col)
    agreed = known.agg(F.min("kind").alias("kind"), F.max("kind").alias("other")).where("kind = other")
    number = reduce(lambda c, k: F.when(F.col("kind") == KINDS[k], k).otherwise(c), range(len(KINDS)), F.lit(-1))
    return agreed.orderBy(F.xxhash64(id_col), id_col).limit(MOST_LABELS).select(id_col, number.alias("label"))


def fit(ranked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Weights | None:
    """The weights from the labelled documents' tails; None without any."""
    known = {r[id_col]: r["label"] for r in _labelled(labels, id_col).collect()}
    some = labels.sparkSession.createDataFrame(list(known.items()), f"id {ranked.schema[id_col].dataType.simpleString()}, label int")
    met = ranked.join(F.broadcast(some), ranked[id_col] == some["id"], "left_semi").select(id_col, "stat", _depth("low").alias("low"), _depth("high").alias("high"))
    rows = bounded_rows(met, MOST_LABELS * len(NAMES), "tails of labelled documents")
    place = {i: k for k, i in enumerate(sorted({r[0] for r in rows}))}
    if not place:
        return None
    deep = np.zeros((len(place), 2 * len(NAMES)))
    for i, stat, low, high in rows:
        deep[place[i], stat], deep[place[i], stat + len(NAMES)] = low, high
    return Weights(deep, np.array([known[i] for i in place]))


def long_form(described: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, stat, lang, v): a row per statistic of each document that isn't blank."""
    pairs = F.array(*[F.struct(F.lit(k).alias("stat"), F.col(n).alias("v")) for k, n in enumerate(NAMES)])
    return described.where("not blank").select(id_col, "lang", F.explode(pairs).alias("x")).select(id_col, "x.stat", "lang", "x.v")


def score(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", with_tails: bool = True) -> DataFrame:
    """described with score_<kind> and kind, and with tail_<statistic> (the rarer side) unless with_tails is false.

    A document's score for a kind is summed up from its statistics' shares before they are brought together.
    """
    described = cut(described)  # read several times below; the texts are read once
    ranked = tails(long_form(described, id_col), id_col)
    weights = fit(ranked, labels, id_col)
    slope = weights.slope if weights else np.zeros((2 * len(NAMES), len(KINDS)))

    def weigh(k: int) -> F.Column:
        of = lambda side: F.element_at(F.array(*[F.lit(float(x)) for x in slope[side * len(NAMES) : (side + 1) * len(NAMES), k]]), F.col("stat") + 1)
        return F.col("low") * of(0) + F.col("high") * of(1)

    deep = ranked.select(id_col, "stat", _depth("low").alias("low"), _depth("high").alias("high"))
    sums = [F.sum(weigh(k)).alias(f"score_{kind}") for k, kind in enumerate(KINDS)]
    rare = [F.max(F.when(F.col("stat") == k, F.exp(-F.greatest("low", "high")))).alias(f"tail_{n}") for k, n in enumerate(NAMES)] if with_tails else []
    folded = deep.groupBy(id_col).agg(*sums, *rare)
    based = [(F.col(f"score_{kind}") + F.lit(float(weights.base[k] if weights else 0.0))).alias(f"score_{kind}") for k, kind in enumerate(KINDS)]
    folded = folded.select(id_col, *based, *[c for c in folded.columns if c.startswith("tail_")])
    most = F.greatest(*[f"score_{k}" for k in KINDS])
    kind = reduce(lambda c, k: F.when(F.col(f"score_{k}") == most, k).otherwise(c), reversed(KINDS), F.lit(None).cast("string"))
    folded = folded.withColumn("kind", kind if weights else F.lit(None).cast("string"))
    return described.join(folded, id_col, "left") if with_tails else folded
