"""The N best rows of every group, by a secondary sort that buffers no group.

Rows are sorted by group, order and all remaining columns inside each partition, and streamed as Arrow batches of which
the first N rows of each run are kept. That is done twice: before the shuffle, so that a task sends at most N rows of
any group however hot the group is, and after it, where the rank is given. All columns take part in the order, so ties
are decided alike in every run.

Defined results: a row with a null in a group column belongs to no group and is left out; nulls in the order come last;
rows equal in all columns are rows of their own; N below 1 gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.session import ship


def _first_of_runs(n: int, n_group: int, rank: bool, names: list[str]):
    """A function over Arrow batches sorted by their first n_group columns; what it carries over is one group's key and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            new = np.zeros(rows, bool)
            for k in range(n_group):
                c = batch.column(k)
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            first = tuple(batch.column(k)[0].as_py() for k in range(n_group))
            if first != held:
                count = 0
            starts = np.flatnonzero(new)
            at = np.arange(rows)
            begin = np.zeros(rows, np.int64)
            begin[starts] = starts
            begin = np.maximum.accumulate(begin)
            place = at - begin + 1
            upto = starts[0] if len(starts) else rows
            place[:upto] += count
            held, count = tuple(batch.column(k)[rows - 1].as_py() for k in range(n_group)), int(place[-1])
            keep = pa.array(place <= n)
            out = batch.filter(keep)
            if rank:
                out = pa.record_batch([*out.columns, pa.array(place[place <= n], pa.int64())], [*names, "__rank"])
            if out.num_rows:
                yield out

    return run


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group by order, with their rank from 1; order columns state direction and place of nulls."""
    ship(df.sparkSession)
    names = df.columns
    if rank in names:
        raise ValueError(f"the table has a column {rank} already; name another for the rank")
    rest = [c for c in names if c not in group]
    sortable = [F.col(f"`{c}`").asc_nulls_last() for c in rest if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    keys = [F.col(f"`{c}`") for c in group]
    columns = [F.col(f"`{c}`") for c in group + rest]
    rows = df.select(*columns)
    for c in group:
        rows = rows.where(F.col(f"`{c}`").isNotNull())
    schema = T.StructType([rows.schema[c] for c in group + rest])
    ranked = T.StructType([*schema.fields, T.StructField("__rank", T.LongType())])
    here = rows.sortWithinPartitions(*keys, *order, *sortable).mapInArrow(_first_of_runs(n, len(group), False, group + rest), schema)
    there = here.repartition(*keys).sortWithinPartitions(*keys, *order, *sortable)
    out = there.mapInArrow(_first_of_runs(n, len(group), True, group + rest), ranked)
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("__rank").alias(rank))


def latest(df: DataFrame, key: str, at: str = "_lake_timestamp") -> DataFrame:
    """One row per key: the one with the greatest timestamp; among several the greatest in its other columns.

    Partially aggregated before the shuffle. Rows with a null key are rows of their own. Null timestamps come first.
    """
    rest = [c for c in df.columns if c not in (key, at)]
    row = F.struct(F.col(at).alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    known = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("__row"))
    back = [F.col(key), F.col("__row.t").alias(at), *[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(rest)]]
    return known.select(*back).unionByName(df.where(F.col(key).isNull()).distinct()).select(*[F.col(f"`{c}`") for c in df.columns])


def freshest_examinations(exams: DataFrame, n: int = 3) -> DataFrame:
    """(peso_id, code, act_id, rocky): the n newest acts of each person and examination code, ranked anew.

    The latest row of an act stands for it. Blanks around a code and letter case don't count; rows without a person or
    a code belong to no group. Acts without a time come last; equal times are decided by the greater act_id.
    """
    rows = latest(exams.select("peso_id", "code", "act_id", "effective_time_low", "_lake_timestamp"), "act_id")
    code = F.upper(F.regexp_replace("code", r"\s+", ""))
    rows = rows.select("peso_id", F.when(code != "", code).alias("code"), "act_id", "effective_time_low")
    order = [F.col("effective_time_low").desc_nulls_last(), F.col("act_id").desc_nulls_last()]
    out = top_n(rows, ["peso_id", "code"], order, n, rank="rocky")
    return out.select("peso_id", "code", "act_id", "rocky")
