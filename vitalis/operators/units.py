"""Quantities in different units into common ones, by a hidden Markov model with the unit as hidden state.

Observations of one series (here: one code, as the tables name no device) are put in order of time. The state is the
unit a value is in. A value is the likelier in a unit, the closer the logarithm of its converted amount is to the smooth
level of the series; how widely values spread around the level, and how often a unit follows another, are fitted to the
stated units of the series. Where a unit is stated, only that state is possible, so a stated unit is never overruled;
between stated ones, Viterbi's algorithm decodes the switches.

The level of a day is the mean logarithm of the amounts stated within DAYS of it, drawn a little towards the mean of the
code; it is an aggregate of days, so it doesn't depend on where a series is split. A series is range-partitioned by time:
a code with a third of all rows spreads over many tasks. Decoding runs over partition borders: each partition reduces
its part of a series to the best scores from every state before it to every state at its end, a small square of numbers;
the driver chains these, and each partition then decodes with the states at its borders known. Scores are whole numbers,
so the result is the same for any partitioning.

Defined results: rows without a number come out without unit and amount; a code not listed gives no rows; values of zero
or below are as unlikely as any value gets; null times come first, at the code's mean level; where nothing is stated for
a code, its values have no unit. Columns other than those named are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalis.functions.quantities import Conversion, Reader
from vitalis.session import bounded_rows, cut, discard, ship

#: The reference of units is sent to all executors; it may not have more rows than this.
MOST_CONVERSIONS = 20_000
#: Parts of series, at most: partitions plus codes.
MOST_PARTS = 1_000_000
#: Days before and after, over which the level is smooth.
DAYS = 30
#: How many values the mean of a code, and the frequency of a unit, weigh.
PRIOR = 20
#: The least spread of logarithms around the level.
LEAST_SPREAD = 0.01
#: The log-likelihood below which a value is as unlikely as any.
UNLIKELY = -20.0
#: Log-likelihoods and logarithms are whole numbers of this fraction.
FINE = 1_000_000
NEVER = -(1 << 60)


def readers_of(reference: DataFrame) -> dict[str, Reader]:
    by_code: dict[str, list[Conversion]] = {}
    for r in bounded_rows(reference.select("code", "unit", "common_unit", "factor", "shift", "decimals"), MOST_CONVERSIONS, "conversions"):
        by_code.setdefault(r["code"].strip(), []).append(Conversion(r["unit"], r["common_unit"], Decimal(r["factor"]), Decimal(r["shift"]), int(r["decimals"])))
    return {code: Reader(conversions) for code, conversions in by_code.items()}


def read_quantities(rows: DataFrame, reference: DataFrame, id_col: str, code_col: str, value_col: str, unit_col: str, text_col: str, time_col: str) -> DataFrame:
    """(id, code, time, numbers, units, stated): what each row states; units has nulls where none is listed or stated."""
    ship(rows.sparkSession)
    readers = rows.sparkSession.sparkContext.broadcast(readers_of(reference))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = readers.value
        for batch in batches:
            numbers, units, stated = [], [], []
            for code, value, unit, text in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5))):
                parts, there = known[code].read(value, unit, text)
                numbers.append([str(n) for n, _ in parts])
                units.append([u for _, u in parts])
                stated.append(there)
            strings = pa.list_(pa.string())
            yield pa.record_batch([*batch.columns[:3], pa.array(numbers, strings), pa.array(units, strings), pa.array(stated)], ["id", "code", "at", "numbers", "units", "stated"])

    code = F.trim(F.col(code_col))
    picked = rows.select(F.col(id_col).cast("long"), code.alias("__code"), F.col(time_col).cast("timestamp_ntz"), F.col(value_col).cast("decimal(38,12)"), F.col(unit_col), F.col(text_col))
    listed = picked.where(F.col("__code").isin(list(readers.value)))
    return listed.mapInArrow(run, "id long, code string, at timestamp_ntz, numbers array<string>, units array<string>, stated boolean")


def _series(read: DataFrame, reference: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """read with the level of its day, and (mean, spread) by code; both from the stated units, in whole numbers."""
    conv = reference.select(F.trim("code").alias("code"), F.col("unit").alias("u"), F.col("factor").cast("double").alias("f"), F.col("shift").cast("double").alias("s"))
    one = F.col("stated") & (F.size("numbers") == 1)
    each = read.where("size(numbers) > 0").select("code", F.to_date("at").alias("day"), F.when(one, F.col("units")[0]).alias("u"), F.col("numbers")[0].cast("double").alias("x"))
    amount = F.col("x") * F.col("f") + F.col("s")
    log = F.when(amount > 0, F.round(F.log(amount) * FINE).cast("long"))
    daily = each.join(F.broadcast(conv), ["code", "u"], "left").withColumn("y", log).groupBy("code", "day")
    daily = cut(daily.agg(F.count("y").alias("n"), F.sum("y").alias("y"), F.sum((F.col("y") / FINE) * F.col("y")).cast("long").alias("q")))
    sums = bounded_rows(daily.groupBy("code").agg(*[F.sum(c).alias(c) for c in "nyq"]).where("n > 0"), MOST_CONVERSIONS, "codes")
    of_code = {}
    for r in sums:
        mean = r["y"] / r["n"] / FINE
        of_code[r["code"]] = (mean, max(LEAST_SPREAD, math.sqrt(max(0.0, r["q"] / r["n"] / FINE - mean * mean))))
    around = Window.partitionBy("code").orderBy(F.unix_date("day")).rangeBetween(-DAYS, DAYS)  # days only
    smooth = daily.where("day is not null").select("code", "day", F.sum("n").over(around).alias("n"), F.coalesce(F.sum("y").over(around), F.lit(0)).alias("y"))
    means = read.sparkSession.createDataFrame([(c, m) for c, (m, _) in of_code.items()], "code string, mean double")
    level = (F.col("y") + F.round(F.col("mean") * PRIOR * FINE)) / (F.col("n") + PRIOR) / FINE
    levels = smooth.join(F.broadcast(means), "code").select("code", "day", level.alias("level"))
    return read.withColumn("day", F.to_date("at")).join(levels, ["code", "day"], "left").select("id", "code", "at", "numbers", "units", "stated", "level"), of_code


class Model:
    """One code's states with their transitions and emissions, in whole numbers."""

    def __init__(self, reader: Reader, mean: float | None, spread: float | None, counts: np.ndarray):
        """counts: how often a stated unit follows another; the last row, how often each is stated."""
        self.units = reader.units
        k = len(self.units)
        self.mean, self.spread = mean, spread
        self.factor = np.array([float(reader.by_unit[u].factor) for u in self.units])
        self.shift = np.array([float(reader.by_unit[u].shift) for u in self.units])
        often = (counts[k] + 1) / (counts[k].sum() + k)
        after = (counts[:k] + PRIOR * often) / (counts[:k].sum(1, keepdims=True) + PRIOR)
        #: scores of a state after each state, and in the last row at the beginning
        self.moves = np.round(np.log(np.vstack([after, often])) * FINE).astype(np.int64)

    def emissions(self, x: np.ndarray, level: np.ndarray) -> np.ndarray:
        amount = x[:, None] * self.factor + self.shift
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (np.log(amount) - np.where(np.isnan(level), self.mean, level)[:, None]) / self.spread
        likely = np.where(amount > 0, np.maximum(-z * z / 2, UNLIKELY), UNLIKELY)
        return np.round(likely * FINE).astype(np.int64)

    def through(self, start: np.ndarray, emitted: np.ndarray) -> np.ndarray:
        """Best scores at each state after the emissions; start has a row of scores by state before them for each way to begin."""
        for e in emitted:
            start = (start[:, :, None] + self.moves[: len(self.units)]).max(1) + e
        return start

    def begin(self, emitted: np.ndarray) -> np.ndarray:
        """Scores at the end of emissions from each state before them, and in the last row from the beginning."""
        return self.through(self.moves + emitted[0], emitted[1:])

    def path(self, first: np.ndarray, emitted: np.ndarray, last: np.ndarray) -> list[int]:
        """The best states of some emissions: first scores the first state besides, last the last one."""
        score, back = first + emitted[0], []
        for e in emitted[1:]:
            ways = score[:, None] + self.moves[: len(self.units)]
            back.append(ways.argmax(0))
            score = ways.max(0) + e
        state = int((score + last).argmax())
        states = [state]
        for came in reversed(back):
            state = int(came[state])
            states.append(state)
        return states[::-1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.Table]]:
    """(partition, code, rows) of each code in a sorted partition; the rows of one code in one partition are held."""
    held: list[pa.RecordBatch] = []
    code = part = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(7)[0].as_py()
        codes = batch.column(1).dictionary_encode()
        place = codes.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
            here = codes.dictionary[int(place[begin])].as_py()
            if here != code and held:
                yield part, code, pa.Table.from_batches(held)
                held = []
            code = here
            held.append(batch.slice(int(begin), int(end - begin)))
    if held:
        yield part, code, pa.Table.from_batches(held)


def _states(rows: pa.Table, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a number, and the state each has stated, -1 where none."""
    with_number = np.flatnonzero(pc.greater(pc.fill_null(pc.list_value_length(rows["numbers"]), 0), 0).to_numpy(zero_copy_only=False))
    some = rows.take(with_number)
    first = pc.if_else(some["stated"], pc.list_element(some["units"], 0), pa.scalar(None, pa.string()))
    return with_number, pc.fill_null(pc.index_in(first, pa.array(units, pa.string())), -1).to_numpy().astype(np.int64)


def _gaps(stated: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of rows without a stated unit."""
    free = np.r_[False, stated < 0, False]
    edges = np.flatnonzero(free[1:] != free[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _emitted(model: Model, rows: pa.Table, at: np.ndarray) -> Callable[[int, int], np.ndarray]:
    numbers, levels = rows["numbers"].combine_chunks(), rows["level"].to_numpy()

    def of(begin: int, end: int) -> np.ndarray:
        some = at[begin:end]
        x = pc.cast(pc.list_element(numbers.take(pa.array(some)), 0), pa.float64()).to_numpy(zero_copy_only=False)
        return model.emissions(x, levels[some])

    return of


def _chained(parts: list[tuple[int, list[int]]], k: int) -> dict[int, tuple[int, int]]:
    """(state before, state at the end) of a series' part in each partition, from the scores through each part; before the first it is k."""
    squares = [(p, np.array(s, np.int64).reshape(k + 1, k)) for p, s in parts]
    so_far = None
    scores = []
    for _, m in squares:
        so_far = m[k] if so_far is None else (so_far[:, None] + m[:k]).max(0)
        so_far = so_far - so_far.max()
        scores.append(so_far)
    end = int(scores[-1].argmax())
    out = {}
    for at in range(len(squares) - 1, -1, -1):
        part, m = squares[at]
        before = k if at == 0 else int((scores[at - 1] + m[:k, end]).argmax())
        out[part] = (before, end)
        end = before
    return out


def common_units(read: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, code, decoded_unit, stated, unit, value_scaled) of what read_quantities gave."""
    spark = read.sparkSession
    ship(spark)
    known = readers_of(reference)
    read = cut(read)  # texts are read once
    series, of_code = _series(read, reference)
    ordered = series.repartitionByRange("code", "at", "id").sortWithinPartitions("code", "at", "id")
    ordered = cut(ordered.withColumn("part", F.spark_partition_id()))
    discard(read)
    sent = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part, code, rows in _pieces(batches):
            units = sent.value[code].units
            stated = _states(rows, units)[1]
            stated, k = stated[stated >= 0], len(units)
            counts = np.zeros((k + 1, k), np.int64)
            np.add.at(counts, (stated[:-1], stated[1:]), 1)
            np.add.at(counts, (np.full(len(stated), k), stated), 1)
            ends = [int(stated[0]), int(stated[-1])] if len(stated) else [-1, -1]
            out.append((part, code, [*ends, *counts.ravel().tolist()]))
        yield _part_rows(out)

    counts: dict[str, np.ndarray] = {}
    last: dict[str, int] = {}
    for part, code, (first, final, *flat) in sorted(map(tuple, bounded_rows(ordered.mapInArrow(count, _PART), MOST_PARTS, "parts of series"))):
        k = len(known[code].units)
        here = np.array(flat, np.int64).reshape(k + 1, k)
        counts[code] = counts.get(code, 0) + here
        if first >= 0:
            if code in last:
                counts[code][last[code], first] += 1
            last[code] = final
    models = {code: Model(known[code], *of_code.get(code, (None, None)), c) for code, c in counts.items() if code in of_code}
    sent_models = spark.sparkContext.broadcast(models)

    def reduce_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part, code, rows in _pieces(batches):
            model = sent_models.value.get(code)
            if model is None:
                continue
            at, stated = _states(rows, model.units)
            if not len(at):
                continue
            emitted, k, pinned = _emitted(model, rows, at), len(model.units), np.flatnonzero(stated >= 0)
            if not len(pinned):
                square = model.begin(emitted(0, len(at)))
            else:
                first, final = int(pinned[0]), int(pinned[-1])
                to = model.moves[:, stated[first]] if not first else (model.begin(emitted(0, first)) + model.moves[:k, stated[first]]).max(1)
                start = np.full((1, k), NEVER, np.int64)
                start[0, stated[final]] = 0
                rest = start if final + 1 == len(at) else model.through(start, emitted(final + 1, len(at)))
                square = np.maximum(to[:, None] + rest, NEVER)
            out.append((part, code, square.ravel().tolist()))
        yield _part_rows(out)

    parts = defaultdict(list)
    for part, code, square in sorted(map(tuple, bounded_rows(ordered.mapInArrow(reduce_parts, _PART), MOST_PARTS, "parts of series"))):
        parts[code].append((part, square))
    borders = {code: _chained(p, len(models[code].units)) for code, p in parts.items()}
    sent_borders = spark.sparkContext.broadcast(borders)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, code, rows in _pieces(batches):
            reader, model = sent.value[code], sent_models.value.get(code)
            units = [None] * rows.num_rows
            at, stated = _states(rows, reader.units)
            if model is not None and len(at):
                states, k, emitted = stated.copy(), len(model.units), _emitted(model, rows, at)
                before, end = sent_borders.value[code][part]
                for begin, stop in _gaps(stated):
                    first = model.moves[states[begin - 1] if begin else before]
                    last = np.where(np.arange(k) == end, 0, NEVER) if stop == len(at) else model.moves[:k, stated[stop]]
                    states[begin:stop] = model.path(first, emitted(begin, stop), last)
                for row, state in zip(at.tolist(), states.tolist()):
                    units[row] = model.units[state]
            common, scaled = [], []
            for numbers, own, unit in zip(rows["numbers"].to_pylist(), rows["units"].to_pylist(), units):
                if unit is None:
                    found = (None, None)
                elif len(numbers) == 1:
                    found = reader.common([(Decimal(numbers[0]), unit)])
                else:
                    found = reader.common([(Decimal(n), u) for n, u in zip(numbers, own)])
                common.append(found[0])
                scaled.append(found[1])
            columns = [rows["id"].combine_chunks(), rows["code"].combine_chunks(), pa.array(units, pa.string()), rows["stated"].combine_chunks(), pa.array(common, pa.string()), pa.array(scaled, pa.int64())]
            yield pa.record_batch(columns, ["id", "code", "decoded_unit", "stated", "unit", "value_scaled"])

    return ordered.mapInArrow(decode, "id long, code string, decoded_unit string, stated boolean, unit string, value_scaled long")


_PART = "part int, code string, numbers array<long>"


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.list_(pa.int64())]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["part", "code", "numbers"])
