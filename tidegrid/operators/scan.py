"""Ordered operators over series too long for one task.

A daily panel bounds a series by the calendar; a tick series has no such bound, and one of them may
hold a third of the table. These operators number the rows without a per-series sort, cut a series
into chunks of equal length, and let chunks run in parallel: frames borrow the rows before a chunk
(halo), running totals and streaks receive a carry from the chunks before it.

Totals and streaks read their input twice (once to count or total, once to apply), so hand them a stored
table rather than a long plan; frames read it once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions.ordered import with_columns
from tidegrid.session import stored

POS, CHUNK = "_pos", "_chunk"


def _part() -> Column:
    return F.shiftright("_at", 33)


def _in_ranges(df: DataFrame, keys: list[str], order: list[str], keep: list[str], name: str) -> DataFrame:
    """``keep`` of ``df`` dealt by sampled bounds over keys and order, sorted, and written with ``_at``, each row's place in the sort."""
    cols = [*keys, *order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    return stored(placed.select(*keep, "_at"), name)


def _with_ranges(placed: DataFrame, keys: list[str], what: dict[str, Column], few: bool = False) -> DataFrame:
    """Rows joined with ``what`` of their series' part in their range; ``what`` are windows or columns over
    ``_n`` rows, ``_w`` weight and ``_first`` place, one row per series and range, ordered by ``_part``. ``few``: these
    rows are few enough for every task, so that ``placed`` is not dealt again to meet them."""
    names = [f"_k{i}" for i in range(len(keys))]
    per = placed.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], _part().alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), F.sum("_weight").alias("_w"))
    per = per.select(*names, "_part", *[c.alias(n) for n, c in what.items()])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], _part() == F.col("_part"))
    return placed.join(F.broadcast(per) if few else per, same).drop(*names)


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str = POS, keep: list[str] | None = None, few: bool = False) -> DataFrame:
    """``df`` with the number of each row in its series, from 0, by ``order``; rows equal in it come in any order.

    Rows are dealt by sampled bounds over keys, order and, last, their place in the input, so neither a hot
    series nor a hot step of the order (a third of the table on one day) meets in one task. They are sorted, written
    with their place in the sort, and a series' rows in a range get the number of those in the ranges before: one row
    per series and range. Null keys are a series. ``df`` is read once; hand in a stored table, since a row's place
    in the input must not change when a task runs again. ``keep`` names the columns of the result (default: all), with
    the keys among them; ``few`` says that series are few, so that their numbers by range go to every task."""
    keep = df.columns if keep is None else keep
    placed = _in_ranges(df.withColumn("_row", F.monotonically_increasing_id()), keys, [*order, "_row"], keep, "numbered")
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    met = _with_ranges(placed.withColumn("_weight", F.lit(0)), keys, {"_shift": F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))}, few)
    return met.select(*keep, (F.col("_at") - F.col("_shift")).alias(out))


def running_weight(df: DataFrame, keys: list[str], order: list[str], weight: str, out: str, total: str) -> DataFrame:
    """``df`` with the weight of the rows of its series before each row (``out``) and of all of them (``total``).

    No two rows may be equal in keys and order: fold them first. Dealt as in ``number_rows``: a series in many ranges is
    summed inside each, and the sums of the ranges before are added."""
    placed = _in_ranges(df, keys, order, df.columns, "in_ranges")
    series = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    before = series.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    met = _with_ranges(placed.withColumn("_weight", F.col(weight)), keys, {"_off": F.coalesce(F.sum("_w").over(before), F.lit(0)), total: F.sum("_w").over(series)})
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn(out, F.coalesce(F.sum("_weight").over(inside), F.lit(0)) + F.col("_off")).drop("_at", "_part", "_weight", "_off")


def halo_frames(df: DataFrame, keys: list[str], halo: int, exprs: Callable[[Axis], dict[str, Column]], chunk_rows: int = 1_000_000) -> DataFrame:
    """Trailing-frame columns over a positioned table, chunk by chunk.

    ``halo`` is how many earlier rows the widest frame reaches; those rows are lent to the next
    chunk and dropped again. ``exprs`` receives the chunk axis."""
    if chunk_rows < halo:
        raise ValueError(f"chunks of {chunk_rows} rows cannot lend {halo}")
    home = F.floor(F.col(POS) / chunk_rows)
    lends = F.col(POS) % chunk_rows >= chunk_rows - halo
    where = F.when(lends, F.array(home, home + 1)).otherwise(F.array(home)) if halo else F.array(home)
    d = df.withColumn(CHUNK, F.explode(where)).withColumn("_home", F.col(CHUNK) == home)
    ax = Axis((*keys, CHUNK), POS)
    return with_columns(d, exprs(ax)).filter("_home").drop("_home", CHUNK)


def _chunks(df: DataFrame, chunk_rows: int) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(POS) / chunk_rows))


def running_sum(df: DataFrame, keys: list[str], value: str, out: str, chunk_rows: int = 1_000_000) -> DataFrame:
    """Sum from the start of the series, in two levels: inside the chunk, plus the chunks before."""
    d = _chunks(df, chunk_rows)
    total = d.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(*keys, CHUNK, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    inside = F.sum(value).over(Axis((*keys, CHUNK), POS).upto())
    d = d.withColumn("_local", inside).join(carry, [*keys, CHUNK])
    return d.withColumn(out, F.coalesce("_local", F.lit(0)) + F.col("_carry")).drop("_local", "_carry", CHUNK)


def running_streak(df: DataFrame, keys: list[str], cond: str, out: str, chunk_rows: int = 1_000_000) -> DataFrame:
    """Length of the run of true rows ending at each row, carried across chunks.

    A chunk passes on its trailing run, or its whole length added to what it received when it holds
    no false row."""
    d = _chunks(df, chunk_rows).withColumn("_c", F.coalesce(F.col(cond), F.lit(False)))
    broke = F.when(~F.col("_c"), F.col(POS))
    per = d.groupBy(*keys, CHUNK).agg(F.max(broke).alias("_last_false"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, CHUNK, F.coalesce(F.max("_last_false").over(before), F.lit(-1)).alias("_carry"))
    inside = F.max(broke).over(Axis((*keys, CHUNK), POS).upto())
    d = d.withColumn("_local", inside).join(carry, [*keys, CHUNK])
    return d.withColumn(out, F.col(POS) - F.coalesce("_local", "_carry")).drop("_local", "_carry", "_c", CHUNK)
