"""Structured Streaming jobs: bars, corrections, activity windows, online scores, streaks, means."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.axis import Axis
from tidegrid.operators.anomaly import Forest, level_of, score_udf
from tidegrid.sources import versions


def bar_stream(ticks: DataFrame, keys: list[str], ts: str, price: str, size: str, late: str, size_col: str | None = None, tick: str | None = None) -> DataFrame:
    """Tumbling open/high/low/close/volume per key. Ticks later than ``late`` are dropped once
    their bar has closed. Ticks of equal time go by ``tick``, their number. All five fold map-side before
    the state store."""
    order = F.struct(ts, tick) if tick else F.col(ts)
    vol = F.sum(size_col).cast("double") if size_col else F.count(F.lit(1)).cast("double")
    bars = ticks.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), vol.alias("volume")
    )
    return bars.select(*keys, F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def sliding_activity(events: DataFrame, keys: list[str], ts: str, value: str, size: str, slide: str, late: str) -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("window.start").alias("window_start"), "n", "total")


def session_activity(events: DataFrame, keys: list[str], ts: str, value: str, gap: str, late: str) -> DataFrame:
    """Runs of events closer than ``gap``; emitted once the watermark passes their end. See ``with_end_marker`` for the
    sessions that are open when a stream ends."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(ts).alias("last_ts"))
    return out.select(*keys, F.col("session_window.start").alias("session_start"), "last_ts", "n", "total")


def score_stream(rows: DataFrame, forest: Forest, thresholds: dict[str, float]) -> DataFrame:
    """Raw isolation score and level of each arriving row, from a fitted forest and fixed cuts on
    the negated raw score."""
    scored = rows.withColumn("raw", score_udf(forest)())
    cut = {k: F.lit(float(v)) for k, v in thresholds.items()}
    return scored.withColumn("level", level_of(-F.col("raw"), cut["moderate"], cut["high"], cut["critical"]))


LATE_DAYS = 30
IDLE_DAYS = 400


def _per_key(df: DataFrame, keys: list[str], ts: str, value: Column, fold: Callable, init: tuple, base_schema: str, out_schema: str, late: int, idle: int) -> DataFrame:
    """Running results per key over days that may arrive out of order.

    The state is the result up to ``late`` days before the key's newest day, and the rows since. A batch is
    merged into those rows (of a repeated day the later arrival counts), everything from its earliest day on is
    computed anew by ``fold(base, values) -> (columns, states)`` and emitted again, so the newest version of a
    day is right whatever the order was. Rows of the days that are folded into the state already (more than ``late`` days
    behind their key's newest) are a side output: they come out with ``late`` true and no result, for
    ``write_updates`` to put aside.

    Event time is the day. A key's timer stands ``idle`` days after its newest day; once the watermark, which is ``idle``
    days behind the newest day of all, passes it, the key leaves the state and starts anew if it comes back. Rows
    behind the watermark itself are dropped by the engine and counted in the query's progress."""
    if idle <= late:
        raise ValueError(f"keys must be held for longer than {late} days")
    n, day_ms = len(init), 86_400_000
    none = [f.split()[0] for f in out_schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (*init, -(2**31), [], [])
        base, upto = held[:n], held[n]
        pdf = pd.concat(list(batches))
        fresh = pd.Series(pdf["_value"].to_numpy(dtype=float), index=(pd.to_datetime(pdf[ts]) - pd.Timestamp(0)).dt.days.to_numpy())
        rows = pd.concat([pd.Series(np.array(held[n + 2], dtype=float), index=np.array(held[n + 1], dtype=np.int64)), fresh[fresh.index > upto]])
        rows = rows[~rows.index.duplicated(keep="last")].sort_index()
        days = rows.index.to_numpy(dtype=np.int64)
        out, states = fold(base, rows.to_numpy(dtype=float))
        newest = int(days[-1]) if len(days) else int(upto)
        done = int(np.searchsorted(days, newest - late, side="right")) if len(days) else 0
        if done:
            base, upto = tuple(x[done - 1].item() for x in states), int(days[done - 1])
        state.update((*base, upto, days[done:].tolist(), rows.to_numpy(dtype=float)[done:].tolist()))
        state.setTimeoutTimestamp(max(newest + idle, state.getCurrentWatermarkMs() // day_ms + 1) * day_ms)
        first = int(np.searchsorted(days, fresh.index[fresh.index > held[n]].min())) if (fresh.index > held[n]).any() else len(days)
        behind = fresh.index[fresh.index <= held[n]].to_numpy(dtype=np.int64)
        for d, cols, is_late in ((days[first:], {c: x[first:] for c, x in out.items()}, False), (behind, {c: [None] * len(behind) for c in out}, True)):
            if len(d):
                back = {name: [k] * len(d) for name, k in zip(keys, key)}
                when = (pd.Timestamp(0) + pd.to_timedelta(d, unit="D")).date
                yield pd.DataFrame(back | {ts: when} | cols | {"late": is_late})[[*none, "late"]]

    state_schema = f"{base_schema}, upto int, days array<int>, vals array<double>"
    timed = df.select(*keys, ts, value.cast("double").alias("_value"), F.col(ts).cast("timestamp").alias("_time")).withWatermark("_time", f"{idle} days")
    return timed.groupBy(*keys).applyInPandasWithState(run, f"{out_schema}, late boolean", state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def streak_stream(df: DataFrame, keys: list[str], ts: str, cond: str, key_type: str = "string", late: int = LATE_DAYS, idle: int = IDLE_DAYS) -> DataFrame:
    """Length of the run of true rows ending at each row. Feed daily rows: the state and the work
    per key are bounded by ``late`` days, whatever the tick rate, and idle keys leave: see ``_per_key``."""

    def fold(base: tuple, v: np.ndarray):
        go, pos = v == 1, np.arange(1, len(v) + 1)
        broken = np.maximum.accumulate(np.where(go, 0, pos)) if len(v) else pos
        run = (pos - broken + np.where(broken == 0, base[0], 0)).astype(np.int32)
        return {"streak": run}, (run,)

    cols = ", ".join(f"{k} {key_type}" for k in keys)
    return _per_key(df, keys, ts, F.coalesce(F.col(cond), F.lit(False)), fold, (0,), "run int", f"{cols}, {ts} date, streak int", late, idle)


def _decayed(x: np.ndarray, keep: float, start: float) -> np.ndarray:
    """y_i = keep y_{i-1} + x_i from ``start``; the rows since the last state are few."""
    return np.fromiter(itertools.islice(itertools.accumulate(x.tolist(), lambda y, v: y * keep + v, initial=start), 1, None), float, len(x))


def ewm_stream(df: DataFrame, keys: list[str], ts: str, value: str, span: float, key_type: str = "string", late: int = LATE_DAYS, idle: int = IDLE_DAYS) -> DataFrame:
    """Normalised exponentially weighted mean and last value per key, carried across batches."""
    keep = 1.0 - 2.0 / (span + 1.0)

    def fold(base: tuple, v: np.ndarray):
        known = ~np.isnan(v)
        num, den = _decayed(np.where(known, v, 0.0), keep, base[0]), _decayed(known.astype(float), keep, base[1])
        last = pd.Series(np.concatenate([[base[2]], v])).ffill().to_numpy()[1:]
        mean = pd.Series(np.where(den > 0, num / np.where(den > 0, den, 1.0), np.nan))
        return {"ewm": mean.astype(object).where(mean.notna(), None).to_numpy(), "last_value": last}, (num, den, last)

    cols = ", ".join(f"{k} {key_type}" for k in keys)
    return _per_key(df, keys, ts, F.col(value), fold, (0.0, 0.0, float("nan")), "num double, den double, last double", f"{cols}, {ts} date, ewm double, last_value double", late, idle)


def write_updates(stream: DataFrame, path: str, checkpoint: str, mode: str, late_path: str | None = None) -> dict[str, int]:
    """Run a stream over what is available, appending each batch's rows with their batch number. A
    batch that is retried writes the same number again, which ``latest_updates`` folds away.

    Rows marked ``late`` go to ``late_path`` (or are left out, but counted). Returns how many rows came late, how many
    the engine dropped behind the watermark, and how many rows the state held in the end."""
    marked = "late" in stream.columns
    late = [0]

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("_batch", F.lit(batch_id))
        if marked:
            batch = batch.persist()
            behind = batch.filter("late").drop("late")
            late[0] += behind.count()
            if late_path:
                behind.write.mode("append").parquet(late_path)
            batch.filter("NOT late").drop("late").write.mode("append").parquet(path)
            batch.unpersist()
        else:
            batch.write.mode("append").parquet(path)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    operators = [o for p in q.recentProgress for o in p["stateOperators"]]
    return {"late": late[0], "dropped": sum(o["numRowsDroppedByWatermark"] for o in operators), "held": operators[-1]["numRowsTotal"] if operators else 0}


def end_of_stream(spark, schema, path: str, ts: str, last: str = "9999-01-01 00:00:00") -> None:
    """Put one row far in the future, null but for its time, into the files of ``path``, the marker source of a stream."""
    row = spark.range(1).select(*[(F.lit(last).cast(f.dataType) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    row.coalesce(1).write.mode("append").parquet(path)


def with_end_marker(events: DataFrame, marker_path: str) -> DataFrame:
    """A stream of events, and of the marker that ``end_of_stream`` writes once the events are over.

    A session ends when the watermark passes it, which the last ones of a stream never see. Run the stream to its end,
    write the marker, and run it again on the same checkpoint: the marker moves the watermark beyond all events,
    so every open window and session comes out. Drop the marker's own rows by their null keys."""
    spark = events.sparkSession
    return events.unionByName(spark.readStream.schema(events.schema).parquet(marker_path))


def latest_updates(log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The newest version of each key in an update log."""
    out = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_r"))
    return out.select(*keys, *[F.col(f"_r.{v}").alias(v) for v in values])


def upsert_stream(stream: DataFrame, stored_path: str, checkpoint: str, ax: Axis, values: list[str]) -> None:
    """Late corrections: each batch's last row per key is merged over the stored panel (``sources.versions``), a version
    per batch. A batch that runs twice merges the same rows again."""
    from tidegrid.operators.sets import keep_last

    def merge(batch: DataFrame, _: int) -> None:
        versions.upsert(stored_path, keep_last(batch, list(ax.id_cols), "arrival", values), ax, values)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


def refresh_stream(changes: DataFrame, stored_path: str, out_path: str, checkpoint: str, ax: Axis, features: Callable[[DataFrame], DataFrame], warmup_rows: int) -> None:
    """Recompute features of the rows a batch touches, from the stored panel (``sources.versions``): only the buckets of
    changed series are opened, and of their years only those that reach ``warmup_rows`` rows before the first change."""
    from pyspark.sql import Window

    def recompute(batch: DataFrame, batch_id: int) -> None:
        since = batch.groupBy(*ax.keys).agg(F.min(ax.ts).alias("_since")).persist()
        rows = versions.read_near(batch.sparkSession, stored_path, since, ax, warmup_rows)
        newest = Window.partitionBy(*ax.keys).orderBy(F.col(ax.ts).desc())
        older = F.sum((F.col(ax.ts) < F.col("_since")).cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
        near = rows.withColumn("_older", older).filter(F.col("_older") <= warmup_rows).drop("_older")
        fresh = features(near).filter(F.col(ax.ts) >= F.col("_since")).drop("_since")
        fresh.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out_path)
        since.unpersist()

    changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(recompute).start().awaitTermination()


def event_time_column(c: str) -> Column:
    return F.col(c).cast("timestamp")
