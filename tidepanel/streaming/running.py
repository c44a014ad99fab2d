"""Exponential means of events in the order of their times, over a batch or a stream.

A batch is numbered by buckets of days and summed by blocks of rows, each a running sum of decaying terms, so that a type
of event with very many rows spreads over tasks.  A stream keeps for each type the running means and the rows whose turn has not come: rows wait
in the state until the watermark has passed their time, then they are taken in the order of (ts, event_id).  So shuffled
rows, within the allowed lateness, and repeated ones give what the batch gives; a row that comes after the watermark is left
out.  What a state holds is bounded by the rows of the allowed lateness.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scan import means_in_order
from ..sources.panels import FactorStore


def running_means(events: DataFrame, periods: dict[str, int], late: str = "1 hour", key: str = "event_type", unit: str = "day") -> DataFrame:
    """(event_id, ts, key, value, means): of each event the exponential means up to it, null before they are seeded with the first values.

    Rows without a time, key or value are left out, as are rows of an id that has been there, of which the least (ts, value) stays.
    """
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), key, F.col("value").cast("double").alias("value")).dropna()
    return _stream(rows, periods, late, key) if events.isStreaming else _batch(rows, periods, key, unit)


def _batch(rows: DataFrame, periods: dict[str, int], key: str, unit: str) -> DataFrame:
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy("ts", "value"))).filter("_n = 1").drop("_n")
    df = means_in_order(once, periods, "value", ["ts", "event_id"], key, unit, "ts")
    return df.select("event_id", "ts", key, "value", *periods)


def _stream(rows: DataFrame, periods: dict[str, int], late: str, key: str) -> DataFrame:
    names, n = list(periods), list(periods.values())

    def step(group: tuple, batches, state: GroupState):
        done, k, means, ts, ids, values = state.get if state.exists else (-(1 << 62), 0, [0.0] * len(n), [], [], [])
        waiting = {i: (t, i, v) for t, i, v in zip(ts, ids, values, strict=True)}
        for pdf in batches:
            # Microseconds since 1970.
            micros = pd.to_datetime(pdf["ts"], utc=True).astype("datetime64[us, UTC]").astype("int64")
            for t, i, v in zip(micros.tolist(), pdf["event_id"].tolist(), pdf["value"].tolist(), strict=True):
                if t > done and (i not in waiting or (t, i, v) < waiting[i]):
                    waiting[i] = (t, i, v)
        mark = state.getCurrentWatermarkMs() * 1000
        turn = sorted(row for row in waiting.values() if row[0] <= mark)
        out = []
        for t, i, v in turn:
            k += 1
            means = [m + v / p if k <= p else m * (1 - 2 / (p + 1)) + v * (2 / (p + 1)) for m, p in zip(means, n, strict=True)]
            out.append((i, t, group[0], v, *[m if k >= p else None for m, p in zip(means, n, strict=True)]))
            del waiting[i]
        left = sorted(waiting.values())
        state.update((max(done, mark), k, means, [r[0] for r in left], [r[1] for r in left], [r[2] for r in left]))
        if left:
            state.setTimeoutTimestamp(max(left[0][0] // 1000, mark // 1000) + 1)
        if not out:
            return
        made = pd.DataFrame(out, columns=["event_id", "ts", key, "value", *names])
        yield made.assign(ts=pd.to_datetime(made["ts"], unit="us", utc=True).dt.tz_localize(None), **{m: made[m].astype(float) for m in names})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    result = f"event_id long, ts timestamp, {key} {kinds[key]}, value double, " + ", ".join(f"{m} double" for m in names)
    state = "done long, k long, means array<double>, ts array<long>, ids array<long>, vals array<double>"
    marked = rows.withColumn("event_id", F.col("event_id").cast("long")).withWatermark("ts", late)
    return marked.groupBy(key).applyInPandasWithState(step, result, state, "append", GroupStateTimeout.EventTimeTimeout)


def to_store(stream: DataFrame, store: FactorStore, name: str, checkpoint: str):
    """Runs the stream (date, code, value) over what there is, each batch a version of the factor; a batch that is run again adds nothing."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.append(name, batch, batch=f"{checkpoint}:{number}")

    return stream.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
