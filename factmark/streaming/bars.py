"""Bars arriving in time: momentum signals and the look-ahead audit, with bounded state.

State per entity is the last ``lookback`` + 1 closes (or two counters), so it does
not grow with the stream. Inside a micro-batch an entity's bars are sorted by time;
a bar at or before the newest one already handled is late: it is reported with
``late = true`` and never changes the state, and the caller routes it to a side table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIGNAL_OUT = ("entity_id string, ts timestamp, close double, signal double, "
              "position int, changed boolean, late boolean")
SIGNAL_STATE = "closes array<double>, seen long, newest timestamp, position int"


def _in_time_order(frames: Iterator[pd.DataFrame], newest):
    """One entity's bars of a micro-batch by time, and which of them are late."""
    bars = pd.concat(list(frames)).sort_values("ts", kind="stable").reset_index(drop=True)
    repeated = bars["ts"].duplicated()
    late = repeated if newest is None else repeated | (bars["ts"] <= newest)
    return bars, late.to_numpy()


def stream_momentum(bars: DataFrame, lookback: int = 60, skip: int = 5,
                    threshold: float = 0.0, delay: str = "1 day") -> DataFrame:
    """Signal and position per bar of (entity_id, ts, close); equals the batch factor."""

    def step(key, frames, state: GroupState):
        closes, seen, newest, position = state.get if state.exists else ([], 0, None, 0)
        rows, late = _in_time_order(frames, newest)
        fresh = rows.loc[~late, "close"].to_numpy(dtype=float)
        history = np.concatenate([np.asarray(closes, dtype=float), fresh])
        at = len(closes) + np.arange(len(fresh))
        ready = at >= lookback
        signal = np.full(len(fresh), np.nan)
        signal[ready] = history[at[ready] - skip] / history[at[ready] - lookback] - 1.0
        want = (signal > threshold).astype(int)
        before = np.concatenate([[position], want[:-1]])
        out = pd.DataFrame({"entity_id": key[0], "ts": rows["ts"], "close": rows["close"],
                            "signal": np.nan, "position": 0, "changed": False, "late": late})
        out.loc[~late, "signal"] = signal
        out.loc[~late, "position"] = want
        out.loc[~late, "changed"] = want != before
        if len(fresh):
            top = rows.loc[~late, "ts"].max().to_pydatetime()
            state.update((history[-(lookback + 1):].tolist(), seen + len(fresh), top,
                          int(want[-1])))
        out["signal"] = out["signal"].astype(object).where(out["signal"].notna(), None)
        yield out

    return (bars.withWatermark("ts", delay).groupBy("entity_id").applyInPandasWithState(
        step, SIGNAL_OUT, SIGNAL_STATE, "append", GroupStateTimeout.NoTimeout))


AUDIT_OUT = ("entity_id string, ts timestamp, delivered long, visible long, "
             "future_visible boolean, extra_visible boolean, late boolean")
AUDIT_STATE = "delivered long, newest timestamp"


def stream_lookahead_audit(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per bar of (entity_id, ts, visible, newest_visible): could it see what was not yet sent?"""

    def step(key, frames, state: GroupState):
        delivered, newest = state.get if state.exists else (0, None)
        rows, late = _in_time_order(frames, newest)
        count = delivered + np.arange(1, len(rows) + 1)
        newest_visible = pd.to_datetime(rows["newest_visible"])
        yield pd.DataFrame({
            "entity_id": key[0], "ts": rows["ts"], "delivered": count,
            "visible": rows["visible"],
            "future_visible": (newest_visible > rows["ts"]).to_numpy(),
            "extra_visible": (rows["visible"] > count).to_numpy(), "late": late})
        top = rows["ts"].max().to_pydatetime()
        state.update((delivered + len(rows), top if newest is None else max(top, newest)))

    return (bars.withWatermark("ts", delay).groupBy("entity_id").applyInPandasWithState(
        step, AUDIT_OUT, AUDIT_STATE, "append", GroupStateTimeout.NoTimeout))


def run_to_files(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process what is available now into Parquet; restarts resume from the checkpoint."""
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output))
    query.awaitTermination()


def split_late(output: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(on-time rows, late rows for the side table)."""
    return output.where(~F.col("late")), output.where("late")
