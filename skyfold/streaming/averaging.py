"""Greedy time bins of a stream, by the rule of ``operators.averaging.time_bins``.

Rows must come in order of time within a baseline, up to the watermark; a row
older than its baseline's open bin is late and is left out.  The state of a
baseline is its open bin alone.  A bin is put out when a row opens the next one,
or when the watermark passes its end by ``time_bin_secs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "antenna1 int, antenna2 int, bin long, time double, interval double, n_rows long, u double, v double, w double, flag_row boolean"
_STATE = "bin long, low double, last double, time double, span double, n long, n0 long, u0 double, v0 double, w0 double, n1 long, u1 double, v1 double, w1 double"


def _close(key: tuple, s: list) -> dict:
    number, _, _, time, span, n, n0, u0, v0, w0, n1, u1, v1, w1 = s
    flagged = n0 == 0  # no row without a flag: the flagged ones are averaged
    m, u, v, w = (n1, u1, v1, w1) if flagged else (n0, u0, v0, w0)
    return {"antenna1": key[0], "antenna2": key[1], "bin": number, "time": time / n, "interval": span, "n_rows": n, "u": u / m, "v": v / m, "w": w / m, "flag_row": flagged}


def stream_time_bins(rows: DataFrame, time_bin_secs: float, event_time: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Averaged bins (schema ``OUTPUT``) of streamed rows: ts, time, interval,
    antenna1, antenna2, flag_row, u, v, w.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(_close(key, s))
            # the next bin goes on counting
            state.update((s[0] + 1, float("nan"), s[2], 0.0, 0.0, 0, 0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0))
            yield pd.DataFrame(out)
            return
        data = pd.concat(list(frames)).sort_values("time", kind="stable")
        for t, span, flag, u, v, w in data[["time", "interval", "flag_row", "u", "v", "w"]].itertuples(index=False, name=None):
            low, high = t - span / 2, t + span / 2
            if s is not None and t < s[2]:
                continue
            if s is None:
                s = [0, low, t, 0.0, 0.0, 0, 0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0]
            elif s[5] == 0:
                s[1] = low
            elif high - s[1] > time_bin_secs:
                out.append(_close(key, s))
                s = [s[0] + 1, low, t, 0.0, 0.0, 0, 0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0]
            k = 10 if flag else 6
            s[2], s[3], s[4], s[5] = t, s[3] + t, s[4] + span, s[5] + 1
            s[k : k + 4] = [s[k] + 1, s[k + 1] + u, s[k + 2] + v, s[k + 3] + w]
        state.update(tuple(s))
        latest = int(data["_ms"].max()) + int(time_bin_secs * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    some = rows.withWatermark(event_time, delay).select("antenna1", "antenna2", event_time, "time", "interval", F.coalesce("flag_row", F.lit(False)).alias("flag_row"), "u", "v", "w", F.expr(f"unix_millis(cast({event_time} as timestamp))").alias("_ms"))
    return some.groupBy("antenna1", "antenna2").applyInPandasWithState(step, OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
