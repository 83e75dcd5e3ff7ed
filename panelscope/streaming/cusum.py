"""The CUSUM detector on a stream of returns, with its state kept by Spark for each ticker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "seen array<double>, up double, down double, last long, t long"


def stream_cusum(returns: DataFrame, ref_window: int = 60, threshold: float = 4.0, cooldown: int = 20, slack: float = 0.5) -> DataFrame:
    """(ticker, t, date) detections of a stream (ticker, date, r) that comes in order of date for each ticker.

    The state is the last ref_window rows, both sums, and the position of the last detection, so it
    doesn't grow. Rules are those of the batch detector: a null return holds a place in the window but
    isn't in its moments, and is itself passed over.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, up, down, last, t = state.get if state.exists else ([], 0.0, 0.0, -cooldown - 1, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("date", ignore_index=True)
        new = rows["r"].to_numpy(float)
        # all moments of the batch at once; only the sums depend on what went before
        values = np.r_[np.array([np.nan if x is None else x for x in seen], float), new]
        before = pd.Series(values).rolling(ref_window, min_periods=2)
        mu, sigma = (x.shift(1).to_numpy()[len(seen) :] for x in (before.mean(), before.std()))
        with np.errstate(invalid="ignore", divide="ignore"):
            z = np.where((sigma >= 1e-12) & (t + np.arange(len(new)) >= ref_window), (new - mu) / sigma, np.nan)
        found = []
        for k in np.flatnonzero(~np.isnan(z)).tolist():
            up, down = max(0.0, up + z[k] - slack), max(0.0, down - z[k] - slack)
            if max(up, down) > threshold and t + k - last > cooldown:
                found.append((key[0], t + k, rows["date"].iloc[k]))
                last, up, down = t + k, 0.0, 0.0
        left = values[-ref_window:]
        state.update(([None if np.isnan(x) else float(x) for x in left], float(up), float(down), int(last), int(t + len(new))))
        yield pd.DataFrame(found, columns=["ticker", "t", "date"])

    return returns.groupBy("ticker").applyInPandasWithState(run, "ticker string, t long, date date", STATE, "append", GroupStateTimeout.NoTimeout)
