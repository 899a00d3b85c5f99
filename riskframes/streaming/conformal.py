"""Event-ordered state on streams: conformal corrections, EWMA variances and freshness, one key a series.

State lives in the engine's store, so a restart or a lost executor goes on from the last committed batch. Outcomes may come late and
in any order; a late one counts from when it comes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "series string, seq bigint, forecast_id string, base double, correction double, adjusted double"
STATE = "pending_ids array<string>, pending_bases array<double>, seen array<string>, scores array<double>"


def correction(scores: list[float], coverage: float, minimum: int, cold: float) -> float:
    """The order statistic at ceil((n + 1) * coverage), held within the sample."""
    n = len(scores)
    if n < minimum or not n:
        return cold
    return sorted(scores)[max(1, min(n, math.ceil((n + 1) * coverage))) - 1]


def conformal_stream(events: DataFrame, coverage: float, window: int, minimum: int, cold: float = 0.0, remember: int = 10_000) -> DataFrame:
    """Issued forecasts of a stream (series, seq, kind, forecast_id, value) with their corrections, in order of seq within a batch.

    The state of a series is its pending forecasts, the last ``window`` scores and the last ``remember`` issued ids: an id that comes again within these
    is an error, so the state doesn't grow with the stream.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, bases, seen, scores = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        pending, known, out = dict(zip(ids, bases, strict=True)), dict.fromkeys(seen), []
        rows = pd.concat(list(frames)).sort_values("seq")
        for e in rows.itertuples():
            if e.kind == "issue":
                if e.forecast_id in known or e.forecast_id in pending:
                    raise ValueError(f"forecast {e.forecast_id} is issued twice")
                known[e.forecast_id] = None
                if len(known) > remember:
                    known.pop(next(iter(known)))
                pending[e.forecast_id] = e.value
                c = correction(scores, coverage, minimum, cold)
                out.append((key[0], e.seq, e.forecast_id, e.value, c, e.value + c))
            else:
                if e.forecast_id not in pending:
                    raise ValueError(f"forecast {e.forecast_id} isn't pending")
                scores = [*scores, e.value - pending.pop(e.forecast_id)][-window:]
        state.update((list(pending), list(pending.values()), list(known), scores))
        yield pd.DataFrame(out, columns=["series", "seq", "forecast_id", "base", "correction", "adjusted"])

    return events.groupBy("series").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def ewma_stream(returns: DataFrame, decay: float, start: float) -> DataFrame:
    """(series, seq, r, variance) of a stream (series, seq, r): the variance before each log return."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v = state.get[0] if state.exists else start
        rows, out = pd.concat(list(frames)).sort_values("seq"), []
        for e in rows.itertuples():
            out.append((key[0], e.seq, e.r, v))
            v = decay * v + (1 - decay) * math.log1p(e.r) ** 2
        state.update((v,))
        yield pd.DataFrame(out, columns=["series", "seq", "r", "variance"])

    return returns.groupBy("series").applyInPandasWithState(run, "series string, seq bigint, r double, variance double", "v double", "append", GroupStateTimeout.NoTimeout)


def filter_stream(rows: DataFrame, model, columns: list[str]) -> DataFrame:
    """(series, seq, pi) of a stream of factor rows: the forward filter with its belief as state. ``model``: fitted regimes."""
    from ..operators.factors import log_density

    import numpy as np

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prior = np.array(state.get[0]) if state.exists else model.start
        table, out = pd.concat(list(frames)).sort_values("seq"), []
        density = log_density(table[columns].to_numpy(float), model.means, model.covariances)
        for seq, logs in zip(table["seq"], density, strict=True):
            w = np.exp(logs - logs.max()) * np.maximum(prior, 1e-300)
            pi = w / w.sum()
            out.append((key[0], seq, pi.tolist()))
            prior = pi @ model.transitions
        state.update((prior.tolist(),))
        yield pd.DataFrame(out, columns=["series", "seq", "pi"])

    return rows.groupBy("series").applyInPandasWithState(run, "series string, seq bigint, pi array<double>", "prior array<double>", "append", GroupStateTimeout.NoTimeout)


def rolling_counts(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Extension: counts and sums of a stream (ts, event_type, value) in sliding windows with a watermark."""
    from pyspark.sql import functions as F

    out = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")
