"""Streams of sources and decisions with keyed state: lagged as-of values, freshness, and holdings of strategies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def asof_stream(rows: DataFrame, lag_sessions: int, max_stale_days: int) -> DataFrame:
    """(series, date, value, source_date, stale) for each session of a stream (series, date, kind, value) of sources and sessions.

    The state holds rows that aren't known yet, with the sessions that they still wait, and the last known one. On equal dates sources come first.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waits, dates, values, last_date, last_value = state.get if state.exists else ([], [], [], None, None)
        queue = list(zip(waits, dates, values, strict=True))
        table = pd.concat(list(frames))
        table["_order"] = (table["kind"] != "source").astype(int)
        out = []
        for e in table.sort_values(["date", "_order"]).itertuples():
            if e.kind == "source":
                if e.value == e.value and e.value is not None:
                    queue.append((lag_sessions, str(e.date), float(e.value)))
                continue
            due = [q for q in queue if q[0] == 0]
            queue = [(w - 1, d, v) for w, d, v in queue if w > 0]
            for _, d, v in due:
                if last_date is None or d > last_date:
                    last_date, last_value = d, v
            stale = last_date is not None and (pd.Timestamp(e.date) - pd.Timestamp(last_date)).days > max_stale_days
            out.append((key[0], str(e.date), None if stale else last_value, last_date, stale))
        state.update(([q[0] for q in queue], [q[1] for q in queue], [q[2] for q in queue], last_date, last_value))
        yield pd.DataFrame(out, columns=["series", "date", "value", "source_date", "stale"])

    schema = "series string, date string, value double, source_date string, stale boolean"
    return rows.groupBy("series").applyInPandasWithState(run, schema, "waits array<int>, dates array<string>, vals array<double>, last_date string, last_value double", "append", GroupStateTimeout.NoTimeout)


def freshness_stream(rows: DataFrame, warn_days: int, fail_days: int) -> DataFrame:
    """(source, date, age_days, status) for each ``check`` of a stream (source, date, kind): the age of the last ``seen`` date.

    No date yet, or one after the check, fails.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        table, out = pd.concat(list(frames)), []
        table["_order"] = (table["kind"] != "seen").astype(int)
        for e in table.sort_values(["date", "_order"]).itertuples():
            if e.kind == "seen":
                last = max(filter(None, (last, str(e.date))))
            else:
                age = (pd.Timestamp(e.date) - pd.Timestamp(last)).days if last else None
                status = "fail" if age is None or age < 0 or age > fail_days else "warn" if age > warn_days else "fresh"
                out.append((key[0], str(e.date), age, status))
        state.update((last,))
        yield pd.DataFrame(out, columns=["source", "date", "age_days", "status"]).astype({"age_days": "Int64"})

    return rows.groupBy("source").applyInPandasWithState(run, "source string, date string, age_days bigint, status string", "last string", "append", GroupStateTimeout.NoTimeout)


def holdings_stream(blocks: DataFrame, rate: float) -> DataFrame:
    """(strategy, seq, gross, cost, net, turnover) of a stream (strategy, seq, target, returns): weights drift from block to block.

    A block whose target doesn't sum to one, or doesn't fit the assets, switches its strategy off for good.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, off = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        out = []
        for e in pd.concat(list(frames)).sort_values("seq").itertuples():
            target, g = np.array(e.target, float), np.array(e.returns, float)
            if off or len(target) != len(g) or abs(target.sum() - 1) > 1e-9 or (held and len(held) != len(g)):
                off = True
                continue
            before = np.array(held) if held else np.full(len(g), 1 / len(g))
            turnover = float(np.abs(target - before).sum())
            gross = float(target @ g)
            grown = target * (1 + g)
            held = (grown / grown.sum()).tolist()
            out.append((key[0], e.seq, gross, rate * turnover, gross - rate * turnover, turnover))
        state.update((held, off))
        yield pd.DataFrame(out, columns=["strategy", "seq", "gross", "cost", "net", "turnover"])

    schema = "strategy string, seq bigint, gross double, cost double, net double, turnover double"
    return blocks.groupBy("strategy").applyInPandasWithState(run, schema, "held array<double>, off boolean", "append", GroupStateTimeout.NoTimeout)
