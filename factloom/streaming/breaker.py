"""A circuit breaker over a stream of calls: per provider CLOSED, OPEN or HALF_OPEN."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "provider string, ts timestamp, ok boolean, state string"


def step(opened: float | None, failures: int, at: float, ok: bool, threshold: int, cooldown: float) -> tuple[str, float | None, int]:
    """State when a call is made, then when the breaker opened and the failures in a row after it."""
    state = "CLOSED" if opened is None else "HALF_OPEN" if at - opened >= cooldown else "OPEN"
    if state == "OPEN":
        return state, opened, failures
    if ok:
        return state, None, 0
    failures += 1
    return state, at if failures >= threshold else opened, failures


def breaker_states(calls: DataFrame, threshold: int = 3, cooldown: float = 30.0) -> DataFrame:
    """For a stream (provider, ts, ok), each call with the state that met it; order is by time within a batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, failures = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        seen = []
        for r in rows.itertuples():
            name, opened, failures = step(opened, failures, r.ts.timestamp(), bool(r.ok), threshold, cooldown)
            seen.append(name)
        state.update((opened, failures))
        yield pd.DataFrame({"provider": key[0], "ts": rows["ts"], "ok": rows["ok"], "state": seen})

    return calls.groupBy("provider").applyInPandasWithState(run, OUT, "opened double, failures int", "append", GroupStateTimeout.NoTimeout)
