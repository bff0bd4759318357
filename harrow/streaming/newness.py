"""Newness over a stream of observations: the state of each key is its last fingerprint, kept for a time by the events' clock."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, run timestamp, fingerprint string, first_seen boolean, changed boolean"
STATE = "first_seen_at timestamp, last_changed_at timestamp, fingerprint string"


def _observe(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # not seen for the retention time
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["run", "fingerprint"], kind="stable")
    run, fingerprint = rows["run"].to_numpy(), rows["fingerprint"].to_numpy()
    known = state.exists
    first_at, changed_at, last = state.get if known else (rows["run"].iloc[0].to_pydatetime(), None, None)
    prior = np.r_[np.array([last], object), fingerprint[:-1]]
    first = np.zeros(len(rows), bool)
    first[0] = not known
    changed = (fingerprint != prior) & ~first
    moved = np.flatnonzero(changed | first)
    state.update((first_at, rows["run"].iloc[moved[-1]].to_pydatetime() if len(moved) else changed_at, fingerprint[-1]))
    newest = int(rows["run"].iloc[-1].timestamp() * 1000)
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1)
    yield pd.DataFrame({"key": key[0], "run": run, "fingerprint": fingerprint, "first_seen": first, "changed": changed})


def stream_newness(observed: DataFrame, retention: str = "180 days") -> DataFrame:
    """observed: streaming key, run, fingerprint, each key's rows in order of run between batches -> first_seen, changed.

    A key whose last run lies further back than `retention` behind the newest run is forgotten: the
    watermark is that far behind, and the state times out at the key's last run. Rows older than that
    are dropped. A key's rows of one trigger are sorted together; bound a trigger at the source.
    """
    rows = observed.select("key", F.col("run").cast("timestamp").alias("run"), "fingerprint").withWatermark("run", retention)
    return rows.groupBy("key").applyInPandasWithState(_observe, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
