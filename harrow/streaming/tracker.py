"""What is new at a source, over a stream: each source's page and its candidates, in the state of transformWithState.

observed: source, candidate (null: the source's own page), at (timestamp), fingerprint. A source's state is a
value (first seen, last checked, last changed, fingerprint) and a map of candidates. A row finds what the rows
before it left: forgotten are candidates not seen for `candidate_days`, all but the `most` last seen of a source, and
sources not checked for `source_days` with all they had. A timer at the end of that time frees the state of a source
that no row comes for. Forgetting goes by the rows' own times, so the outcome doesn't depend on how rows fall into triggers,
as long as a source's rows come in order of time between triggers; inside one they are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harrow.sources.versions import VersionedTable

OUT = "source string, candidate string, at timestamp, fingerprint string, first_seen boolean, changed boolean, known boolean, n_candidates long"
_VALUE = "first_at timestamp, checked_at timestamp, changed_at timestamp, fingerprint string"
_ENTRY = "first_at timestamp, seen_at timestamp, changed_at timestamp, fingerprint string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Retention:
    """Days for which sources and candidates are remembered, and the most candidates of a source."""

    source_days: float = 365
    candidate_days: float = 180
    most: int = 1000


class _Tracker(StatefulProcessor):
    def __init__(self, keep: Retention):
        self.keep = keep
        self.source_for, self.candidate_for = pd.Timedelta(days=keep.source_days), pd.Timedelta(days=keep.candidate_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.source = handle.getValueState("source", _VALUE)
        self.candidates = handle.getMapState("candidates", "candidate string", _ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        seen = pd.concat(list(rows)).sort_values(["at", "candidate", "fingerprint"], kind="stable", na_position="first")
        own = self.source.get() if self.source.exists() else None
        # the store gives them in the order of its keys: the last seen have to stand last, equal times as rows are sorted
        never = pd.Timestamp.min.to_pydatetime()
        known = dict(sorted(((k[0], v) for k, v in self.candidates.iterator()), key=lambda e: (e[1][1] or never, e[0])))
        before = set(known)
        out = []
        for candidate, at, fingerprint in zip(seen["candidate"], seen["at"], seen["fingerprint"], strict=True):
            now = at.to_pydatetime()
            if own is not None and own[1] is not None and now - own[1] > self.source_for:
                own, known = None, {}
            known = {k: v for k, v in known.items() if v[1] is None or now - v[1] <= self.candidate_for}
            if own is None:
                own = (now, now, None, None)
            own = (own[0], now, own[2], own[3])
            if candidate is None or pd.isna(candidate):
                first, changed = own[3] is None, own[3] is not None and own[3] != fingerprint
                own = (own[0], now, now if first or changed else own[2], fingerprint)
                candidate = None
            else:
                entry = known.pop(candidate, None)
                first, changed = entry is None, entry is not None and entry[3] != fingerprint
                # the last seen stand last
                known[candidate] = (now if first else entry[0], now, now if first or changed else entry[2], fingerprint)
                while len(known) > self.keep.most:
                    del known[next(iter(known))]
            out.append((key[0], candidate, at, fingerprint, first, changed, not first, len(known)))
        self.source.update(own)
        for gone in before - set(known):
            self.candidates.removeKey((gone,))
        for candidate, entry in known.items():
            self.candidates.updateValue((candidate,), entry)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((pd.Timestamp(own[1]) + self.source_for).timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.source.clear()
        self.candidates.clear()
        return iter(())


def track(observed: DataFrame, keep: Retention = Retention(), late: str = "1 hour") -> DataFrame:
    """The stream with first_seen, changed, known (seen before, changed or not) and n_candidates (remembered after the row).

    The session has to keep state in RocksDB (see rocks_state). The state of a source last seen at t is freed when the watermark,
    `late` behind the newest row, has passed t + source_days.
    """
    rows = observed.select("source", "candidate", F.col("at").cast("timestamp").alias("at"), "fingerprint").withWatermark("at", late)
    return rows.groupBy("source").transformWithStateInPandas(_Tracker(keep), OUT, "append", "EventTime")


class rocks_state:  # noqa: N801  a context manager
    """Sets the session's state store for a query that is started inside."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.NAME)
        self.spark.conf.set(self.NAME, ROCKS)

    def __exit__(self, *_):
        self.spark.conf.set(self.NAME, self.before)


def carry_forward(feed: VersionedTable, days: int, at: str, usable: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: puts each batch's usable rows into the feed by its key and lets go of rows more than `days` older than the feed's newest (by
    column `at`). A batch that comes again changes nothing, as rows are put in by key."""

    def merge(batch: DataFrame, _: int) -> None:
        rows = usable(batch)
        if rows.isEmpty():
            return
        feed.upsert(rows)
        newest = feed.read().agg(F.max(at)).first()[0]
        old = F.col(at) < F.lit(newest) - F.make_dt_interval(F.lit(days))

        def apply(kept: DataFrame | None, deleted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
            return kept.where(~old | F.col(at).isNull()), deleted

        feed.change(apply)

    return merge
