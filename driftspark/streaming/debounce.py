"""Debounced clusters over a stream of observations that may come out of order.

Every file has a state of its own, an entry in the map of its bucket: what is settled (the debounced state after a run
whose predecessors are all known), and the runs that wait for theirs. A run that follows the settled one is settled at once, and so is what waits
behind it. A run further on waits; so do the runs of a file of which nothing is settled yet, unless they begin with
``first``. What comes out after each batch is the state over all that is known, as if nothing were missing: the
waiting runs are folded in their order, gaps start anew, but nothing of that is kept. So a file's last output equals what
all its runs give in one batch, in whatever order they came.

After ``patience`` the runs that wait are settled, gaps and all, by a timer; an older run that comes later than that is
left out. A file that is not heard of for ``forget`` is dropped, by a timer too, and starts anew. Time is that of column
``at``, where the stream has one, and of arrival otherwise. (Timers of the machine's clock would keep a stream that is to
end with its input running for ever.)
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.debounce import THRESHOLD
from ..shipping import ship

STATE = "stable long, candidate long, consecutive long, seq long"
OUTPUT = f"repo_id string, file_path string, {STATE}"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PATIENCE_MS = 24 * 3600 * 1000
State = tuple[int, int, int, int]
FILE = "repo_id string, file_path string"
File = tuple[str, str]
#: Files share calls in so many buckets; a stream must keep the number it began with.
BUCKETS = 1024


def after(state: State | None, seq: int, raw: int, threshold: int) -> State:
    """The state after one observation; a gap in ``seq`` starts anew."""
    if state is None or state[3] + 1 != seq:
        return raw, raw, 0, seq
    stable, candidate, n, _ = state
    if raw == stable:
        return stable, stable, 0, seq
    n = n + 1 if candidate == raw else 1
    return (raw, raw, 0, seq) if n >= threshold else (stable, raw, n, seq)


def settle(state: State | None, waiting: dict[int, int], threshold: int, first: int | None = None, all_of_it: bool = False) -> tuple[State | None, dict[int, int]]:
    """The settled state and what still waits: runs are settled as long as they follow, or ``all_of_it``."""
    left = dict(sorted((s, r) for s, r in waiting.items() if state is None or s > state[3]))
    for seq, raw in list(left.items()):
        if not all_of_it and seq != (first if state is None else state[3] + 1):
            break
        state = after(state, seq, raw, threshold)
        del left[seq]
    return state, left


class Debounce(StatefulProcessor):
    """The states of a bucket's files: what is settled of each, the runs that wait for their predecessors, and since when.

    Each file is an entry of a map, read and written once a batch; ``due`` has the files of each timer. A call costs much more
    than an entry, so files share calls.
    """

    def __init__(self, threshold: int, first: int | None, patience_ms: int, forget_ms: int | None) -> None:
        self.threshold, self.first, self.patience, self.forget = threshold, first, patience_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", FILE, f"{STATE}, waiting binary, seen long, since long")
        self.due = handle.getMapState("due", "ms long", "files string")

    def _known(self, file: File) -> tuple[State | None, dict[int, int], int, int] | None:
        found = self.files.getValue(file)
        if found is None:
            return None
        *state, waiting, seen, since = found
        runs = np.frombuffer(bytes(waiting), np.int64).reshape(-1, 2)
        return None if state[3] is None else tuple(state), dict(runs.tolist()), seen, since

    def _keep(self, file: File, state: State | None, waiting: dict[int, int], seen: int, since: int) -> None:
        runs = np.array(list(waiting.items()), np.int64).tobytes()
        self.files.updateValue(file, (*(state or (None,) * 4), runs, seen, since))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got: dict[File, dict[int, int]] = {}
        latest: dict[File, int] = {}
        for batch in rows:
            for repo_id, file_path, seq, raw, ms in zip(*(batch[c].tolist() for c in ("repo_id", "file_path", "seq", "raw", "ms")), strict=True):
                file = repo_id, file_path
                got.setdefault(file, {}).setdefault(seq, raw)
                latest[file] = max(latest.get(file, 0), ms)
        out, due = [], defaultdict(list)
        for file, new in got.items():
            state, waiting, _, since = self._known(file) or (None, {}, 0, 0)
            waited, seen = bool(waiting), latest[file]
            state, waiting = settle(state, new | waiting, self.threshold, self.first)
            self._keep(file, state, waiting, seen, since if waited else seen)
            if waiting and not waited:
                due[seen + self.patience].append(file)
            if self.forget is not None:
                due[seen + self.forget].append(file)
            shown, _ = settle(state, waiting, self.threshold, all_of_it=True)
            if shown:
                out.append((*file, *shown))
        for ms, files in due.items():
            others = self.due.getValue((ms,))
            self.due.updateValue((ms,), (json.dumps((json.loads(others[0]) if others else []) + files),))
            self.handle.registerTimer(ms)
        if out:
            yield pd.DataFrame(out, columns=["repo_id", "file_path", "stable", "candidate", "consecutive", "seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = int(expiredTimerInfo.getExpiryTimeInMs())
        files = self.due.getValue((now,))
        for file in map(tuple, json.loads(files[0]) if files else []):
            known = self._known(file)
            if known is None:
                continue
            state, waiting, seen, since = known
            if self.forget is not None and seen + self.forget <= now:
                self.files.removeKey(file)
            elif waiting and since + self.patience <= now:
                self._keep(file, *settle(state, waiting, self.threshold, all_of_it=True), seen, since)
        if files:
            self.due.removeKey((now,))
        yield from ()

    def close(self) -> None:
        pass


def debounced(observed: DataFrame, threshold: int = THRESHOLD, *, first: int | None = None, patience_ms: int = PATIENCE_MS, forget_ms: int | None = None, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """The latest state of each file seen in a batch, from a stream of (repo_id, file_path, seq, raw), and maybe at.

    Of repeated runs the one that came first counts; rows of times more than ``delay`` before the latest ones are left out.
    The session's state store is set to RocksDB, which this needs.
    """
    ship(observed.sparkSession)
    observed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    time = F.col("at") if "at" in observed.columns else F.current_timestamp()
    rows = observed.withColumn("at", time).withWatermark("at", delay)
    rows = rows.select("repo_id", "file_path", F.col("seq").cast("long").alias("seq"), F.col("raw").cast("long").alias("raw"), "at", F.unix_millis("at").alias("ms"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("repo_id", "file_path"), F.lit(buckets)))
    processor = Debounce(threshold, first, patience_ms, forget_ms)
    return rows.groupBy("bucket").transformWithStateInPandas(processor, OUTPUT, "update", "eventTime")
