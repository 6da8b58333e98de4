"""Early stopping while a run's epochs arrive, in any order."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import ship

OUTPUT = "run_id string, epoch int, best_score double, best_epoch int, stale int, stopped boolean"
#: Buckets of runs: each is one value of the state.
BUCKETS = 1024


def advance(state: tuple, epoch: int, score: float | None, patience: int, min_delta: float) -> tuple:
    """(best, best_epoch, stale, stop) after an epoch; a stopped run stays as it is."""
    best, at, stale, stop = state
    if stop is not None:
        return state
    if score is not None and score == score and score > best + min_delta:
        return score, epoch, 0, None
    stale += 1
    return best, at, stale, epoch if patience > 0 and stale >= patience else None


def _released(held: tuple, came: dict[int, tuple], now: int, patience: int, min_delta: float, wait: int | None) -> tuple:
    """A run (its fold, the next epoch it waits for, epochs that came early with the time they came, the end of the wait) after more of its epochs."""
    state, due, early, _ = held
    waiting = early | {e: v for e, v in came.items() if e >= due and e not in early}
    order, oldest, deadline, done = sorted(waiting), None, None, 0
    for epoch in order:
        if epoch > due:
            if wait is None:
                break
            if oldest is None:  # of all that wait from here on
                oldest = list(accumulate((waiting[e][1] for e in order[::-1]), min))[::-1]
            if oldest[done] + wait > now:
                deadline = oldest[done] + wait
                break  # else what is missing has had its time
        state = advance(state, epoch, waiting[epoch][0], patience, min_delta)
        due, done = epoch + 1, done + 1
    return state, due, {e: waiting[e] for e in order[done:]}, deadline


def _stopping(patience: int, min_delta: float, wait: int | None):
    """What a batch does to a bucket of runs: its state is read and written once, and its timer is the first of its runs' deadlines."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = pickle.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentWatermarkMs() if wait is not None else 0
        came = {}
        for frame in frames:
            for run, epoch, score, at in zip(frame.run_id.tolist(), frame.epoch.tolist(), frame.safety_score.tolist(), frame.came.tolist(), strict=True):
                came.setdefault(str(run), {}).setdefault(int(epoch), (score, at))
        moved = came.keys() | {run for run, held in runs.items() if held[3] is not None and held[3] <= now}
        for run in moved:
            runs[run] = _released(runs.get(run, ((-1.0, None, 0, None), 1, {}, None)), came.get(run, {}), now, patience, min_delta, wait)
        state.update((pickle.dumps(runs),))
        ends = [held[3] for held in runs.values() if held[3] is not None]
        if ends:
            state.setTimeoutTimestamp(min(ends))
        if moved:
            rows = [(run, due - 1, best if at is not None else None, at, stale, stop is not None) for run in moved for (best, at, stale, stop), due, _, _ in [runs[run]]]
            yield pd.DataFrame(rows, columns=["run_id", "epoch", "best_score", "best_epoch", "stale", "stopped"]).astype({"best_score": "Float64", "best_epoch": "Int32"})

    return step


def stopping_stream(history: DataFrame, patience: int, min_delta: float = 0.0, time_col: str | None = None, delay: str = "0 seconds", wait: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The state of each run after each batch of ``run_id, epoch, safety_score``.

    Epochs count from 1; one that comes early waits in the state until those before it have come, repeats are ignored. With ``wait`` (seconds of event time, by
    ``time_col`` and a watermark of ``delay``) it waits no longer than that: a timer then releases the run, and epochs that are missing are passed over as if the
    run had never had them. Without, a missing epoch holds its run for good. Rows later than the watermark do not count. Runs are dealt to ``buckets``
    (not to be changed over a checkpoint), whose states move with their rows, one value a batch however many runs and epochs wait. The RocksDB state store keeps them off the heap.
    """
    ship(history.sparkSession)
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket")
    if wait is None:
        rows = history.select(bucket, "run_id", "epoch", "safety_score", F.lit(0).cast("bigint").alias("came"))
        return rows.groupBy("bucket").applyInPandasWithState(_stopping(patience, min_delta, None), OUTPUT, "runs binary", "update", GroupStateTimeout.NoTimeout)
    if time_col is None:
        raise ValueError("a wait needs the column of event time")
    rows = history.withWatermark(time_col, delay).select(bucket, "run_id", "epoch", "safety_score", F.unix_millis(time_col).alias("came"), time_col)
    return rows.groupBy("bucket").applyInPandasWithState(_stopping(patience, min_delta, 1000 * wait), OUTPUT, "runs binary", "update", GroupStateTimeout.EventTimeTimeout)
