"""Keyed state: the same pure transition functions drive streaming state and batch replays of event logs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("complete", "error")
#: Leases last this long after they are taken or renewed; failed states are kept so long; most attempts.
LEASE_S, FAILED_TTL_S, MOST_ATTEMPTS = 90.0, 86_400.0, 5


def lease_step(state: dict, event: dict) -> tuple[dict, str]:
    """State after an event (op, token, t) and its outcome.

    acquire: granted unless another token's lease runs, a ready state stands, a failed one waits for its retry, or attempts are used up.
    renew, release, ready, fail: only by the token that holds a running lease.
    """
    s, op, token, t = dict(state), event["op"], event["token"], float(event["t"])
    if s.get("status") == "failed" and t - s["failed_at"] > FAILED_TTL_S:
        s = {}
    held = s.get("token") and t < s.get("expires", 0.0)
    if op == "acquire":
        if held:
            return s, "busy"
        if s.get("status") == "ready":
            return s, "hit"
        if s.get("status") == "failed" and s.get("attempt", 0) >= MOST_ATTEMPTS:
            return s, "held"
        if s.get("status") == "failed" and t < s["retry_after"]:
            return s, "waiting"
        took_over = s.get("status") == "processing"
        s |= {"status": "processing", "token": token, "expires": t + LEASE_S, "attempt": s.get("attempt", 0) + 1}
        return s, "takeover" if took_over else "granted"
    if not held or s["token"] != token:
        return s, "not_owner"
    if op == "renew":
        s["expires"] = t + LEASE_S
        return s, "renewed"
    s |= {"token": None, "expires": 0.0}
    if op == "ready":
        s |= {"status": "ready", "attempt": 0}
        return s, "ready"
    if op == "fail":
        delay = min(600.0, 30.0 * 2 ** (s["attempt"] - 1))
        s |= {"status": "failed", "failed_at": t, "retry_after": t + delay}
        return s, "failed"
    s["status"] = s.get("status") if s.get("status") == "ready" else "missing"
    return s, "released"


def replay_leases(events: DataFrame, key: str = "key", op: str = "op", token: str = "token", time: str = "t") -> DataFrame:
    """(key, t, op, token, outcome, status) of every event of a log, in order of time and op within each key.

    Events are sorted by key and time where Spark can spill them, and pass by in batches: a task holds one batch and the
    running key's state, never a key's whole log.
    """
    rows = events.select(F.col(key).alias("key"), F.col(op).alias("op"), F.col(token).alias("token"), F.col(time).cast("double").alias("t"))
    kind = rows.schema["key"].dataType.simpleString()
    by_key = rows.repartition("key").sortWithinPartitions("key", "t", "op", "token")
    schema = f"key {kind}, t double, op string, token string, outcome string, status string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), {}
        for batch in batches:  # keys follow each other, so only the running key's state is held
            columns = [batch.column(k).to_pylist() for k in range(4)]
            outcomes, statuses = [], []
            for k, o, token_, t in zip(*columns):
                if k != current:
                    current, state = k, {}
                state, outcome = lease_step(state, {"op": o, "token": token_, "t": t})
                outcomes.append(outcome)
                statuses.append(state.get("status", "missing"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(1), batch.column(2), pa.array(outcomes, pa.string()), pa.array(statuses, pa.string())], ["key", "t", "op", "token", "outcome", "status"])

    return by_key.mapInArrow(fold, schema)


def progress_step(highest: float, values: Iterable[float]) -> tuple[float, list[float]]:
    """The highest value so far, and those values that exceed all before them."""
    out = []
    for v in values:
        if v > highest:
            highest = v
            out.append(v)
    return highest, out


def monotone(stream: DataFrame, key: str, value: str, ttl: str = "1 hour", order: str = "ts") -> DataFrame:
    """A stream's (key, value) events that exceed every earlier value of their key.

    Keys are forgotten when the watermark (as late as `ttl`) passes their last event by `ttl`. Event time decides, so
    that a run over what is available ends and replays agree.
    """
    keep_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        highest = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(order)
        highest, out = progress_step(highest, rows[value].astype(float).tolist())
        state.update((highest,))
        last_ms = int(rows[order].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame({key: [k[0]] * len(out), value: out})

    kind = stream.schema[key].dataType.simpleString()
    timed = stream.withWatermark(order, ttl)
    return timed.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {value} double", "highest double", "append", GroupStateTimeout.EventTimeTimeout)


def running_ema(stream: DataFrame, key: str, value: str, order: str = "ts", start: float = 600.0, alpha: float = 0.3) -> DataFrame:
    """(key, ema) after each batch of a stream: start, then (1 - alpha) * old + alpha * value in order."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema = state.get[0] if state.exists else start
        for v in pd.concat(list(batches)).sort_values(order)[value].astype(float):
            ema = (1 - alpha) * ema + alpha * v
        state.update((ema,))
        yield pd.DataFrame({key: [k[0]], "ema": [ema]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, ema double", "ema double", "update", GroupStateTimeout.NoTimeout)


def merged_events(events: DataFrame, key: str, order: str, progress: str, step: str, nudge: float = 0.008, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """(key, order, step, progress) of what a listener is shown of several sources' events, in order.

    Values at or below the highest so far are stale and dropped, but a new step is always shown, nudged above the one
    before; nothing follows a terminal step.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col(step).isin(*terminal)).over(before), F.lit(False))
    highest, last = F.max(progress).over(before), F.lag(step).over(w)
    rows = events.select(key, order, step, progress, ended.alias("_ended"), highest.alias("_high"), last.alias("_last")).where(~F.col("_ended"))
    new = F.col("_last").isNull() | (F.col("_last") != F.col(step))
    rising = F.col("_high").isNull() | (F.col(progress) > F.col("_high"))
    shown = F.when(rising | F.col(step).isin(*terminal), F.col(progress)).otherwise(F.least(F.lit(1.0), F.col("_high") + nudge))
    return rows.where(rising | new | F.col(step).isin(*terminal)).select(key, order, step, shown.alias(progress))


def in_band(share, low: float, high: float):
    """A source's own progress (0 to 1) as a place in its band of the whole."""
    return F.lit(low) + (high - low) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
