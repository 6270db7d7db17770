"""Event logic, in batch over event time and as streams with state.

Batch forms are plain window functions and replayable; stream forms share their
rules and add watermarks or timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def debounced(events: DataFrame, by: list[str], ts: str, value: str, quiet_seconds: float = 2.0) -> DataFrame:
    """One row per burst: events closer than the quiet time; the last value, first and last time, size."""
    w = Window.partitionBy(*by).orderBy(ts, value)
    gap = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts))
    new = F.coalesce(gap > int(quiet_seconds * 1e6), F.lit(True)).cast("int")
    rows = events.withColumn("__burst", F.sum(new).over(w))
    return rows.groupBy(*by, "__burst").agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.max_by(value, F.struct(ts, value)).alias("last_value"), F.count(F.lit(1)).alias("n_events")).drop("__burst")


def debounced_stream(events: DataFrame, by: list[str], ts: str, value: str, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """The same on a stream: a session per burst, emitted once when the watermark passes its end."""
    w = F.session_window(ts, quiet)
    return events.withWatermark(ts, late).groupBy(*by, w).agg(F.max_by(value, F.struct(ts, value)).alias("last_value"), F.count(F.lit(1)).alias("n_events"))


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """First of equal requests: on a stream within the watermark, in batch over all."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min(F.struct(ts, *(c for c in rest if c != ts))).alias("x")).select(*keys, "x.*")


def cursor_numbers(cursor: Column) -> Column:
    return F.transform(F.regexp_extract_all(cursor, F.lit(r"(\d+)")), lambda x: x.cast("long"))


def cursor_labels(cursor: Column) -> Column:
    return F.regexp_extract_all(cursor, F.lit(r"([^\d]+)"))


def progressed(events: DataFrame, task: str = "task_id", order: str = "seq") -> DataFrame:
    """Adds is_progress: phase changed, a counter grew, or the cursor moved on under equal labels.

    events: phase, completed, cursor, bytes_read, output_blocks, checkpoint_version.
    After an event without any of them, any of them is progress.
    """
    w = Window.partitionBy(task).orderBy(order)
    text, counts = ["phase", "cursor"], ["completed", "bytes_read", "output_blocks", "checkpoint_version"]
    now = {c: F.coalesce(c, F.lit("")) for c in text} | {c: F.coalesce(c, F.lit(0)) for c in counts}
    before = {c: F.coalesce(F.lag(c).over(w), F.lit("")) for c in text} | {c: F.coalesce(F.lag(c).over(w), F.lit(0)) for c in counts}
    any_of = lambda x: (x["phase"] != "") | (x["cursor"] != "") | (x["completed"] != 0) | (x["bytes_read"] != 0) | (x["output_blocks"] != 0) | (x["checkpoint_version"] != 0)
    grew = (now["phase"] != "") & (now["phase"] != before["phase"])
    for c in counts:
        grew = grew | (now[c] > before[c])
    a, b = before["cursor"], now["cursor"]
    both = (F.size(cursor_numbers(a)) > 0) & (F.size(cursor_numbers(b)) > 0) & (cursor_labels(a) == cursor_labels(b)) & (cursor_numbers(b) > cursor_numbers(a))
    moved = (b != "") & (b != a) & ((a == "") | both)
    return events.withColumn("is_progress", F.when(any_of(before), grew | moved).otherwise(any_of(now)))


def progress_signature() -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit(d)) for c, d in (("phase", ""), ("cursor", ""), ("completed", "0"), ("bytes_read", "0"), ("output_blocks", "0"), ("checkpoint_version", "0"))))


def stalled(events: DataFrame, timeout: Column, task: str = "task_id", ts: str = "at_seconds") -> DataFrame:
    """Per task: how long it stood still at most, paused time left out, and whether beyond `timeout`.

    events need is_progress and paused (boolean: the time up to the next event is).
    """
    w = Window.partitionBy(task).orderBy(ts)
    step = F.coalesce(F.lead(ts).over(w) - F.col(ts), F.lit(0.0))
    rows = events.withColumn("__still", F.when(F.coalesce("paused", F.lit(False)), 0.0).otherwise(step)).withColumn("__run", F.sum(F.col("is_progress").cast("int")).over(w))
    runs = rows.groupBy(task, "__run").agg(F.sum("__still").alias("still"), F.max(timeout).alias("timeout"))
    return runs.groupBy(task).agg(F.max("still").alias("longest_still"), F.bool_or(F.col("still") > F.col("timeout")).alias("stalled"))


def median(values: Column) -> Column:
    """Median of an array, null if it is empty (windows with an order take no median)."""
    x, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2.0)


def blended_rates(samples: DataFrame, default_rate: Column, lane: str = "lane", order: str = "seq") -> DataFrame:
    """rate after each sample (completed_cost, service_seconds): prior and observation blended.

    Observed: 0.45 median of the last 21 rates, 0.35 exponential average (weight
    0.25), 0.20 total ratio; it weighs n / 8, 0.8 at most.
    """
    w = Window.partitionBy(lane).orderBy(order)
    rate = F.col("service_seconds") / F.greatest(F.lit(0.001), F.col("completed_cost"))
    rows = samples.withColumn("__rate", rate)
    recent = median(F.collect_list("__rate").over(w.rowsBetween(-20, 0)))
    total = F.sum("service_seconds").over(w) / F.greatest(F.lit(0.001), F.sum("completed_cost").over(w))
    # An exponential average forgets: beyond 200 samples a weight is below 1e-24.
    last = F.collect_list("__rate").over(w.rowsBetween(-199, 0))
    ewma = F.aggregate(F.slice(last, 2, 200), F.element_at(last, 1), lambda a, x: a * 0.75 + x * 0.25)
    weight = F.least(F.lit(0.80), F.count(F.lit(1)).over(w) / 8.0)
    rows = rows.withColumns({"recent": recent, "ewma": ewma, "total": total, "weight": weight})
    observed = F.col("recent") * 0.45 + F.col("ewma") * 0.35 + F.col("total") * 0.20
    return rows.withColumn("rate", default_rate * (1 - F.col("weight")) + observed * F.col("weight")).drop("__rate")


def critical_path(remaining: DataFrame) -> DataFrame:
    """seconds per `at`: the slowest lane of remaining (at, lane, cost, rate, workers)."""
    return remaining.where("cost > 0").groupBy("at").agg(F.max(F.col("cost") * F.col("rate") / F.greatest(F.lit(1), F.col("workers"))).alias("seconds"))


def displayed(estimates: DataFrame, key: str, order: str = "at", every: float = 10.0, step: float = 0.20) -> DataFrame:
    """What a display shows: an update every `every` seconds, a step of max(5 s, 20 %), frozen while paused."""
    schema = f"{key} string, {order} double, shown long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shown, at, out = None, 0.0, []
        for t, seconds, paused, reset in pdf.sort_values(order)[[order, "seconds", "paused", "reset"]].itertuples(index=False):
            raw = max(1, -int(-seconds // 1))
            if shown is None or reset:
                shown, at = raw, t
            elif not paused and t - at >= every:
                most = max(5, int(shown * step))
                shown, at = shown + max(-most, min(most, raw - shown)), t
            out.append((str(pdf[key].iloc[0]), float(t), shown))
        return pd.DataFrame(out, columns=[key, order, "shown"])

    return estimates.groupBy(key).applyInPandas(run, schema)


def eta_errors(points: DataFrame, key: str) -> DataFrame:
    """Quality of shown estimates (at, shown, actual): median error, of the last ten minutes, jumps."""
    w = Window.partitionBy(key).orderBy("at")
    jump, before = F.col("shown") - F.lag("shown").over(w), F.lag("shown").over(w)
    error = F.when(F.col("actual") > 0, F.abs(F.col("shown") - F.col("actual")) / F.col("actual")).otherwise(0.0)
    rows = points.withColumns({"jump": jump, "before": before, "error": error})
    large = F.abs("jump") > F.greatest(F.lit(30), F.floor(F.col("before") * 0.25))
    return rows.groupBy(key).agg(
        F.median("error").alias("median_error"),
        F.median(F.when(F.col("actual") <= 600, F.col("error"))).alias("final_error"),
        F.count_if(large).alias("jumps"),
        F.greatest(F.lit(0), F.max("jump")).alias("largest_up"),
        F.abs(F.least(F.lit(0), F.min("jump"))).alias("largest_down"),
    )


def overlap_seconds(spans: DataFrame, pauses: DataFrame, key: str) -> DataFrame:
    """Seconds of each span (key, start, end) that pauses (key, start, end) cover; where pauses overlap, each counts.

    One ordered pass over a key's boundaries, in whole microseconds: the time
    paused before t is the ends so far less the starts so far, and t for each
    pause that still runs. A span takes what came between its two ends.
    """
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    zero = F.lit(0).cast("long")
    s, e = us("start"), us("end")
    rows = spans.select(F.col(key), "start", "end").distinct()
    kept = pauses.where("start < end")
    edges = [
        kept.select(key, s.alias("__t"), (-s).alias("__sum"), F.lit(1).cast("long").alias("__n"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), zero.alias("__sign")),
        kept.select(key, e.alias("__t"), e.alias("__sum"), F.lit(-1).cast("long").alias("__n"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), zero.alias("__sign")),
        rows.select(key, s.alias("__t"), zero.alias("__sum"), zero.alias("__n"), F.col("start").cast("double"), F.col("end").cast("double"), (zero - 1).alias("__sign")),
        rows.select(key, e.alias("__t"), zero.alias("__sum"), zero.alias("__n"), F.col("start").cast("double"), F.col("end").cast("double"), (zero + 1).alias("__sign")),
    ]
    w = Window.partitionBy(key).orderBy("__t")
    paused = F.sum("__sum").over(w) + F.sum("__n").over(w) * F.col("__t")
    at = reduce(DataFrame.unionByName, edges).withColumn("__paused", paused * F.col("__sign")).where("__sign <> 0")
    return at.groupBy(key, "start", "end").agg((F.greatest(F.lit(0), F.sum("__paused")) / 1e6).alias("paused_seconds"))


def safely_paused(states: DataFrame) -> DataFrame:
    """Whether each run may count as paused: nothing active, writer idle, all acknowledgements in."""
    missing = F.size(F.array_except("required", "received"))
    return states.select("run_id", ((F.col("active") == 0) & F.col("writer_idle") & (F.col("owned_processes") == 0) & (missing == 0)).alias("safely_paused"), missing.alias("n_missing"))


# Pressure limits of the controller.
MEMORY, CPU, DISK, LATENCY_MS, FAILURES = 0.90, 90.0, 90.0, 250.0, 0.05
LEAST_FREE, SPARE_FREE = 512 << 20, 1 << 30


def pressure(budget: int) -> Column:
    """What a resource sample alone says."""
    share = F.col("app_rss_bytes") / max(1, budget)
    spare = (F.col("total_cpu_percent") < 55) & (F.col("app_cpu_percent") < 55) & (share < 0.70) & (F.col("memory_available_bytes") >= SPARE_FREE) & (F.col("disk_busy_percent") < 70) & (F.col("writer_queue_depth") <= 1) & (F.col("queue_depth") > F.col("active_tasks"))
    return (
        F.when((share >= MEMORY) | (F.col("memory_available_bytes") < LEAST_FREE), "memory_pressure")
        .when((F.col("total_cpu_percent") >= CPU) | (F.col("app_cpu_percent") >= CPU), "cpu_pressure")
        .when((F.col("disk_busy_percent") >= DISK) | (F.col("network_read_latency_ms") >= LATENCY_MS), "io_pressure")
        .when(F.col("worker_failure_rate") > FAILURES, "recovery_cooldown")
        .when(spare, "underutilized")
        .otherwise("stable")
    )


class Hysteresis:
    """State that follows a candidate after `samples` in a row and `dwell` seconds in the old one."""

    def __init__(self, samples: int = 3, dwell: float = 30.0, saved: tuple | None = None):
        self.samples, self.dwell = samples, dwell
        self.state, self.since, self.candidate, self.count = saved or ("stable", None, "stable", 0)

    def observe(self, at: float, candidate: str, paused: bool = False) -> bool:
        """Whether the state changed."""
        self.since = at if self.since is None else self.since
        if paused:
            return False
        if candidate == self.state:
            self.candidate, self.count = candidate, 0
            return False
        self.count = self.count + 1 if candidate == self.candidate else 1
        self.candidate = candidate
        if self.count < self.samples or at - self.since < self.dwell:
            return False
        self.state, self.since, self.count = candidate, at, 0
        return True

    def saved(self) -> tuple:
        return self.state, self.since, self.candidate, self.count


def controlled(samples: DataFrame, key: str, samples_needed: int = 3, dwell: float = 30.0) -> DataFrame:
    """state and changed after each sample (key, at, candidate, paused), in order of time."""
    schema = f"{key} {dict(samples.dtypes)[key]}, at double, candidate string, state string, changed boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, out = Hysteresis(samples_needed, dwell), []
        for at, candidate, paused in pdf.sort_values("at")[["at", "candidate", "paused"]].itertuples(index=False):
            changed = h.observe(float(at), candidate, bool(paused))
            out.append((pdf[key].iloc[0], float(at), candidate, h.state, changed))
        return pd.DataFrame(out, columns=[key, "at", "candidate", "state", "changed"])

    return samples.groupBy(key).applyInPandas(run, schema)


def controlled_stream(samples: DataFrame, key: str, samples_needed: int = 3, dwell: float = 30.0) -> DataFrame:
    """The same on a stream; the controller's state is kept in the state store."""
    kind = dict(samples.dtypes)[key]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        h = Hysteresis(samples_needed, dwell, (state.get[0], state.get[1], state.get[2], state.get[3]) if state.exists else None)
        out = []
        for at, candidate, paused in pd.concat(list(parts)).sort_values("at")[["at", "candidate", "paused"]].itertuples(index=False):
            out.append((k[0], float(at), candidate, "", h.observe(float(at), candidate, bool(paused))))
            out[-1] = (*out[-1][:3], h.state, out[-1][4])
        state.update(h.saved())
        yield pd.DataFrame(out, columns=[key, "at", "candidate", "state", "changed"])

    return samples.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at double, candidate string, state string, changed boolean", "state string, since double, candidate string, count int", "append", "NoTimeout")


def watchdog_stream(events: DataFrame, timeout_ms: int, task: str = "task_id") -> DataFrame:
    """Tasks of a stream whose signature hasn't changed for timeout_ms of processing time, once each."""
    kind = dict(events.dtypes)[task]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(k[0], last)], columns=[task, "stalled_at"])
            return
        last = state.get[0] if state.exists else None
        new = [s for part in parts for s in part["signature"] if s != last]
        if new or not state.exists:
            state.update((new[-1] if new else last,))
            state.setTimeoutDuration(timeout_ms)

    return events.groupBy(task).applyInPandasWithState(run, f"{task} {kind}, stalled_at string", "signature string", "append", "ProcessingTimeTimeout")
