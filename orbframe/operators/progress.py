"""Progress events of jobs: dispatch, rates, throttling, outcomes."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbframe.operators import order as order_
from orbframe.operators import ranges
from orbframe.session import cut

LEVELS = ("info", "warning", "error")
INTERVAL = 0.1

EVENT = (
    "type string, message string, frame bigint, total bigint, elapsed double, fps double, eta double, "
    "output string, frames bigint, cancelled boolean"
)


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """One JSON object per line to typed columns plus the raw fields as VARIANT.

    A line that is not JSON is kept as an info message, blank lines go.
    """
    text = F.trim(value)
    raw = F.try_parse_json(text)
    ok = raw.isNotNull()
    typed = F.when(ok, F.from_json(text, EVENT))
    plain = F.struct(*[
        (F.lit("info") if n == "type" else text if n == "message" else F.lit(None)).cast(t).alias(n)
        for n, t in (f.split(" ") for f in EVENT.split(", "))
    ])
    rest = [c for c in lines.columns if c != value]
    return lines.filter(text != "").select(*rest, F.coalesce(typed, plain).alias("e"), raw.alias("extra")).select(*rest, "e.*", "extra")


def dispatch(events: DataFrame) -> DataFrame:
    """Progress messages with their defaults: zeros, and -1 for an unknown end."""
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    rest = [c for c in events.columns if c not in ("frame", "total", "elapsed", "fps", "eta", "type", "message", "extra", "output", "frames", "cancelled")]
    return events.filter(F.col("type") == "progress").select(
        *rest, zero("frame", "bigint"), zero("total", "bigint"), zero("elapsed", "double"), zero("fps", "double"),
        F.coalesce("eta", F.lit(-1.0)).alias("eta"),
    )


def job_sessions(events: DataFrame, bucket: Column, key: str = "job", order: list[str] = ["ts"], is_start: str = "is_start") -> DataFrame:
    """Adds ``session``: how many starts a job has seen so far."""
    df = events.withColumn("_one", F.col(is_start).cast("int"))
    return ranges.running_total(df, [key], order, bucket, "_one", "session").drop("_one")


def rates(events: DataFrame, bucket: Column, key: list[str], order: list[str], step: str = "n", total: str = "total") -> DataFrame:
    """Running count, elapsed seconds, rate and time left per event.

    ``ts`` is in seconds. Counts run bucket by bucket, so one long job does
    not sit in one task.
    """
    first = events.groupBy(*key).agg(F.min("ts").alias("_t0"))
    run = ranges.running_total(events, key, order, bucket, step, "frame").join(first, key)
    elapsed = F.col("ts") - F.col("_t0")
    rate = F.when(elapsed > 0, F.col("frame") / elapsed).otherwise(F.lit(0.0))
    eta = F.when((F.col(total) > 0) & (rate > 0), (F.col(total) - F.col("frame")) / rate)
    return run.withColumns({
        "elapsed": F.bround(elapsed, 3), "fps": F.bround(rate, 3), "eta": F.bround(eta, 1),
    }).drop("_t0")


def due(ts, last: float | None, interval: float) -> bool:
    """Whether an event is far enough from the last one that was let through."""
    return last is None or ts - last >= interval


def throttle(df: DataFrame, bucket: Column | None, key: list[str], order: list[str], interval: float = INTERVAL, size: int = order_.BUCKET) -> DataFrame:
    """Keep a job's first event, its last (``frame = total``), and others only
    when ``interval`` seconds passed since the last one kept.

    Every event points to the one that is kept next if it is kept. Rows are put into
    buckets of ``size``, in order, whatever job they belong to; inside a bucket the
    pointers are followed by doubling. What a bucket makes of the time of the last event
    kept before it is a step function. Neighbouring buckets of a job are combined pair by
    pair, then pairs of pairs, and on the way back each bucket learns the time it starts
    with. So a job of any length and density runs on all cores. ``bucket`` isn't needed any more.
    """
    rows = order_.indexed(df, [*key, *order]).withColumn("_b", order_.bucket(size))
    cols = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key)
    steps = rows.groupBy("_b").applyInPandas(lambda pdf: _steps(pdf, key, interval), f"{cols}, _b long, due array<double>, leaves array<double>")
    seq = F.row_number().over(Window.partitionBy(*key).orderBy("_b")) - 1
    starts = _starts(cut(steps.withColumn("_seq", seq)), key, interval)
    columns = df.columns
    kept = lambda left, right: _kept(left, right, key, interval)[columns]
    return rows.groupBy("_b").cogroup(starts.withColumnRenamed("_b", "_of").groupBy("_of")).applyInPandas(kept, df.schema)


def _jobs(pdf: pd.DataFrame, key: list[str]):
    """Rows from, to and the name of each job in a sorted bucket."""
    job = pdf.groupby(key, dropna=False, sort=False).ngroup().to_numpy()
    edges = np.r_[0, np.flatnonzero(np.diff(job)) + 1, len(pdf)].tolist()
    names = pdf[key].astype(object).where(pdf[key].notna(), None)
    return [(a, b, tuple(names.iloc[a])) for a, b in zip(edges, edges[1:])]


def _first_due(ts, last, interval):
    """The first of the sorted ``ts`` that is ``interval`` after each ``last``; the rule is on the rounded difference."""
    last = np.asarray(last, float)
    at = np.searchsorted(ts, last + interval, "left")
    before = ts[np.maximum(at - 1, 0)]
    at = np.where((at > 0) & (before - last >= interval), np.searchsorted(ts, before, "left"), at)
    here = ts[np.minimum(at, len(ts) - 1)]
    return np.where((at < len(ts)) & (here - last < interval), np.searchsorted(ts, here, "right"), at)


def _pointers(ts, forced, interval):
    """The place of the event that is kept next after each one; the length, if there is none."""
    n = len(ts)
    due_at = np.maximum(_first_due(ts, ts, interval), np.arange(n) + 1)
    following = np.minimum.accumulate(np.where(forced, np.arange(n), n)[::-1])[::-1]
    return np.minimum(due_at, np.r_[following, n][1:])


def _steps(pdf: pd.DataFrame, key: list[str], interval: float) -> pd.DataFrame:
    """For each job of a bucket: from the last event kept before it (the first step that is due)
    to the time of the last one kept in it (``leaves``; NaN if there is none)."""
    pdf = pdf.sort_values("_at", ignore_index=True)
    out = []
    for a, b, name in _jobs(pdf, key):
        ts = pdf["ts"].to_numpy(float)[a:b]
        forced = (pdf["frame"] == pdf["total"]).to_numpy()[a:b]
        n = len(ts)
        hop = np.r_[_pointers(ts, forced, interval), n]
        last = np.where(hop < n, hop, np.arange(n + 1))
        while (hop[:n] < n).any():  # all chains at once, twice as far each time
            last, hop = last[last], hop[hop]
        # a chain comes in at the first event that is due, at a forced one at the latest
        stop = int(np.argmax(np.r_[forced, True]))
        due_at = np.r_[ts[:stop], np.inf]
        leaves = np.r_[ts, np.nan][last[: stop + 1]]
        change = np.r_[leaves[1:] != leaves[:-1], True]
        out.append((*name, int(pdf["_b"].iloc[0]), due_at[change], leaves[change]))
    return pd.DataFrame(out, columns=[*key, "_b", "due", "leaves"])


def _starts(steps: DataFrame, key: list[str], interval: float) -> DataFrame:
    """``start`` for each job and bucket: the time of the last event kept before it."""
    names, kind = steps.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in steps.schema)
    levels, most = [steps], steps.agg(F.max("_seq")).first()[0] or 0
    while most > 0:  # up: two neighbours become one
        pairs = levels[-1].groupBy(*key, F.shiftright("_seq", 1).alias("_pair"))
        levels.append(cut(pairs.applyInPandas(lambda pdf: _combined(pdf, interval)[names], kind)))
        most >>= 1
    known = levels[-1].select(*key, "_seq", F.lit(float("-inf")).alias("start"))
    pair = F.shiftright("_seq", 1).alias("_pair")
    first = F.get(F.filter(F.arrays_zip("due", "leaves"), lambda s: s["due"] - F.col("start") >= interval), F.lit(0))["leaves"]
    for level in levels[-2::-1]:  # down: the left one starts as the pair does, the right one behind the left one
        left = level.where("_seq % 2 = 0").select(*key, pair, "due", "leaves")
        both = level.select(*key, "_seq", pair).join(known.withColumnRenamed("_seq", "_pair"), [*key, "_pair"]).join(left, [*key, "_pair"])
        behind = F.when(first.isNull() | F.isnan(first), F.col("start")).otherwise(first)
        known = cut(both.select(*key, "_seq", F.when(F.col("_seq") % 2 == 0, F.col("start")).otherwise(behind).alias("start")))
    return steps.select(*key, "_seq", "_b").join(known, [*key, "_seq"])


def _combined(pdf: pd.DataFrame, interval: float) -> pd.DataFrame:
    """The step function of two neighbouring buckets."""
    pdf = pdf.sort_values("_seq", ignore_index=True)
    due_at, leaves = (np.asarray(pdf[c][0], float) for c in ("due", "leaves"))
    if len(pdf) == 2:
        right_due, right_leaves = (np.asarray(pdf[c][1], float) for c in ("due", "leaves"))
        to = right_leaves[np.minimum(_first_due(right_due, leaves, interval), len(right_due) - 1)]
        to = np.where(np.isnan(to), leaves, to)
        if np.isnan(leaves[-1]):  # what the left one lets pass meets the steps of the right one
            due_at, to = np.r_[due_at[:-1], right_due], np.r_[to[:-1], right_leaves]
        change = np.r_[to[1:] != to[:-1], True]
        due_at, leaves = due_at[change], to[change]
    made = pdf.iloc[:1].copy()
    made["_seq"] //= 2
    made["due"], made["leaves"] = [due_at], [leaves]
    return made


def _kept(pdf: pd.DataFrame, starts: pd.DataFrame, key: list[str], interval: float) -> pd.DataFrame:
    """The events of a bucket that are kept, from where each job's chain comes in."""
    pdf = pdf.sort_values("_at", ignore_index=True)
    start_of = {name: starts["start"].iloc[a] for a, _, name in _jobs(starts, key)}
    keep = np.zeros(len(pdf), bool)
    for a, b, name in _jobs(pdf, key):
        ts = pdf["ts"].to_numpy(float)[a:b]
        forced = (pdf["frame"] == pdf["total"]).to_numpy()[a:b]
        hop = np.r_[_pointers(ts, forced, interval), b - a]
        on = np.zeros(b - a + 1, bool)
        on[np.argmax(np.r_[(ts - start_of[name] >= interval) | forced, True])] = True
        while (hop[:-1] < b - a).any():  # what is reached in 1, 2, 4 .. hops
            on[hop[on]] = True
            hop = hop[hop]
        keep[a:b] = on[:-1]
    return pdf[keep]


def outcome(events: DataFrame, key: list[str] = ["job"]) -> DataFrame:
    """Last word per job: frames, elapsed, cancelled, failed.

    Values the job reported itself win over the counted ones.
    """
    last = lambda c, t: F.max_by(c, F.when(F.col("type") == t, F.col("ts")))
    return events.groupBy(*key).agg(
        F.coalesce(last("frames", "done"), F.max("frame")).alias("frames"),
        F.coalesce(F.max_by("elapsed", F.when((F.col("type") == "done") & F.col("elapsed").isNotNull(), F.col("ts"))), F.max("ts") - F.min("ts")).alias("elapsed"),
        F.coalesce(F.bool_or(F.col("cancelled")), F.lit(False)).alias("cancelled"),
        F.coalesce(F.bool_or(F.col("type") == "error"), F.lit(False)).alias("failed"),
    )


def message_log(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type").isin(*LEVELS))


def latest_status(progress: DataFrame, key: list[str] = ["job"]) -> DataFrame:
    """Latest state and finished share per job; one aggregate, no sort."""
    s = progress.groupBy(*key).agg(F.max_by(F.struct("frame", "total", "elapsed", "fps", "eta"), F.struct("ts", "frame")).alias("s"))
    done = F.when(F.col("s.total") > 0, F.least(F.lit(1.0), F.col("s.frame") / F.col("s.total"))).otherwise(F.lit(0.0))
    return s.select(*key, "s.*", done.alias("fraction"))
