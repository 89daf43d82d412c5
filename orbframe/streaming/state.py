"""Stateful operators on frame and progress streams.

The order is frame order within a clip and time order within a job. With ``patience`` rows
may come in any order: what is ahead of its turn waits in the state, keyed by its position,
until all before it has come or the watermark has passed its time (a timer), and gaps are
given up then. What comes after its turn is late: it goes out flagged, as a side output.
Without ``patience`` nothing waits: a batch is sorted, and what comes at or before the last
position is late.
"""

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from orbframe.operators.progress import due
from orbframe.operators.ranges import ALPHA
from orbframe.operators.temporal import CAP, CHUNK, OVERLAP, TAU, pulled
from orbframe.session import scratch_path

#: Seconds that late rows are still put out for.
DAY = 86_400
#: Rows that wait in one entry of the state, at most; and a position or time behind all others.
BLOCK, NEVER = 4096, (1 << 63) - 1
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(df: DataFrame, schema: str) -> DataFrame:
    """Run a stream over what is there now and return what it wrote.

    Output and checkpoint lie in the shared folder, so a lost executor or
    driver resumes from the last finished batch.
    """
    spark = df.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    query = df.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream, be it one file or a folder of part files.

    Part files have no order among each other, so a folder is one batch, which the
    stateful operators sort.
    """
    path = f"{sf}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if any(f"/{name}.parquet/" in f for f in table.inputFiles()):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(sf)


def clocked(df: DataFrame, ts: str, patience: int, grace: int) -> DataFrame:
    """Adds ``at_ms`` of ``ts``, and ``at_clock`` with a watermark ``patience`` seconds behind the latest ``ts``.

    The engine drops rows that are behind the watermark before an operator sees them. The
    clock runs ``grace`` seconds ahead of ``ts``, so late rows still come through and can be
    put out; rows later than ``patience`` and ``grace`` together are the engine's to drop.
    """
    clock = F.expr(f"{ts} + INTERVAL {int(grace)} SECONDS")
    return df.withColumns({"at_ms": F.unix_millis(ts), "at_clock": clock}).withWatermark("at_clock", f"{int(grace + patience)} seconds")


class _Ordered(StatefulProcessor):
    """Hands a key's rows to ``step`` in their order; ``columns`` (all but the key) come as tuples.

    ``at`` names the positions. If they ``count`` from 0, a row's turn comes when all
    before it have come; else only time brings it. Of rows with one position the first
    stays. A row without a position moves the watermark and does nothing else.
    """

    state_schema = ""
    at, at_schema = ["f"], "f bigint"
    columns: list[tuple[str, str]] = []
    output: list[str] = []
    count = True
    #: Positions that come back are late, or (False) rows of their own.
    distinct = True
    #: Below all positions.
    start: tuple = (-1,)

    def __init__(self, waits: bool):
        self.waits = waits

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        # the last position that has been passed; how many rows wait at most; the time of the last one released; the first position
        # (if they count) and the first time among those that wait
        passed = ", ".join(f"m_{c}" for c in self.at_schema.split(", "))
        self.mark = handle.getValueState("mark", f"{passed}, waiting bigint, time bigint, low bigint, due bigint")
        # rows that wait, as blocks with an array for each column: a call to the store takes far longer than a row
        self.fields = [tuple(c.split(" ")) for c in self.at_schema.split(", ")] + [*self.columns, ("at_ms", "bigint")]
        self.held = handle.getListState("held", ", ".join(f"{n} array<{t}>" for n, t in self.fields)) if self.waits else None

    def close(self):
        pass

    def step(self, key, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def finish(self, key) -> list[tuple]:
        """What is left to put out when a key has been quiet for long."""
        return []

    def quiet(self, time: int) -> int | None:
        """When ``finish`` is due, if no row comes after one of ``time``."""
        return None

    def _load(self):
        kept = self.mark.get()
        if kept is None:
            return self.start, 0, 0, NEVER, NEVER
        *passed, waiting, time, low, due = kept
        return tuple(passed), waiting, time, low, due

    def _passed(self, position, passed) -> bool:
        return position <= passed if self.distinct else position < passed

    def handleInputRows(self, key, rows, timerValues):
        passed, waiting, time, low, due = self._load()
        ready: dict[tuple, tuple] | list = []
        late = []
        names = [n for n, _ in self.columns]
        for pdf in rows:
            pdf = pdf[pdf[self.at].notna().all(axis=1)]
            if "placed_row" in pdf:
                pdf = pdf[pdf["placed_row"].astype(bool)]
            ms = pdf["at_ms"].astype("int64").tolist() if self.waits else [0] * len(pdf)
            for position, values, t in zip(pdf[self.at].itertuples(index=False, name=None), pdf[names].itertuples(index=False, name=None), ms):
                (late if self._passed(position, passed) else ready).append((position, values, t))
        ready.sort(key=lambda r: r[0])
        if self.distinct:
            first = {}
            for r in ready:
                if first.setdefault(r[0], r) is not r:
                    late.append(r)
            ready = list(first.values())
        if self.waits:
            ready, passed, waiting, low, due = self._in_turn(ready, passed, waiting, low, due)
        elif ready:
            passed = ready[-1][0]
        yield from self._out(key, ready, late, passed, waiting, time, low, due)

    def _waiting(self, passed) -> dict[tuple, tuple]:
        """All rows that wait, by position, in their order. Of rows with one position the first stays."""
        every = {}
        for block in self.held.get():
            for row in zip(*block):
                position = row[: len(self.at)]
                if position not in every and not self._passed(position, passed):
                    every[position] = (position, row[len(self.at) : -1], row[-1])
        return dict(sorted(every.items()))

    def _hold(self, rows: list[tuple], low, due):
        """Append rows to those that wait. One timer, for the first of them to be due, stands for all."""
        for i in range(0, len(rows), BLOCK):
            columns = zip(*((*position, *values, t) for position, values, t in rows[i : i + BLOCK]))
            self.held.appendValue(tuple([_plain(v, kind) for v in column] for (_, kind), column in zip(self.fields, columns)))
        first = min(t for _, _, t in rows)
        if first < due:
            self.handle.registerTimer(first)
        return min(low, rows[0][0][0]) if self.count else low, min(due, first)

    def _in_turn(self, ready, passed, waiting, low, due):
        """Of new rows, and those that have waited, what can go; the rest waits."""
        go, left = [], ready
        if self.count:
            new, held, turn = {r[0]: r for r in ready}, None, (passed[0] + 1,)
            while True:
                if held is None and waiting and turn[0] == low:
                    held = self._waiting(passed)
                    # what has waited was there first
                    new = {k: r for k, r in new.items() if k not in held} | held
                if turn not in new:
                    break
                go.append(new.pop(turn))
                turn = (turn[0] + 1,)
            passed, left = (turn[0] - 1,), list(new.values())
            if held is not None:
                self.held.clear()
                left.sort(key=lambda r: r[0])
                waiting, low = 0, NEVER
        if left:
            low, due = self._hold(left, low, due)
        return go, passed, waiting + len(left), low, due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # all that the watermark has passed goes at once, with the first timer of the batch
        now, (passed, waiting, time, low, due) = timerValues.getCurrentWatermarkInMs(), self._load()
        go = []
        if waiting and due <= now:
            every = self._waiting(passed)
            last = max((k for k, _, t in every.values() if t <= now), default=passed)
            go, left = [], []
            for r in every.values():
                # what waited behind the gap may follow at once
                if r[0] <= last or (self.count and go and r[0] == (last[0] + 1,)):
                    go.append(r)
                    last = r[0] if r[0] > last else last
                else:
                    left.append(r)
            self.held.clear()
            passed, waiting, low, due = last if go else passed, len(left), NEVER, NEVER
            if left:
                low, due = self._hold(left, low, due)
        yield from self._out(key, go, [], passed, waiting, time, low, due, now)

    def _out(self, key, go, late, passed, waiting, time, low, due, now=None):
        rows = self.step(key, [(*position, *values) for position, values, _ in go]) if go else []
        if go:
            time = max(r[2] for r in go)
            if self.waits and (end := self.quiet(time)) is not None:
                self.handle.registerTimer(end)
        elif now is not None and (end := self.quiet(time)) is not None and now >= end and not waiting:
            rows = self.finish(key)
        self.mark.update((*(_plain(p) for p in passed), waiting, time, low, due))
        if rows or late:
            blank = {n: None for n in self.output}
            side = [tuple((blank | dict(zip(self.key, key)) | {a: v for a, v in zip(self.at, r[0]) if a in blank} | {"late": True}).values()) for r in late]
            yield pd.DataFrame([(*r, False) for r in rows] + side, columns=self.output).astype(self.types)


def _plain(v, kind=""):
    """Numpy scalars and arrays as Python values; what is missing as None. Pandas makes whole numbers with gaps floats."""
    if isinstance(v, np.ndarray):
        return v.tolist()
    if isinstance(v, np.generic):
        v = v.item()
    if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    return int(v) if kind in ("int", "bigint") else v


def _ordered(df, keys, processor, schema, ts, patience, grace, side):
    """Apply an ordered processor; its side output is left out unless asked for.

    Where one row lacks a whole number, pandas makes floats of that column for all rows that
    come with it, and the store keeps a float key or position as a null. So keys go there as
    strings, and positions without nulls, beside a mark of which rows have one.
    """
    if patience is not None:
        df = clocked(df, ts, patience, grace)
    placed = reduce(and_, (F.col(c).isNotNull() for c in processor.at))
    df = df.withColumns({"placed_row": placed} | {c: F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)) for c in processor.at} | {k: F.col(k).cast("string") for k in keys})
    kinds = dict(c.split(" ") for c in schema.split(", "))
    texts = ", ".join(f"{c} {'string' if c in keys else kind}" for c, kind in kinds.items())
    processor.waits = patience is not None
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    mode = "none" if patience is None else "EventTime"
    out = df.groupBy(*keys).transformWithStateInPandas(processor, f"{texts}, late boolean", "append", mode)
    out = out.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()), "late")
    return out if side else out.where(~F.col("late")).drop("late")


class MovingRange(_Ordered):
    """Exponential average of ``lo`` and ``hi``; the first frame sets it."""

    state_schema = "lo double, hi double"
    columns = [("lo", "double"), ("hi", "double")]
    key, output, types = ["clip"], ["clip", "f", "lo", "hi", "late"], {"lo": "float64", "hi": "float64", "late": bool}

    def __init__(self, alpha: float = ALPHA, waits: bool = False):
        super().__init__(waits)
        self.alpha = alpha

    def step(self, key, rows):
        lo, hi = self.state.get() if self.state.exists() else (None, None)
        out = []
        for f, new_lo, new_hi in rows:
            lo = new_lo if lo is None else lo + self.alpha * (new_lo - lo)
            hi = new_hi if hi is None else hi + self.alpha * (new_hi - hi)
            out.append((*key, f, lo, hi))
        self.state.update((lo, hi))
        return out


def moving_range(frames: DataFrame, alpha: float = ALPHA, ts: str = "ts", patience: int | None = None, grace: int = DAY, side: bool = False) -> DataFrame:
    """``frames``: clip, f, lo, hi (and ``ts``), one row per frame."""
    return _ordered(frames, ["clip"], MovingRange(alpha), "clip string, f bigint, lo double, hi double", ts, patience, grace, side)


class Stabiliser(_Ordered):
    """Previous output of one scanline; the next one leans on it."""

    state_schema = "line array<double>"
    columns = [("line", "array<double>")]
    key, output, types = ["clip", "y"], ["clip", "y", "f", "line", "late"], {"late": bool}

    def __init__(self, tau: float = TAU, cap: float = CAP, waits: bool = False):
        super().__init__(waits)
        self.tau, self.cap = tau, cap

    def step(self, key, rows):
        prev = np.asarray(self.state.get()[0]) if self.state.exists() else None
        out = []
        for f, line in rows:
            d = np.asarray(line, dtype=float)
            if prev is not None and len(prev) == len(d) and self.tau > 0:
                d = pulled(d, prev, self.tau, self.cap)
            prev = d
            out.append((*key, f, d))
        self.state.update(([float(v) for v in prev],))
        return out


def stabilise(lines: DataFrame, tau: float = TAU, cap: float = CAP, ts: str = "ts", patience: int | None = None, grace: int = DAY, side: bool = False) -> DataFrame:
    """``lines``: clip, y, f, line array<double> (and ``ts``). State is one scanline per key,
    and those that wait, so a clip spreads over as many keys as it has rows."""
    return _ordered(lines, ["clip", "y"], Stabiliser(tau, cap), "clip string, y int, f int, line array<double>", ts, patience, grace, side)


class Chunks(_Ordered):
    """Emits a chunk's frame list once it is complete, the rest at the end.

    ``n`` is the clip's length when known. Where it isn't, the last partial chunk leaves
    when no frame has come for ``idle`` milliseconds of the stream's time.
    """

    state_schema = "chunk int, frames array<int>"
    columns = [("n", "bigint")]
    key, output, types = ["clip"], ["clip", "chunk", "f", "pos", "len", "emit", "late"], {"chunk": "Int32", "pos": "Int32", "len": "Int32", "emit": "boolean", "late": bool}

    def __init__(self, size: int = CHUNK, overlap: int = OVERLAP, idle: int = 0, waits: bool = False):
        super().__init__(waits)
        self.size, self.stride, self.overlap, self.idle = size, size - overlap, overlap, idle

    def _emit(self, key, chunk, frames, full):
        emit = [not full or i < self.stride for i in range(len(frames))]
        return [(*key, chunk, f, i, len(frames), e) for i, (f, e) in enumerate(zip(frames, emit))]

    def step(self, key, rows):
        chunk, held = self.state.get() if self.state.exists() else (0, [])
        held, out = list(held or []), []
        for f, n in rows:
            held.append(int(f))
            if len(held) == self.size:
                out += self._emit(key, chunk, held, True)
                held, chunk = held[self.stride:], chunk + 1
            if pd.notna(n) and f + 1 == n and held:
                out += self._emit(key, chunk, held, False)
                held = []
        self.state.update((int(chunk), held))
        return out

    def quiet(self, time):
        return time + self.idle

    def finish(self, key):
        chunk, held = self.state.get() if self.state.exists() else (0, [])
        if not held:
            return []
        self.state.update((int(chunk) + 1, []))
        return self._emit(key, chunk, list(held), False)


CHUNK_SCHEMA = "clip string, chunk int, f int, pos int, len int, emit boolean"


def chunks(frames: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, ts: str = "ts", patience: int | None = None, grace: int = DAY, idle: int = 0, side: bool = False) -> DataFrame:
    """``frames``: clip, f, n (length or NULL; and ``ts``)."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    return _ordered(frames, ["clip"], Chunks(size, overlap, idle), CHUNK_SCHEMA, ts, patience, grace, side)


class Progress(_Ordered):
    """Running count, rate and time left of a job, throttled."""

    state_schema = "done bigint, t0 double, last double"
    at, at_schema = ["ts", "id"], "ts double, id bigint"
    columns = [("n", "bigint"), ("total", "bigint")]
    count, distinct, start = False, False, (float("-inf"), -(1 << 63))
    key, output, types = ["job"], ["job", "id", "frame", "elapsed", "fps", "eta", "late"], {"frame": "Int64", "elapsed": "float64", "fps": "float64", "eta": "float64", "late": bool}

    def __init__(self, interval: float, waits: bool = False):
        super().__init__(waits)
        self.interval = interval

    def step(self, key, rows):
        done, t0, last = self.state.get() if self.state.exists() else (0, None, None)
        out = []
        for ts, id_, n, total in rows:
            done += int(n)
            t0 = ts if t0 is None else t0
            if not (due(ts, last, self.interval) or (pd.notna(total) and done == total)):
                continue
            last, elapsed = ts, ts - t0
            rate = done / elapsed if elapsed > 0 else 0.0
            eta = (total - done) / rate if pd.notna(total) and total > 0 and rate > 0 else None
            out.append((*key, id_, done, elapsed, rate, eta))
        self.state.update((int(done), float(t0), float(last)))
        return out


PROGRESS_SCHEMA = "job bigint, id bigint, frame bigint, elapsed double, fps double, eta double"


def progress(events: DataFrame, interval: float, clock: str = "at", patience: int | None = None, grace: int = DAY, side: bool = False) -> DataFrame:
    """``events``: job, id, ts in seconds, n frames done, total or NULL (and ``clock``, a timestamp)."""
    return _ordered(events, ["job"], Progress(interval), PROGRESS_SCHEMA, clock, patience, grace, side)


def latest(events: DataFrame) -> DataFrame:
    """Latest state per job, for ``update`` or ``complete`` output."""
    return events.groupBy("job").agg(F.max_by(F.struct("frame", "total"), "ts").alias("s")).select("job", "s.*")
