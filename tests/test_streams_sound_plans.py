"""Streams equal batches, rotations are rotations, plans have the right shape."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbframe.operators import progress, quality, ranges, soundfield, temporal
from orbframe.plans import all_queries
from orbframe.streaming import state
from conftest import SF


def stream_of(spark, tmp_path, df, parts):
    """The rows of ``df`` as a file stream of several micro-batches."""
    folder = str(tmp_path / "in")
    for p in range(parts):
        df.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(folder)
    src = df.drop("part")
    return spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_moving_range_over_batches(spark, tmp_path):
    rng = np.random.default_rng(53)
    rows = [(c, f, float(rng.random()), float(1 + rng.random()), f // 4) for c in "ab" for f in range(12)]
    df = spark.createDataFrame(rows, "clip string, f bigint, lo double, hi double, part int")
    got = state.run_available(state.moving_range(stream_of(spark, tmp_path, df, 3)), "clip string, f bigint, lo double, hi double").orderBy("clip", "f").toPandas()
    want = ranges.moving_range(df.drop("part")).orderBy("clip", "f").toPandas()
    assert len(got) == 24 and np.allclose(got[["lo", "hi"]], want[["lo", "hi"]])


def test_late_frames_are_dropped(spark, tmp_path):
    rows = [("a", f, 0.0, 1.0, p) for f, p in [(0, 0), (1, 0), (3, 0), (2, 1), (4, 1)]]
    df = spark.createDataFrame(rows, "clip string, f bigint, lo double, hi double, part int")
    got = state.run_available(state.moving_range(stream_of(spark, tmp_path, df, 2)), "clip string, f bigint, lo double, hi double")
    assert sorted(r.f for r in got.collect()) == [0, 1, 3, 4]


def test_chunks_over_batches(spark, tmp_path):
    rows = [("a", f, 10, f // 3) for f in range(10)]
    df = spark.createDataFrame(rows, "clip string, f int, n bigint, part int")
    got = state.run_available(state.chunks(stream_of(spark, tmp_path, df, 4), 4, 2), state.CHUNK_SCHEMA)
    frames = df.select("clip", "f")
    want = temporal.chunk_windows(frames, temporal.clip_lengths(frames), 4, 2).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_progress_over_batches(spark, tmp_path):
    ts = [0.0, 0.05, 0.12, 0.2, 0.25, 0.31]
    rows = [(1, i, t, 2, 12, i // 2) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "job bigint, id bigint, ts double, n bigint, total bigint, part int")
    got = state.run_available(state.progress(stream_of(spark, tmp_path, df, 3), 0.1), state.PROGRESS_SCHEMA).orderBy("id").collect()
    assert [r.id for r in got] == [0, 2, 4, 5] and got[0].fps == 0.0 and got[-1].eta == 0.0


def test_latest_status_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 5, 10, 0), (1, 2.0, 7, 10, 1), (2, 1.0, 1, 4, 1)], "job bigint, ts double, frame bigint, total bigint, part int")
    q = state.latest(stream_of(spark, tmp_path, df, 2)).writeStream.format("memory").queryName("latest_t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.job: r.frame for r in spark.table("latest_t").collect()} == {1: 7, 2: 1}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_yaw_matrix_is_a_rotation(spark, order):
    m = soundfield.yaw_matrix(spark, order, 61.0)
    assert soundfield.off_identity(soundfield.product(m, soundfield.transpose(m))).first().worst < 1e-12
    assert soundfield.off_identity(soundfield.product(m, soundfield.yaw_matrix(spark, order, -61.0))).first().worst < 1e-12
    assert soundfield.off_identity(soundfield.yaw_matrix(spark, order, 0.0)).first().worst == 0


def test_rotation_moves_the_bearing_by_the_yaw(spark):
    az = math.radians(37.0)
    s = [math.sin(0.1 * i) for i in range(200)]
    rows = [("a", i, [v, v * math.sin(az), 0.0, v * math.cos(az)]) for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "clip string, n bigint, ch array<double>")
    turned = soundfield.rotate(df, 1, 63.0)
    assert soundfield.bearing(turned, ["clip"]).first().bearing == pytest.approx(100.0)
    assert soundfield.loudness_kept(df, turned, ["clip"]).first().kept
    with pytest.raises(ValueError):
        soundfield.rotate(df, 4, 1.0)
    w = spark.range(1).select(soundfield.wrap_degrees(F.lit(270.0))).first()[0]
    assert w == -90.0


def test_stage_times_drop_the_warm_up(spark):
    df = spark.createDataFrame([("warp", 0, 99.0), ("warp", 1, 3.0), ("fill", 1, 1.0), ("warp", 2, 3.0), ("fill", 2, 1.0)], "stage string, frame int, seconds double")
    got = {r.stage: (r.seconds, r.per_frame, r.share) for r in quality.stage_times(df).collect()}
    assert got == {"warp": (6.0, 3.0, 0.75), "fill": (2.0, 1.0, 0.25)}


def plan(spark, name):
    return all_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_no_cross_joins(spark, name):
    if name.startswith("stream_") or name.startswith("frame_depth") or name in ("chunk_path", "residual_fill"):
        pytest.skip("runs jobs while it is built")
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_an_eye_takes_one_shuffle_of_pixels(spark):
    """Range, splat, crack windows, taps, gather and fill run inside frames:
    every shuffle on frame keys is the same one, reused at run time."""
    df = all_queries.QUERIES["right_eye"](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [l for l in text.splitlines() if "Exchange hashpartitioning(" in l and "Reused" not in l]
    assert len(shuffles) == 1 and "BroadcastHashJoin" not in text, text


def test_scans_read_only_what_is_used(spark):
    text = all_queries.QUERIES["frame_range"](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "label" not in text.split("ReadSchema")[1].split("\n")[0]


def test_a_folder_of_part_files_streams_whole(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 2).repartition(4).write.parquet(f"{tmp_path}/t.parquet")
    got = state.run_available(state.table_stream(spark, str(tmp_path), "t"), "id long, v long")
    assert sorted((r.id, r.v) for r in got.collect()) == [(i, 2 * i) for i in range(100)]


FRAMES = "clip string, f bigint, lo double, hi double, ts timestamp, part int"
RANGES = "clip string, f bigint, lo double, hi double"


def timed(spark, rows):
    """Frames ``(f, part)`` of one clip at a frame a second, and a last batch that moves the watermark."""
    last = max(p for _, p in rows) + 1
    made = [("a", f, float(f), 1.0, f, p) for f, p in rows] + [("", None, None, None, 1000, last)]
    return spark.createDataFrame(made, "clip string, f bigint, lo double, hi double, s long, part int").withColumn("ts", F.timestamp_seconds("s")).drop("s"), last + 1


def test_frames_wait_for_their_turn(spark, tmp_path):
    order = [5, 0, 7, 2, 1, 3, 9, 4, 8, 6]
    df, parts = timed(spark, [(f, i // 3) for i, f in enumerate(order)])
    got = state.run_available(state.moving_range(stream_of(spark, tmp_path, df, parts), 0.5, patience=100), RANGES).orderBy("f").collect()
    lo, want = None, []
    for f in range(10):
        lo = float(f) if lo is None else lo + 0.5 * (f - lo)
        want.append((f, lo))
    assert [(r.f, r.lo) for r in got] == want


def test_rows_without_a_position_may_come_with_others(spark, tmp_path):
    order = [5, 0, 2, 1, 3, 4]
    lines = {(y, f): np.random.default_rng(7 * f + (y or 9)).random(4) for y in (0, 1, None) for f in order}
    rows = [("a", y, f, lines[y, f].tolist(), f, i // 2) for i, f in enumerate(order) for y in (0, 1, None)]
    rows += [("a", None, None, None, 0, p) for p in range(3)] + [(None, None, None, None, 1000, 3)]
    df = spark.createDataFrame(rows, "clip string, y int, f int, line array<double>, s long, part int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # all keys come in one batch of Arrow
    try:
        got = state.run_available(state.stabilise(stream_of(spark, tmp_path, df, 4), patience=100), "clip string, y int, f int, line array<double>").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, last = {}, {}
    for f in sorted(order):
        for y in (0, 1, None):
            d = lines[y, f]
            last[y] = temporal.pulled(d, last[y], temporal.TAU, temporal.CAP) if y in last else d
            want[y, f] = last[y]
    assert len(got) == len(want) and all(r.clip == "a" and np.allclose(r.line, want[r.y, r.f]) for r in got)


def test_gaps_are_given_up_and_what_comes_then_is_late(spark, tmp_path):
    # 2 is missing when the watermark (4 s behind) passes 3; it comes after that
    df, parts = timed(spark, [(0, 0), (1, 0), (3, 0), (4, 1), (12, 1), (5, 2), (2, 3), (6, 3), (5, 3)])
    out = state.run_available(state.moving_range(stream_of(spark, tmp_path, df, parts), 1.0, patience=4, side=True), RANGES + ", late boolean")
    rows = out.collect()
    assert sorted(r.f for r in rows if not r.late) == [0, 1, 3, 4, 5, 6, 12]
    assert sorted((r.clip, r.f, r.lo) for r in rows if r.late) == [("a", 2, None), ("a", 5, None)]


def test_the_last_chunk_leaves_on_a_timer(spark, tmp_path):
    df, parts = timed(spark, [(f, (f * 7) % 3) for f in range(10)])
    src = stream_of(spark, tmp_path, df.select("clip", F.col("f"), F.lit(None).cast("bigint").alias("n"), "ts", "part"), parts)
    got = state.run_available(state.chunks(src, 4, 2, patience=50, idle=60_000), state.CHUNK_SCHEMA)
    frames = spark.range(10).select(F.lit("a").alias("clip"), F.col("id").cast("int").alias("f"))
    want = temporal.chunk_windows(frames, temporal.clip_lengths(frames), 4, 2).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_progress_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(1, i, float(i) / 4, 2, None, int(rng.integers(0, 3))) for i in range(40)] + [(0, None, None, None, None, 3)]
    df = spark.createDataFrame(rows, "job bigint, id bigint, ts double, n bigint, total bigint, part int")
    df = df.withColumn("at", F.coalesce(F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")), F.timestamp_seconds(F.lit(5000))))
    got = state.run_available(state.progress(stream_of(spark, tmp_path, df, 4), 1.0, patience=60), state.PROGRESS_SCHEMA).orderBy("id").collect()
    assert [(r.id, r.frame) for r in got] == [(i, 2 * i + 2) for i in range(0, 40, 4)]


class _Calls:
    """A handle, its states and a watermark, as one key sees them; counts calls."""

    def __init__(self):
        self.n, self.timers, self.kept, self.watermark = 0, set(), {}, -1

    def getValueState(self, name, *schemas):
        return _State(self, name)

    getListState = getMapState = getValueState

    def registerTimer(self, t):
        self.n += 1
        self.timers.add(t)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def batch(self, processor, key, rows, columns):
        """What the processor puts out for rows, then for timers up to the watermark."""
        out = [*processor.handleInputRows(key, iter([pd.DataFrame(rows, columns=columns)]), self)] if rows else []
        for t in sorted(t for t in self.timers if t <= self.watermark):
            out += processor.handleExpiredTimer(key, self, type("Info", (), {"getExpiryTimeInMs": lambda _, t=t: t})())
            self.timers.discard(t)
        return [r for pdf in out for r in pdf.itertuples(index=False)]


class _State:
    """A value, a list or a map."""

    def __init__(self, calls, name):
        self.calls, self.name = calls, name

    def _kept(self, empty):
        self.calls.n += 1
        return self.calls.kept.setdefault(self.name, empty)

    def get(self):
        kept = self._kept(None)
        return iter(kept or []) if self.name == "held" else kept

    def exists(self):
        return bool(self._kept(None))

    def update(self, value):
        self.calls.n += 1
        self.calls.kept[self.name] = value

    def clear(self):
        self.calls.n += 1
        self.calls.kept.pop(self.name, None)

    def appendValue(self, value):
        self.calls.kept[self.name] = [*(self._kept(None) or []), value]

    def containsKey(self, key):
        return key in (self._kept(None) or {})

    def getValue(self, key):
        return self._kept({})[key]

    def updateValue(self, key, value):
        self.calls.kept[self.name] = (self._kept(None) or {}) | {key: value}

    def removeKey(self, key):
        self._kept({}).pop(key, None)

    def iterator(self):
        for item in list((self._kept(None) or {}).items()):
            self.calls.n += 1
            yield item


def test_calls_to_the_state_store_do_not_grow_with_the_rows_that_wait():
    for make, columns, row in [
        (lambda: state.Progress(1.0, waits=True), ["ts", "id", "n", "total", "at_ms"], lambda i: (i / 2, i, 2, None, i * 500)),
        (lambda: state.Stabiliser(waits=True), ["f", "line", "at_ms"], lambda i: (i + 1, np.ones(3), i * 500)),
    ]:
        key, count = (1,) * (1 if len(columns) == 5 else 2), {}
        for n in (10, 300):
            calls, processor = _Calls(), make()
            processor.init(calls)
            for part in (1, 0, 2):
                assert not calls.batch(processor, key, [row(i) for i in range(n) if i % 3 == part], columns)
            calls.watermark = 10**9
            out = calls.batch(processor, key, [], columns)
            assert len(out) == (n // 2 if len(columns) == 5 else n)
            count[n] = calls.n
        assert count[300] <= count[10] + 5


def test_a_frame_that_waits_and_comes_again_goes_out_once():
    calls, processor = _Calls(), state.MovingRange(1.0, waits=True)
    processor.init(calls)
    columns, out = ["f", "lo", "hi", "at_ms"], []
    for rows, calls.watermark in [([(2, 2.0, 0.0, 2000), (5, 5.0, 0.0, 5000)], -1), ([(0, 0.0, 0.0, 0), (1, 1.0, 0.0, 1000), (2, 9.0, 0.0, 2000)], -1), ([], 10_000)]:
        out += calls.batch(processor, ("a",), rows, columns)
    assert [(r.f, r.lo) for r in out] == [(0, 0.0), (1, 1.0), (2, 2.0), (5, 5.0)]
