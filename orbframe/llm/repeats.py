"""Windows that other documents have as well: what both removals of repeats share.

A window is ``size`` consecutive units (bytes or words) of one row. Neighbouring windows
whose least gram hash is equal form a span; equal windows have equal least hashes, so
they only ever meet under one hash. Spans are dealt by it as three numbers and sorted.
Of equal spans the smallest doc_id has the windows first, in all others they are
covered. Where a hash has different spans, one document of each is a candidate: its
windows may stand in another span as well, which the operators find out by their
methods. Copies of a passage, however many, so send one span further.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe.llm import text as T
from orbframe.session import cut

COVERED, CANDIDATE = 1, 2
#: Bits of a window's start; above them is the mark of the row's text, as rows may repeat a doc_id with another one.
START = 40


def spans(values, grams, at, size: int, k: int):
    """``hash, row, first, last`` (windows, by start) and ``span`` hash of each span."""
    least = T.sliding_min(grams, size - k + 1)
    n = len(values)
    inside = np.zeros(max(0, n - size + 1), bool)
    new = np.zeros(len(inside) + 1, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            inside[a : b - size + 1] = True
            new[a] = new[b - size + 1] = True
    least = least[: len(inside)]
    change = np.r_[True, least[1:] != least[:-1]] | new[:-1] if len(least) else np.zeros(0, bool)
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(least)] - 1 if len(first) else first
    first, last = first[inside[first]], last[inside[first]]
    return least[first], np.searchsorted(at, first, "right") - 1, first, last, T.hash_spans(values, first, last + size), at


def flags(docs: DataFrame, spans_of, partitions: int | None = None) -> DataFrame:
    """``doc_id`` with its ``covered`` and ``candidate`` spans (arrays of hashes)."""

    def emit(batches):
        for batch in batches:
            for first, _, data, at in T.chunks(batch.column(1)):
                h, row, _, _, span = spans_of(data, at)[:5]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(span.view(np.int64)), batch.column(0).take(pa.array(first + row))], ["h", "span", "doc_id"])

    def classify(batches):
        """Rows come in order of hash, span, doc_id. Of the hash left open, one waiting row is kept."""
        state = None  # hash, span, its smallest doc_id, whether the hash has had another span, waiting
        for batch in batches:
            h, span, doc = (batch.column(i).to_numpy() for i in range(3))
            if not len(h):
                continue
            new_h, new_span = np.r_[True, h[1:] != h[:-1]], np.r_[True, (h[1:] != h[:-1]) | (span[1:] != span[:-1])]
            out_doc, out_span, out_kind = [], [], []
            goes_on = state is not None and state[0] == h[0]
            same_span = goes_on and state[1] == span[0]
            new_h[0], new_span[0] = not goes_on, not same_span
            at = np.maximum.accumulate(np.where(new_span, np.arange(len(h)), -1))
            smallest = np.where(at < 0, state[2] if same_span else 0, doc[np.maximum(at, 0)])
            covered = ~new_span & (doc > smallest)
            run = np.cumsum(new_h)  # 0: the hash that was open before
            heads = np.flatnonzero(new_span)
            count = np.bincount(run[heads], minlength=run[-1] + 1)
            if goes_on:
                count[0] += 2 if state[3] else 1
                if not state[3] and count[0] > 1:
                    out_doc, out_span, out_kind = [state[2]], [state[1]], [CANDIDATE]
            many = heads[count[run[heads]] > 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.array(out_doc, np.int64), doc[covered], doc[many]]), pa.array(np.r_[np.array(out_span, np.int64), span[covered], span[many]]),
                 pa.array(np.r_[np.array(out_kind, np.int32), np.full(covered.sum(), COVERED, np.int32), np.full(len(many), CANDIDATE, np.int32)].astype(np.int32))],
                ["doc_id", "span", "kind"],
            )
            state = (h[-1], span[-1], smallest[-1], bool(count[run[-1]] > 1))

    made = T.plain(docs).where("doc_id is not null").mapInArrow(emit, "h long, span long, doc_id long")
    made = made.repartition("h").sortWithinPartitions("h", "span", "doc_id").mapInArrow(classify, "doc_id long, span long, kind int")
    pick = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("span")))
    return made.groupBy("doc_id").agg(pick(COVERED).alias("covered"), pick(CANDIDATE).alias("candidate"))


def among(span, flagged) -> np.ndarray:
    """Which spans are flagged for their row."""
    flagged = np.unique(np.asarray(flagged, np.int64))
    if not len(flagged):
        return np.zeros(len(span), bool)
    at = np.minimum(np.searchsorted(flagged, span.view(np.int64)), len(flagged) - 1)
    return flagged[at] == span.view(np.int64)


def by_row(column: pa.Array, data, at, spans_of):
    """For each row with flagged spans: row, their hashes, first and last windows (from the row's
    start on), the units of all such rows and where this row's begin. Other rows aren't looked at."""
    lists = column.to_pylist()
    rows = [i for i, flagged in enumerate(lists) if flagged]
    if not rows:
        return
    if len(rows) < len(lists):
        data = np.concatenate([data[at[i] : at[i + 1]] for i in rows])
        at = np.r_[0, np.cumsum(np.diff(at)[rows])]
    h, row, first, last, span, units, *rest = spans_of(data, at)
    edge = np.searchsorted(row, np.arange(len(at)))
    for j, i in enumerate(rows):
        s = slice(edge[j], edge[j + 1])
        hit = among(span[s], lists[i])
        yield i, h[s][hit], first[s][hit] - units[j], last[s][hit] - units[j], (data, rest, int(units[j]))


def chunks(batch, flagged: int):
    """``ids, flagged, bytes, offsets`` of the rows with something flagged, by chunk."""
    batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(flagged)), 0), False))
    ids = batch.column(0).to_pylist()
    for first, last, data, at in T.chunks(batch.column(1)):
        yield ids[first:last], batch.column(flagged)[first:last], data, at


def marked(start, text):
    """``start`` with the mark of its text above it."""
    return start + ((zlib.crc32(text) & 0x7FFFFF) << START)


def own(starts, text):
    """Of marked starts, those of this very text, without the mark."""
    starts = np.asarray(starts, np.int64)
    return starts[starts >> START == zlib.crc32(text) & 0x7FFFFF] & ((1 << START) - 1)


def covered_units(n: int, first, last, size: int) -> np.ndarray:
    """Units covered by windows that start from ``first`` to ``last``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.asarray(first, np.int64), 1)
    np.add.at(step, np.asarray(last, np.int64) + size, -1)
    return np.cumsum(step[:-1]) > 0


def resolved(docs: DataFrame, spans_of, candidates_to_windows, finish, schema: str):
    """Flag spans, find out about candidates, and finish each row with the windows covered.

    ``candidates_to_windows`` takes rows ``doc_id, text, covered, candidate`` and gives
    ``doc_id, start``; ``finish(rows, bytes, offsets)`` gives the batch of results. Both
    uses of the flagged texts ask for the same columns and rows, so one shuffle serves both.
    """
    # all spans have been through a shuffle; it leaves the disk before the texts go through theirs
    flagged = cut(flags(docs, spans_of), free=True)
    texts = T.plain(docs)
    known = texts.join(flagged.hint("merge"), "doc_id", "left")
    found = candidates_to_windows(known).groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    every = known.join(found, "doc_id", "left").select("doc_id", "text", "covered", "starts", "candidate")

    def run(batches):
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(1)):
                yield finish(batch.slice(first, last - first), data, at)

    return every.mapInArrow(run, schema)
