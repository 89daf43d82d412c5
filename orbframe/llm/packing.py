"""Packing of token pieces into sequences: dominance reduction, then best fit.

Only lengths matter to a packing, so the instance is a histogram with at most
``capacity`` entries, whatever the number of documents. The reduction and the
best fit work on its counts and give patterns (lengths that share a sequence) with
how often each is used. Pieces then take places by their number within their
length; that number comes from counts per partition, so a length that a third of
all pieces have is spread over all tasks.

A null text has the closing id alone. Repeated rows are packed each for itself.
An empty table gives no rows. Other columns are left out of the result.
"""

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbframe.llm import bpe
from orbframe.llm import text as T
from orbframe.session import cut


def dominant(lengths: list[int], counts: list[int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns that some best packing has, with their counts, and the histogram left over.

    From the largest item down: it is packed alone if nothing fits beside it, and with
    the largest item that fits if both fill the sequence or no third one could come in.
    Then whatever another sequence has beside the item could change places with that.
    """
    left = dict(zip(lengths, counts))
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = {x: pattern.count(x) for x in set(pattern)}
        n = min(left[x] // k for x, k in need.items())
        fixed.append((pattern, n))
        for x, k in need.items():
            left[x] -= k * n
            if not left[x]:
                del left[x]
                sizes.pop(bisect.bisect_left(sizes, x))

    stuck: list[int] = []  # sizes that no rule decides
    while sizes:
        rest = [x for x in sizes if not stuck or x < stuck[-1]]
        if not rest:
            break
        big = rest[-1]
        room = capacity - big
        fits = [x for x in sizes if x <= room and (x != big or left[big] > 1)]
        if not fits:
            take((big,))
            continue
        best, small = fits[-1], fits[0]
        # the two smallest places beside the big one
        second = small if left[small] - (small == big) > 1 else (fits[1] if len(fits) > 1 else None)
        if best == room or second is None or small + second > room:
            take((big, best))
            continue
        stuck.append(big)
    return fixed, {x: left[x] for x in sizes}


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing order, on counts.

    Open sequences of one content are one entry. The n items of a size go to the entry
    with the least room that takes them, as many as it and they allow.
    """
    entries: dict[int, list[list]] = {}  # room -> [[pattern, count]]
    rooms: list[int] = []
    full: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if not room:
            full.append((pattern, n))
        else:
            if room not in entries:
                entries[room] = []
                bisect.insort(rooms, room)
            entries[room].append([pattern, n])

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                k = capacity // size
                if n // k:
                    put((size,) * k, n // k, capacity - k * size)
                if n % k:
                    put((size,) * (n % k), 1, capacity - size * (n % k))
                break
            room = rooms[i]
            pattern, open_ = entries[room].pop()
            if not entries[room]:
                del entries[room]
                rooms.pop(i)
            k = room // size
            whole = min(open_, n // k)
            if whole:
                put(pattern + (size,) * k, whole, room - k * size)
                n -= whole * k
            if open_ > whole:
                if n and n < k:
                    put(pattern + (size,) * n, 1, room - n * size)
                    open_ -= 1
                    n = 0
                if open_ > whole:
                    put(pattern, open_ - whole, room)
    return full + [(p, n) for some in entries.values() for p, n in some]


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    lengths = sorted(histogram)
    fixed, left = dominant(lengths, [histogram[x] for x in lengths], capacity)
    return fixed + best_fit(left, capacity)


def places(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of piece numbers and the sequences they go to.

    Piece ``first + i`` of a run goes to sequence ``sequence + i`` at ``offset``.
    There are as many runs as places in patterns, which the histogram bounds.
    """
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in found:
        offset = 0
        for x in pattern:
            rows.append((x, given.get(x, 0), sequence, offset))
            given[x] = given.get(x, 0) + n
            offset += x
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T))


def pieces(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids and the closing one."""
    raw = docs.sparkSession.sparkContext.broadcast(bpe.raw_file(path))

    def run(batches):
        v = bpe.vocabulary(raw.value)
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(1)):
                ids, ends = bpe.encode(data, at, v)
                ids = np.insert(ids.astype(np.uint32), ends[1:], np.uint32(end))
                ends = ends + np.arange(len(ends))
                n = np.diff(ends)
                count = -(-n // capacity)
                head = n - (count - 1) * capacity
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece, head[row] + (piece - 1) * capacity, 0)
                length = np.where(piece, capacity, head[row])
                whole = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                begin = ends[row] + start
                crc = [zlib.crc32(whole[4 * b : 4 * e]) for b, e in zip(begin.tolist(), (begin + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    docs = T.plain(docs)
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, group: int = 500_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece.

    Runs the tokenizer once: pieces (a few numbers each) go to the shared folder.
    The driver sees one count per length, ``capacity`` at most. Pieces of a length are
    numbered in salted groups of about ``group`` rows, each from where the last one ends.
    """
    made = cut(pieces(docs, path, capacity, end))
    histogram = {r.length: r["count"] for r in made.groupBy("length").count().collect()}
    table = docs.sparkSession.sparkContext.broadcast(places(patterns(histogram, capacity)))
    salts = 16 + sum(histogram.values()) // group
    made = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    numbered = made.withColumn("number", F.row_number().over(own) - 1).join(bases, ["length", "salt"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        t = table.value
        key = t["length"] << 40 | t["first"]
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = np.searchsorted(key, length << 40 | number, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(t["sequence"][run] + number - t["first"][run]), pa.array(t["offset"][run])], [*columns, "sequence_id", "offset"]
            )

    return numbered.select(*columns, (F.col("number") + F.col("base")).cast("long").alias("number")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
