"""Importance resampling towards a target: weights from arrays, ranks by a radix sort.

Features are runs of one to three words, hashed to buckets by CRC-32. Buckets are counted
over all source texts and all target texts; a bucket's gain is the logarithm of the ratio
of its smoothed shares, in whole thousandths. The array of gains goes to all tasks (one
number a bucket), and a document's weight is a sum of it. With a Gumbel number of the
document's id added, the highest scores are a draw without replacement.

The order is made by least-significant-digit radix sort over the digits of the composite
key: the doc_id's first, then the score's, highest first. In each pass the rows of a block
(of 2**18 places at most) are counted by digit; running totals over digits and blocks
give each (digit, block) its first destination; each block then deals its rows, in their
order, to their destinations, which are the places of the next pass. After the last pass
a row's place is its rank. Each pass is written to the shared folder. Nothing but the
gains and the key's range passes through the driver, and no group is larger than a block,
whatever key repeats.

A null text has no words: weight 0. Rows without a doc_id have no score, are not among
the N that the share is taken of, and are never drawn. Rows that repeat a doc_id are
scored one by one; those of equal key keep the order in which they were read. A text is
looked at whole, however long. An empty target counts as all zeros. An empty table gives
no rows. Other columns are left out.
"""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbframe.llm import text as T
from orbframe.session import cut

#: Rows of a block, and bits of a digit.
BLOCK_BITS, DIGIT_BITS = 18, 12
#: Longer words are hashed on their own.
LONG_WORD = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def _byte_table():
    """CRC-32 of one byte, by the rule: the reversed polynomial, eight shifts."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _byte_table()


def _applied(table, crc):
    """A shift, given by what each of the four bytes becomes; shifting is linear, so bytes add up by xor."""
    return np.bitwise_xor.reduce([table[..., k, (crc >> np.uint32(8 * k)) & np.uint32(0xFF)] for k in range(4)])


def _shift_tables(longest: int):
    """By length n, byte and its place: what a CRC becomes if n zero bytes follow; for n up to ``longest``, and for powers of two."""
    one = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = [one]
    for _ in range(longest):
        short.append(_CRC[short[-1] & np.uint32(0xFF)] ^ (short[-1] >> np.uint32(8)))
    powers = [short[1]]
    for _ in range(40):
        powers.append(_applied(powers[-1], powers[-1]))
    return np.array(short), powers


_SHORT, _POWERS = _shift_tables(LONG_WORD + 1)


def shifted(crc, n):
    """CRCs as they enter the CRC of a text that has ``n`` more bytes."""
    near = np.minimum(n, LONG_WORD + 1) * (n <= LONG_WORD + 1)
    out = np.bitwise_xor.reduce([_SHORT[near, k, (crc >> np.uint32(8 * k)) & np.uint32(0xFF)] for k in range(4)])
    far = np.flatnonzero(n > LONG_WORD + 1)
    for j in range(int(n.max()).bit_length() if len(far) else 0):
        some = far[(n[far] >> j) & 1 == 1]
        out[some] = _applied(_POWERS[j], out[some])
    return out


def word_crcs(data, starts, ends):
    """CRC-32 of each word, a byte of all words at a time; long words on their own."""
    size = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.where(size > LONG_WORD, 0, size), kind="stable")
    sorted_starts, sorted_size = starts[order], np.where(size > LONG_WORD, 0, size)[order]
    run = crc[order]
    for i in range(int(sorted_size[0]) if len(order) else 0):
        n = int(np.searchsorted(-sorted_size, -i, "left"))
        run[:n] = _CRC[(run[:n] ^ data[sorted_starts[:n] + i]) & np.uint32(0xFF)] ^ (run[:n] >> np.uint32(8))
    crc[order] = ~run
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        crc[i] = zlib.crc32(data[starts[i] : ends[i]])
    return crc


def features(data, at, buckets: int):
    """Buckets of all runs of one to three words, the row of each, and the words of each row."""
    low = _LOWER[data]
    inside = _INSIDE[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1 if len(data) else starts
    first = np.searchsorted(starts, at)
    row = T.rows_of(first)
    one, size = word_crcs(low, starts, ends), ends - starts
    blank = np.uint32(zlib.crc32(b" "))
    spaced = shifted(np.full(len(one), blank, np.uint32), size) ^ one if len(one) else one
    made, rows, run = [one], [row], one
    for k in (1, 2):
        if len(run) < 2:
            break
        run = shifted(run[:-1], size[k:] + 1) ^ spaced[k:]
        same = row[k:] == row[:-k]
        made.append(run[same])
        rows.append(row[k:][same])
    return (np.concatenate(made) % np.uint32(buckets)).astype(np.int64), np.concatenate(rows), np.diff(first)


def counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all ``texts`` (one column) fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, at in T.chunks(batch.column(0)):
                total += np.bincount(features(data, at, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r.bucket] = r.n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: the logarithm of its share in the target over that in the source, in thousandths."""
    n = len(source)
    whole_source, whole_target = int(source.sum()) + n, int(target.sum()) + n
    ratio = lambda s, t: ((t + 1) * whole_source) / ((s + 1) * whole_target)
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int, seed: int) -> int:
    """The document's own random number, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches):
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(1)):
                bucket, row, words = features(data, at, buckets)
                n = np.bincount(row, minlength=last - first)
                # whole numbers below 2**53, so doubles hold the sums exactly
                weight = np.bincount(row, shared.value[bucket], last - first).astype(np.int64)
                ids = batch.column(0)[first:last]
                score = [None if i is None else w + gumbel(i, seed) for i, w in zip(ids.to_pylist(), weight.tolist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(n), pa.array(weight), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    return T.plain(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


# --- the sort -----------------------------------------------------------------


def ordered(rows: DataFrame, key: list[tuple[str, bool]]) -> DataFrame:
    """``rows`` with ``place`` from 0 in the order of ``key`` (columns of longs without nulls, and whether the highest is first).

    ``rows`` should be files at rest. Equal keys keep the order of reading.
    """
    sides = [f(c).alias(f"{name}_{c}") for c, _ in key for f, name in ((F.min, "low"), (F.max, "high"))]
    limits = rows.agg(*sides).first()
    digits = []
    for column, highest in reversed(key):
        low, high = limits[f"low_{column}"], limits[f"high_{column}"]
        if low is None:
            return rows.withColumn("place", F.lit(None).cast("long"))
        if high - low < 1 << 63:
            away, width = F.lit(high) - F.col(column) if highest else F.col(column) - F.lit(low), (high - low).bit_length()
        else:  # the difference doesn't fit; with the sign's bit turned, longs are in unsigned order
            away, width = F.col(column).bitwiseXOR(F.lit((1 << 63) - 1 if highest else -(1 << 63))), 64
        digits += [F.shiftrightunsigned(away, at).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int") for at in range(0, width, DIGIT_BITS)]
    names = rows.columns
    digits = digits or [F.lit(0)]
    made = rows.withColumn("place", F.monotonically_increasing_id())
    for digit in digits:
        made = _dealt(cut(made.withColumn("digit", digit)), names)
    return cut(made)


def _dealt(rows: DataFrame, names: list[str]) -> DataFrame:
    """One pass: each row's place after a stable sort by ``digit``."""
    rows = rows.withColumn("block", F.shiftright("place", BLOCK_BITS))
    counted = rows.groupBy("block", "digit").agg(F.count("*").alias("n"))
    totals = counted.groupBy("digit").agg(F.sum("n").alias("all"))
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = totals.select("digit", so_far("all", Window.orderBy("digit")).alias("before"))  # one row a digit
    first = counted.withColumn("earlier", so_far("n", Window.partitionBy("digit").orderBy("block")))
    first = first.join(F.broadcast(before), "digit").select(F.col("block").alias("of_block"), F.col("digit").alias("of_digit"), (F.col("before") + F.col("earlier")).alias("to"))

    def deal(key, left, right):
        start = np.zeros(1 << DIGIT_BITS, np.int64)
        start[right.column("of_digit").to_numpy()] = right.column("to").to_numpy()
        # rows go to their slots, so nothing is compared
        at = np.full(1 << BLOCK_BITS, -1, np.int64)
        at[left.column("place").to_numpy() & ((1 << BLOCK_BITS) - 1)] = np.arange(left.num_rows)
        at = at[at >= 0]
        digit = left.column("digit").to_numpy()[at]
        n = np.bincount(digit, minlength=1 << DIGIT_BITS)
        by_digit = np.argsort(digit.astype(np.uint16), kind="stable")  # of 16 bits: counting, not comparing
        to = np.empty(len(digit), np.int64)
        to[by_digit] = np.arange(len(digit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        return left.select(names).take(pa.array(at)).append_column("place", pa.array(to))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.groupBy("block").cogroup(first.groupBy("of_block")).applyInArrow(deal, f"{kinds}, place long")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row of ``docs``; ``target`` has texts as well.

    Of the N rows with at least ``least_words`` words, ``percent`` of a hundred are drawn (rounded down).
    """
    texts = lambda df: df.select(F.col("text").cast("string").alias("text"))
    gain = gains(counts(texts(T.plain(docs)), buckets), counts(texts(target), buckets))
    made = cut(scored(docs, gain, seed))
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    columns = ["doc_id", "n_features", "weight", "score"]
    sorted_ = ordered(made.where(able).select(*columns), [("score", True), ("doc_id", False)])
    share = made.where(able).count() * percent // 100
    rank = F.when(F.col("place") < share, F.col("place") + 1)
    rest = made.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    return sorted_.select(*columns, rank.alias("rank")).unionByName(rest)
