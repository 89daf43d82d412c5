"""Passages of 50 words that an earlier document has, by FM-indexes per shard.

Candidate spans (see ``repeats``) are dealt by their least gram hash, so spans that can
share a window meet in one shard. A shard is indexed: suffix order by doubling, the
Burrows-Wheeler transform in a wavelet matrix of packed bits with counts per word.
Spans stream over it from right to left, all in step. The interval of the words matched
so far is extended by backward search; where no smaller doc_id has the longer string,
it gives up words on the right (the next wider interval, by the array of common prefix
lengths) and tries again. That is the matching statistic of each word, up to ``size``;
a word where it reaches ``size`` starts a repeated window.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none. A null doc_id
covers nothing and is not covered. Rows that repeat a doc_id don't cover each other and
are finished one by one. An empty table gives no rows. ``deduplicated`` keeps all columns.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe.llm import repeats
from orbframe.llm import text as T

#: Words of the grams that deal out spans, and words in a shard's index (about).
GRAM, SHARD = 30, 200_000


def spans_of(size: int):
    gram = min(GRAM, size)

    def of(data, at):
        starts, ends, first = T.words(data, at)
        hashes = T.word_hashes(data, starts, ends)
        return (*repeats.spans(hashes, T.gram_hashes(hashes, gram), first, size, gram), starts, ends)

    return of


class Bits:
    """Packed bits with the count of ones before each word of 64."""

    def __init__(self, bits):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    def ones(self, i):
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols, size: int):
        self.levels, self.n = [], len(symbols)
        for level in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.begin = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, c, i):
        for level, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(c >> level & 1, zeros + ones, i - ones)
        return i

    def rank(self, c, i):
        """How often ``c`` occurs before place ``i``."""
        return self._down(c, i) - self.begin[c]


def ranges(values):
    """Minimum of ``2**k`` values from each place on, for each k."""
    out, step = [values], 1
    while step * 2 <= len(values):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
        step *= 2
    return out


class Index:
    """FM-index of ``text`` (0 ends each part), with the least owner of any interval."""

    def __init__(self, text, owner, limit: int):
        n = len(text)
        rank, step, ranks = text, 1, [text]
        order = np.argsort(text, kind="stable")
        while step < limit:
            key = rank * (n + 1) + np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            ranks.append(rank)
            step *= 2
        self.n = n
        size = int(text.max(initial=0)) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        self.bwt = WaveletMatrix(text[order - 1], size)
        a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
        for k in range(len(ranks) - 2, -1, -1):
            inside = (a < n) & (b < n)
            same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
            for x in (a, b, shared):
                x[same] += 1 << k
        self.shared = ranges(np.r_[-1, shared, -1])  # place i: of i - 1 and i
        self.owners = ranges(owner[order])

    def extend(self, c, lo, hi):
        base = self.before[c]
        return base + self.bwt.rank(c, lo), base + self.bwt.rank(c, hi)

    def least_owner(self, lo, hi):
        """Of intervals that aren't empty."""
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), self.owners[0].dtype)
        for level in np.unique(k).tolist():
            at = k == level
            out[at] = np.minimum(self.owners[level][lo[at]], self.owners[level][hi[at] - (1 << level)])
        return out

    def widened(self, lo, hi, depth):
        """The interval of the first ``depth`` symbols."""
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.shared) - 1, -1, -1):
            table, step = self.shared[k], 1 << k
            from_ = lo - step + 1
            ok = from_ >= 0
            ok[ok] = table[from_[ok]] >= depth[ok]
            lo[ok] -= step
            ok = hi < len(table)
            ok[ok] = table[hi[ok]] >= depth[ok]
            hi[ok] += step
        return lo, hi


def matching_statistics(index: Index, text, at, owner, size: int):
    """For each symbol of each part: how many symbols from it on (``size`` at most) a smaller owner has; none extends by 0."""
    found = np.zeros(len(text), np.int64)
    n = len(at) - 1
    place = at[1:].copy()  # what is left of it is to be matched
    lo, hi, depth = np.zeros(n, np.int64), np.full(n, index.n, np.int64), np.zeros(n, np.int64)
    active = np.flatnonzero(place > at[:-1])
    while len(active):
        long = active[depth[active] == size]
        if len(long):
            depth[long] -= 1
            lo[long], hi[long] = index.widened(lo[long], hi[long], depth[long])
        c = text[place[active] - 1]
        new_lo, new_hi = index.extend(c, lo[active], hi[active])
        ok = (new_hi > new_lo) & (c > 0)  # 0 ends parts in the index, and is a word that it lacks here
        ok[ok] = index.least_owner(new_lo[ok], new_hi[ok]) < owner[active[ok]]
        on = active[ok]
        lo[on], hi[on] = new_lo[ok], new_hi[ok]
        depth[on] += 1
        place[on] -= 1
        found[place[on]] = depth[on]
        stop = active[~ok]
        none = stop[depth[stop] == 0]
        place[none] -= 1
        some = stop[depth[stop] > 0]
        if len(some):
            first = index.shared[0]
            depth[some] = np.maximum(np.maximum(first[lo[some]], first[hi[some]]), 0)
            lo[some], hi[some] = index.widened(lo[some], hi[some], depth[some])
        active = active[place[active] > at[active]]
    return found


def shard_windows(texts: pa.Array, doc, start, size: int):
    """``doc`` and word number of windows that a smaller doc has in this shard."""
    data, at = T.flat(texts)
    data, at = data[at[0] : at[-1]], at - at[0]
    starts, ends, first = T.words(data, at)
    _, word = np.unique(T.word_hashes(data, starts, ends), return_inverse=True)
    owners, owner = np.unique(doc, return_inverse=True)
    n = np.diff(first)
    parts = np.insert(word + 1, first[1:], 0)
    edges = first + np.arange(len(first))
    out = np.zeros(len(word), np.int64)
    for a, b in _runs(edges, SHARD):
        piece = parts[edges[a] : edges[b]]
        symbols, piece = np.unique(np.r_[0, piece], return_inverse=True)
        index = Index(piece[1:].astype(np.int64), np.repeat(owner[a:b], n[a:b] + 1).astype(np.int32), 64)
        # words of other pieces that this one doesn't have end every match
        at_ = np.searchsorted(symbols, word + 1)
        known = symbols[np.minimum(at_, len(symbols) - 1)] == word + 1
        out = np.maximum(out, matching_statistics(index, np.where(known, at_, 0), first, owner.astype(np.int32), size))
    hit = np.flatnonzero(out >= size)
    row = np.searchsorted(first, hit, "right") - 1
    return doc[row], start[row] + hit - first[row]


def _runs(edges, limit: int):
    a, n = 0, len(edges) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + limit, "right")) - 1)
        yield a, b
        a = b


def windows_repeated(known: DataFrame, size: int) -> DataFrame:
    """``doc_id, start`` (word number) of candidate windows that a smaller doc_id has as well."""
    of = spans_of(size)

    def emit(batches):
        for batch in batches:
            for ids, flagged, data, at in repeats.chunks(batch, 3):
                rows = []
                for i, h, a, b, (own, (starts, ends), unit) in repeats.by_row(flagged, data, at, of):
                    mark = repeats.marked(0, data[at[i] : at[i + 1]])
                    rows += [(x, ids[i], mark + y, own[starts[unit + y] : ends[unit + z + size - 1]].tobytes()) for x, y, z in zip(h.view(np.int64).tolist(), a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_pylist([dict(zip(("h", "doc_id", "start", "span"), r)) for r in rows], pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("span", pa.binary())]))

    def answer(batches):
        held, n = [], 0
        for batch in batches:
            h = batch.column(0).to_numpy()
            new = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)] if len(h) else np.zeros(1, np.int64)
            for a, b in zip(new[:-1].tolist(), new[1:].tolist()):
                if held and n > SHARD * 6 and held[-1].column(0)[-1].as_py() != h[a]:
                    yield look(held)
                    held, n = [], 0
                held.append(batch.slice(a, b - a))
                n += held[-1].column(3).nbytes
        if held:
            yield look(held)

    def look(held):
        t = pa.Table.from_batches(held).combine_chunks()
        doc, start = shard_windows(t.column("span"), t.column("doc_id").to_numpy(), t.column("start").to_numpy(), size)
        T.release()
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start)], ["doc_id", "start"])

    rows = known.select("doc_id", "text", "covered", "candidate").mapInArrow(emit, "h long, doc_id long, start long, span binary")
    return rows.repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(answer, "doc_id long, start long")


def kept_words(batch, data, at, of, size: int):
    """For each row: words, words removed, and the kept ones joined by one space."""
    starts, ends, first = T.words(data, at)
    gone = np.zeros(len(starts), bool)
    for i, _, a, b, _ in repeats.by_row(batch.column(2), data, at, of):
        gone[first[i] : first[i + 1]] |= repeats.covered_units(first[i + 1] - first[i], a, b, size)
    for i, s in enumerate(batch.column(3).to_pylist()):
        if s:
            s = repeats.own(s, data[at[i] : at[i + 1]])
            gone[first[i] : first[i + 1]] |= repeats.covered_units(first[i + 1] - first[i], s, s, size)
    text, keep = data.copy(), np.zeros(len(data) + 1, np.int64)
    row_end = at[1:][np.repeat(np.arange(len(at) - 1), np.diff(first))]
    inner = ends < row_end
    text[ends[inner]] = 32
    np.add.at(keep, starts[~gone], 1)
    np.add.at(keep, (ends + inner)[~gone], -1)
    keep = np.cumsum(keep[:-1]) > 0
    kept = [text[a:b][keep[a:b]].tobytes().rstrip(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    total = np.r_[0, np.cumsum(gone)]
    return np.diff(first), total[first[1:]] - total[first[:-1]], kept


def _resolved(docs: DataFrame, size: int, finish, schema: str) -> DataFrame:
    return repeats.resolved(docs, spans_of(size), lambda known: windows_repeated(known, size), finish, schema)


def removed(docs: DataFrame, size: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row."""
    of = spans_of(size)

    def finish(batch, data, at):
        n, out, kept = kept_words(batch, data, at, of, size)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(out), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _resolved(docs, size, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, size: int = 50) -> DataFrame:
    """``docs`` without the repeated words; a text that loses some has its words joined by one space.

    A document of which nothing is left goes.
    """
    of = spans_of(size)

    def finish(batch, data, at):
        _, out, kept = kept_words(batch, data, at, of, size)
        some = np.flatnonzero(out > 0).tolist()
        whole = [hashlib.md5(data[at[i] : at[i + 1]]).hexdigest() for i in some]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), pa.array(whole, pa.string()), pa.array([kept[i].decode() for i in some], pa.string())], ["id", "whole", "left"])

    changed = _resolved(docs, size, finish, "id long, whole string, left string").dropDuplicates(["id", "whole"])
    # the columns of docs are in a struct of their own, so no name clashes
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    joined = rows.join(changed, (F.col("d.doc_id").cast("long") == F.col("id")) & (F.md5(F.col("d.text").cast("string").cast("binary")) == F.col("whole")), "left")
    changes = {"text": F.coalesce("left", F.col("d.text"))}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.coalesce(F.length("left"), F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    kept = joined.where(F.col("left").isNull() | (F.length("left") > 0))
    return kept.select(*(changes.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))
