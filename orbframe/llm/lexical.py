"""Ranked lexical search: term at a time, with a limit on accumulators.

Documents are scored where they lie. A first pass counts, over all documents, those that
hold each term of the items, those with any term, and all terms. In the second, a task
makes the postings of some documents (a shard) and answers the items one by one: terms go
from the rarest to the most frequent, and each has a bound, its greatest contribution in
the shard. While the terms still to come could bring a document without an accumulator to
the k-th best score so far, postings create accumulators; from then on they only update
those that exist, exactly. The k-th best so far is that of the shard's partial scores or
of what the task has answered before, whichever is higher. Each task gives the best k of
each item, and a window picks the best of all tasks. No posting is shuffled.

Items go to the tasks in parts of at most ``PART`` characters (a longer item is a part of its
own), so what is broadcast is bounded; documents are read twice for each part.

Null texts and texts without terms score nothing. Rows that repeat a doc_id are documents
each; those without one count in the figures, but aren't ranked. Of rows that repeat an
item_id the one with the smallest text is the item; those without one aren't items. Ties
go to the smaller doc_id. A text is looked at whole, however long. Empty tables give no
rows. Other columns are left out.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbframe.llm import text as T
from orbframe.llm.bpe import distinct

#: Postings of a shard, about.
SHARD = 2_000_000
#: Characters of the items that are answered together.
PART = 1_000_000
#: Constants of the score: contributions are whole numbers of 1/SCALE of a weight.
SCALE, TF_PART, LENGTH_PART, LENGTH_SHARE = 1_000_000_000, 1000, 8, 75
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def terms_of(data, at):
    """Terms in order: number of each in the list of distinct ones, that list, and the first term of each row (and of all)."""
    data = _LOWER[data]
    inside = _INSIDE[data]
    if not inside.any():
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(at), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    tiles = np.zeros(len(data) + 1, bool)  # terms and the gaps between them
    tiles[starts] = tiles[ends] = tiles[0] = tiles[-1] = True
    cuts = np.flatnonzero(tiles)
    which, words = distinct(data, cuts)
    return which[np.searchsorted(cuts, starts)], words, np.searchsorted(starts, at)


def postings(data, at, terms: pa.Array):
    """``row, term, tf`` of those of ``terms`` that rows hold, and the number of all terms of each row."""
    which, words, first = terms_of(data, at)
    known = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    term = known[which] if len(which) else which
    row = T.rows_of(first)
    key, tf = np.unique((row * max(1, len(terms)) + term)[term >= 0], return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), tf, np.diff(first)


def figures(docs: DataFrame, terms: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each of ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        held, some, every = np.zeros(len(shared.value), np.int64), 0, 0
        for batch in batches:
            for _, _, data, at in T.chunks(batch.column(1)):
                _, term, _, n = postings(data, at, shared.value)
                held += np.bincount(term, minlength=len(held))
                some, every = some + int((n > 0).sum()), every + int(n.sum())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, at]), pa.array(np.r_[some, every, held[at]])], ["term", "n"])

    found = {r.term: r.n for r in T.plain(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    held = np.zeros(len(terms), np.int64)
    for t, n in found.items():
        if t >= 0:
            held[t] = n
    return found.get(-1, 0), found.get(-2, 0), held


class Part:
    """Items with their terms (rarest first, with repeats counted) and the terms' weights."""

    def __init__(self, items: list[tuple[int, str]]):
        ids, texts = [i for i, _ in items], pa.array([t for _, t in items], pa.string())
        data, at = T.flat(texts)
        which, words, first = terms_of(data[at[0] : at[-1]], at - at[0])
        used, which = np.unique(which, return_inverse=True)
        self.terms = words.take(pa.array(used))
        self.items = [(i, *np.unique(which[a:b], return_counts=True)) for i, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist()) if b > a]

    def weigh(self, some: int, every: int, held: np.ndarray) -> None:
        self.some, self.every = some, every
        self.weight = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
        ordered = []
        for i, term, times in self.items:
            order = np.lexsort((term, held[term]))
            ordered.append((i, term[order], times[order] * self.weight[term[order]]))
        self.items = ordered


class Best:
    """The best ``k`` of each item so far: score, then smaller doc_id."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def least(self, item: int) -> int:
        """What a document must reach to be among the best (a tie may)."""
        score = self.of.get(item)
        return int(score[0][-1]) if score is not None and len(score[0]) == self.k else 1

    def add(self, item: int, score, doc) -> None:
        if item in self.of:
            score, doc = np.r_[self.of[item][0], score], np.r_[self.of[item][1], doc]
        order = np.lexsort((doc, -score))[: self.k]
        if len(order):
            self.of[item] = score[order], doc[order]


def answer(shard, part: Part, best: Best) -> None:
    """All items against one shard: ``doc`` ids, and postings as ``start`` of each term, ``row`` and ``share``."""
    doc, start, row, share = shard
    top = np.zeros(len(start) - 1, np.int64)
    full = np.flatnonzero(np.diff(start))
    if len(full):
        top[full] = np.maximum.reduceat(share, start[:-1][full])
    sums = np.zeros(len(doc), np.int64)
    exists = np.zeros(len(doc), bool)
    for item, term, weight in part.items:
        left = np.cumsum((weight * top[term])[::-1])[::-1]  # what this term and those after it can bring
        floor, open_, made = best.least(item), True, False
        for t, w, bound in zip(term.tolist(), weight.tolist(), left.tolist()):
            a, b = start[t], start[t + 1]
            if a == b or not w:
                continue
            if open_ and made and bound < (high := int(sums.max())) and len(doc) >= best.k:
                floor = max(floor, min(high, int(np.partition(sums, -best.k)[-best.k])))
            open_ = open_ and bound >= floor
            at, more = row[a:b], share[a:b]
            if open_:
                exists[at] = made = True
            else:
                if not made:
                    break
                on = exists[at]
                at, more = at[on], more[on]
            sums[at] += w * more
        if made:
            found = np.flatnonzero(sums >= floor)
            best.add(item, sums[found], doc[found])
            sums[:] = 0
            exists[:] = False


def _shard(pending, part: Part):
    """Postings of several chunks by term, with each one's share of its term's weight."""
    base, docs, rows, terms, shares = 0, [], [], [], []
    for ids, row, term, tf, n in pending:
        m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * x * part.some // part.every for x in n.tolist()], np.int64)
        rows.append(row + base)
        terms.append(term)
        shares.append(SCALE * tf // (TF_PART * tf + LENGTH_PART * m[row]))
        docs.append(ids)
        base += len(ids)
    term = np.concatenate(terms)
    order = np.argsort(term, kind="stable")
    start = np.searchsorted(term[order], np.arange(len(part.terms) + 1))
    return np.concatenate(docs), start, np.concatenate(rows)[order], np.concatenate(shares)[order]


def parts(items: DataFrame):
    """The items in parts of bounded size, one after the other."""
    one = items.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text"))
    held, length = [], 0
    for r in one.orderBy("item_id").toLocalIterator():
        if held and length + len(r.text) > PART:
            yield Part(held)
            held, length = [], 0
        held.append((r.item_id, r.text))
        length += len(r.text)
    if held:
        yield Part(held)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, scores above 0."""
    schema = "item_id long, doc_id long, score long"
    found = docs.sparkSession.createDataFrame([], schema)
    for part in parts(items):
        found = found.union(_answers(docs, part, k, schema))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _answers(docs: DataFrame, part: Part, k: int, schema: str) -> DataFrame:
    part.weigh(*figures(docs, part.terms))
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches):
        part, best, pending, size = shared.value, Best(k), [], 0
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(1)):
                row, term, tf, n = postings(data, at, part.terms)
                ids = batch.column(0)[first:last]
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                keep = named[row]
                pending.append((pc.fill_null(ids, 0).to_numpy(), row[keep], term[keep], tf[keep], n))
                size += len(row)
                if size >= SHARD:
                    answer(_shard(pending, part), part, best)
                    pending, size = [], 0
        if pending and part.every:
            answer(_shard(pending, part), part, best)
        if best.of:
            made = [(item, *x) for item, x in best.of.items()]
            item = np.repeat([m[0] for m in made], [len(m[1]) for m in made])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([m[2] for m in made])), pa.array(np.concatenate([m[1] for m in made]))], ["item_id", "doc_id", "score"])

    return T.plain(docs).mapInArrow(run, schema)
