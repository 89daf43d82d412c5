"""Token counts under a unigram model, worked out on a trie of the distinct pre-tokens.

A pre-token's best segmentation has the greatest sum of piece scores (then the fewest
pieces). The best sum up to a prefix is the same for all pre-tokens that share it, so
the forward step is done once per trie node, level by level for all nodes at once;
pre-tokens read their counts at their terminal nodes. Pieces are a public vocabulary's,
scored by rank: -log2(rank + 2) in 2**-16 steps, whole numbers, so sums are exact.

A null text has no tokens. Rows are counted one by one. An empty table gives no rows.
Other columns are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe.llm import bpe
from orbframe.llm import text as T

#: A sum and its pieces are one number: sum * FEWER - pieces.
FEWER = np.int64(1) << 20
_state: dict = {}


class Pieces:
    """Scores by hash of piece, and the lengths that pieces have."""

    def __init__(self, raw: bytes):
        pieces = bpe.vocabulary(raw).pieces.to_pylist()
        values = T._TABLE[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum([len(p) for p in pieces])
        full = np.array([bool(p) for p in pieces])
        keys = T.hash_spans(values, np.r_[0, ends[:-1]][full], ends[full])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.scores = scores(len(pieces))[full][order]
        self.lengths = sorted({len(p) for p in pieces if p})

    def of(self, keys):
        """Score of each hashed piece; what is none has 1, which no piece has."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.scores[at], np.int64(1))


def scores(n: int) -> np.ndarray:
    return np.round(-np.log2(np.arange(n) + 2.0) * 65536).astype(np.int64)


def forward(words: pa.Array, pieces: Pieces) -> np.ndarray:
    """Best ``sum * FEWER - pieces`` of each of the distinct ``words``."""
    order = np.argsort(np.array(words.to_pylist(), object)) if len(words) else np.zeros(0, np.int64)
    data, at = T.flat(words.take(pa.array(order)))
    size, start = np.diff(at), at[:-1]
    shared = common_prefixes(data, at)
    # as T.hash_spans has it, with the running sums made once
    up, down = T.powers(len(data))
    sums = np.r_[np.uint64(0), np.cumsum(T._TABLE[data] * up[: len(data)], dtype=np.uint64)]
    out = np.zeros(len(words), np.int64)
    alive = np.arange(len(words))
    node = {0: np.zeros(len(words), np.int64)}  # by level: each word's node
    best = {0: np.zeros(1, np.int64)}
    depth = 0
    while len(alive := alive[size[alive] > depth]):
        depth += 1
        new = shared[alive] < depth
        new[0] = True
        node[depth] = np.zeros(len(words), np.int64)
        node[depth][alive] = np.cumsum(new) - 1
        first = alive[new]
        top = np.full(len(first), np.iinfo(np.int64).min)
        for n in pieces.lengths:
            if n > depth:
                break
            begin = start[first] + depth - n
            score = pieces.of(T.mix((sums[begin + n] - sums[begin]) * down[begin] + np.uint64(n)))
            here = score <= 0
            before = best[depth - n][node[depth - n][first]]
            top = np.where(here & (before > np.iinfo(np.int64).min), np.maximum(top, before + score * FEWER - 1), top)
        best[depth] = top
        done = alive[size[alive] == depth]
        out[order[done]] = top[node[depth][done]]
    return out


def common_prefixes(data, at):
    """How many bytes each word shares with the one before it in sorted order."""
    n = np.zeros(max(0, len(at) - 1), np.int64)
    left = np.arange(1, len(n))
    size, depth = np.diff(at), 0
    while len(left):
        left = left[(size[left] > depth) & (size[left - 1] > depth)]
        left = left[data[at[left] + depth] == data[at[left - 1] + depth]]
        depth += 1
        n[left] = depth
    return n


def best(words: list[bytes], raw: bytes) -> list[tuple[int, int]]:
    """Score and number of pieces of each word."""
    value = forward(pa.array(words, pa.binary()), Pieces(raw))
    n = (-value) % FEWER
    return list(zip(((value + n) // FEWER).tolist(), n.tolist()))


def counted(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, score`` for each row; the score is a whole number of 2**-16 bits."""
    raw = docs.sparkSession.sparkContext.broadcast(bpe.raw_file(path))

    def run(batches):
        if "pieces" not in _state:
            _state["pieces"] = Pieces(raw.value)
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(1), 2 * T.CHUNK):
                offsets, _ = bpe.pretokens(data, at, {})
                n, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                if len(offsets) > 1:
                    which, words = bpe.distinct(data, offsets)
                    value = forward(words, _state["pieces"])
                    pieces = (-value) % FEWER
                    edge = np.searchsorted(offsets, at)
                    n = np.r_[0, np.cumsum(pieces[which])][edge]
                    total = np.r_[0, np.cumsum(((value + pieces) // FEWER)[which])][edge]
                    pre = np.diff(edge)
                else:
                    pre = np.zeros(len(at) - 1, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(pre), pa.array(np.diff(n)), pa.array(np.diff(total))], ["doc_id", "n_pretokens", "n_tokens", "score"])

    docs = T.plain(docs)
    return docs.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score long")
