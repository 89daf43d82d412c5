"""Near duplicates: a Hamming join of b-bit MinHash signatures, confirmed on full sets.

A document's set holds its distinct word shingles, A-Z in lower case; a shorter text
has its whole sequence as one. 32 components of 16 bits stand for it. They are split
into 8 chunks of 4, and a chunk may hold one error: a document goes under each chunk
with each of its components left out. Two signatures that differ in at most 15
components agree on such a key (eight chunks with two errors each would make 16).
Two sets of similarity 0.8 miss all keys with a probability of 1.2e-6.

Equal sets are one node. Under a key, nodes are held against the first one; what is
confirmed makes components. Of keys that still hold several components, small ones
compare across these, where signatures agree enough. Large ones are split around a
hub by the shingles that it lacks (``around``). So a group costs about its size, and
no link between components is lost.

A null text or one without words has an empty set and no links. A null doc_id has
no links. Rows that repeat a doc_id are answered one by one. An empty table gives no
rows. Other columns are left out of ``linked``, and kept by ``deduplicated``.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe.llm import text as T
from orbframe.llm.graph import linked as linked_nodes
from orbframe.session import cut

COMPONENTS, CHUNKS = 32, 8
#: Signatures of linked sets agree in so many components at least (all but 3e-6 at similarity 0.8).
AGREE = 14
_A = np.random.default_rng(7).integers(0, 2**63, COMPONENTS, np.uint64) * np.uint64(2) + np.uint64(1)
_X = np.random.default_rng(8).integers(0, 2**64, COMPONENTS, np.uint64)


def shingle_sets(data, at, k: int):
    """Sorted distinct shingle hashes of each row, end to end, and their offsets."""
    starts, ends, first = T.words(data, at)
    hashes = T.word_hashes(data, starts, ends, lower=True)
    grams = T.gram_hashes(hashes, k)
    sets, n = [], np.zeros(len(at), np.int64)
    bounds = first.tolist()
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        elif b > a:
            s = T.gram_hashes(hashes[a:b], b - a)
        else:
            continue
        sets.append(s)
        n[i + 1] = len(s)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum(n)


def signatures(sets, at):
    """``COMPONENTS`` values of 16 bits for each row that has a set."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, COMPONENTS), np.uint16)
    if len(full):
        for j in range(COMPONENTS):
            least = np.minimum.reduceat((sets ^ _X[j]) * _A[j], at[full])
            out[full, j] = (T.mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, set_id, signature`` of each row."""

    def run(batches):
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(1)):
                sets, ends = shingle_sets(data, at, k)
                signature = signatures(sets, ends)
                ids = [hashlib.blake2b(sets[s:e], digest_size=16).digest() if e > s else None for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, signature.size + 1, COMPONENTS), pa.int32()), pa.array(signature.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(np.diff(ends)), pa.array(ids, pa.binary()), lists], ["doc_id", "n_shingles", "set_id", "signature"])

    return T.plain(docs).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, signature array<int>")


def keys_of(nodes: DataFrame) -> DataFrame:
    """``key, node, signature``: each chunk with each component left out."""
    size = COMPONENTS // CHUNKS
    made = []
    for c in range(CHUNKS):
        for gone in range(size):
            key = F.lit(c * size + gone).cast("long")
            for i in (i for i in range(size) if i != gone):
                key = F.shiftleft(key, 16).bitwiseOR(F.get("signature", F.lit(c * size + i)).cast("long"))
            made.append(key)
    return nodes.select(F.explode(F.array(*made)).alias("key"), F.col("n_shingles").alias("size"), "node")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose documents' sets are similar enough."""
    texts = T.plain(docs)
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, known = None, None
        for batch in batches:
            keep = []
            a, left = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, end, data, at in T.chunks(batch.column(3)):
                sets, ends = shingle_sets(data, at, k)
                for i in range(first, end):
                    if (a[i], left[i]) != last:
                        last = (a[i], left[i])
                        known, _ = shingle_sets(*T.flat(pa.array([left[i]], pa.string())), k)
                    own = sets[ends[i - first] : ends[i - first + 1]]
                    same = len(np.intersect1d(known, own, assume_unique=True))
                    keep.append(same > 0 and 100 * same >= percent * (len(known) + len(own) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def around(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``pivot, node, size, linked, heads, reach`` for ``members(pivot, node)``.

    Say x is no link of the pivot, and y is a link of x. In one order of all shingles,
    by hash with the pivot's last, both have their first common shingle among their first
    ``size - need + 1``, where ``need`` is the least overlap that any link has. If it is
    not the pivot's, it is a head of both. If it is, all they share is the pivot's, so x
    overlaps with the pivot as much as with y; that is too little for y of the pivot's
    size, and is enough for y of a size up to ``reach`` at most (0 if that is no link's size).
    """
    texts = T.plain(docs)
    both = members.join(texts.select(F.col("doc_id").alias("node"), F.col("text").alias("text_b")), "node")
    both = both.join(texts.select(F.col("doc_id").alias("pivot"), F.col("text").alias("text_a")), "pivot").select("pivot", "node", "text_a", "text_b")

    def run(batches):
        last, known = None, None
        for batch in batches:
            pivots, left = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for first, end, data, at in T.chunks(batch.column(3)):
                sets, ends = shingle_sets(data, at, k)
                heads, link, reach = [], [], []
                for i in range(first, end):
                    if (pivots[i], left[i]) != last:
                        last = (pivots[i], left[i])
                        known, _ = shingle_sets(*T.flat(pa.array([left[i]], pa.string())), k)
                    own = sets[ends[i - first] : ends[i - first + 1]]
                    outside = np.setdiff1d(own, known, assume_unique=True)
                    size, same = len(own), len(own) - len(outside)
                    least = -(-percent * size // 100)
                    link.append(100 * same >= percent * (size + len(known) - same))
                    most = (100 + percent) * same // percent - size
                    reach.append(most if not link[-1] and most >= least else 0)
                    heads.append((outside[: size - least + 1] ^ T.mix(pivots[i : i + 1].astype(np.uint64))).view(np.int64))
                at_head = pa.array(np.cumsum([0, *map(len, heads)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], batch.column(1)[first:end], pa.array(np.diff(ends)), pa.array(link, pa.bool_()), pa.ListArray.from_arrays(at_head, pa.array(np.concatenate(heads))), pa.array(reach, pa.int64())],
                    ["pivot", "node", "size", "linked", "heads", "reach"],
                )

    return both.mapInArrow(run, "pivot long, node long, size long, linked boolean, heads array<long>, reach long")


def linked(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    made = cut(sketches(docs, k))
    sets = made.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    sets = cut(sets)
    signed = sets.select("node", "signature", "n_shingles")
    group = linked_nodes(
        signed,
        keys_of,
        lambda pairs: confirmed(_agreeing(pairs, signed), docs, k, percent),
        lambda members: around(members, docs, k, percent),
    )
    of_set = sets.select("set_id", "node").join(group.hint("merge"), "node", "left").select("set_id", F.coalesce("component", "node").alias("found"))
    done = made.join(of_set.hint("merge"), "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    # Spark takes an array to have one element, so signatures look small; they are never broadcast
    signed = signed.hint("merge")
    for end in ("a", "b"):
        pairs = pairs.join(signed.select(F.col("node").alias(end), F.col("signature").alias(f"s_{end}")), end)
    same = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda e: e))
    return pairs.where(same >= AGREE).select("a", "b")


def deduplicated(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; of rows that agree in doc_id and text (nulls as well), one stays."""
    gone = linked(docs, k, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
