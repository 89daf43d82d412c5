"""Exact top-k by inner product: descending lengths, rotated partial sums, residual bounds.

Components are integers, floor(1024 x). Vectors are sorted by length, longest first, and
packed into blocks. Queries meet the longest block first, which gives each a score to
beat. Then a block of queries meets a later block only if its longest vector times some
query's length can reach that query's score. Inside, both are rotated to the directions
of the sum of x x^T (its SVD), largest first; the sum over the first directions plus the
product of what is left of both lengths bounds the score, and what can't reach the score
to beat goes before the next directions are added. What stays is scored in integers.

Vectors that are null or hold a null or non-finite component take no part; shorter ones
count as filled with zeros. Rows that repeat a vec_id are candidates each; as queries,
they count once. Ties go to the smaller vec_id. An empty table gives no rows. Other
columns are left out. Components are at most 2**24 or so, or products leave 64 bits.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbframe.session import cut

BLOCK, QUERY_BLOCK, STEP = 1024, 256, 16


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, x`` (array of long) and ``norm`` of the vectors that take part."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.exists("embedding", lambda v: bad(v.cast("double"))))
    made = good.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return made.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of an array column, filled with zeros to ``d``."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d)[None, :] < n[:, None]] = column.flatten().to_numpy()
    return out


def rotation(made: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the sum of x x^T over all vectors, largest first: d x d numbers, whatever the input."""

    def part(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(0), d).astype(float)
            total += x.T @ x
        i = np.indices((d, d)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i[0]), pa.array(i[1]), pa.array(total.ravel())], ["i", "j", "v"])

    total = np.zeros((d, d))
    for r in made.select("x").mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()


def packed(rows: DataFrame, d: int, size: int) -> DataFrame:
    """Runs of rows in their order as ``ids, xs`` (bytes), ``n`` and the greatest length ``top``."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), size):
                b = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0).to_numpy().tobytes()]), pa.array([matrix(b.column(1), d).tobytes()]), pa.array([len(b)]), pa.array([max(b.column(2).to_pylist())])],
                    ["ids", "xs", "n", "top"],
                )

    return rows.select("vec_id", "x", "norm").mapInArrow(run, "ids binary, xs binary, n long, top double")


def scored(q_ids, q, least, c_ids, c, turn, k: int):
    """Of one block against another: the ``k`` best of each query that reach ``least``."""
    qr, cr = q @ turn, c @ turn
    d = q.shape[1]
    q_rest, c_rest = (np.sqrt(np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]) for r in (qr, cr))
    slack = 0.5 + 1e-9 * q_rest[:, :1] * c_rest[:, 0].max(initial=0)
    i, j = np.nonzero(q_rest[:, :1] * c_rest[None, :, 0] >= least[:, None] - slack)
    partial = np.zeros(len(i))
    for at in range(0, d, STEP):
        to = min(d, at + STEP)
        if len(i) * 8 > len(q) * len(c):
            partial += (qr[:, at:to] @ cr[:, at:to].T)[i, j]
        else:
            partial += np.einsum("nd,nd->n", qr[i, at:to], cr[j, at:to])
        rest = q_rest[i, to] * c_rest[j, to] if to < d else 0
        stay = (partial + rest >= least[i] - slack[i, 0]) & (q_ids[i] != c_ids[j])
        i, j, partial = i[stay], j[stay], partial[stay]
    score = np.einsum("nd,nd->n", q[i], c[j])
    stay = score >= least[i]
    i, j, score = i[stay], j[stay], score[stay]
    order = np.lexsort((c_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    best = place < k
    return i[best], c_ids[j[best]], score[best]


def _meet(pairs: DataFrame, turn, d: int, k: int) -> DataFrame:
    """Block pairs to ``query_id, vec_id, score``."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                least = np.frombuffer(r["least"], np.float64)
                i, found, score = scored(ids, np.frombuffer(r["q_xs"], np.int64).reshape(-1, d), least, c_ids, np.frombuffer(r["xs"], np.int64).reshape(-1, d), turn.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return pairs.select("q_ids", "q_xs", "least", "ids", "xs").mapInArrow(run, "query_id long, vec_id long, score long")


def top(vectors: DataFrame, queries, k: int = 10, scale: int = 1024, groups: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each query.

    ``queries`` is a condition on ``vec_id``. Blocks of candidates are dealt to ``groups``
    tasks; each block of queries goes to every group.
    """
    spark = vectors.sparkSession
    made = cut(integers(vectors, scale))
    d = made.agg(F.max(F.size("x"))).first()[0] or 1
    turn = spark.sparkContext.broadcast(rotation(made, d))
    groups = groups or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = made.repartitionByRange(groups, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = cut(packed(ordered, d, BLOCK).withColumn("number", F.monotonically_increasing_id()))
    asked = made.where(queries).groupBy("vec_id").agg(F.min("x").alias("x"), F.max("norm").alias("norm"))
    asked = asked.repartitionByRange(groups, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    asked = cut(packed(asked, d, QUERY_BLOCK).select(F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"), F.col("n").alias("q_n")).withColumn("q", F.monotonically_increasing_id()))
    head = blocks.orderBy(F.desc("top"), "number").limit(1)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    none = F.udf(lambda n: np.full(n, -np.inf).tobytes(), "binary")
    first = asked.withColumn("least", none("q_n")).join(F.broadcast(head.select("ids", "xs", "number")), F.lit(True))
    found = cut(_meet(first.repartition(groups, "q"), turn, d, k))
    beat = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
    return _rest(asked, blocks, head, found, beat, turn, d, k, groups, best)


def _rest(asked, blocks, head, found, beat, turn, d, k, groups, best):
    """The blocks after the first one, for the queries that they can still change."""

    def spread(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_xs"], np.int64).reshape(-1, d)
                norm = np.sqrt((x.astype(float) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["q"])), pa.array(ids), pa.array(norm)], ["q", "query_id", "norm"])

    own = asked.mapInArrow(spread, "q long, query_id long, norm double").join(beat, "query_id", "left")
    # in the order of the block's ids; the length a vector needs to reach the score of some query
    reach = F.min(F.when(F.col("least").isNull() | (F.col("least") <= 0), F.lit(0.0)).otherwise((F.col("least") - 1) / F.col("norm"))).alias("reach")
    asked = asked.join(own.groupBy("q").agg(F.collect_list(F.struct("query_id", "least")).alias("known"), reach), "q")

    def with_least(batches):
        for batch in batches:
            least = []
            for ids, known in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                of = {x["query_id"]: x["least"] for x in known}
                least.append(np.array([-np.inf if of[i] is None else of[i] for i in np.frombuffer(ids, np.int64).tolist()], float).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(least), batch.column(4)], ["q", "q_ids", "q_xs", "least", "reach"])

    asked = asked.select("q", "q_ids", "q_xs", "known", "reach").mapInArrow(with_least, "q long, q_ids binary, q_xs binary, least binary, reach double")
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    others = blocks.join(F.broadcast(head.select("number")), "number", "left_anti").withColumn("g", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"))
    pairs = others.join(asked, "g").where("top >= reach")
    every = found.union(_meet(pairs, turn, d, k)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return every.select("query_id", "rank", "vec_id", "score")
