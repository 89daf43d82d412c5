"""A dense index in the order of a table, and buckets of so many rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbframe.session import cut

#: Rows of a bucket.
BUCKET = 1 << 16
_ROW = (1 << 33) - 1


def indexed(df: DataFrame, order: list[str], name: str = "_at") -> DataFrame:
    """``df`` with its rows' places, 0, 1, 2 .. by ``order``, in ``name``.

    Rows are dealt to tasks by ranges of the whole order, not by a key, so a key with a
    third of all rows is spread as any other. What is joined is one row a task.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at_rest = cut(ordered.withColumn(name, F.monotonically_increasing_id()))
    task = F.shiftright(name, 33)
    held = at_rest.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    placed = at_rest.withColumn("_task", task).join(F.broadcast(base), "_task")
    return placed.withColumn(name, F.col("_base") + F.col(name).bitwiseAND(F.lit(_ROW))).drop("_task", "_base")


def bucket(size: int = BUCKET, name: str = "_at") -> Column:
    """The bucket of each row; it grows with the order and never holds more than ``size`` rows."""
    return F.floor(F.col(name) / size)
