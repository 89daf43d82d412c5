"""What grows with the input is never broadcast, however small Spark takes it to be."""

from pyspark.sql import functions as F

from orbframe.llm import graph, lines, near


def plans_of(monkeypatch, *modules):
    seen, cut = [], graph.cut

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for m in modules:
        monkeypatch.setattr(m, "cut", noted)
    return seen


def all_merge(plans):
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    return joins and all("SortMergeJoin" in j for j in joins)


def test_keys_of_nodes_are_not_broadcast(spark, monkeypatch):
    seen = plans_of(monkeypatch, graph)
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node long")
    keys_of = lambda df: df.select(F.explode(F.array(F.col("node") % 3, F.lit(7) + F.col("node") % 20)).alias("key"), F.lit(5).cast("long").alias("size"), "node")
    confirm = lambda pairs: pairs.where("a % 20 = b % 20")
    split = lambda members: members.select("pivot", "node", F.lit(5).cast("long").alias("size"), (F.col("pivot") % 20 == F.col("node") % 20).alias("linked"), F.array(F.col("node") % 20).alias("heads"), F.lit(5).cast("long").alias("reach"))
    got = graph.linked(nodes, keys_of, confirm, split)
    assert {tuple(r) for r in got.collect()} == {(i, i % 20) for i in range(60)}
    assert all_merge([*seen, got._jdf.queryExecution().executedPlan().toString()])


def test_signatures_are_not_broadcast(spark):
    signed = spark.createDataFrame([(i, [1] * near.COMPONENTS, 4) for i in range(4)], "node long, signature array<int>, n_shingles long")
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    got = near._agreeing(graph.cut(pairs), graph.cut(signed))
    assert got.count() == 2 and all_merge([got._jdf.queryExecution().executedPlan().toString()])


def test_keys_of_lines_are_not_broadcast(spark, monkeypatch):
    seen = plans_of(monkeypatch, lines, graph)
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    docs = spark.createDataFrame([(i, " ".join([*words[: i % 12], f"w{i}", *words[i % 12 :]]) + f"\nrow {i} alone") for i in range(24)], "doc_id long, text string")
    got = lines.groups(docs)
    assert got.count() == 48
    assert all_merge([*seen, got._jdf.queryExecution().executedPlan().toString()])
