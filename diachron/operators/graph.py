"""Connected components of an edge list by repeated contraction; nothing is collected."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b`` of any type that has an order).

    A component's smallest node names it. Each round every node hooks to its best neighbour or itself
    and the graph is contracted. Rounds alternate between the order of ids, which settles stars at once,
    and a random order, which shrinks chains by a constant share, so their number is logarithmic. Hooks
    are tables of their own, so joins deal both sides anew and a hub's edges can be split. The hooks of
    all rounds are composed once at the end.
    """
    store = Scratch(edges.sparkSession, "components")
    level = store.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not level.isEmpty():
        turn = len(rounds)
        rank = (lambda c: F.struct(F.col(c).alias("r"), F.col(c).alias("n"))) if turn % 2 == 0 else (lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("n")))  # noqa: B023
        best = level.select("a", "b").union(level.select("b", "a")).groupBy("a").agg(F.min(rank("b")).alias("best"))
        hooks = store.save(best.select(F.col("a").alias("u"), F.when(F.col("best") < rank("a"), F.col("best.n")).otherwise(F.col("a")).alias("m")))
        left = level.join(hooks, level["a"] == hooks["u"]).select(F.col("m").alias("x"), "b")
        right = left.join(hooks.select(F.col("u").alias("v"), F.col("m").alias("y")), F.col("b") == F.col("v")).where("x <> y")
        following = store.save(right.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        store.drop(level)
        rounds.append(hooks)
        level = following
    if not rounds:
        return level.select(F.col("a").alias("node"), F.col("b").alias("component"))
    mapping = rounds[0].select(F.col("u").alias("node"), F.col("m").alias("root"))
    for hooks in rounds[1:]:
        mapping = mapping.join(hooks, mapping["root"] == hooks["u"], "left").select("node", F.coalesce("m", "root").alias("root"))
    mapping = store.save(mapping)
    smallest = store.save(mapping.groupBy("root").agg(F.min("node").alias("component")))
    store.close(mapping, smallest)
    return mapping.join(smallest, "root").select("node", "component")
