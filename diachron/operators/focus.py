"""The two-hop subgraph around some focus phrases."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Scratch
from . import dynamics as dyn

#: Focus phrases of one subgraph.
MOST = 5
# Colours of the three hops in the standard theme.
HOPS = ("#e63946", "#457b9d", "#a8dadc")


def focus_terms(words: DataFrame, mapping: DataFrame, most: int = MOST) -> DataFrame:
    """``at, term``: at most ``most`` focus phrases, each as the annotation names it.

    ``words``: at, phrase, in order; blank ones go. ``mapping``: variant, merged. Two words that the
    mapping makes one are one term, at the first place.
    """
    asked = words.select("at", F.lower(F.trim("phrase")).alias("phrase")).where("phrase <> ''").orderBy("at").limit(most)
    named = asked.join(mapping.select(F.col("variant").alias("phrase"), "merged"), "phrase", "left")
    return named.groupBy(F.coalesce("merged", "phrase").alias("term")).agg(F.min("at").alias("at")).select("at", "term")


def year_modes(years: DataFrame, first: int = 1991) -> DataFrame:
    """``year, mode, before``: what can be drawn of a year: itself, against the year before, and over three years."""
    modes = [("static", 0), ("speed", 1), ("accel", 2)]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(back).alias("back")) for m, back in modes]))
    out = years.select(F.col("year").cast("long").alias("year"), rows.alias("m")).where((F.col("m.back") == 0) | (F.col("year") - F.col("m.back") >= first))
    return out.select("year", "m.mode", (F.col("year") - F.col("m.back")).alias("before"))


def _capped(values: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """One row each: the caps of the positive and of the negative values' sizes."""
    up = dyn.percentile_exclusive(values.where(F.col(column) > 0), column).withColumnRenamed("cap", "up")
    down = dyn.percentile_exclusive(values.where(F.col(column) < 0).withColumn(column, -F.col(column)), column).withColumnRenamed("cap", "down")
    return up, down


def _coloured(values: DataFrame, column: str, colours: tuple) -> DataFrame:
    """Adds ``color``: the ramp of a signed value up to the 95th percentile of its sign."""
    for cap in _capped(values, column):
        values = values.join(F.broadcast(cap), F.lit(True), "left")  # one row
    return values.withColumn("color", dyn.ramp(F.col(column), F.coalesce("up", F.lit(0.0)), F.coalesce("down", F.lit(0.0)), colours)).drop("up", "down")


def _sized(nodes: DataFrame, edge_list: DataFrame, largest: float) -> DataFrame:
    """Adds ``size`` from ``df``, by the number of nodes and edges."""
    n = edge_list.agg(F.count(F.lit(1)).alias("n_edges"))
    m = nodes.agg(F.min("df").alias("lo"), F.max("df").alias("hi"), F.count(F.lit(1)).alias("n_nodes")).crossJoin(F.broadcast(n))
    m = m.select("lo", "hi", dyn.adaptive_max(F.col("n_nodes"), F.col("n_edges"), largest).alias("big"))
    return nodes.crossJoin(F.broadcast(m)).withColumn("size", dyn.node_size(F.col("df"), F.col("lo"), F.col("hi"), 5.0, F.col("big"))).drop("lo", "hi", "big")  # m: one row


def _widened(edge_list: DataFrame) -> DataFrame:
    m = edge_list.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    return edge_list.crossJoin(F.broadcast(m)).withColumn("width", dyn.edge_width(F.col("w"), F.col("lo"), F.col("hi"))).drop("lo", "hi")  # m: one row


def static_tables(chosen: DataFrame, df: DataFrame, year: int, largest: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (phrase, df, size) and edges (a, b, w, width) of one year's selected edges ``chosen`` (a, b, w). ``df``: year, phrase, df."""
    ends = chosen.select(F.explode(F.array("a", "b")).alias("phrase")).distinct()
    nodes = ends.join(df.where(F.col("year") == year).select("phrase", "df"), "phrase", "left").na.fill(0, ["df"])
    return _sized(nodes, chosen, largest), _widened(chosen.select("a", "b", "w"))


def change_tables(chosen: DataFrame, df: DataFrame, year: int, mode: str, largest: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as :func:`static_tables` with ``change`` and ``color``: log fold change of shares
    against the year before (``speed``) or their second difference over three years (``accel``).

    An edge's count in a year is the sum of its ends' document frequencies.
    """
    nodes, sides = static_tables(chosen, df, year, largest)
    colours, column = (dyn.SPEED, "speed") if mode == "speed" else (dyn.ACCEL, "accel")
    moved = lambda counts, keys: dyn.speed(counts, keys, year, year - 1) if mode == "speed" else dyn.accel(counts, keys, year)
    by_node = moved(df.withColumnRenamed("df", "n"), ["phrase"]).select("phrase", F.col(column).alias("change"))
    by_edge = moved(dyn.endpoint_counts(chosen, df), ["a", "b"]).select("a", "b", F.col(column).alias("change"))
    return _coloured(nodes.join(by_node, "phrase"), "change", colours), _coloured(sides.join(by_edge, ["a", "b"]), "change", colours)


def focus_tables(nodes: DataFrame, edge_list: DataFrame, df: DataFrame, yearly: DataFrame, year: int, mode: str) -> tuple[DataFrame, DataFrame]:
    """A focus subgraph's nodes (node, hop, change, color) and edges (a, b, w, change, color).

    ``nodes`` and ``edge_list`` come from :func:`focus_subgraph`; ``yearly``: year, a, b, w. Static nodes take
    the colour of their hop, others a signed colour; an edge changes by its own weight's share among the
    subgraph's edges. Counts of other phrases and edges do not enter.
    """
    kept = df.join(F.broadcast(nodes.select(F.col("node").alias("phrase"))), "phrase", "left_semi").withColumnRenamed("df", "n")
    weights = focus_edge_weights(edge_list, yearly).withColumnRenamed("w", "n")
    if mode == "static":
        hue = F.element_at(F.array(*map(F.lit, HOPS)), F.least(F.col("hop"), F.lit(2)).cast("int") + 1)
        zero = F.lit(0.0)
        return nodes.select("node", "hop", zero.alias("change"), hue.alias("color")), edge_list.select("a", "b", "w", zero.alias("change"), F.lit(HOPS[2]).alias("color"))
    colours, column = (dyn.SPEED, "speed") if mode == "speed" else (dyn.ACCEL, "accel")
    moved = lambda counts, keys: dyn.speed(counts, keys, year, year - 1) if mode == "speed" else dyn.accel(counts, keys, year)
    by_node = nodes.join(moved(kept, ["phrase"]).select(F.col("phrase").alias("node"), F.col(column).alias("change")), "node", "left").na.fill(0.0, ["change"])
    by_edge = edge_list.join(moved(weights, ["a", "b"]).select("a", "b", F.col(column).alias("change")), ["a", "b"], "left").na.fill(0.0, ["change"])
    return _coloured(by_node, "change", colours), _coloured(by_edge, "change", colours)


def focus_edge_weights(edge_list: DataFrame, yearly: DataFrame) -> DataFrame:
    """``year, a, b, w``: the weights of a subgraph's edges in every year that has them."""
    return yearly.join(F.broadcast(edge_list.select("a", "b")), ["a", "b"], "left_semi").select("year", "a", "b", "w")


def focus_subgraph(e: DataFrame, focus: list[str], k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, hop) and edges (a, b, w) of one year's network ``e`` (a, b, w).

    Hop 1: the ``k`` strongest neighbours of each focus phrase; hop 2: of each hop-1 phrase the
    ``k`` strongest outside both. Kept are edges among focus phrases, to hop 1, and from a hop-1
    phrase to the hop-2 phrases it selected. Node tables hold at most ``len(focus) * k * (k + 1)``
    rows, so they are broadcast.
    """
    ways = e.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").union(e.select("b", "a", "w"))
    store = Scratch(e.sparkSession, "focus")
    strongest = W.partitionBy("x").orderBy(F.desc("w"), "y")
    zero = store.save(ways.where(F.col("x").isin(focus)).select(F.col("x").alias("node")).distinct())
    one = store.save(ways.where(F.col("x").isin(focus)).withColumn("rn", F.row_number().over(strongest)).where(F.col("rn") <= k).select(F.col("y").alias("node")).distinct())
    inner = zero.union(one).distinct()
    outside = ways.join(F.broadcast(one.select(F.col("node").alias("x"))), "x").join(F.broadcast(inner.select(F.col("node").alias("y"))), "y", "left_anti")
    chosen = store.save(outside.withColumn("rn", F.row_number().over(strongest)).where(F.col("rn") <= k).select("x", "y", "w"))
    hops = zero.withColumn("hop", F.lit(0)).union(one.withColumn("hop", F.lit(1))).union(chosen.select(F.col("y").alias("node"), F.lit(2).alias("hop")))
    nodes = hops.groupBy("node").agg(F.min("hop").alias("hop"))
    marks = nodes.where("hop < 2")
    near = e.join(F.broadcast(marks.select(F.col("node").alias("a"), F.col("hop").alias("ha"))), "a").join(F.broadcast(marks.select(F.col("node").alias("b"), F.col("hop").alias("hb"))), "b")
    kept = near.where("ha + hb <= 1").select("a", "b", "w")
    far = chosen.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")
    return nodes, kept.union(far).distinct()


def focus_sizes(df: DataFrame, largest: float, drop: float = 0.08, floor: float = 0.6) -> DataFrame:
    """``phrase, size``: focus phrases step down a little with their rank by document frequency."""
    rank = F.row_number().over(W.orderBy(F.desc("df"), "phrase")) - 1
    return df.select("phrase", F.greatest(largest - rank * (largest * drop), F.lit(largest * floor)).alias("size"))
