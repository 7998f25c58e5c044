"""Effective conductance between two phrases, year by year, without linear algebra.

The sub-network of a pair has the edge A-B and edges from both to their strongest neighbours, so
paths other than the direct edge run through shared neighbours only: two resistors in series each,
all in parallel. Where A and B are not connected the pseudo-inverse of the two stars still gives
a finite value, kept under the flag ``connected = false``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Scratch
from .network import both_ways


def ranked_neighbours(e: DataFrame) -> DataFrame:
    """``year, x, c, w, rnk``: neighbours of every phrase by falling weight, then name."""
    return both_ways(e).withColumn("rnk", F.row_number().over(W.partitionBy("year", "x").orderBy(F.desc("w"), "c")))


def conductance(e: DataFrame, pairs: DataFrame, k: int = 10) -> DataFrame:
    """``a, b, year, w_ab, g_raw, base, connected`` for each pair (a, b) and year in which either has neighbours.

    Ranks are taken once for all pairs; leaving out the partner is a shift by one below its rank.
    ``base`` is the largest weight in the sub-network.
    """
    store = Scratch(e.sparkSession, "conductance")
    ends = store.save(pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct())
    near = store.save(both_ends(e, ends))  # the pairs' own edges, read for ranks and for the direct ones
    ranked = store.save(ranked_neighbours(near).join(ends, "x"))
    sides = []
    for me, other in (("a", "b"), ("b", "a")):
        own = pairs.join(ranked, pairs[me] == ranked["x"]).select("a", "b", "year", "c", "w", "rnk")
        partner = ranked.select("year", F.col("x").alias(me), F.col("c").alias(other), F.col("rnk").alias("prnk"))
        kept = own.join(partner, ["year", "a", "b"], "left").where(F.col("c") != F.col(other))
        kept = kept.where(F.col("rnk") - F.when(F.col("prnk") < F.col("rnk"), 1).otherwise(0) <= k)
        sides.append(kept.select("a", "b", "year", "c", F.lit(me).alias("side"), "w"))
    legs = sides[0].union(sides[1]).groupBy("a", "b", "year", "c").agg(
        F.max(F.when(F.col("side") == "a", F.col("w"))).alias("wa"), F.max(F.when(F.col("side") == "b", F.col("w"))).alias("wb")
    )
    wa, wb = F.col("wa").cast("double"), F.col("wb").cast("double")
    star = legs.groupBy("a", "b", "year").agg(
        F.sum(F.when(wa.isNotNull() & wb.isNotNull(), wa * wb / (wa + wb))).alias("through"),
        F.sum(1 / wa).alias("sa"), F.count("wa").alias("ma"), F.sum(1 / wb).alias("sb"), F.count("wb").alias("mb"),
        F.max(F.greatest(F.coalesce("wa", F.lit(0)), F.coalesce("wb", F.lit(0)))).alias("top"),
    )
    low, high = F.least("a", "b"), F.greatest("a", "b")
    direct = pairs.select("a", "b", low.alias("lo"), high.alias("hi")).join(near.select("year", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("w").alias("w_ab")), ["lo", "hi"]).select("a", "b", "year", "w_ab")
    both = star.join(direct, ["a", "b", "year"], "full").na.fill({"w_ab": 0, "top": 0, "sa": 0.0, "sb": 0.0, "ma": 0, "mb": 0})
    connected = (F.col("w_ab") > 0) | F.col("through").isNotNull()
    apart = F.col("sa") / F.pow(F.col("ma") + 1, F.lit(2)) + F.col("sb") / F.pow(F.col("mb") + 1, F.lit(2))
    g = F.when(connected, F.col("w_ab") + F.coalesce("through", F.lit(0.0))).otherwise(F.when(apart > 0, 1 / apart).otherwise(0.0))
    return both.select("a", "b", "year", F.col("w_ab").cast("long").alias("w_ab"), g.alias("g_raw"), F.greatest("w_ab", "top").cast("long").alias("base"), connected.alias("connected"))


def both_ends(e: DataFrame, ends: DataFrame) -> DataFrame:
    """The edges that touch a phrase of ``ends``; other ranks are not needed."""
    left = e.join(ends.select(F.col("x").alias("a")), "a", "left_semi").select("year", "a", "b", "w")
    right = e.join(ends.select(F.col("x").alias("b")), "b", "left_semi").select("year", "a", "b", "w")
    return left.union(right).distinct()


def normalised(g: DataFrame) -> DataFrame:
    """Adds ``g``: conductance over weights scaled by the largest, rounded to 4; 0 below 1e-6 of resistance."""
    value = F.when(F.col("base") > 0, F.col("g_raw") / F.col("base")).otherwise(0.0)
    return g.withColumn("g", F.when((value > 0) & (1 / value > 1e-6), F.round(value, 4)).otherwise(0.0))


def year_max_norm(g: DataFrame) -> DataFrame:
    """``g_norm``: raw conductance over the year's largest among all pairs, null where not positive."""
    top = F.broadcast(g.groupBy("year").agg(F.max(F.when(F.col("g_raw") > 0, F.col("g_raw"))).alias("__top")))  # one row a year
    return g.join(top, "year").withColumn("g_norm", F.when(F.col("g_raw") > 0, F.round(F.col("g_raw") / F.col("__top"), 4))).drop("__top")


def group_norm(g: DataFrame, maxima: DataFrame) -> DataFrame:
    """Against a table of group maxima (grp, year, g_max), clamped at 1 and rounded to 4."""
    return g.join(maxima, ["grp", "year"], "left").withColumn("g_group", F.round(F.least(F.lit(1.0), F.col("g_raw") / F.col("g_max")), 4))


def resistance(g: Column) -> Column:
    return F.when(g > 0, F.round(1 / g, 4))


def last_three(g: DataFrame, value: str = "g_norm") -> DataFrame:
    """``a, b, v1, v2, v3``: the last three non-null values in year order, of pairs that have three."""
    w = W.partitionBy("a", "b").orderBy(F.desc("year"))
    ranked = g.where(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    pick = lambda r: F.max(F.when(F.col("rn") == r, F.col(value)))
    return ranked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), pick(3).alias("v1"), pick(2).alias("v2"), pick(1).alias("v3")).where("n = 3").drop("n")


def trend_badge(g: DataFrame, threshold: float = 0.5, value: str = "g_norm") -> DataFrame:
    t = last_three(g, value)
    above = sum((F.col(c) >= threshold).cast("int") for c in ("v1", "v2", "v3"))
    return t.select("a", "b", (above >= 2).alias("above"), (F.col("v3") > F.col("v1")).alias("rising"), (above >= 2).__and__(F.col("v3") > F.col("v1")).alias("warning"))


def distance_window(g: DataFrame, first: int, last: int) -> DataFrame:
    """Last positive raw value inside the window; last positive normalised value of the whole series; the alert."""
    raw = F.max_by(F.when((F.col("g_raw") > 0) & F.col("year").between(first, last), F.col("g_raw")), F.when((F.col("g_raw") > 0) & F.col("year").between(first, last), F.col("year")))
    norm = F.max_by(F.when(F.col("g_norm") > 0, F.col("g_norm")), F.when(F.col("g_norm") > 0, F.col("year")))
    return g.groupBy("a", "b").agg(raw.alias("g_last_raw"), norm.alias("g_norm_last"), F.coalesce(norm >= 0.5, F.lit(False)).alias("alert"))


def pre_burst(g: DataFrame, bursts: DataFrame, value: str = "g_norm") -> DataFrame:
    """``bursts``: a, b, burst. Mean of the five years before, of the years before those, and the relative rise."""
    j = g.where(F.col(value).isNotNull()).join(bursts, ["a", "b"])
    pre = F.avg(F.when((F.col("year") >= F.col("burst") - 5) & (F.col("year") < F.col("burst")), F.col(value)))
    early = F.avg(F.when(F.col("year") < F.col("burst") - 5, F.col(value)))
    return j.groupBy("a", "b").agg(pre.alias("pre_avg"), early.alias("early_avg"), F.when(early != 0, (pre - early) / early).alias("pre_rise"))
