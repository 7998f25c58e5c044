"""Yearly co-occurrence networks: document frequency, edges, selection and colouring."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Scratch
from .graph import connected_components

CS, OTHER, CROSS = "#7b1fa2", "#9e9e9e", "#ce93d8"


def doc_freq(postings: DataFrame) -> DataFrame:
    """``year, phrase, df``: documents per phrase."""
    return postings.groupBy("year", "phrase").agg(F.count(F.lit(1)).alias("df"))


def edges(postings: DataFrame, *extra) -> DataFrame:
    """``year, a, b, w`` with ``a < b``: documents that hold both phrases.

    The self join runs on the document, so its fan-out is bounded by the square of the phrases in
    one document whatever the phrase frequencies; counts combine before they are shuffled.
    """
    left = postings.select("year", "doc", F.col("phrase").alias("a"), *extra)
    right = postings.select(F.col("doc").alias("doc_"), F.col("phrase").alias("b"))
    pairs = left.join(right, (F.col("doc") == F.col("doc_")) & (F.col("a") < F.col("b")))
    return pairs.groupBy("year", "a", "b").agg(F.count(F.lit(1)).alias("w"))


def category_edges(postings: DataFrame, is_cs) -> DataFrame:
    """``year, a, b, w, n_cs, n_oth``: edge weights split by the document's category."""
    left = postings.select("year", "doc", F.col("phrase").alias("a"), is_cs.alias("cs"))
    right = postings.select(F.col("doc").alias("doc_"), F.col("phrase").alias("b"))
    pairs = left.join(right, (F.col("doc") == F.col("doc_")) & (F.col("a") < F.col("b")))
    n_cs = F.sum(F.col("cs").cast("long"))
    return pairs.groupBy("year", "a", "b").agg(F.count(F.lit(1)).alias("w"), n_cs.alias("n_cs"), (F.count(F.lit(1)) - n_cs).alias("n_oth"))


def both_ways(e: DataFrame) -> DataFrame:
    """``year, x, c, w``: every edge from both ends."""
    return e.select("year", F.col("a").alias("x"), F.col("b").alias("c"), "w").union(e.select("year", "b", "a", "w"))


def top_edges(e: DataFrame, n: int, score="w", least: int = 0) -> DataFrame:
    """The ``n`` best edges, ties by name; a top-n heap per task, then one merge."""
    return e.where(F.col("w") >= least).orderBy(F.desc(score), "a", "b").limit(n)


def pmi_edges(e: DataFrame, df: DataFrame, totals: DataFrame, least: int = 5, share: float = 0.2, base: int = 2) -> DataFrame:
    """Edges with positive PMI and the blended score ``share * pmi + (1 - share) * log(w + 1)``."""
    a = df.select("year", F.col("phrase").alias("a"), F.col("df").alias("df_a"))
    b = df.select("year", F.col("phrase").alias("b"), F.col("df").alias("df_b"))
    joined = e.where(F.col("w") >= least).join(a, ["year", "a"]).join(b, ["year", "b"]).join(F.broadcast(totals), "year")  # totals: one row per year
    pmi = F.log2(F.col("w") * F.col("n_docs") / (F.col("df_a") * F.col("df_b")))
    blended = joined.withColumn("pmi", pmi).where("pmi > 0")
    weight = F.log2(F.col("w") + 1) if base == 2 else F.log10(F.col("w") + 1)
    return blended.select("year", "a", "b", "w", "pmi", (share * F.col("pmi") + (1 - share) * weight).alias("score"))


def docs_per_year(postings: DataFrame) -> DataFrame:
    return postings.groupBy("year").agg(F.count_distinct("doc").alias("n_docs"))


def discounted(e: DataFrame, w_cs: float) -> DataFrame:
    """Category-discounted weight ``w_cs * n_cs + n_oth`` beside the raw one."""
    return e.withColumn("n_eff", w_cs * F.col("n_cs") + F.col("n_oth"))


def edge_colors(e: DataFrame) -> DataFrame:
    share = F.col("n_cs") / (F.col("n_cs") + F.col("n_oth"))
    return e.withColumn("color", F.when(share > 0.6, CS).when(share < 0.4, OTHER).otherwise(CROSS))


def node_colors(e: DataFrame) -> DataFrame:
    ends = e.select("year", F.explode(F.array("a", "b")).alias("phrase"), "n_cs", "n_oth")
    share = F.sum("n_cs") / F.sum(F.col("n_cs") + F.col("n_oth"))
    return ends.groupBy("year", "phrase").agg(F.when(share > 0.5, CS).otherwise(OTHER).alias("color"))


def node_shares(df: DataFrame) -> DataFrame:
    total = F.broadcast(df.groupBy("year").agg(F.sum("df").alias("__total")))  # one row a year
    return df.join(total, "year").withColumn("share", F.col("df") / F.col("__total")).drop("__total")


def whitelist_edges(e: DataFrame, chosen: DataFrame, words: list[str], least: int = 5) -> DataFrame:
    """``chosen`` (year, a, b, w) with each listed word filled up to ``least`` edges by weight, where it has them.

    Words are taken together, not one after another: an edge two listed words share fills both.
    """
    listed = F.broadcast(chosen.sparkSession.createDataFrame([(w,) for w in words], "x string"))
    have = both_ways(chosen).join(listed, "x").groupBy("year", "x").agg(F.count(F.lit(1)).alias("have"))
    free = both_ways(e.join(chosen.select("year", "a", "b"), ["year", "a", "b"], "left_anti")).join(listed, "x").join(have, ["year", "x"], "left")
    ranked = free.withColumn("rn", F.row_number().over(W.partitionBy("year", "x").orderBy(F.desc("w"), "c"))).where(F.col("rn") <= least - F.coalesce("have", F.lit(0)))
    added = ranked.select("year", F.least("x", "c").alias("a"), F.greatest("x", "c").alias("b"), "w").distinct()
    return chosen.select("year", "a", "b", "w").union(added)


def components(chosen: DataFrame) -> DataFrame:
    """``node, component`` of a selected network, smallest name first."""
    return connected_components(chosen.select("a", "b"))


def patch_fragments(e: DataFrame, chosen: DataFrame, small: int = 10, least: int = 3, most: int = 600, penalty: float = 0.5) -> DataFrame:
    """Edges that tie small components to the largest one, by weight discounted with the trunk end's popularity."""
    parts = Scratch(e.sparkSession, "fragments").save(components(chosen))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    trunk = sizes.orderBy(F.desc("size"), "component").limit(1).select(F.col("component").alias("trunk"))
    kinds = parts.join(sizes, "component").join(F.broadcast(trunk), F.col("component") == F.col("trunk"), "left")
    trunk_nodes = kinds.where("trunk IS NOT NULL").select(F.col("node").alias("c"))
    loose = kinds.where(F.col("trunk").isNull() & (F.col("size") <= small)).select(F.col("node").alias("x"))
    both = both_ways(e.withColumn("year", F.lit(0))).select("x", "c", "w")
    popularity = both.groupBy("c").agg(F.sum("w").alias("pop"))
    tied = both.where(F.col("w") >= least).join(loose, "x").join(trunk_nodes, "c").join(popularity, "c")
    score = F.col("w") * F.pow(F.lit(penalty), 1 + F.log10(F.greatest(F.col("pop"), F.lit(1)).cast("double")))
    return tied.select(F.least("x", "c").alias("a"), F.greatest("x", "c").alias("b"), "w", score.alias("score")).orderBy(F.desc("score"), "a", "b").limit(most)
