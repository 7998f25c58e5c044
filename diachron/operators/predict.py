"""Link prediction: candidates, outcomes, series features, shapes and ranking rules."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from .network import edges
from .ranking import ranked, running

VARIANT = 0.4


def linked(postings: DataFrame, first: int, last: int) -> DataFrame:
    """``a, b``: pairs that share a document in the years."""
    return edges(postings.where(F.col("year").between(first, last)).withColumn("year", F.lit(0))).select("a", "b")


def ordered(df: DataFrame) -> DataFrame:
    """Unordered key ``lo, hi`` of a pair."""
    return df.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))


def unlinked(pairs: DataFrame, links: DataFrame) -> DataFrame:
    known = links.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    return ordered(pairs).join(known, ["lo", "hi"], "left_anti").drop("lo", "hi")


def not_variants(pairs: DataFrame) -> DataFrame:
    return pairs.where(tx.shared_tokens(F.col("a"), F.col("b")) <= VARIANT)


def two_hop(e: DataFrame, seeds: DataFrame, bridge_stop: list[str], top: int = 12) -> DataFrame:
    """``a, b, via, i``: per seed the strongest two-step ends it is not linked with. ``e``: a, b, w; ``seeds``: a."""
    ways = e.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").union(e.select("b", "a", "w"))
    bridges = ways.where(~F.col("y").isin(bridge_stop)) if bridge_stop else ways
    one = bridges.join(seeds.select(F.col("a").alias("x")), "x", "left_semi").select(F.col("x").alias("a"), F.col("y").alias("via"), F.col("w").alias("cw"))
    two = one.join(bridges.select(F.col("x").alias("via"), F.col("y").alias("b"), F.col("w").alias("cv")), "via").where("a <> b")
    apart = two.join(ways.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti")
    scored = apart.select("a", "b", "via", F.least("cw", "cv").alias("i"))
    return scored.withColumn("rn", F.row_number().over(W.partitionBy("a").orderBy(F.desc("i"), "b", "via"))).where(F.col("rn") <= top).drop("rn")


def deduped(pairs: DataFrame, order: list) -> DataFrame:
    """The first row of each unordered pair."""
    return ordered(pairs).withColumn("rn", F.row_number().over(W.partitionBy("lo", "hi").orderBy(*order))).where("rn = 1").drop("rn", "lo", "hi")


def mid_frequency(counts: DataFrame, low: int, high: int, most: int = 6000) -> DataFrame:
    """``phrase, n``: of the ``most`` most frequent phrases (then by name) those within a band."""
    return counts.orderBy(F.desc("n"), "phrase").limit(most).where(F.col("n").between(low, high))


def mid_frequency_pairs(counts: DataFrame, low: int, high: int, most: int = 6000) -> DataFrame:
    """``a, b, product``: pairs among the phrases of a band; at most ``most`` of them, which bounds pairs and broadcast."""
    hot = mid_frequency(counts, low, high, most)
    left, right = hot.select(F.col("phrase").alias("a"), F.col("n").alias("na")), hot.select(F.col("phrase").alias("b"), F.col("n").alias("nb"))
    return left.join(F.broadcast(right), F.col("a") < F.col("b")).select("a", "b", (F.col("na") * F.col("nb")).alias("product"))


def drawn_pairs(counts: DataFrame, seed: int, n: int) -> DataFrame:
    """``a, b, draw``: ``n`` draws of two hot phrases each, without draws of one phrase; the first draw of each pair.

    Phrases are numbered by name; draw k takes the numbers that digests of seed and k give, so the
    pairs are the same on every run and only those drawn are formed.
    """
    numbered = ranked(counts.select("phrase"), [F.asc("phrase")], "number")
    size = counts.agg(F.count(F.lit(1)).alias("size"))
    digest = lambda side: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.lit(side))), 1, 12), 16, 10).cast("long")
    draws = counts.sparkSession.range(n).crossJoin(F.broadcast(size.where("size > 0"))).select("id", (digest("a") % F.col("size") + 1).alias("x"), (digest("b") % F.col("size") + 1).alias("y"))  # size: one row
    drawn = draws.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("id").alias("draw"))
    one, two = numbered.select(F.col("number").alias("x"), F.col("phrase").alias("a")), numbered.select(F.col("number").alias("y"), F.col("phrase").alias("b"))
    return drawn.join(one, "x").join(two, "y").select("a", "b", "draw")


def random_control(counts: DataFrame, seed: int, n: int) -> DataFrame:
    """``a, b``: the distinct pairs of ``n`` draws of two hot phrases each."""
    return drawn_pairs(counts, seed, n).select("a", "b")


def equal_control(counts: DataFrame, links: DataFrame, seed: int, n: int, tries: int = 200) -> DataFrame:
    """``a, b``: the first ``n`` drawn pairs that pass the filters of the candidates, out of ``tries`` draws for each that is asked for."""
    fresh = unlinked(not_variants(drawn_pairs(counts, seed, n * tries)), links)
    return fresh.orderBy("draw").limit(n).select("a", "b")


def outcomes(pairs: DataFrame, yearly: DataFrame, early: tuple, late: tuple, least: int) -> DataFrame:
    """Adds hit, p1, p2, n_links, n_years_ge, max_n, first_link from yearly weights (year, a, b, w)."""
    keyed = ordered(pairs)
    seen = keyed.select("lo", "hi").join(yearly.select("year", F.col("a").alias("lo"), F.col("b").alias("hi"), "w"), ["lo", "hi"])
    span = seen.where(F.col("year").between(early[0], late[1]))
    top = lambda years: F.coalesce(F.max(F.when(F.col("year").between(*years), F.col("w"))), F.lit(0)).cast("long")
    agg = span.groupBy("lo", "hi").agg(
        top(early).alias("p1"), top(late).alias("p2"), F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("w") >= least).alias("n_years_ge"), F.max("w").alias("max_n"), F.min("year").alias("first_link")
    )
    out = keyed.join(agg, ["lo", "hi"], "left").drop("lo", "hi").na.fill(0, ["p1", "p2", "n_links", "n_years_ge", "max_n", "first_link"])
    return out.withColumn("hit", (F.col("p2") >= least) & (F.col("p2") > F.col("p1")))


def cv(values: Column) -> Column:
    """Population coefficient of variation over the positive values of a group; 0 below three of them."""
    v = F.when(values > 0, values)
    return F.when(F.count(v) >= 3, F.stddev_pop(v) / F.avg(v)).otherwise(0.0)


def g_features(series: DataFrame) -> DataFrame:
    """Per pair (a, b, year, g), positive values in year order: cv, peak, trapezoid area and slope of ln g by index."""
    w = W.partitionBy("a", "b").orderBy("year")
    v = series.where("g > 0").withColumn("i", F.row_number().over(w).cast("double")).withColumn("area", (F.col("g") + F.lag("g").over(w)) / 2)
    return v.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), cv(F.col("g")).alias("cv"), F.max("g").alias("peak"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"),
        F.when(F.count(F.lit(1)) >= 3, F.regr_slope(F.log("g"), F.col("i"))).otherwise(0.0).alias("slope"),
    )


def tail_slope(series: DataFrame) -> DataFrame:
    """``(mean of the last two - mean of the first two) / mean`` per pair of at least two values."""
    w = W.partitionBy("a", "b")
    v = series.withColumn("up", F.row_number().over(w.orderBy("year"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("year"))))
    last, first = F.avg(F.when(F.col("down") <= 2, F.col("g"))), F.avg(F.when(F.col("up") <= 2, F.col("g")))
    return v.groupBy("a", "b").agg(F.when(F.avg("g") != 0, (last - first) / F.avg("g")).otherwise(0.0).alias("tail_slope"))


def shape_features(series: DataFrame, years: list[int]) -> DataFrame:
    """Peak and its place, squared correlation with time, dominant frequency and cv; missing years count as 0."""
    n = len(years)
    cells = [F.coalesce(F.max(F.when(F.col("year") == y, F.col("g"))), F.lit(0.0)) for y in years]
    wide = series.groupBy("a", "b").agg(*[c.alias(f"v{i}") for i, c in enumerate(cells)])
    v = [F.col(f"v{i}") for i in range(n)]
    mean = sum(v) / n
    wide = wide.withColumn("mean", mean).withColumn("peak", F.greatest(*v))
    place = F.coalesce(*[F.when(v[i] == F.col("peak"), F.lit(i / (n - 1))) for i in range(n)])
    mid = (n - 1) / 2
    sxy = sum((i - mid) * (v[i] - F.col("mean")) for i in range(n))
    sxx, syy = sum((i - mid) ** 2 for i in range(n)), sum(F.pow(v[i] - F.col("mean"), F.lit(2)) for i in range(n))
    power = []
    for k in range(1, n // 2 + 1):
        re = sum(v[i] * math.cos(2 * math.pi * k * i / n) for i in range(n))
        im = sum(v[i] * math.sin(2 * math.pi * k * i / n) for i in range(n))
        power.append(F.round(re * re + im * im, 9))  # rounding noise must not choose between equal powers
    top = F.greatest(*power)
    frequency = F.coalesce(*[F.when(power[k] == top, F.lit((k + 1) / n)) for k in range(len(power))])
    return wide.select(
        "a", "b", "peak", place.alias("peak_pos"), F.when(syy > 1e-18, sxy * sxy / (sxx * syy)).otherwise(0.0).alias("lin_r2"), frequency.alias("frequency"), F.when(F.col("mean") > 0, F.sqrt(syy / n) / F.col("mean")).otherwise(0.0).alias("cv")
    )


def classify_shape(values: Column) -> Column:
    """The shape of a series from the array of its non-null values in year order."""
    v = values
    top = F.array_max(v)
    n = F.transform(v, lambda x: x / top)
    size = F.size(v)
    first, last, third = n[0], F.element_at(n, -1), F.element_at(n, -3)
    peaks = F.filter(F.sequence(F.lit(1), size - 2), lambda i: (n[i] >= n[i - 1]) & (n[i] > n[i + 1]) & (n[i] >= 0.85))
    falls = (F.size(peaks) > 0) & (n[F.element_at(peaks, -1)] - last > 0.2)
    tail = last - third
    return (
        F.when(size < 5, "insufficient").when(top <= 0, "all-zero").when(falls, "rise-then-fall").when((last > 1.5 * first) & (tail > 0.05), "mono-rise")
        .when((last > 1.2 * first) & (F.abs(tail) <= 0.05), "rise-plateau").when((F.abs(last - first) <= 0.15) & (F.array_max(n) - F.array_min(n) <= 0.3), "flat").otherwise("volatile")
    )


def series_summary(series: DataFrame) -> DataFrame:
    v = series.where("g IS NOT NULL")
    return v.groupBy("a", "b").agg(
        F.min_by("g", "year").alias("first"), F.max_by("g", "year").alias("last"), F.avg("g").alias("mean"), F.max_by("year", F.struct("g", (-F.col("year")).alias("y"))).alias("peak_year"),
        F.sort_array(F.collect_list(F.struct("year", "g"))).alias("points"),
    ).withColumn("shape", classify_shape(F.transform("points", lambda p: p["g"]))).drop("points")


def bucket_hits(rows: DataFrame, bucket: Column, least: int = 10) -> DataFrame:
    """``bucket, n, rate``: hit rate of each bucket with enough rows."""
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("rate")).where(F.col("n") >= least)


def feature_auc(rows: DataFrame, feature: str) -> DataFrame:
    """Area under the curve of a feature for ``hit`` by rank sums with average ranks, over distinct values.

    NaN where all rows hit or none does; without rows ``n_rows`` is 0 and the others are null.
    """
    by_value = rows.groupBy(F.col(feature).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("p"))
    summed = running(by_value, [F.asc("v")], F.col("n"), "upto").withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    p, n = F.sum("p"), F.coalesce(F.sum("n"), F.lit(0))
    pairs = F.nullif(p * (n - p), F.lit(0))
    auc = F.coalesce((F.sum(F.col("rank") * F.col("p")) - p * (p + 1) / 2) / pairs, F.when(n > 0, float("nan")))
    return summed.agg(p.alias("n_hits"), n.alias("n_rows"), auc.alias("auc"))


def greedy_fields(ranked: DataFrame, per_field: dict[str, int], depth: int = 64) -> list[tuple[str, str, int]]:
    """Takes each field's best phrases that no earlier field took. ``ranked``: field, phrase, n.

    Fields are few and each contributes its ``depth`` best rows, so the ordered pass is over a
    bounded list; ``depth`` exceeds the sum of all quotas, which makes the pass exact.
    """
    need = max(depth, sum(per_field.values()) + 1)
    w = W.partitionBy("field").orderBy(F.desc("n"), "phrase")
    rows = ranked.where(F.col("field").isin(list(per_field))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= need).orderBy("field", "rn").collect()
    taken: set[str] = set()
    out = []
    for f, quota in per_field.items():
        for r in (x for x in rows if x.field == f and x.phrase not in taken):
            if quota == 0:
                break
            taken.add(r.phrase)
            out.append((f, r.phrase, r.n))
            quota -= 1
    return out
