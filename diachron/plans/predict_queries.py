"""Link prediction on the sparse vocabulary, series analytics on the dense one."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import network as net
from ..operators import predict as pr
from ..sources import papers as src
from ..storage import Scratch
from .catalog import POST, SPARSE, query
from .network_queries import _G, _GN, _g, cond

TRAIN, EARLY, LATE = (1995, 1997), (1998, 1999), (2000, 2001)
_SHARE = "len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / greatest(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' '))))"
_LINKED = "lk AS (SELECT DISTINCT p.phrase AS a, q.phrase AS b FROM post p JOIN post q ON p.doc = q.doc AND p.phrase < q.phrase WHERE p.year BETWEEN 1995 AND 1997)"
_E97 = "e AS (SELECT p.phrase AS a, q.phrase AS b, count(*) AS w FROM post p JOIN post q ON p.doc = q.doc AND p.phrase < q.phrase WHERE p.year = 1997 GROUP BY ALL), wy AS (SELECT a AS x, b AS y, w FROM e UNION ALL SELECT b, a, w FROM e)"
_SEEDS = "sd AS (SELECT phrase AS a FROM (SELECT phrase, count(*) AS n FROM post WHERE year = 1997 GROUP BY phrase ORDER BY n DESC, phrase LIMIT 20))"
_TWO = f"{SPARSE}, {_LINKED}, {_E97}, {_SEEDS}, th AS (SELECT s.x AS a, t.y AS b, s.y AS via, least(s.w, t.w) AS i FROM wy s JOIN sd ON s.x = sd.a JOIN wy t ON t.x = s.y WHERE t.y <> s.x AND NOT EXISTS (SELECT 1 FROM wy z WHERE z.x = s.x AND z.y = t.y) QUALIFY row_number() OVER (PARTITION BY s.x ORDER BY least(s.w, t.w) DESC, t.y, s.y) <= 12)"
_C15 = f"{_TWO}, cd AS (SELECT * FROM th WHERE {_SHARE} <= 0.4 AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.a = least(th.a, th.b) AND lk.b = greatest(th.a, th.b)) QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY i DESC, a, via) = 1)"
_YW = "yw AS (SELECT p.year, p.phrase AS lo, q.phrase AS hi, count(*) AS w FROM post p JOIN post q ON p.doc = q.doc AND p.phrase < q.phrase WHERE p.year >= 1998 GROUP BY ALL)"


def _out_sql(cand: str) -> str:
    return f"""{_YW}, ag AS (SELECT a, b, coalesce(max(w) FILTER (WHERE year <= 1999), 0) AS p1, coalesce(max(w) FILTER (WHERE year >= 2000), 0) AS p2, count(w) AS n_links, count(*) FILTER (WHERE w >= 1) AS n_years_ge, coalesce(max(w), 0) AS max_n, coalesce(min(year), 0) AS first_link
 FROM {cand} c LEFT JOIN yw ON lo = least(a, b) AND hi = greatest(a, b) GROUP BY a, b), oc AS (SELECT *, p2 >= 1 AND p2 > p1 AS hit FROM ag)"""


def sparse(spark, d):
    return Scratch(spark, "postings").save(src.postings(spark, d, "sparse"))


def _parts(spark, d):
    p = sparse(spark, d)
    e = Scratch(spark, "year").save(net.edges(p.where("year = 1997")).select("a", "b", "w"))
    seeds = p.where("year = 1997").groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "phrase").limit(20).select(F.col("phrase").alias("a"))
    return p, pr.two_hop(e, F.broadcast(seeds), [])  # 20 seeds


@query("two_hop", f"WITH {_TWO} SELECT a, b, via, i FROM th")
def two_hop(spark, d):
    return _parts(spark, d)[1].select("a", "b", "via", "i")


def _c15(spark, d):
    p, found = _parts(spark, d)
    fresh = pr.unlinked(pr.not_variants(found), pr.linked(p, *TRAIN))
    return p, Scratch(spark, "candidates").save(pr.deduped(fresh, [F.desc("i"), "a", "via"]))


@query("candidates_2015", f"WITH {_C15} SELECT a, b, via, i FROM cd")
def candidates_2015(spark, d):
    return _c15(spark, d)[1].select("a", "b", "via", "i")


@query("dedupe_pairs", f"WITH {_TWO} SELECT least(a, b) AS lo, greatest(a, b) AS hi, max(i) AS i FROM th GROUP BY ALL")
def dedupe_pairs(spark, d):
    kept = pr.deduped(_parts(spark, d)[1], [F.desc("i"), "a", "via"])
    return kept.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "i")


_C16 = f"{SPARSE}, {_LINKED}, ct AS (SELECT phrase, count(*) AS n FROM post WHERE year = 1997 GROUP BY phrase ORDER BY n DESC, phrase LIMIT 6000), ho AS (SELECT * FROM ct WHERE n BETWEEN 3 AND 40), pp AS (SELECT x.phrase AS a, y.phrase AS b, x.n * y.n AS product FROM ho x JOIN ho y ON x.phrase < y.phrase), cd AS (SELECT * FROM pp WHERE {_SHARE} <= 0.4 AND (a, b) NOT IN (SELECT (a, b) FROM lk) ORDER BY product DESC, a, b LIMIT 400)"


def _c16(spark, d):
    p = sparse(spark, d)
    counts = p.where("year = 1997").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    pairs = pr.unlinked(pr.not_variants(pr.mid_frequency_pairs(counts, 3, 40)), pr.linked(p, *TRAIN))
    return p, Scratch(spark, "candidates").save(pairs.orderBy(F.desc("product"), "a", "b").limit(400))


@query("candidates_2016", f"WITH {_C16} SELECT a, b, product FROM cd")
def candidates_2016(spark, d):
    return _c16(spark, d)[1].select("a", "b", "product")


@query("candidates_2026", f"WITH {_TWO}, c7 AS (SELECT * FROM th WHERE i BETWEEN 1 AND 40 AND {_SHARE} <= 0.4 QUALIFY row_number() OVER (PARTITION BY a ORDER BY i DESC, b, via) <= 7) SELECT a, b, via, i FROM c7")
def candidates_2026(spark, d):
    found = pr.not_variants(_parts(spark, d)[1].where("i BETWEEN 1 AND 40"))
    return found.withColumn("rn", F.row_number().over(W.partitionBy("a").orderBy(F.desc("i"), "b", "via"))).where("rn <= 7").select("a", "b", "via", "i")


@query("topk_per_seed", f"WITH {_TWO} SELECT a, b, via, i, row_number() OVER (PARTITION BY a ORDER BY i DESC, b, via) AS rn FROM th QUALIFY rn <= 3")
def topk_per_seed(spark, d):
    return _parts(spark, d)[1].withColumn("rn", F.row_number().over(W.partitionBy("a").orderBy(F.desc("i"), "b", "via")).cast("long")).where("rn <= 3").select("a", "b", "via", "i", "rn")


@query("variant_filter", f"WITH {_C16} SELECT a, b FROM pp WHERE {_SHARE} <= 0.4")
def variant_filter(spark, d):
    """All candidate pairs of the band but variants of each other."""
    counts = sparse(spark, d).where("year = 1997").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return pr.not_variants(pr.mid_frequency_pairs(counts, 3, 40)).select("a", "b")


def _drawn(side: str) -> str:
    return f"CAST('0x' || substr(md5('42|' || id || '|{side}'), 1, 12) AS BIGINT) % (SELECT count(*) FROM ct) + 1"


_CTRL = f"""{SPARSE}, {_LINKED}, ct AS (SELECT phrase, row_number() OVER (ORDER BY phrase) AS number FROM post WHERE year = 1997 GROUP BY phrase HAVING count(*) >= 5), dr AS (SELECT {_drawn('a')} AS x, {_drawn('b')} AS y FROM range(500) t(id)),
 rc AS (SELECT DISTINCT p.phrase AS a, q.phrase AS b FROM dr JOIN ct p ON p.number = least(x, y) JOIN ct q ON q.number = greatest(x, y) WHERE x <> y), cd AS (SELECT * FROM rc WHERE {_SHARE} <= 0.4 AND (a, b) NOT IN (SELECT (a, b) FROM lk))"""


def _control(spark, d):
    p = sparse(spark, d)
    hot = p.where("year = 1997").groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return p, Scratch(spark, "control").save(pr.unlinked(pr.not_variants(pr.random_control(hot, 42, 500)), pr.linked(p, *TRAIN)))


@query("random_control", f"WITH {_CTRL} SELECT a, b FROM cd")
def random_control(spark, d):
    return _control(spark, d)[1].select("a", "b")


def _outcomes(p, pairs):
    yearly = net.edges(p.where("year >= 1998"))
    return pr.outcomes(pairs.select("a", "b"), yearly, EARLY, LATE, 1)


@query("check_hit", f"WITH {_C15}, {_out_sql('cd')} SELECT a, b, p1, p2, hit FROM oc")
def check_hit(spark, d):
    return _outcomes(*_c15(spark, d)).select("a", "b", "p1", "p2", "hit")


@query("link_outcomes", f"WITH {_C16}, {_out_sql('cd')} SELECT a, b, n_links, n_years_ge, max_n, first_link FROM oc")
def link_outcomes(spark, d):
    return _outcomes(*_c16(spark, d)).select("a", "b", "n_links", "n_years_ge", "max_n", "first_link")


@query("hit_rates", f"WITH {_C16}, {_out_sql('cd')} SELECT count(*) AS n, round(avg(CASE WHEN n_links > 0 THEN 1.0 ELSE 0.0 END), 6) AS loose, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS strict FROM oc")
def hit_rates(spark, d):
    o = _outcomes(*_c16(spark, d))
    return o.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("n_links") > 0).cast("double")), 6).alias("loose"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("strict"))


_FAIR = f"""{_C15}, ct AS (SELECT phrase, row_number() OVER (ORDER BY phrase) AS number FROM post WHERE year = 1997 GROUP BY phrase HAVING count(*) >= 5), dr AS (SELECT id, {_drawn('a')} AS x, {_drawn('b')} AS y FROM (SELECT unnest(range(200 * (SELECT count(*) FROM cd))) AS id)),
 rc AS (SELECT p.phrase AS a, q.phrase AS b, min(id) AS draw FROM dr JOIN ct p ON p.number = least(x, y) JOIN ct q ON q.number = greatest(x, y) WHERE x <> y GROUP BY ALL),
 cl AS (SELECT a, b FROM rc WHERE {_SHARE} <= 0.4 AND (a, b) NOT IN (SELECT (a, b) FROM lk) ORDER BY draw LIMIT (SELECT count(*) FROM cd)),
 arms AS (SELECT 'experiment' AS tag, a, b FROM cd UNION ALL SELECT 'control', a, b FROM cl), ps AS (SELECT DISTINCT a, b FROM arms), {_out_sql('ps')},
 rt AS (SELECT tag, count(a) AS n, avg(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0.0 END) AS rate FROM (SELECT unnest(['experiment', 'control']) AS tag) LEFT JOIN arms USING (tag) LEFT JOIN oc USING (a, b) GROUP BY tag)"""


@query("fair_compare", f"WITH {_FAIR} SELECT tag, n, round(rate, 6) AS rate, round(rate - (SELECT rate FROM rt WHERE tag = 'control'), 6) AS gain FROM rt")
def fair_compare(spark, d):
    """Candidates against as many drawn pairs that passed the same filters: hit rates, and their gain over the control's."""
    p, found = _c15(spark, d)
    hot = p.where("year = 1997").groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    control = pr.equal_control(hot, pr.linked(p, *TRAIN), 42, found.count())
    arms = found.select(F.lit("experiment").alias("tag"), "a", "b").union(control.select(F.lit("control"), "a", "b"))
    arms = Scratch(spark, "arms").save(arms)
    o = arms.join(_outcomes(p, arms.select("a", "b").distinct()), ["a", "b"]).select("tag", F.col("hit").cast("double").alias("hit"))
    tags = spark.createDataFrame([("experiment",), ("control",)], "tag string")
    rates = tags.join(o, "tag", "left").groupBy("tag").agg(F.count("hit").alias("n"), F.avg("hit").alias("rate"))
    base = rates.where("tag = 'control'").select(F.col("rate").alias("base"))  # one row, as rates has one a tag
    return rates.crossJoin(F.broadcast(base)).select("tag", "n", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - F.col("base"), 6).alias("gain"))


@query("i_bucket_hits", f"WITH {_C15}, {_out_sql('cd')} SELECT CASE WHEN i >= 2 THEN 'strong' ELSE 'weak' END AS bucket, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS rate FROM oc JOIN cd USING (a, b) GROUP BY bucket HAVING count(*) >= 10")
def i_bucket_hits(spark, d):
    p, pairs = _c15(spark, d)
    rows = _outcomes(p, pairs).join(pairs.select("a", "b", "i"), ["a", "b"])
    return pr.bucket_hits(rows, F.when(F.col("i") >= 2, "strong").otherwise("weak")).withColumn("rate", F.round("rate", 6))


_RANKED = f"{_C16}, {_out_sql('cd')}, rr AS (SELECT oc.a, oc.b, hit, row_number() OVER (ORDER BY product DESC, oc.a, oc.b) AS rn FROM oc JOIN cd USING (a, b))"


def _ranked(spark, d):
    p, pairs = _c16(spark, d)
    rows = _outcomes(p, pairs).join(pairs, ["a", "b"])
    return rows.withColumn("rn", F.row_number().over(W.orderBy(F.desc("product"), "a", "b")).cast("long"))


@query("rank_bucket", f"WITH {_RANKED} SELECT CASE WHEN rn <= 50 THEN 50 WHEN rn <= 100 THEN 100 WHEN rn <= 200 THEN 200 ELSE 400 END AS bucket, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS rate FROM rr GROUP BY bucket")
def rank_bucket(spark, d):
    b = F.when(F.col("rn") <= 50, 50).when(F.col("rn") <= 100, 100).when(F.col("rn") <= 200, 200).otherwise(400)
    return pr.bucket_hits(_ranked(spark, d), b, 1).withColumn("rate", F.round("rate", 6))


@query("rank_gradient", f"WITH {_RANKED} SELECT (rn - 1) // 100 AS bucket, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS rate FROM rr GROUP BY bucket")
def rank_gradient(spark, d):
    return pr.bucket_hits(_ranked(spark, d), F.floor((F.col("rn") - 1) / 100), 1).withColumn("rate", F.round("rate", 6))


@query("feature_auc", f"WITH {_RANKED}, rk AS (SELECT hit, product, rank() OVER (ORDER BY product) + (count(*) OVER (PARTITION BY product) - 1) / 2.0 AS r FROM rr JOIN cd USING (a, b)) SELECT CAST(sum(hit::INT) AS BIGINT) AS n_hits, count(*) AS n_rows, round((sum(CASE WHEN hit THEN r ELSE 0 END) - sum(hit::INT) * (sum(hit::INT) + 1) / 2) / (sum(hit::INT) * (count(*) - sum(hit::INT))), 6) AS auc FROM rk")
def feature_auc(spark, d):
    return pr.feature_auc(_ranked(spark, d), "product").withColumn("auc", F.round("auc", 6))


@query("cap_per_field", f"WITH {POST}, c AS (SELECT category AS field, phrase, count(*) AS n FROM post WHERE year = 1997 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, phrase) AS rn FROM c) SELECT field, phrase, n FROM r WHERE rn <= 4")
def cap_per_field(spark, d):
    c = src.postings(spark, d).where("year = 1997").groupBy(F.col("category").alias("field"), "phrase").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rn", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "phrase"))).where("rn <= 4").drop("rn")


@query("balanced_seeds")
def balanced_seeds(spark, d):
    """Greedy across fields, so order-dependent; tested against a plain version."""
    c = src.postings(spark, d).where("year = 1997").groupBy(F.col("category").alias("field"), "phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    quota = {"MACHINERY": 2, "AUTOMOBILE": 4, "BUILDING": 4, "FURNITURE": 4, "HOUSEHOLD": 4}
    return spark.createDataFrame(pr.greedy_fields(c, quota), "field string, phrase string, n long")


# --- series ------------------------------------------------------------------


def series(spark, d):
    return _g(spark, d).select("a", "b", "year", F.col("g_raw").alias("g"))


_S = f"{_G}, s AS (SELECT a, b, year, g_raw AS g FROM g)"


@query("cv_signal", f"WITH {_S} SELECT a, b, round(CASE WHEN count(*) FILTER (WHERE g > 0) >= 3 THEN stddev_pop(g) FILTER (WHERE g > 0) / avg(g) FILTER (WHERE g > 0) ELSE 0 END, 6) AS cv FROM s GROUP BY a, b")
def cv_signal(spark, d):
    return series(spark, d).groupBy("a", "b").agg(F.round(pr.cv(F.col("g")), 6).alias("cv"))


@query("g_features", f"WITH {_S}, v AS (SELECT *, row_number() OVER w AS i, (g + lag(g) OVER w) / 2 AS area FROM s WHERE g > 0 WINDOW w AS (PARTITION BY a, b ORDER BY year)) SELECT a, b, count(*) AS n, round(stddev_pop(g) / avg(g), 6) AS cv, round(max(g), 6) AS peak, round(coalesce(sum(area), 0), 6) AS area, round(regr_slope(ln(g), i), 6) + 0.0 AS slope FROM v GROUP BY a, b HAVING count(*) >= 3")
def g_features(spark, d):
    out = pr.g_features(series(spark, d)).where("n >= 3")
    return out.select("a", "b", "n", *[F.round(c, 6).alias(c) for c in ("cv", "peak", "area")], (F.round("slope", 6) + 0.0).alias("slope"))


@query("tail_slope", f"WITH {_S}, v AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY year) AS u, row_number() OVER (PARTITION BY a, b ORDER BY year DESC) AS l FROM s) SELECT a, b, round((avg(g) FILTER (WHERE l <= 2) - avg(g) FILTER (WHERE u <= 2)) / avg(g), 6) + 0.0 AS tail_slope FROM v GROUP BY a, b")
def tail_slope(spark, d):
    return pr.tail_slope(series(spark, d)).select("a", "b", (F.round("tail_slope", 6) + 0.0).alias("tail_slope"))


_YEARS = list(range(1995, 2001))


def _dft(k: int) -> str:
    return f"round(pow(sum(g0 * cos(2 * pi() * {k} * i / 6)), 2) + pow(sum(g0 * sin(2 * pi() * {k} * i / 6)), 2), 9) AS d{k}"


@query("shape_features", f"WITH {_S}, k AS (SELECT DISTINCT a, b FROM s), z AS (SELECT k.a, k.b, t.i, coalesce(s.g, 0) AS g0 FROM k CROSS JOIN (SELECT unnest(range(0, 6)) AS i) t LEFT JOIN s ON s.a = k.a AND s.b = k.b AND s.year = 1995 + t.i), q AS (SELECT a, b, max(g0) AS peak, arg_max(i, (g0, -i)) / 5.0 AS peak_pos, coalesce(pow(corr(g0, i), 2), 0) AS lin_r2, {_dft(1)}, {_dft(2)}, {_dft(3)}, stddev_pop(g0) / avg(g0) AS cv FROM z GROUP BY a, b) SELECT a, b, round(peak, 6) AS peak, round(peak_pos, 6) AS peak_pos, round(lin_r2, 6) AS lin_r2, round(CASE WHEN d1 >= d2 AND d1 >= d3 THEN 1 WHEN d2 >= d3 THEN 2 ELSE 3 END / 6.0, 6) AS frequency, round(cv, 6) AS cv FROM q")
def shape_features(spark, d):
    out = pr.shape_features(series(spark, d), _YEARS)
    return out.select("a", "b", *[F.round(c, 6).alias(c) for c in ("peak", "peak_pos", "lin_r2", "frequency", "cv")])


_SHAPE = f"""{_S}, l AS (SELECT a, b, list(g ORDER BY year) AS v FROM s WHERE g IS NOT NULL GROUP BY a, b), m AS (SELECT a, b, v, list_max(v) AS t FROM l), n AS (SELECT a, b, len(v) AS k, t, list_transform(v, lambda x: x / t) AS n FROM m),
 p AS (SELECT *, list_filter(range(2, k), lambda i: n[i] >= n[i - 1] AND n[i] > n[i + 1] AND n[i] >= 0.85) AS pk, n[k] - n[k - 2] AS tl FROM n),
 sh AS (SELECT a, b, CASE WHEN k < 5 THEN 'insufficient' WHEN t <= 0 THEN 'all-zero' WHEN len(pk) > 0 AND n[pk[-1]] - n[k] > 0.2 THEN 'rise-then-fall' WHEN n[k] > 1.5 * n[1] AND tl > 0.05 THEN 'mono-rise' WHEN n[k] > 1.2 * n[1] AND abs(tl) <= 0.05 THEN 'rise-plateau' WHEN abs(n[k] - n[1]) <= 0.15 AND list_max(n) - list_min(n) <= 0.3 THEN 'flat' ELSE 'volatile' END AS shape FROM p)"""


@query("classify_shape", f"WITH {_SHAPE} SELECT a, b, shape FROM sh")
def classify_shape(spark, d):
    return pr.series_summary(series(spark, d)).select("a", "b", "shape")


@query("series_summary", f"WITH {_SHAPE} SELECT s.a, s.b, round(arg_min(g, year), 6) AS first, round(arg_max(g, year), 6) AS last, round(avg(g), 6) AS mean, arg_max(year, (g, -year)) AS peak_year FROM s GROUP BY s.a, s.b")
def series_summary(spark, d):
    out = pr.series_summary(series(spark, d))
    return out.select("a", "b", *[F.round(c, 6).alias(c) for c in ("first", "last", "mean")], "peak_year")


@query("group_stats", f"WITH {_SHAPE}, x AS (SELECT a, b, avg(g) AS m FROM s GROUP BY a, b) SELECT shape, count(*) AS n, round(avg(m), 6) AS mean_g, round(quantile_cont(m, 0.5), 6) AS median_g FROM sh JOIN x USING (a, b) GROUP BY shape")
def group_stats(spark, d):
    s = pr.series_summary(series(spark, d))
    return s.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mean"), 6).alias("mean_g"), F.round(F.percentile("mean", 0.5), 6).alias("median_g"))


@query("year_max_norm", f"WITH {_GN} SELECT year, round(max(g_norm), 6) AS top, count(g_norm) AS n FROM gn GROUP BY year")
def year_max_norm(spark, d):
    return cond.year_max_norm(_g(spark, d)).groupBy("year").agg(F.round(F.max("g_norm"), 6).alias("top"), F.count("g_norm").alias("n"))


@query("rank_rules", f"WITH {_S}, f AS (SELECT a, b, max(g) AS peak, avg(g) AS mean, arg_max(g, year) AS last FROM s GROUP BY a, b) SELECT a, b, row_number() OVER (ORDER BY round(peak, 9) DESC, a, b) AS by_peak, row_number() OVER (ORDER BY round(mean, 9) DESC, a, b) AS by_mean, row_number() OVER (ORDER BY round(last, 9) DESC, a, b) AS by_last FROM f")
def rank_rules(spark, d):
    f = series(spark, d).groupBy("a", "b").agg(F.max("g").alias("peak"), F.avg("g").alias("mean"), F.max_by("g", "year").alias("last"))
    return f.select("a", "b", *[F.row_number().over(W.orderBy(F.desc(F.round(c, 9)), "a", "b")).cast("long").alias(f"by_{c}") for c in ("peak", "mean", "last")])


@query("predict_topn", f"WITH {_S}, f AS (SELECT a, b, CASE WHEN count(*) FILTER (WHERE g > 0) >= 3 THEN stddev_pop(g) FILTER (WHERE g > 0) / avg(g) FILTER (WHERE g > 0) ELSE 0 END AS cv FROM s GROUP BY a, b) SELECT a, b, round(cv, 6) AS cv FROM f ORDER BY round(cv, 6) DESC, a, b LIMIT 8")
def predict_topn(spark, d):
    f = series(spark, d).groupBy("a", "b").agg(F.round(pr.cv(F.col("g")), 6).alias("cv"))
    return f.orderBy(F.desc("cv"), "a", "b").limit(8)


@query("cv_bucket_hits", f"WITH {_S}, f AS (SELECT a, b, stddev_pop(g) / avg(g) AS cv, arg_max(g, year) > arg_min(g, year) AS hit FROM s GROUP BY a, b) SELECT CASE WHEN cv >= 0.3 THEN 'high' WHEN cv >= 0.2 THEN 'mid' ELSE 'low' END AS bucket, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS rate FROM f GROUP BY bucket")
def cv_bucket_hits(spark, d):
    f = series(spark, d).groupBy("a", "b").agg((F.stddev_pop("g") / F.avg("g")).alias("cv"), (F.max_by("g", "year") > F.min_by("g", "year")).alias("hit"))
    return pr.bucket_hits(f, F.when(F.col("cv") >= 0.3, "high").when(F.col("cv") >= 0.2, "mid").otherwise("low"), 1).withColumn("rate", F.round("rate", 6))
