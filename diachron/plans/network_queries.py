"""Sources, filters, networks, dynamics and conductance on the adapters."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import conductance as cond
from ..operators import dynamics as dyn
from ..operators import network as net
from ..operators import predict as pr
from ..sources import papers as src
from ..storage import Scratch
from .catalog import BOTH, CAT_EDGES, DF, EDGES, NET, PAPERS, POST, query



def is_cs():
    return F.col("category") == "MACHINERY"


def dense(spark, d):
    return src.postings(spark, d, "dense")


# --- sources -----------------------------------------------------------------


@query("scan_papers", f"WITH {PAPERS} SELECT arxiv_id, lower(title) || '.' || chr(10) || lower(abstract) AS text FROM papers WHERE year = 1992 AND starts_with(string_split(categories, ' ')[1], 'src1')")
def scan_papers(spark, d):
    return src.scan_papers(src.papers(spark, d), 1992, category="src1")


@query("scan_abstracts", f"WITH {PAPERS} SELECT arxiv_id, lower(title) || '.' || chr(10) || lower(abstract) AS text FROM papers WHERE year BETWEEN 1991 AND 1993")
def scan_abstracts(spark, d):
    return src.scan_papers(src.papers(spark, d), 1991, 1993)


@query("list_years", f"WITH {PAPERS} SELECT DISTINCT year FROM papers")
def list_years(spark, d):
    return src.papers(spark, d).select("year").distinct()


@query("parse_years", f"WITH {PAPERS} SELECT year, count(*) AS n FROM papers WHERE year IN (1991, 1993, 1994, 1995) GROUP BY year")
def parse_years(spark, d):
    years = src.parse_years("1991,1993-1995", [])
    return src.papers(spark, d).where(F.col("year").isin(years)).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("index_year_range", f"WITH {PAPERS} SELECT min(year) AS first_year, max(year) AS last_year FROM papers")
def index_year_range(spark, d):
    return src.papers(spark, d).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("null_audit", f"WITH {PAPERS} SELECT count(*) AS n_rows, count(arxiv_id) AS n_arxiv_id, count(title) AS n_title, count(abstract) AS n_abstract FROM papers")
def null_audit(spark, d):
    return src.null_audit(src.papers(spark, d))


@query("dry_run_counts", f"WITH {PAPERS} SELECT coalesce(year, 0) AS year, count(*) AS n FROM papers GROUP BY ROLLUP (year)")
def dry_run_counts(spark, d):
    return src.dry_run_counts(src.papers(spark, d)).na.fill(0, ["year"])  # year 0: the total


@query("content_hash", rf"WITH {PAPERS} SELECT arxiv_id, sha1(trim(regexp_replace(lower(title), '\s+', ' ', 'g')) || chr(10) || trim(regexp_replace(lower(abstract), '\s+', ' ', 'g'))) AS content_hash FROM papers")
def content_hash(spark, d):
    return src.papers(spark, d).select("arxiv_id", src.content_hash().alias("content_hash"))


@query("empty_text_delete", f"WITH {PAPERS} SELECT arxiv_id FROM papers WHERE title <> '' OR abstract <> ''")
def empty_text_delete(spark, d):
    return src.without_empty(src.papers(spark, d)).select("arxiv_id")


@query("paper_row_number", f"WITH {PAPERS} SELECT arxiv_id, row_number() OVER (PARTITION BY year ORDER BY arxiv_id) AS paper_id, year FROM papers")
def paper_row_number(spark, d):
    numbered = F.row_number().over(W.partitionBy("year").orderBy("arxiv_id")).cast("long")
    return src.papers(spark, d).select("arxiv_id", numbered.alias("paper_id"), "year")


# --- filters -----------------------------------------------------------------




@query("phrase_filter", f"WITH {POST} SELECT year, doc FROM post WHERE phrase = (SELECT min(phrase) FROM post)")
def phrase_filter(spark, d):
    p = dense(spark, d)
    first = p.agg(F.min("phrase").alias("phrase"))
    return p.join(F.broadcast(first), "phrase").select("year", "doc")


_TWO = "two AS (SELECT phrase, row_number() OVER (ORDER BY n DESC, phrase) AS rn FROM (SELECT phrase, count(*) AS n FROM post GROUP BY phrase) QUALIFY rn <= 3)"


def top_phrases(p, n=3):
    """The n most frequent phrases, ties by name; ``rn`` from 1."""
    counted = p.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "phrase").limit(n)
    return counted.select("phrase", F.row_number().over(W.orderBy(F.desc("n"), "phrase")).cast("long").alias("rn"))


@query("phrase_filter_and", f"WITH {POST}, {_TWO} SELECT year, doc FROM post JOIN two USING (phrase) WHERE rn <= 2 GROUP BY year, doc HAVING count(*) = 2")
def phrase_filter_and(spark, d):
    p = dense(spark, d)
    return p.join(F.broadcast(top_phrases(p, 2)), "phrase").groupBy("year", "doc").agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


@query("phrase_filter_or", f"WITH {POST}, {_TWO}, h AS (SELECT year, doc, count(*) AS n_hits FROM post JOIN two USING (phrase) GROUP BY year, doc) SELECT year, doc, n_hits FROM h QUALIFY row_number() OVER (PARTITION BY year ORDER BY n_hits DESC, doc) <= 50")
def phrase_filter_or(spark, d):
    p = dense(spark, d)
    hits = p.join(F.broadcast(top_phrases(p)), "phrase").groupBy("year", "doc").agg(F.count(F.lit(1)).alias("n_hits"))
    return hits.withColumn("rn", F.row_number().over(W.partitionBy("year").orderBy(F.desc("n_hits"), "doc"))).where("rn <= 50").drop("rn")


@query("category_binary", f"WITH {POST} SELECT year, category = 'MACHINERY' AS is_cs, count(DISTINCT doc) AS n FROM post GROUP BY ALL")
def category_binary(spark, d):
    return dense(spark, d).groupBy("year", is_cs().alias("is_cs")).agg(F.count_distinct("doc").alias("n"))


@query("category_like_any", f"WITH {PAPERS} SELECT arxiv_id, categories FROM papers WHERE categories LIKE 'src1%' OR categories LIKE 'src3%'")
def category_like_any(spark, d):
    return src.papers(spark, d).where(F.col("categories").like("src1%") | F.col("categories").like("src3%")).select("arxiv_id", "categories")


@query("in_list", f"WITH {PAPERS} SELECT arxiv_id, title FROM papers WHERE arxiv_id IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark)")
def in_list(spark, d):
    wanted = src.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("arxiv_id"))
    return src.papers(spark, d).join(wanted, "arxiv_id", "left_semi").select("arxiv_id", "title")


@query("since_filter", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-01-01'")
def since_filter(spark, d):
    return src.table(spark, d, "orders").where(F.col("o_orderdate").cast("date") >= F.lit("2000-01-01").cast("date")).select("o_orderkey")


@query("freq_band", f"WITH {POST}, t AS (SELECT phrase, count(*) AS n FROM post WHERE year = 1996 GROUP BY phrase ORDER BY n DESC, phrase LIMIT 6000) SELECT phrase, n FROM t WHERE n BETWEEN 30 AND 60")
def freq_band(spark, d):
    counted = dense(spark, d).where("year = 1996").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return pr.mid_frequency(counted, 30, 60)


@query("hot_filter", f"WITH {POST}, {DF} SELECT year, phrase, df FROM df WHERE df >= 20")
def hot_filter(spark, d):
    return net.doc_freq(dense(spark, d)).where("df >= 20")


@query("jargon_filter", f"WITH {POST} SELECT phrase, count(*) AS n FROM post WHERE NOT contains(phrase, 'economy') AND NOT contains(phrase, 'promo') AND length(phrase) - length(replace(phrase, ' ', '')) <= 3 GROUP BY phrase")
def jargon_filter(spark, d):
    jargon = ["economy", "promo"]
    p = dense(spark, d)
    for j in jargon:
        p = p.where(~F.col("phrase").contains(j))
    return p.where(F.size(F.split("phrase", " ")) <= 4).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


@query("bridge_stop", f"WITH {POST}, {_TWO} SELECT phrase, count(*) AS n FROM post WHERE phrase NOT IN (SELECT phrase FROM two) GROUP BY phrase")
def bridge_stop(spark, d):
    p = dense(spark, d)
    return p.join(F.broadcast(top_phrases(p).select("phrase")), "phrase", "left_anti").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


# --- networks ----------------------------------------------------------------


@query("doc_freq", f"WITH {POST}, {DF} SELECT * FROM df")
def doc_freq(spark, d):
    return net.doc_freq(dense(spark, d))


@query("phrase_topn", f"WITH {POST} SELECT phrase, count(*) AS n FROM post GROUP BY phrase ORDER BY n DESC, phrase LIMIT 25")
def phrase_topn(spark, d):
    return dense(spark, d).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "phrase").limit(25)


@query("distinct_phrases", f"WITH {POST} SELECT DISTINCT phrase FROM post")
def distinct_phrases(spark, d):
    return dense(spark, d).select("phrase").distinct()


@query("cooc_edges", f"WITH {POST}, {EDGES} SELECT * FROM edges")
def cooc_edges(spark, d):
    return net.edges(dense(spark, d))


@query("edges_topn", f"WITH {POST}, {EDGES} SELECT * FROM edges WHERE year = 1997 AND w >= 2 ORDER BY w DESC, a, b LIMIT 200")
def edges_topn(spark, d):
    return net.top_edges(net.edges(dense(spark, d).where("year = 1997")), 200, least=2)


_PMI = f"{NET}, tot AS (SELECT year, count(DISTINCT doc) AS n FROM post GROUP BY year), pmi AS (SELECT e.year, e.a, e.b, e.w, log2(CAST(e.w AS DOUBLE) * t.n / (x.df * y.df)) AS pmi FROM edges e JOIN df x ON e.year = x.year AND e.a = x.phrase JOIN df y ON e.year = y.year AND e.b = y.phrase JOIN tot t ON e.year = t.year WHERE e.w >= 3)"


def _pmi(spark, d, base=2):
    p = dense(spark, d)
    return net.pmi_edges(net.edges(p), net.doc_freq(p), net.docs_per_year(p), least=3, base=base)


@query("edges_pmi", f"WITH {_PMI} SELECT year, a, b, w, round(pmi, 6) AS pmi, round(0.2 * pmi + 0.8 * log2(w + 1), 6) AS score FROM pmi WHERE pmi > 0")
def edges_pmi(spark, d):
    return _pmi(spark, d).select("year", "a", "b", "w", F.round("pmi", 6).alias("pmi"), F.round("score", 6).alias("score"))


@query("edges_pmi_log10", f"WITH {_PMI} SELECT year, a, b, w, round(0.2 * pmi + 0.8 * log10(w + 1), 6) AS score FROM pmi WHERE pmi > 0")
def edges_pmi_log10(spark, d):
    return _pmi(spark, d, 10).select("year", "a", "b", "w", F.round("score", 6).alias("score"))


@query("edge_cat_counts", f"WITH {POST}, {CAT_EDGES} SELECT * FROM cedges")
def edge_cat_counts(spark, d):
    return net.category_edges(dense(spark, d), is_cs())


@query("edges_discount", f"WITH {POST}, {CAT_EDGES} SELECT year, a, b, w, CAST(0.5 * n_cs + n_oth AS DOUBLE) AS n_eff FROM cedges WHERE year = 1998 AND w >= 2 ORDER BY n_eff DESC, a, b LIMIT 150")
def edges_discount(spark, d):
    e = net.discounted(net.category_edges(dense(spark, d).where("year = 1998"), is_cs()), 0.5)
    return net.top_edges(e, 150, "n_eff", 2).select("year", "a", "b", "w", "n_eff")


@query("category_colors", f"WITH {POST}, {CAT_EDGES} SELECT year, a, b, CASE WHEN n_cs / (n_cs + n_oth) > 0.6 THEN '{net.CS}' WHEN n_cs / (n_cs + n_oth) < 0.4 THEN '{net.OTHER}' ELSE '{net.CROSS}' END AS color FROM cedges")
def category_colors(spark, d):
    return net.edge_colors(net.category_edges(dense(spark, d), is_cs())).select("year", "a", "b", "color")


@query("category_node_colors", f"WITH {POST}, {CAT_EDGES}, ends AS (SELECT year, a AS phrase, n_cs, n_oth FROM cedges UNION ALL SELECT year, b, n_cs, n_oth FROM cedges) SELECT year, phrase, CASE WHEN sum(n_cs) / sum(n_cs + n_oth) > 0.5 THEN '{net.CS}' ELSE '{net.OTHER}' END AS color FROM ends GROUP BY ALL")
def category_node_colors(spark, d):
    return net.node_colors(net.category_edges(dense(spark, d), is_cs()))


_SEL = "sel AS (SELECT * FROM edges WHERE year = 1997 ORDER BY w DESC, a, b LIMIT 60)"


def _selected(spark, d, n=60):
    e = net.edges(dense(spark, d).where("year = 1997"))
    return e, net.top_edges(e, n)


@query("whitelist_edges", f"""WITH {POST}, {EDGES}, {_SEL}, wl AS (SELECT unnest(['brand#11 economy', 'brand#55 standard']) AS x),
 sb AS (SELECT a AS x, b AS c, w FROM sel UNION ALL SELECT b, a, w FROM sel), have AS (SELECT x, count(*) AS h FROM sb WHERE x IN (SELECT x FROM wl) GROUP BY x),
 free AS (SELECT * FROM edges WHERE year = 1997 AND (a, b) NOT IN (SELECT (a, b) FROM sel)), fb AS (SELECT a AS x, b AS c, w FROM free UNION ALL SELECT b, a, w FROM free),
 r AS (SELECT fb.x, c, w, coalesce(h, 0) AS h, row_number() OVER (PARTITION BY fb.x ORDER BY w DESC, c) AS rn FROM fb JOIN wl ON fb.x = wl.x LEFT JOIN have ON fb.x = have.x)
 SELECT year, a, b, w FROM sel UNION ALL SELECT DISTINCT 1997, least(x, c), greatest(x, c), w FROM r WHERE rn <= 5 - h""")
def whitelist_edges(spark, d):
    e, chosen = _selected(spark, d)
    return net.whitelist_edges(e, chosen, ["brand#11 economy", "brand#55 standard"])


_COMP = f"""{POST}, {EDGES}, {_SEL}, ways AS (SELECT a AS x, b AS c FROM sel UNION SELECT b, a FROM sel),
 reach(x, c) AS (SELECT x, c FROM ways UNION SELECT r.x, b.c FROM reach r JOIN ways b ON r.c = b.x), comp AS (SELECT x AS node, min(least(x, c)) AS component FROM reach GROUP BY x)"""


@query("connected_components", f"WITH RECURSIVE {_COMP} SELECT node, component FROM comp")
def connected_components(spark, d):
    return net.components(_selected(spark, d)[1])


@query("patch_fragments", f"""WITH RECURSIVE {_COMP}, sz AS (SELECT component, count(*) AS size FROM comp GROUP BY component), trunk AS (SELECT component FROM sz ORDER BY size DESC, component LIMIT 1),
 y AS (SELECT * FROM edges WHERE year = 1997), nb AS (SELECT a AS x, b AS c, w FROM y UNION ALL SELECT b, a, w FROM y), pop AS (SELECT c, sum(w) AS pop FROM nb GROUP BY c)
 SELECT least(nb.x, nb.c) AS a, greatest(nb.x, nb.c) AS b, nb.w, round(nb.w * pow(0.5, 1 + log10(greatest(pop, 1))), 6) AS score FROM nb JOIN pop ON nb.c = pop.c
 JOIN comp l ON nb.x = l.node JOIN sz ON l.component = sz.component JOIN comp t ON nb.c = t.node
 WHERE t.component = (SELECT component FROM trunk) AND l.component <> (SELECT component FROM trunk) AND sz.size <= 10 AND nb.w >= 2""")
def patch_fragments(spark, d):
    e, chosen = _selected(spark, d)
    return net.patch_fragments(e, chosen, least=2, most=100_000).select("a", "b", "w", F.round("score", 6).alias("score"))


@query("node_shares", f"WITH {POST}, {DF} SELECT year, phrase, df, round(df / sum(df) OVER (PARTITION BY year), 9) AS share FROM df")
def node_shares(spark, d):
    return net.node_shares(net.doc_freq(dense(spark, d))).withColumn("share", F.round("share", 9))


@query("n_series", f"WITH {POST}, {EDGES}, top AS (SELECT a, b FROM edges GROUP BY a, b ORDER BY sum(w) DESC, a, b LIMIT 10) SELECT a, b, year, w AS n FROM edges JOIN top USING (a, b)")
def n_series(spark, d):
    e = net.edges(dense(spark, d))
    top = e.groupBy("a", "b").agg(F.sum("w").alias("s")).orderBy(F.desc("s"), "a", "b").limit(10).select("a", "b")
    return e.join(F.broadcast(top), ["a", "b"]).select("a", "b", "year", F.col("w").alias("n"))


@query("inverted_index", f"WITH {POST} SELECT phrase, year, doc FROM post")
def inverted_index(spark, d):
    return dense(spark, d).select("phrase", "year", "doc")


@query("domain_vote", f"WITH {POST} SELECT phrase, count(*) FILTER (WHERE category = 'MACHINERY') AS n_cs, count(*) FILTER (WHERE category <> 'MACHINERY') AS n_oth, count(*) FILTER (WHERE category = 'MACHINERY') > count(*) FILTER (WHERE category <> 'MACHINERY') AS is_cs FROM post WHERE year = 2000 GROUP BY phrase")
def domain_vote(spark, d):
    cs, oth = F.count_if(is_cs()), F.count_if(~is_cs())
    return dense(spark, d).where("year = 2000").groupBy("phrase").agg(cs.alias("n_cs"), oth.alias("n_oth"), (cs > oth).alias("is_cs"))


@query("pair_group", f"WITH {POST}, {CAT_EDGES} SELECT a, b, n_cs AS cs_hits, n_oth AS non_hits, CASE WHEN n_cs >= n_oth THEN 'cs' ELSE 'non-cs' END AS grp FROM cedges WHERE year = 2000")
def pair_group(spark, d):
    e = net.category_edges(dense(spark, d).where("year = 2000"), is_cs())
    return e.select("a", "b", F.col("n_cs").alias("cs_hits"), F.col("n_oth").alias("non_hits"), F.when(F.col("n_cs") >= F.col("n_oth"), "cs").otherwise("non-cs").alias("grp"))


@query("field_balance", f"WITH {POST} SELECT category, count(DISTINCT phrase) AS n, round(count(DISTINCT phrase) / sum(count(DISTINCT phrase)) OVER (), 6) AS share FROM post GROUP BY category")
def field_balance(spark, d):
    g = dense(spark, d).groupBy("category").agg(F.count_distinct("phrase").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("topk_neighbors", f"WITH {POST}, {EDGES}, {BOTH} SELECT year, x, c, w, row_number() OVER (PARTITION BY year, x ORDER BY w DESC, c) AS rnk FROM nbr QUALIFY rnk <= 10")
def topk_neighbors(spark, d):
    return cond.ranked_neighbours(net.edges(dense(spark, d))).where("rnk <= 10").withColumn("rnk", F.col("rnk").cast("long"))


# --- dynamics ----------------------------------------------------------------

_TOT = "tot AS (SELECT year, CAST(sum(df) AS DOUBLE) AS t FROM df GROUP BY year)"
_PHR = "ph AS (SELECT DISTINCT phrase FROM df WHERE year IN ({y}))"


def _n(y, alias):
    return f"LEFT JOIN df {alias} ON ph.phrase = {alias}.phrase AND {alias}.year = {y}"


def _t(y):
    return f"(SELECT t FROM tot WHERE year = {y})"


_SPEED = f"{POST}, {DF}, {_TOT}, {_PHR.format(y='1999, 1998')}, sp AS (SELECT ph.phrase, log2(((coalesce(p.df, 0) + 0.5) / {_t(1999)}) / ((coalesce(q.df, 0) + 0.5) / {_t(1998)})) AS v FROM ph {_n(1999, 'p')} {_n(1998, 'q')})"


def _speed(spark, d):
    return dyn.speed(net.doc_freq(dense(spark, d)).withColumnRenamed("df", "n"), ["phrase"], 1999, 1998)


@query("log2fc", "SELECT o_custkey, count(*) FILTER (WHERE year(o_orderdate) = 1999) AS c1, round(log2(((count(*) FILTER (WHERE year(o_orderdate) = 1999) + 0.5) / 100) / ((count(*) FILTER (WHERE year(o_orderdate) = 1998) + 0.5) / 90)) + 0.0, 6) AS fc FROM orders GROUP BY o_custkey")
def log2fc(spark, d):
    c1, c0 = F.count_if(F.year("o_orderdate") == 1999), F.count_if(F.year("o_orderdate") == 1998)
    g = src.table(spark, d, "orders").groupBy("o_custkey").agg(c1.alias("c1"), c0.alias("c0"))
    return g.select("o_custkey", "c1", F.round(dyn.log2fc(F.col("c1"), F.lit(100), F.col("c0"), F.lit(90)) + 0.0, 6).alias("fc"))


@query("speed_nodes", f"WITH {_SPEED} SELECT phrase, round(v, 6) + 0.0 AS speed FROM sp")
def speed_nodes(spark, d):
    return _speed(spark, d).select("phrase", (F.round("speed", 6) + 0.0).alias("speed"))


def _edge_counts(y):
    return f"(SELECT a, b, coalesce(x.df, 0) + coalesce(z.df, 0) AS n FROM en LEFT JOIN df x ON en.a = x.phrase AND x.year = {y} LEFT JOIN df z ON en.b = z.phrase AND z.year = {y})"


_EN = "en AS (SELECT a, b FROM edges WHERE year = 1999 ORDER BY w DESC, a, b LIMIT 100)"


def _ends(spark, d):
    p = dense(spark, d)
    top = net.top_edges(net.edges(p.where("year = 1999")), 100)
    return dyn.endpoint_counts(top, net.doc_freq(p)), top, p


@query("speed_edges_full", f"WITH {NET}, {_EN}, c1 AS {_edge_counts(1999)}, c0 AS {_edge_counts(1998)} SELECT c1.a, c1.b, round(log2(((c1.n + 0.5) / (SELECT CAST(sum(n) AS DOUBLE) FROM c1)) / ((c0.n + 0.5) / (SELECT CAST(sum(n) AS DOUBLE) FROM c0))), 6) + 0.0 AS speed FROM c1 JOIN c0 USING (a, b)")
def speed_edges_full(spark, d):
    counts, _, _ = _ends(spark, d)
    return dyn.speed(counts, ["a", "b"], 1999, 1998).select("a", "b", (F.round("speed", 6) + 0.0).alias("speed"))


def _focus_counts(y):
    return f"(SELECT en.a, en.b, coalesce(e.w, 0) AS n FROM en LEFT JOIN edges e ON en.a = e.a AND en.b = e.b AND e.year = {y})"


def focus_edge_counts(spark, d):
    p = dense(spark, d)
    e = net.edges(p)
    top = net.top_edges(e.where("year = 1999"), 100)
    return e.join(F.broadcast(top.select("a", "b")), ["a", "b"]).select("year", "a", "b", F.col("w").alias("n"))


@query("speed_edges_focus", f"WITH {NET}, {_EN}, c1 AS {_focus_counts(1999)}, c0 AS {_focus_counts(1998)} SELECT c1.a, c1.b, round(log2(((c1.n + 0.5) / (SELECT CAST(sum(n) AS DOUBLE) FROM c1)) / ((c0.n + 0.5) / (SELECT CAST(sum(n) AS DOUBLE) FROM c0))), 6) + 0.0 AS speed FROM c1 JOIN c0 USING (a, b)")
def speed_edges_focus(spark, d):
    return dyn.speed(focus_edge_counts(spark, d), ["a", "b"], 1999, 1998).select("a", "b", (F.round("speed", 6) + 0.0).alias("speed"))


@query("accel_nodes", f"WITH {POST}, {DF}, {_TOT}, {_PHR.format(y='1999, 1998, 1997')} SELECT ph.phrase, round(coalesce(p.df, 0) / {_t(1999)} - 2 * coalesce(q.df, 0) / {_t(1998)} + coalesce(r.df, 0) / {_t(1997)}, 9) + 0.0 AS accel FROM ph {_n(1999, 'p')} {_n(1998, 'q')} {_n(1997, 'r')}")
def accel_nodes(spark, d):
    return dyn.accel(net.doc_freq(dense(spark, d)).withColumnRenamed("df", "n"), ["phrase"], 1999).select("phrase", (F.round("accel", 9) + 0.0).alias("accel"))


def _accel_sql(counts):
    c = ", ".join(f"c{i} AS {counts(y)}" for i, y in enumerate((1999, 1998, 1997)))
    s = [f"(SELECT CAST(sum(n) AS DOUBLE) FROM c{i})" for i in range(3)]
    return f"WITH {NET}, {_EN}, {c} SELECT c0.a, c0.b, round(c0.n / {s[0]} - 2 * c1.n / {s[1]} + c2.n / {s[2]}, 9) + 0.0 AS accel FROM c0 JOIN c1 USING (a, b) JOIN c2 USING (a, b)"


@query("accel_edges_full", _accel_sql(_edge_counts))
def accel_edges_full(spark, d):
    return dyn.accel(_ends(spark, d)[0], ["a", "b"], 1999).select("a", "b", (F.round("accel", 9) + 0.0).alias("accel"))


@query("accel_edges_focus", _accel_sql(_focus_counts))
def accel_edges_focus(spark, d):
    return dyn.accel(focus_edge_counts(spark, d), ["a", "b"], 1999).select("a", "b", (F.round("accel", 9) + 0.0).alias("accel"))


def _p95(values, by=""):
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""r AS (SELECT {g}v, row_number() OVER ({part}ORDER BY v) AS rn, count(*) OVER ({part}) AS n FROM {values}),
 k AS (SELECT *, greatest(1, least(95 * (n + 1) // 100, n - 1)) AS j FROM r),
 cap AS (SELECT {g}CASE WHEN max(n) = 1 THEN min(v) ELSE sum(CASE WHEN rn = j THEN v * (100 - (95 * (n + 1) - 100 * j)) WHEN rn = j + 1 THEN v * (95 * (n + 1) - 100 * j) ELSE 0 END) / 100 END AS cap FROM k {'GROUP BY ' + by if by else ''})"""


@query("p95_cap", f"WITH {POST}, {DF}, v AS (SELECT year, df AS v FROM df), {_p95('v', 'year')} SELECT year, round(cap, 6) AS cap FROM cap")
def p95_cap(spark, d):
    return dyn.percentile_exclusive(net.doc_freq(dense(spark, d)), "df", by=["year"]).select("year", F.round("cap", 6).alias("cap"))


def _channel(light, full, t):
    return "'#' || " + " || ".join(f"lpad(lower(to_hex(CAST(trunc({a} + ({b - a}) * {t}) AS BIGINT))), 2, '0')" for a, b in zip(light, full))


def _color_sql(colours):
    return f"CASE WHEN v >= 0 THEN {_channel(*colours[0], 'least(1.0, v / 1.5)')} ELSE {_channel(*colours[1], 'least(1.0, -v / 0.75)')} END"


@query("speed_color", f"WITH {_SPEED} SELECT phrase, {_color_sql(dyn.SPEED)} AS color FROM sp")
def speed_color(spark, d):
    return _speed(spark, d).select("phrase", dyn.ramp(F.col("speed"), F.lit(1.5), F.lit(0.75), dyn.SPEED).alias("color"))


@query("accel_color", f"WITH {_SPEED} SELECT phrase, {_color_sql(dyn.ACCEL)} AS color FROM sp")
def accel_color(spark, d):
    return _speed(spark, d).select("phrase", dyn.ramp(F.col("speed"), F.lit(1.5), F.lit(0.75), dyn.ACCEL).alias("color"))


@query("node_size", f"WITH {POST}, {DF}, m AS (SELECT min(df) AS lo, max(df) AS hi, greatest(6.0, least(40.0, 40.0 * sqrt(1500.0 / greatest(count(*) + 763, 1)))) AS big FROM df WHERE year = 1999) SELECT phrase, round(CASE WHEN lo = hi THEN big * 0.4 ELSE 5.0 + (big - 5.0) * (df - lo) / (hi - lo) END, 6) AS size FROM df, m WHERE year = 1999")
def node_size(spark, d):
    df = net.doc_freq(dense(spark, d)).where("year = 1999")
    m = df.agg(F.min("df").alias("lo"), F.max("df").alias("hi"), dyn.adaptive_max(F.count(F.lit(1)), F.lit(763)).alias("big"))
    return df.crossJoin(F.broadcast(m)).select("phrase", F.round(dyn.node_size(F.col("df"), F.col("lo"), F.col("hi"), 5.0, F.col("big")), 6).alias("size"))


@query("edge_width", f"WITH {POST}, {EDGES}, m AS (SELECT min(w) AS lo, max(w) AS hi FROM edges WHERE year = 1999) SELECT a, b, round(CASE WHEN lo = hi THEN 1.5 ELSE 0.5 + 4.5 * (w - lo) / (hi - lo) END, 6) AS width, round(1.0 + 4.0 * least(1.0, w / 200.0), 6) AS small_width FROM edges, m WHERE year = 1999")
def edge_width(spark, d):
    e = net.edges(dense(spark, d).where("year = 1999"))
    m = e.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    return e.crossJoin(F.broadcast(m)).select("a", "b", F.round(dyn.edge_width(F.col("w"), F.col("lo"), F.col("hi")), 6).alias("width"), F.round(dyn.edge_width_saturating(F.col("w")), 6).alias("small_width"))


# --- conductance -------------------------------------------------------------

_PAIRS = "pairs AS (SELECT a, b FROM edges GROUP BY a, b ORDER BY sum(w) DESC, a, b LIMIT 20)"


def _g_sql(k):
    return f"""{BOTH}, ua AS (SELECT p.a, p.b, n.year, n.c, n.w, row_number() OVER (PARTITION BY p.a, p.b, n.year ORDER BY n.w DESC, n.c) AS r FROM pairs p JOIN nbr n ON n.x = p.a AND n.c <> p.b QUALIFY r <= {k}),
 ub AS (SELECT p.a, p.b, n.year, n.c, n.w, row_number() OVER (PARTITION BY p.a, p.b, n.year ORDER BY n.w DESC, n.c) AS r FROM pairs p JOIN nbr n ON n.x = p.b AND n.c <> p.a QUALIFY r <= {k}),
 direct AS (SELECT p.a, p.b, e.year, e.w FROM pairs p JOIN edges e ON e.a = least(p.a, p.b) AND e.b = greatest(p.a, p.b)),
 keys AS (SELECT a, b, year FROM ua UNION SELECT a, b, year FROM ub UNION SELECT a, b, year FROM direct),
 thr AS (SELECT a, b, year, sum(CAST(ua.w AS DOUBLE) * ub.w / (ua.w + ub.w)) AS s FROM ua JOIN ub USING (a, b, year, c) GROUP BY a, b, year),
 sa AS (SELECT a, b, year, sum(1.0 / w) AS s, count(*) AS m, max(w) AS mx FROM ua GROUP BY a, b, year), sb AS (SELECT a, b, year, sum(1.0 / w) AS s, count(*) AS m, max(w) AS mx FROM ub GROUP BY a, b, year),
 g AS (SELECT a, b, year, coalesce(direct.w, 0) AS w_ab, greatest(coalesce(direct.w, 0), coalesce(sa.mx, 0), coalesce(sb.mx, 0)) AS base, (coalesce(direct.w, 0) > 0 OR thr.s IS NOT NULL) AS connected,
  CASE WHEN coalesce(direct.w, 0) > 0 OR thr.s IS NOT NULL THEN coalesce(direct.w, 0) + coalesce(thr.s, 0) ELSE 1.0 / (coalesce(sa.s, 0) / pow(coalesce(sa.m, 0) + 1, 2) + coalesce(sb.s, 0) / pow(coalesce(sb.m, 0) + 1, 2)) END AS g_raw
  FROM keys LEFT JOIN direct USING (a, b, year) LEFT JOIN thr USING (a, b, year) LEFT JOIN sa USING (a, b, year) LEFT JOIN sb USING (a, b, year))"""


_G = f"{POST}, {EDGES}, {_PAIRS}, {_g_sql(10)}"
_GN = f"{_G}, gn AS (SELECT *, CASE WHEN g_raw > 0 THEN round(g_raw / max(CASE WHEN g_raw > 0 THEN g_raw END) OVER (PARTITION BY year), 4) END AS g_norm FROM g)"


def strong_pairs(e, n=20):
    return e.groupBy("a", "b").agg(F.sum("w").alias("s")).orderBy(F.desc("s"), "a", "b").limit(n).select("a", "b")


def _g(spark, d, k=10):
    store = Scratch(spark, "edges")
    e = store.save(net.edges(dense(spark, d)))  # read several times
    return cond.conductance(e, store.save(strong_pairs(e)), k)


@query("g_series", f"WITH {_G} SELECT a, b, year, w_ab, connected, round(CASE WHEN base > 0 AND g_raw > 0 THEN g_raw / base ELSE 0 END, 4) AS g FROM g")
def g_series(spark, d):
    """Conductance scaled by the largest weight, 10 neighbours: the flagship."""
    return cond.normalised(_g(spark, d)).select("a", "b", "year", "w_ab", "connected", "g")


@query("g_raw_series", f"WITH {POST}, {EDGES}, {_PAIRS}, {_g_sql(20)} SELECT a, b, year, round(g_raw, 6) AS g_raw, connected FROM g")
def g_raw_series(spark, d):
    return _g(spark, d, 20).select("a", "b", "year", F.round("g_raw", 6).alias("g_raw"), "connected")


@query("g_norm", f"WITH {_GN} SELECT a, b, year, g_norm FROM gn")
def g_norm(spark, d):
    return cond.year_max_norm(_g(spark, d)).select("a", "b", "year", "g_norm")


@query("g_group_norm", f"WITH {_G}, mx AS (SELECT year, max(g_raw) * 0.9 AS g_max FROM g GROUP BY year) SELECT a, b, year, round(least(1.0, g_raw / g_max), 4) AS g_group FROM g JOIN mx USING (year)")
def g_group_norm(spark, d):
    g = _g(spark, d).withColumn("grp", F.lit("cs"))
    maxima = g.groupBy("grp", "year").agg((F.max("g_raw") * 0.9).alias("g_max"))
    return cond.group_norm(g, maxima).select("a", "b", "year", "g_group")


@query("resistance", f"WITH {_G} SELECT a, b, year, CASE WHEN g_raw > 0 THEN round(1 / g_raw, 4) END AS r FROM g")
def resistance(spark, d):
    return _g(spark, d).select("a", "b", "year", cond.resistance(F.col("g_raw")).alias("r"))


@query("concept_docs", f"WITH {POST}, {EDGES}, {DF}, {BOTH} SELECT d.year, d.phrase, d.df, count(n.c) AS n_neighbours, CAST(coalesce(sum(n.w), 0) AS BIGINT) AS weight FROM df d LEFT JOIN nbr n ON d.year = n.year AND d.phrase = n.x GROUP BY d.year, d.phrase, d.df")
def concept_docs(spark, d):
    p = dense(spark, d)
    n = net.both_ways(net.edges(p)).groupBy("year", F.col("x").alias("phrase")).agg(F.count(F.lit(1)).alias("n_neighbours"), F.sum("w").alias("weight"))
    return net.doc_freq(p).join(n, ["year", "phrase"], "left").na.fill(0, ["n_neighbours", "weight"])


@query("distance_window", f"WITH {_GN}, x AS (SELECT a, b, arg_max(g_raw, year) FILTER (WHERE g_raw > 0 AND year BETWEEN 1996 AND 1999) AS lr, arg_max(g_norm, year) FILTER (WHERE g_norm > 0) AS ln FROM gn GROUP BY a, b) SELECT a, b, round(lr, 6) AS g_last_raw, ln AS g_norm_last, coalesce(ln >= 0.5, false) AS alert FROM x")
def distance_window(spark, d):
    out = cond.distance_window(cond.year_max_norm(_g(spark, d)), 1996, 1999)
    return out.withColumn("g_last_raw", F.round("g_last_raw", 6))


_LAST3 = "l3 AS (SELECT a, b, max(CASE WHEN rn = 3 THEN g_norm END) AS v1, max(CASE WHEN rn = 2 THEN g_norm END) AS v2, max(CASE WHEN rn = 1 THEN g_norm END) AS v3 FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY year DESC) AS rn FROM gn WHERE g_norm IS NOT NULL) WHERE rn <= 3 GROUP BY a, b HAVING count(*) = 3)"


@query("trend_badge", f"WITH {_GN}, {_LAST3}, t AS (SELECT a, b, (v1 >= 0.8)::INT + (v2 >= 0.8)::INT + (v3 >= 0.8)::INT >= 2 AS above, v3 > v1 AS rising FROM l3) SELECT a, b, above, rising, above AND rising AS warning FROM t")
def trend_badge(spark, d):
    return cond.trend_badge(cond.year_max_norm(_g(spark, d)), 0.8)


@query("last3_rise", f"WITH {_GN}, {_LAST3} SELECT a, b, CASE WHEN v1 <> 0 THEN round((v3 - v1) / v1, 6) + 0.0 END AS rise FROM l3")
def last3_rise(spark, d):
    t = cond.last_three(cond.year_max_norm(_g(spark, d)))
    return t.select("a", "b", F.when(F.col("v1") != 0, F.round((F.col("v3") - F.col("v1")) / F.col("v1"), 6) + 0.0).alias("rise"))


@query("pre_burst", f"WITH {_GN}, x AS (SELECT a, b, avg(g_norm) FILTER (WHERE year >= 1996 AND year < 2001) AS p, avg(g_norm) FILTER (WHERE year < 1996) AS e FROM gn WHERE g_norm IS NOT NULL GROUP BY a, b) SELECT a, b, round(p, 6) AS pre_avg, round(e, 6) AS early_avg, round((p - e) / e, 6) + 0.0 AS pre_rise FROM x")
def pre_burst(spark, d):
    g = cond.year_max_norm(_g(spark, d))
    out = cond.pre_burst(g, g.select("a", "b").distinct().withColumn("burst", F.lit(2001)))
    return out.select("a", "b", F.round("pre_avg", 6).alias("pre_avg"), F.round("early_avg", 6).alias("early_avg"), (F.round("pre_rise", 6) + 0.0).alias("pre_rise"))


@query("pair_batch", f"WITH {_GN} SELECT a, b, count(*) AS n_years, round(max(g_raw), 6) AS g_peak, round(avg(g_norm), 6) AS g_norm_mean, min(year) AS first_year FROM gn WHERE g_norm IS NOT NULL GROUP BY a, b")
def pair_batch(spark, d):
    g = cond.year_max_norm(_g(spark, d)).where("g_norm IS NOT NULL")
    return g.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_years"), F.round(F.max("g_raw"), 6).alias("g_peak"), F.round(F.avg("g_norm"), 6).alias("g_norm_mean"), F.min("year").alias("first_year"))
