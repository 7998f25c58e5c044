"""Rank-biased overlap, BM25, concept pairs and focus subgraphs."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conductance as cond
from ..operators import focus as foc
from ..operators import network as net
from ..operators import retrieval as ret
from ..sources import files
from ..sources import papers as src
from ..storage import Scratch
from .catalog import BOTH, DF, EDGES, POST, SPARSE, query
from .text_queries import _MATCH, TOKS, _matched, _tokens, toks

QUERY = ["brand#11 economy", "brand#23 promo", "brand#34 standard", "brand#45 large", "brand#52 small"]
_Q = "q AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in QUERY) + f"]) AS phrase, unnest(range(1, {len(QUERY) + 1})) AS rq)"
RARE = ["brand#8 red plate", "brand#16 hot rod", "brand#15 blue widget", "brand#7 hot bolt", "brand#21 small gear"]
_RARE = "q AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in RARE) + "]) AS phrase)"
_RANKED = f"{POST}, {_Q}, rk AS (SELECT year, doc, phrase, row_number() OVER (PARTITION BY year, doc ORDER BY pos, phrase) AS r, count(*) OVER (PARTITION BY year, doc) AS n FROM post)"
_RBO = f"{_RANKED}, h AS (SELECT year, doc, greatest(r, rq) AS m, greatest(n, {len(QUERY)}) AS d FROM rk JOIN q USING (phrase)), rbo AS (SELECT year, doc, count(*) AS n_hits, 0.1 * sum(list_sum(list_transform(range(m, d + 1), lambda k: pow(0.9, k - 1) / k))) AS score FROM h GROUP BY year, doc)"


def ranked(spark, d):
    return ret.ranked_phrases(src.postings(spark, d))


@query("rbo", f"WITH {_RBO} SELECT year, doc, n_hits, round(score, 10) AS score FROM rbo")
def rbo(spark, d):
    return ret.rbo(QUERY, ranked(spark, d)).select("year", "doc", "n_hits", F.round("score", 10).alias("score"))


@query("max_rbo", f"WITH {_RANKED}, s AS (SELECT DISTINCT n FROM rk) SELECT n, round(0.1 * list_sum(list_transform(range(1, greatest(n, 5) + 1), lambda k: pow(0.9, k - 1) * least(k, 5) / k)), 10) AS max_rbo FROM s")
def max_rbo(spark, d):
    n = ranked(spark, d).select("n").distinct()
    return n.select("n", F.round(ret.max_rbo(F.lit(5), F.greatest(F.col("n"), F.lit(5)).cast("int")), 10).alias("max_rbo"))


@query("rbo_candidates", f"WITH {_RBO} SELECT year, doc, n_hits FROM rbo QUALIFY row_number() OVER (PARTITION BY year ORDER BY n_hits DESC, doc) <= 100")
def rbo_candidates(spark, d):
    return ret.candidates(QUERY, src.postings(spark, d), 100)


@query("search_rbo", f"WITH {_RBO}, r AS (SELECT year, doc, n_hits, round(score, 4) AS score FROM rbo), y AS (SELECT * FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY year ORDER BY score DESC, doc) <= 60) SELECT * FROM y ORDER BY score DESC, year DESC, doc LIMIT 20")
def search_rbo(spark, d):
    return ret.search_rbo(QUERY, ranked(spark, d))


@query("paper_schema", f"WITH {_RBO}, r AS (SELECT year, doc, round(score, 4) AS score FROM rbo WHERE round(score, 4) > 0 ORDER BY score DESC, year DESC, doc LIMIT 20) SELECT r.doc, r.year, score, o_orderpriority AS title, string_agg(h.phrase, '|' ORDER BY h.r) AS hit_phrases FROM r JOIN orders ON o_orderkey = r.doc JOIN (SELECT rk.year, rk.doc, phrase, rk.r FROM rk JOIN q USING (phrase)) h ON h.doc = r.doc AND h.year = r.year GROUP BY ALL")
def paper_schema(spark, d):
    docs = ranked(spark, d)
    top = ret.search_rbo(QUERY, docs).select("year", "doc", "score")
    hits = docs.where(F.col("phrase").isin(QUERY)).join(F.broadcast(top), ["year", "doc"]).groupBy("doc", "year", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]), "|").alias("hit_phrases"))
    meta = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("title"))
    return hits.join(meta, "doc", "left").select("doc", "year", "score", "title", "hit_phrases")


@query("metadata_join", "SELECT o_orderkey AS doc, coalesce(c.c_name, 'order ' || o_orderkey) AS title FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o_custkey = c_custkey")
def metadata_join(spark, d):
    first = src.table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name")
    o = src.table(spark, d, "orders")
    return o.join(first, o["o_custkey"] == first["c_custkey"], "left").select(F.col("o_orderkey").alias("doc"), F.coalesce("c_name", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("title"))


_STATUS = "sq AS (SELECT unnest(['brand#11 economy', 'brand#11 economys', 'brand#11 economyes', 'unknown', 'brand#23 promo', 'brand#23 promos']) AS phrase)"
_LOOSE = "CASE WHEN ends_with(phrase, 'es') THEN left(phrase, length(phrase) - 2) WHEN ends_with(phrase, 's') THEN left(phrase, length(phrase) - 1) END"


@query("phrase_status", f"WITH {POST}, {_STATUS}, kn AS (SELECT DISTINCT phrase AS k FROM post WHERE year >= 1999) SELECT phrase, CASE WHEN phrase IN (SELECT k FROM kn) THEN 'exact' WHEN {_LOOSE} IN (SELECT k FROM kn) THEN 'loose' ELSE 'missing' END AS status FROM sq")
def phrase_status(spark, d):
    asked = spark.createDataFrame([(x,) for x in ("brand#11 economy", "brand#11 economys", "brand#11 economyes", "unknown", "brand#23 promo", "brand#23 promos")], "phrase string")
    return ret.phrase_status(asked, src.postings(spark, d).where("year >= 1999"))


@query("resolve_variant", f"WITH {POST}, {_STATUS}, lx AS (SELECT phrase AS k, count(*) AS n FROM post GROUP BY phrase), f AS (SELECT phrase, unnest([phrase, phrase || '(s)', phrase || 'es', phrase || '(es)']) AS form, unnest([1, 2, 3, 4]) AS pri FROM sq), m AS (SELECT phrase, form AS match, pri, 0 AS n FROM f JOIN lx ON form = k UNION ALL SELECT phrase, k, 5, -n FROM sq JOIN lx ON string_split(k, ' ')[1] = string_split(phrase, ' ')[1]) SELECT phrase, match FROM m QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY pri, n, match) = 1")
def resolve_variant(spark, d):
    from pyspark.sql import Window as W

    asked = spark.createDataFrame([(x,) for x in ("brand#11 economy", "brand#11 economys", "brand#11 economyes", "unknown", "brand#23 promo", "brand#23 promos")], "phrase string")
    known = src.postings(spark, d).groupBy(F.col("phrase").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    forms = asked.select("phrase", F.posexplode(tx.phrase_variants(F.col("phrase"))).alias("pri", "form"))
    exact = forms.join(known, F.col("form") == F.col("k")).select("phrase", F.col("k").alias("match"), "pri", F.lit(0).cast("long").alias("order"))
    prefix = asked.join(known, F.split("phrase", " ")[0] == F.split("k", " ")[0]).select("phrase", F.col("k").alias("match"), F.lit(9).alias("pri"), (-F.col("n")).alias("order"))
    best = W.partitionBy("phrase").orderBy("pri", "order", "match")
    return exact.union(prefix).withColumn("rn", F.row_number().over(best)).where("rn = 1").select("phrase", "match")


@query("prefix_index", f"WITH {POST}, lx AS (SELECT phrase, count(*) AS n FROM post GROUP BY phrase) SELECT string_split(phrase, ' ')[1] AS word, phrase, n FROM lx QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, phrase) <= 5")
def prefix_index(spark, d):
    from pyspark.sql import Window as W

    n = src.postings(spark, d).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).withColumn("word", F.split("phrase", " ")[0])
    return n.withColumn("rn", F.row_number().over(W.partitionBy("word").orderBy(F.desc("n"), "phrase"))).where("rn <= 5").select("word", "phrase", "n")


_CAND = f"{POST}, {_Q}, ca AS (SELECT year, doc FROM post JOIN q USING (phrase) GROUP BY year, doc QUALIFY row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, doc) <= 2000), ch AS (SELECT post.* FROM post SEMI JOIN ca USING (year, doc))"


@query("pairs_ab", f"WITH {_CAND} SELECT x.phrase AS a, y.phrase AS b, count(*) AS n_papers, 2 * count(*) AS weight FROM ch x JOIN ch y ON x.doc = y.doc WHERE x.phrase IN (SELECT phrase FROM q) AND (y.phrase NOT IN (SELECT phrase FROM q) OR x.phrase < y.phrase) GROUP BY ALL ORDER BY n_papers DESC, a, b LIMIT 50")
def pairs_ab(spark, d):
    return ret.pairs_ab(QUERY, src.postings(spark, d))


@query("bridges_acb", f"WITH {_CAND.replace(POST, SPARSE).replace(_Q, _RARE)}, wy AS (SELECT x.phrase AS x, y.phrase AS y, count(*) AS w FROM ch x JOIN ch y ON x.doc = y.doc AND x.phrase <> y.phrase GROUP BY ALL), hub AS (SELECT phrase AS c FROM ch WHERE phrase NOT IN (SELECT phrase FROM q) GROUP BY phrase ORDER BY count(*) DESC, phrase LIMIT 30) SELECT s.x AS a, s.y AS c, t.y AS b, least(s.w, t.w) AS strength FROM wy s JOIN hub ON s.y = hub.c JOIN wy t ON t.x = s.y WHERE s.x IN (SELECT phrase FROM q) AND t.y NOT IN (SELECT phrase FROM q) AND t.y <> s.y AND NOT EXISTS (SELECT 1 FROM wy z WHERE z.x = s.x AND z.y = t.y) ORDER BY strength DESC, a, c, b LIMIT 50")
def bridges_acb(spark, d):
    return ret.bridges_acb(RARE, src.postings(spark, d, "sparse"))


@query("recommend", f"WITH {_CAND} SELECT x.phrase AS a, y.phrase AS b, x.year, count(*) AS n_papers FROM ch x JOIN ch y ON x.doc = y.doc WHERE x.phrase IN (SELECT phrase FROM q) AND y.phrase NOT IN (SELECT phrase FROM q) GROUP BY ALL HAVING count(*) >= 2")
def recommend(spark, d):
    p = src.postings(spark, d)
    chosen = p.join(ret.candidates(QUERY, p).select("year", "doc"), ["year", "doc"], "left_semi")
    a = chosen.where(F.col("phrase").isin(QUERY)).select("year", "doc", F.col("phrase").alias("a"))
    b = chosen.where(~F.col("phrase").isin(QUERY)).select("year", "doc", F.col("phrase").alias("b"))
    return a.join(b, ["year", "doc"]).groupBy("a", "b", "year").agg(F.count(F.lit(1)).alias("n_papers")).where("n_papers >= 2")


@query("orchestrate_skip", r"SELECT item_id, CASE WHEN regexp_full_match(text, '[A-Za-z0-9\s\-,.:'']+') AND len(list_filter(string_split(text, ','), lambda x: trim(x, ' ') <> '')) BETWEEN 1 AND 5 THEN array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: lower(trim(x, ' '))), lambda x: x <> '')[1:5], '|') END AS phrases FROM benchmark")
def orchestrate_skip(spark, d):
    t = F.col("text")
    return src.table(spark, d, "benchmark").select("item_id", F.when(tx.skips_expansion(t), F.array_join(tx.parse_phrases(t), "|")).alias("phrases"))


_ASKED = "ask AS (SELECT unnest(['brand#11 economy', 'brand#23 promos', 'brand#34 standardes', 'unknowns']) AS phrase)"
ASKED = ["brand#11 economy", "brand#23 promos", "brand#34 standardes", "unknowns"]
_EXPANDED = f"{_ASKED}, ex AS (SELECT phrase AS query, phrase FROM ask UNION SELECT phrase, {_LOOSE} FROM ask WHERE {_LOOSE} IS NOT NULL)"


@query("expand_query_a", f"WITH {_EXPANDED} SELECT query, phrase FROM ex")
def expand_query_a(spark, d):
    return ret.expanded(spark.createDataFrame([(x,) for x in ASKED], "phrase string"))


@query("a_is_query", f"WITH {POST}, {_EXPANDED}, fm AS (SELECT phrase AS f FROM ex UNION SELECT phrase || '(s)' FROM ex UNION SELECT phrase || '(es)' FROM ex), ph AS (SELECT DISTINCT phrase || CASE year % 3 WHEN 0 THEN '(s)' WHEN 1 THEN '(es)' ELSE '' END AS phrase FROM post) SELECT phrase, phrase IN (SELECT f FROM fm) AS is_query FROM ph")
def a_is_query(spark, d):
    k = F.col("year") % 3
    p = src.postings(spark, d).select(F.concat("phrase", F.when(k == 0, "(s)").when(k == 1, "(es)").otherwise("")).alias("phrase")).distinct()
    return p.withColumn("is_query", ret.is_query(F.col("phrase"), ret.expand_query(ASKED)))


_MAPPED = "mp AS (SELECT 'unknown' AS input, 'brand#23 promo' AS term UNION ALL SELECT 'brand#34 vague', 'brand#34 standard')"


@query("resolve_with_match", f"""WITH {POST}, {_MAPPED}, sq AS (SELECT unnest(['brand#11 economy', 'brand#45 nothing', 'unknown', 'brand#34 vague', 'no such']) AS phrase), lx AS (SELECT phrase AS k, count(*) AS n FROM post GROUP BY phrase),
 fm AS (SELECT phrase, CAST(NULL AS VARCHAR) AS matched, 0 AS step, 0 AS o, phrase AS term FROM sq UNION ALL SELECT phrase, term, 1, 0, term FROM sq JOIN mp ON input = phrase UNION ALL (SELECT phrase, k, 2, row_number() OVER (PARTITION BY phrase ORDER BY n DESC, k) AS o, k FROM sq JOIN lx ON string_split(k, ' ')[1] = string_split(phrase, ' ')[1] QUALIFY o <= 5)),
 al AS (SELECT phrase, matched, step, o, unnest([term, term || '(s)', term || 'es', term || '(es)']) AS form, unnest([0, 1, 2, 3]) AS fa FROM fm), ok AS (SELECT al.*, k FROM al JOIN lx ON form = k QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY step, o, fa, k) = 1)
 SELECT sq.phrase, k AS match, matched FROM sq LEFT JOIN ok USING (phrase)""")
def resolve_with_match(spark, d):
    asked = spark.createDataFrame([(x,) for x in ("brand#11 economy", "brand#45 nothing", "unknown", "brand#34 vague", "no such")], "phrase string")
    known = src.postings(spark, d).groupBy(F.col("phrase").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    mapping = spark.createDataFrame([("unknown", "brand#23 promo"), ("brand#34 vague", "brand#34 standard")], "input string, term string")
    return ret.resolved(asked, known, mapping)


# --- BM25 --------------------------------------------------------------------

_BM = f"""{TOKS}, tf AS MATERIALIZED (SELECT doc, tok, len, count(*) AS tf FROM (SELECT doc, len(toks) AS len, unnest(toks) AS tok FROM toks) GROUP BY doc, tok, len),
 dfs AS MATERIALIZED (SELECT tok, count(*) AS df FROM tf GROUP BY tok), st AS MATERIALIZED (SELECT count(*) AS n, avg(len(toks)) AS ml FROM toks),
 qt AS MATERIALIZED (SELECT DISTINCT item_id AS query, unnest({_tokens('text')}) AS tok FROM benchmark),
 sc AS (SELECT query, doc, sum(ln(1 + ((SELECT n FROM st) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT ml FROM st)))) AS score FROM qt JOIN dfs USING (tok) JOIN tf USING (tok) GROUP BY query, doc)"""


def asked(spark, d):
    q = src.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(tx.tokenize(F.col("text"))).alias("tok"))
    return q.distinct()


@query("bm25_build", f"WITH {_BM} SELECT tok, df FROM dfs")
def bm25_build(spark, d):
    return ret.bm25_tables(toks(spark, d))[1]


@query("bm25_search", f"WITH {_BM} SELECT query, doc, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 10")
def bm25_search(spark, d):
    return ret.best(ret.bm25(toks(spark, d), asked(spark, d)), 10).withColumn("score", F.round("score", 6))


@query("pagination", f"WITH {_BM} SELECT query, doc, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) BETWEEN 11 AND 20")
def pagination(spark, d):
    return ret.best(ret.bm25(toks(spark, d), asked(spark, d)), 10, 10).withColumn("score", F.round("score", 6))


@query("bm25_count", f"WITH {_BM} SELECT query, count(*) AS n FROM sc GROUP BY query")
def bm25_count(spark, d):
    return ret.bm25(toks(spark, d), asked(spark, d)).groupBy("query").agg(F.count(F.lit(1)).alias("n"))


_REC = _MATCH[_MATCH.index("tk AS (") :]


@query("bm25_in_set", f"WITH {_BM}, {_REC} SELECT query, doc, round(score, 6) AS score FROM sc WHERE doc IN (SELECT doc FROM rec) QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 5")
def bm25_in_set(spark, d):
    """Among the documents that the annotation gives a phrase."""
    t, records = _matched(spark, d)
    scored = ret.bm25(t, asked(spark, d)).join(records.where("size(phrases) > 0").select("doc").distinct(), "doc", "left_semi")
    return ret.best(scored, 5).select("query", "doc", F.round("score", 6).alias("score"))


@query("fts_multi", f"WITH {_BM}, t AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 200) SELECT doc, round(max(score), 6) AS score, count(*) AS n_hits FROM t GROUP BY doc")
def fts_multi(spark, d):
    top = ret.best(ret.bm25(toks(spark, d), asked(spark, d)), 200)
    return top.groupBy("doc").agg(F.round(F.max("score"), 6).alias("score"), F.count(F.lit(1)).alias("n_hits"))


@query("focus_papers", f"WITH {POST} SELECT x.year, x.doc FROM post x JOIN post y ON x.doc = y.doc WHERE x.phrase = 'brand#11 economy' AND y.phrase = 'brand#23 promo' ORDER BY year DESC, doc LIMIT 30")
def focus_papers(spark, d):
    p = src.postings(spark, d)
    x, y = p.where("phrase = 'brand#11 economy'").select("year", "doc"), p.where("phrase = 'brand#23 promo'").select("doc")
    return x.join(y, "doc", "left_semi").select("year", "doc").orderBy(F.desc("year"), "doc").limit(30)


# --- focus subgraph ----------------------------------------------------------

_F = QUERY[:2]
_FOCUS = f"""{POST}, {EDGES}, {BOTH}, ny AS (SELECT x, c, w FROM nbr WHERE year = 1999), fx AS (SELECT unnest(['{_F[0]}', '{_F[1]}']) AS x), z AS (SELECT DISTINCT x AS node FROM ny JOIN fx USING (x)),
 o AS (SELECT DISTINCT c AS node FROM (SELECT c FROM ny JOIN fx USING (x) QUALIFY row_number() OVER (PARTITION BY ny.x ORDER BY w DESC, c) <= 5)),
 ch AS (SELECT x, c, w FROM ny WHERE x IN (SELECT node FROM o) AND c NOT IN (SELECT node FROM z UNION SELECT node FROM o) QUALIFY row_number() OVER (PARTITION BY x ORDER BY w DESC, c) <= 5),
 nd AS (SELECT node, min(hop) AS hop FROM (SELECT node, 0 AS hop FROM z UNION ALL SELECT node, 1 FROM o UNION ALL SELECT c, 2 FROM ch) GROUP BY node)"""


def _focus(spark, d):
    e = Scratch(spark, "year").save(net.edges(src.postings(spark, d).where("year = 1999")).select("a", "b", "w"))
    return foc.focus_subgraph(e, _F, 5)


@query("focus_subgraph", f"WITH {_FOCUS} SELECT node, CAST(hop AS BIGINT) AS hop FROM nd")
def focus_subgraph(spark, d):
    return _focus(spark, d)[0].withColumn("hop", F.col("hop").cast("long"))


@query("focus_edges", f"WITH {_FOCUS} SELECT e.a, e.b, e.w FROM edges e JOIN nd p ON e.a = p.node JOIN nd q ON e.b = q.node WHERE e.year = 1999 AND p.hop + q.hop <= 1 UNION SELECT least(x, c), greatest(x, c), w FROM ch")
def focus_edges(spark, d):
    return _focus(spark, d)[1]


@query("focus_doc_freq", f"WITH {_FOCUS}, {DF} SELECT phrase, df FROM df WHERE year = 1998 AND phrase IN (SELECT node FROM nd)")
def focus_doc_freq(spark, d):
    nodes = _focus(spark, d)[0].select(F.col("node").alias("phrase"))
    return net.doc_freq(src.postings(spark, d).where("year = 1998")).join(F.broadcast(nodes), "phrase", "left_semi").select("phrase", "df")


@query("focus_sizes", f"WITH {POST}, {DF}, f AS (SELECT phrase, row_number() OVER (ORDER BY df DESC, phrase) - 1 AS r FROM df WHERE year = 1999 AND phrase IN ({', '.join(repr(x) for x in QUERY)})) SELECT phrase, round(greatest(72.0 - r * (72.0 * 0.08), 72.0 * 0.6), 6) AS size FROM f")
def focus_sizes(spark, d):
    df = net.doc_freq(src.postings(spark, d).where("year = 1999")).where(F.col("phrase").isin(QUERY))
    return foc.focus_sizes(df, 72.0).withColumn("size", F.round("size", 6))


@query("focus_terms", """WITH al AS (SELECT DISTINCT lower(p_name) AS merged, lower(p_name) || 's' AS variant FROM part), w AS (SELECT p_partkey AS "at", CASE p_partkey % 3 WHEN 0 THEN p_name || 's' WHEN 1 THEN '  ' ELSE ' ' || upper(p_name) || ' ' END AS phrase FROM part), f AS (SELECT "at", lower(trim(phrase)) AS phrase FROM w WHERE trim(phrase) <> '' ORDER BY "at" LIMIT 5) SELECT min("at") AS "at", coalesce(merged, phrase) AS term FROM f LEFT JOIN al ON variant = phrase GROUP BY term""")
def focus_terms(spark, d):
    part, k = src.table(spark, d, "part"), F.col("p_partkey") % 3
    words = part.select(F.col("p_partkey").alias("at"), F.when(k == 0, F.concat("p_name", F.lit("s"))).when(k == 1, "  ").otherwise(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))).alias("phrase"))
    mapping = part.select(F.lower("p_name").alias("merged")).distinct().withColumn("variant", F.concat("merged", F.lit("s")))
    return foc.focus_terms(words, mapping)


@query("year_modes", f"WITH {POST}, y AS (SELECT DISTINCT year FROM post), m AS (SELECT unnest(['static', 'speed', 'accel']) AS mode, unnest([0, 1, 2]) AS back) SELECT year, mode, year - back AS before FROM y, m WHERE back = 0 OR year - back >= 1996")
def year_modes(spark, d):
    return foc.year_modes(src.postings(spark, d).select("year").distinct(), 1996)


def _series(spark, d):
    p = src.postings(spark, d)
    return net.top_edges(net.edges(p.where("year = 1999")), 100).select("a", "b", "w"), net.doc_freq(p)


_TOP = f"{POST}, {EDGES}, {DF}, en AS (SELECT a, b, w FROM edges WHERE year = 1999 ORDER BY w DESC, a, b LIMIT 100), nd AS (SELECT phrase, df FROM df WHERE year = 1999 AND phrase IN (SELECT a FROM en UNION SELECT b FROM en)), mm AS (SELECT min(df) AS lo, max(df) AS hi, greatest(6.0, least(40.0, 40.0 * sqrt(1500.0 / greatest(count(*) + (SELECT count(*) FROM en), 1)))) AS big FROM nd), mw AS (SELECT min(w) AS lo, max(w) AS hi FROM en)"
_SIZE = "round(CASE WHEN lo = hi THEN big * 0.4 ELSE 5.0 + (big - 5.0) * (df - lo) / (hi - lo) END, 6) AS size"
_WIDTH = "round(CASE WHEN lo = hi THEN 1.5 ELSE 0.5 + 4.5 * (w - lo) / (hi - lo) END, 6) AS width"


@query("export_static_nodes", f"WITH {_TOP} SELECT phrase, df, {_SIZE} FROM nd, mm")
def export_static_nodes(spark, d):
    return foc.static_tables(*_series(spark, d), 1999)[0].withColumn("size", F.round("size", 6))


@query("export_static_edges", f"WITH {_TOP} SELECT a, b, w, {_WIDTH} FROM en, mw")
def export_static_edges(spark, d):
    return foc.static_tables(*_series(spark, d), 1999)[1].withColumn("width", F.round("width", 6))


def _fold(rows: str, keys: str) -> str:
    """Log fold change of shares between 1999 and 1998 of ``rows`` (year, keys, n)."""
    total = lambda y: f"(SELECT sum(n) FROM {rows} WHERE year = {y})"
    count = lambda y: f"coalesce(sum(n) FILTER (WHERE year = {y}), 0)"
    return f"(SELECT {keys}, log2((({count(1999)} + 0.5) / {total(1999)}) / (({count(1998)} + 0.5) / {total(1998)})) AS change FROM {rows} WHERE year IN (1998, 1999) GROUP BY {keys})"


_ENDS = "ec AS (SELECT df.year, en.a, en.b, sum(df) AS n FROM en JOIN df ON df.phrase IN (en.a, en.b) GROUP BY ALL)"


@query("export_speed_nodes", f"WITH {_TOP}, dn AS (SELECT year, phrase, df AS n FROM df) SELECT phrase, df, {_SIZE}, round(change, 6) + 0.0 AS change FROM nd JOIN {_fold('dn', 'phrase')} USING (phrase), mm")
def export_speed_nodes(spark, d):
    return foc.change_tables(*_series(spark, d), 1999, "speed")[0].select("phrase", "df", F.round("size", 6).alias("size"), (F.round("change", 6) + 0.0).alias("change"))


@query("export_speed_edges", f"WITH {_TOP}, {_ENDS} SELECT a, b, w, {_WIDTH}, round(change, 6) + 0.0 AS change FROM en JOIN {_fold('ec', 'a, b')} USING (a, b), mw")
def export_speed_edges(spark, d):
    return foc.change_tables(*_series(spark, d), 1999, "speed")[1].select("a", "b", "w", F.round("width", 6).alias("width"), (F.round("change", 6) + 0.0).alias("change"))


@query("export_accel_nodes", f"WITH {_TOP}, sh AS (SELECT year, phrase, df / sum(df) OVER (PARTITION BY year) AS s FROM df) SELECT phrase, df, {_SIZE}, round(coalesce(x.s, 0) - 2 * coalesce(y.s, 0) + coalesce(z.s, 0), 9) + 0.0 AS change FROM nd LEFT JOIN (SELECT * FROM sh WHERE year = 1999) x USING (phrase) LEFT JOIN (SELECT * FROM sh WHERE year = 1998) y USING (phrase) LEFT JOIN (SELECT * FROM sh WHERE year = 1997) z USING (phrase), mm")
def export_accel_nodes(spark, d):
    return foc.change_tables(*_series(spark, d), 1999, "accel")[0].select("phrase", "df", F.round("size", 6).alias("size"), (F.round("change", 9) + 0.0).alias("change"))


def _focus_parts(spark, d, mode):
    p = src.postings(spark, d)
    return foc.focus_tables(*_focus(spark, d), net.doc_freq(p), net.edges(p), 1999, mode)


@query("focus_node_colours", f"WITH {_FOCUS} SELECT node, CAST(hop AS BIGINT) AS hop, CASE hop WHEN 0 THEN '{foc.HOPS[0]}' WHEN 1 THEN '{foc.HOPS[1]}' ELSE '{foc.HOPS[2]}' END AS color FROM nd")
def focus_node_colours(spark, d):
    return _focus_parts(spark, d, "static")[0].select("node", F.col("hop").cast("long").alias("hop"), "color")


_FEDGES = f"{_FOCUS}, fe AS (SELECT e.a, e.b, e.w FROM edges e JOIN nd p ON e.a = p.node JOIN nd q ON e.b = q.node WHERE e.year = 1999 AND p.hop + q.hop <= 1 UNION SELECT least(x, c), greatest(x, c), w FROM ch), fw AS (SELECT e.year, e.a, e.b, e.w AS n FROM edges e JOIN fe ON e.a = fe.a AND e.b = fe.b)"


@query("focus_edge_weights", f"WITH {_FEDGES} SELECT year, a, b, n AS w FROM fw")
def focus_edge_weights(spark, d):
    return foc.focus_edge_weights(_focus(spark, d)[1], net.edges(src.postings(spark, d)))


@query("focus_speed_edges", f"WITH {_FEDGES} SELECT a, b, w, round(change, 6) + 0.0 AS change FROM fe JOIN {_fold('fw', 'a, b')} USING (a, b)")
def focus_speed_edges(spark, d):
    return _focus_parts(spark, d, "speed")[1].select("a", "b", "w", (F.round("change", 6) + 0.0).alias("change"))


@query("focus_speed_nodes", f"WITH {_FOCUS}, {DF}, dn AS (SELECT year, phrase AS node, df AS n FROM df WHERE phrase IN (SELECT node FROM nd)) SELECT node, CAST(hop AS BIGINT) AS hop, round(coalesce(change, 0), 6) + 0.0 AS change FROM nd LEFT JOIN {_fold('dn', 'node')} USING (node)")
def focus_speed_nodes(spark, d):
    return _focus_parts(spark, d, "speed")[0].select("node", F.col("hop").cast("long").alias("hop"), (F.round("change", 6) + 0.0).alias("change"))


_FILES = """fl AS (SELECT DISTINCT 'static' AS mode, 'network_' || y || '_e20_t1500' || s || '.html' AS file, y, s FROM yr, (SELECT unnest(['', '_disc']) AS s)
 UNION ALL SELECT 'speed', 'network_' || (y - 1) || '-' || y || '_e20_t1500.html', y, '' FROM yr UNION ALL SELECT 'accel', 'network_' || (y - 2) || '-' || (y - 1) || '-' || y || '_e10_t1500.html', y, '' FROM yr)"""


@query("registry", f"""WITH yr AS (SELECT DISTINCT 18 + year(o_orderdate) AS y FROM orders), {_FILES} SELECT CAST(y AS BIGINT) AS year, CASE WHEN y = 1991 THEN 5 WHEN y = 1992 THEN 10 ELSE 20 END AS e, CASE WHEN y <= 2016 THEN 1.0 WHEN y <= 2021 THEN 0.5 ELSE 0.3 END AS w_cs, 1500 AS topn,
 'network_' || y || '_e20_t1500' || CASE WHEN y <= 2016 THEN '' ELSE '_disc' END || '.html' AS static_file, 'network_' || (y - 1) || '-' || y || '_e20_t1500.html' AS speed_file, '' AS accel_file FROM yr""")
def registry(spark, d):
    """Files of other thresholds are not taken, weighted ones where the year is weighted."""
    years = src.table(spark, d, "orders").select((F.year("o_orderdate") + 18).cast("long").alias("year")).distinct()
    y = lambda back: (F.col("year") - back).cast("string")
    name = lambda *parts: F.concat(F.lit("network_"), *parts, F.lit(".html"))
    listed = [("static", name(y(0), F.lit("_e20_t1500"))), ("static", name(y(0), F.lit("_e20_t1500_disc"))), ("speed", name(y(1), F.lit("-"), y(0), F.lit("_e20_t1500"))), ("accel", name(y(2), F.lit("-"), y(1), F.lit("-"), y(0), F.lit("_e10_t1500")))]
    found = years.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), f.alias("file")) for m, f in listed])).alias("f")).select("f.*")
    return files.registry(found, years)


@query("hub_neighbours", f"WITH {POST}, {EDGES}, {BOTH} SELECT year, x, count(*) AS degree, max(w) AS strongest FROM nbr GROUP BY year, x")
def hub_neighbours(spark, d):
    n = cond.both_ways(net.edges(src.postings(spark, d)))
    return n.groupBy("year", "x").agg(F.count(F.lit(1)).alias("degree"), F.max("w").alias("strongest"))
