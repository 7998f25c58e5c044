"""Retrieval: rank-biased overlap, BM25, phrase status, concept pairs and bridges."""

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import Scratch
from .network import edges

K1, LENGTH_SHARE = 1.2, 0.75


# --- rank-biased overlap ------------------------------------------------------


def overlap_weights(spark: SparkSession, depth: int, p: float = 0.9) -> DataFrame:
    """``m, d, wt``: the sum over k = m..d of ``p**(k-1) / k`` for all ranks up to ``depth``, a small fixed table."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    rows = []
    for d in range(1, depth + 1):
        total = 0.0
        for m in range(d, 0, -1):
            total += p ** (m - 1) / m
            rows.append((m, d, total))
    return spark.createDataFrame(rows, "m int, d int, wt double")


def rbo(query: list[str], docs: DataFrame, depth: int = 64, p: float = 0.9) -> DataFrame:
    """``year, doc, n_hits, score``: overlap of a ranked phrase list with each document's ranked phrases.

    ``docs``: year, doc, phrase, rank (from 1), n. Only documents that share a phrase are scored:
    a join on the phrase replaces the comparison of lists. Lists longer than ``depth`` are scored
    by the closed sum instead of the table.
    """
    spark = docs.sparkSession
    ranks = list(dict.fromkeys(query))
    wanted = F.broadcast(spark.createDataFrame([(q, ranks.index(q) + 1) for q in ranks], "phrase string, rq int"))
    hits = docs.join(wanted, "phrase").select("year", "doc", F.greatest("rank", "rq").cast("int").alias("m"), F.greatest("n", F.lit(len(query))).cast("int").alias("d"))
    table = F.broadcast(overlap_weights(spark, depth, p).select("m", F.col("d").alias("d_"), "wt"))
    scored = hits.join(table, (hits["m"] == table["m"]) & (hits["d"] == table["d_"]), "left").select("year", "doc", hits["m"].alias("m"), "d", "wt")
    beyond = F.aggregate(F.sequence(F.col("m"), F.col("d")), F.lit(0.0), lambda s, k: s + F.pow(F.lit(p), k - 1) / k)
    return scored.groupBy("year", "doc").agg(F.count(F.lit(1)).alias("n_hits"), ((1 - p) * F.sum(F.coalesce("wt", beyond))).alias("score"))


def max_rbo(n: Column, d: Column, p: float = 0.9) -> Column:
    """The largest overlap a list of n phrases can reach at depth d."""
    return F.when(d > 0, (1 - p) * F.aggregate(F.sequence(F.lit(1), d), F.lit(0.0), lambda s, k: s + F.pow(F.lit(p), k - 1) * F.least(k, n) / k)).otherwise(1.0)


def ranked_phrases(postings: DataFrame) -> DataFrame:
    """``year, doc, phrase, rank, n`` by place of first hit."""
    by_doc = W.partitionBy("year", "doc")
    return postings.select("year", "doc", "phrase", F.row_number().over(by_doc.orderBy("pos", "phrase")).alias("rank"), F.count(F.lit(1)).over(by_doc).alias("n"))


def search_rbo(query: list[str], docs: DataFrame, top: int = 20, p: float = 0.9) -> DataFrame:
    """Best documents: the best of each year first, then the best of all; by rounded score, later year, id."""
    scored = rbo(query, docs, p=p).withColumn("score", F.round("score", 4)).where("score > 0")
    per_year = scored.withColumn("rn", F.row_number().over(W.partitionBy("year").orderBy(F.desc("score"), "doc"))).where(F.col("rn") <= 3 * top)
    return per_year.drop("rn").orderBy(F.desc("score"), F.desc("year"), "doc").limit(top)


def phrase_status(queries: DataFrame, known: DataFrame) -> DataFrame:
    """``phrase, status``: exact, loose (its singular is known) or missing. ``known``: phrase."""
    k = known.select(F.col("phrase").alias("k")).distinct()
    exact = queries.join(k.select(F.col("k").alias("e")), F.col("phrase") == F.col("e"), "left")
    loose = exact.join(k.select(F.col("k").alias("l")), tx.strip_plural(F.col("phrase")) == F.col("l"), "left")
    return loose.select("phrase", F.when(F.col("e").isNotNull(), "exact").when(F.col("l").isNotNull(), "loose").otherwise("missing").alias("status"))


def resolved(asked: DataFrame, known: DataFrame, mapping: DataFrame | None = None, most: int = 5) -> DataFrame:
    """``phrase, match, matched``: the annotation's form of each phrase, and the mapped or lexicon term it came from.

    ``known``: k, n, the phrases of the annotation. First its own forms in order, then the forms of what
    ``mapping`` (input, term) names, then those of the ``most`` most frequent known phrases with its first word.
    """
    def found(terms: DataFrame, step: int) -> DataFrame:
        forms = terms.select("phrase", "matched", "order", F.posexplode(tx.phrase_variants(F.col("term"))).alias("form_at", "form"))
        return forms.join(known.select("k"), F.col("form") == F.col("k")).select("phrase", F.col("k").alias("match"), "matched", F.struct(F.lit(step).alias("step"), "order", "form_at", F.col("k").alias("name")).alias("rank"))

    none, first = F.lit(None).cast("string"), F.lit(0).cast("long")
    out = found(asked.select("phrase", none.alias("matched"), first.alias("order"), F.col("phrase").alias("term")), 0)
    if mapping is not None:
        named = asked.join(mapping, F.col("phrase") == F.col("input"))
        out = out.union(found(named.select("phrase", F.col("term").alias("matched"), first.alias("order"), "term"), 1))
    alike = asked.join(known, F.split("phrase", " ")[0] == F.split("k", " ")[0]).withColumn("order", F.row_number().over(W.partitionBy("phrase").orderBy(F.desc("n"), "k")).cast("long")).where(F.col("order") <= most)
    out = out.union(found(alike.select("phrase", F.col("k").alias("matched"), "order", F.col("k").alias("term")), 2))
    best = out.groupBy("phrase").agg(F.min_by(F.struct("match", "matched"), "rank").alias("b"))
    return asked.join(best, "phrase", "left").select("phrase", "b.match", "b.matched")


def orchestrate(text: str, expand: Callable[[str], list[str]] | None = None, cache: dict | None = None, most: int = 5) -> tuple[list[str], str]:
    """Ordered phrases of a search and how they were found: ``skip``, ``cache``, ``llm`` or ``error: ...``.

    Plain English phrases are taken as they are; anything else is looked up in ``cache`` (query to
    phrases) or given to ``expand``, whose answer is kept there.
    """
    q = text.strip()
    if not q:
        raise ValueError("the query is empty")
    parts = [p.strip().lower() for p in q.split(",") if p.strip()]
    if re.fullmatch(r"[A-Za-z0-9\s\-,.:']+", q) and 1 <= len(parts) <= most:
        return parts[:most], "skip"
    if cache is not None and cache.get(q):
        return list(cache[q])[:most], "cache"
    if expand is None:
        raise ValueError("the query needs expansion, and no function for it is given")
    try:
        phrases = list(expand(q))
    except Exception as e:
        return [], f"error: {type(e).__name__}: {e}"
    if cache is not None:
        cache[q] = phrases
    return phrases, "llm"


def recommend(query: list[str], postings: DataFrame, last_years: DataFrame, top: int = 50, most: int | None = 2000) -> dict:
    """Pairs and bridges of the query with the status of its phrases and a warning for those that are missing.

    ``last_years``: the postings that tell which phrases are known.
    """
    asked = postings.sparkSession.createDataFrame([(q,) for q in query], "phrase string")
    status = [r.asDict() for r in phrase_status(asked, last_years.select("phrase")).collect()]  # one row for each query phrase
    missing = sorted(r["phrase"] for r in status if r["status"] == "missing")
    warnings = [{"code": "PHRASE_MISSING", "level": "warning", "detail": missing}] if missing else []
    return {"phrase_status": status, "warnings": warnings, "pairs": pairs_ab(query, postings, top, most), "bridges": bridges_acb(query, postings, top=top, most=most), "candidates": candidates(query, postings, most)}


# --- concept pairs ------------------------------------------------------------


def expanded(queries: DataFrame) -> DataFrame:
    """``query, phrase``: each query phrase and its singular, where it has one; what side A of a pair may be."""
    forms = F.array(F.col("phrase"), tx.strip_plural(F.col("phrase")))
    return queries.select(F.col("phrase").alias("query"), F.explode(F.array_compact(forms)).alias("phrase")).where("phrase <> ''").distinct()


def is_query(phrase: Column, allowed: list[str]) -> Column:
    """Whether a phrase is one of the (expanded) queries, as it stands or as either with a trailing (s) or (es)."""
    forms = {f"{q}{tail}" for q in allowed for tail in ("", "(s)", "(es)")}
    forms |= {q.removesuffix(tail) for q in allowed for tail in ("(s)", "(es)")}
    return phrase.isin(sorted(forms))


def expand_query(query: list[str]) -> list[str]:
    """The query phrases and their singulars as a list, in order; the rule of :func:`expanded` for a few phrases."""
    out = []
    for q in query:
        p = q.strip().lower()
        out.append(q)
        if p.endswith("es") and len(p) > 3:
            out.append(p[:-2])
        elif p.endswith("s") and len(p) > 2:
            out.append(p[:-1])
    return list(dict.fromkeys(x for x in out if x))


def candidates(query: list[str], postings: DataFrame, most: int | None = 2000) -> DataFrame:
    """``year, doc``: documents with any of the phrases, at most ``most`` per year by hits, then id; all without ``most``."""
    hits = postings.where(F.col("phrase").isin(query)).groupBy("year", "doc").agg(F.count(F.lit(1)).alias("n_hits"))
    if most is None:
        return hits
    return hits.withColumn("rn", F.row_number().over(W.partitionBy("year").orderBy(F.desc("n_hits"), "doc"))).where(F.col("rn") <= most).select("year", "doc", "n_hits")


def pairs_ab(query: list[str], postings: DataFrame, top: int = 50, most: int | None = 2000) -> DataFrame:
    """``a, b, n_papers, weight``: query-like phrases and what they stand with in the candidate documents.

    Of two query-like phrases the smaller is A.
    """
    allowed = expand_query(query)
    chosen = postings.join(candidates(query, postings, most).select("year", "doc"), ["year", "doc"], "left_semi")
    like = is_query(F.col("phrase"), allowed)
    left, right = chosen.where(like).select("doc", F.col("phrase").alias("a")), chosen.select("doc", F.col("phrase").alias("b"), like.alias("like"))
    n = left.join(right, "doc").where(~F.col("like") | (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_papers"))
    return n.orderBy(F.desc("n_papers"), "a", "b").limit(top).withColumn("weight", 2 * F.col("n_papers"))


def bridges_acb(query: list[str], postings: DataFrame, hubs: int = 30, top: int = 50, most: int | None = 2000) -> DataFrame:
    """``a, c, b, strength``: A and B never together in the candidate documents, both with a hub C."""
    like = lambda c: is_query(F.col(c), expand_query(query))
    chosen = postings.join(candidates(query, postings, most).select("year", "doc"), ["year", "doc"], "left_semi").withColumn("year", F.lit(0))
    store = Scratch(postings.sparkSession, "bridges")
    chosen = store.save(chosen)
    e = edges(chosen)
    ways = store.save(e.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").union(e.select("b", "a", "w")))
    hub = chosen.where(~like("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "phrase").limit(hubs).select(F.col("phrase").alias("c"))
    ac = ways.where(like("x")).select(F.col("x").alias("a"), F.col("y").alias("c"), F.col("w").alias("wa")).join(F.broadcast(hub), "c")  # at most `hubs` rows
    cb = ways.where(~like("y")).select(F.col("x").alias("c"), F.col("y").alias("b"), F.col("w").alias("wb"))
    met = ac.join(cb, "c").where("b <> c")
    apart = met.join(ways.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti")
    return apart.select("a", "c", "b", F.least("wa", "wb").alias("strength")).orderBy(F.desc("strength"), "a", "c", "b").limit(top)


# --- BM25 ---------------------------------------------------------------------


def bm25_tables(toks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term counts (doc, tok, tf, len), document frequencies (tok, df) and the corpus row (n_docs, mean_len)."""
    sized = toks.select("doc", F.size("toks").alias("len"), F.explode("toks").alias("tok"))
    tf = sized.groupBy("doc", "tok", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    stats = toks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("toks")).alias("mean_len"))
    return tf, df, stats


def bm25(toks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, doc, score`` of all documents that hold a query word. ``queries``: query, tok (distinct).

    The query words are written first, so that their size is known, and only the tokens among them are
    counted; the optimiser broadcasts them below its threshold.
    """
    store = Scratch(toks.sparkSession, "bm25")
    toks = store.save(toks.select("doc", "toks"))
    words = store.save(queries.select("tok").distinct())
    asked = store.save(queries)
    sized = toks.select("doc", F.size("toks").alias("len"), F.explode("toks").alias("tok"))
    tf = store.save(sized.join(words, "tok").groupBy("doc", "tok", "len").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    stats = store.save(toks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("toks")).alias("mean_len")))
    store.drop(toks, words)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * F.col("len") / F.col("mean_len"))
    # one number for each document and word, made once; then a sum for each query that has the word
    weighed = tf.join(df, "tok").crossJoin(F.broadcast(stats)).select("doc", "tok", (idf * F.col("tf") * (K1 + 1) / norm).alias("part"))  # stats: one row
    return weighed.join(asked, "tok").groupBy("query", "doc").agg(F.sum("part").alias("score"))


def best(scores: DataFrame, top: int, offset: int = 0) -> DataFrame:
    """A page of each query's documents by score, then id; scores that differ by rounding noise are equal."""
    ranked = scores.withColumn("rn", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")))
    return ranked.where(F.col("rn").between(offset + 1, offset + top)).drop("rn")
