"""Lexicon extraction: seeds, bigram statistics, junction-approved merges, repeated to a fixed point."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import Scratch
from . import grams
from .ranking import ranked


@dataclass(frozen=True)
class ScanParams:
    theta: float = 0.3
    least_adjacent: int = 5
    least_together: int = 3
    iterations: int = 10
    max_tokens: int = 6
    seeds: int = 50
    stop1: tuple = ()
    stop2: tuple = ()
    stop3: tuple = field(default=())


def tokens(papers_text: DataFrame) -> DataFrame:
    """``doc, toks``: from arxiv_id, text."""
    return papers_text.select(F.col("arxiv_id").alias("doc"), tx.tokenize(F.col("text")).alias("toks"))


def seed_tokens(toks: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """``doc, tok, n, first``: each document's most frequent tokens, ties by first place."""
    places = toks.select("doc", F.posexplode("toks").alias("at", "tok"))
    if p.stop1:
        places = places.where(~F.col("tok").isin(*p.stop1))
    counted = places.groupBy("doc", "tok").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("n"), "first"))
    return counted.withColumn("rn", rank).where(F.col("rn") <= p.seeds).drop("rn")


def pair_counts(terms: DataFrame) -> DataFrame:
    """``x, y, co`` with ``x < y``: documents that hold both terms."""
    left = terms.select("doc", F.col("tok").alias("x"))
    right = terms.select(F.col("doc").alias("doc_"), F.col("tok").alias("y"))
    return left.join(right, (F.col("doc") == F.col("doc_")) & (F.col("x") < F.col("y"))).groupBy("x", "y").agg(F.count(F.lit(1)).alias("co"))


def bigram_docfreq(toks: DataFrame) -> DataFrame:
    """``x, y, cadj``: documents in which x stands directly before y, over all tokens, x and y different."""
    pair = lambda i: F.when(F.col("toks")[i - 1] != F.col("toks")[i], F.concat(F.col("toks")[i - 1], F.lit(" "), F.col("toks")[i]))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("toks") - 1), pair))  # strings, which are told apart by hash
    rows = toks.where(F.size("toks") > 1).select(F.explode(pairs).alias("p")).where("p IS NOT NULL")
    counted = rows.groupBy("p").agg(F.count(F.lit(1)).alias("cadj"))
    return counted.select(F.substring_index("p", " ", 1).alias("x"), F.substring_index("p", " ", -1).alias("y"), "cadj")


def junctions(co: DataFrame, cadj: DataFrame, p: ScanParams) -> DataFrame:
    """``x, y, cadj``: directed token pairs at which two terms may be joined."""
    dense = cadj.where(F.col("cadj") >= p.least_adjacent)
    low, high = F.least("x", "y"), F.greatest("x", "y")
    seen = co.select(F.col("x").alias("lo"), F.col("y").alias("hi"), "co")
    return dense.withColumn("lo", low).withColumn("hi", high).join(seen, ["lo", "hi"]).where((F.col("co") > 0) & (F.col("cadj") / F.col("co") >= p.theta)).select("x", "y", "cadj")


def beginning(toks: DataFrame, p: ScanParams) -> tuple[DataFrame, DataFrame]:
    """The terms (doc, tok) of each document before any merge, its seeds, and the junctions; both are tables."""
    store = Scratch(toks.sparkSession, "beginning")
    toks = store.save(toks)
    terms = store.save(grams.seeds(toks, p.seeds, p.stop1).select("doc", F.explode("seeds").alias("tok")))
    try:
        junction = store.save(grams.junctions(toks, p.least_adjacent, p.theta, p.seeds, p.stop1))
    except OverflowError:  # more pairs than fit into a task: by shuffles
        junction = store.save(junctions(pair_counts(terms), bigram_docfreq(toks), p))
    store.close(terms, junction)
    return terms, junction


def _pairs_by_joins(ends: DataFrame, junction: DataFrame) -> DataFrame:
    """``doc, a, b``: only pairs whose touching tokens form a junction are generated, by joins."""
    ends = ends.select("doc", "tok", F.element_at(F.split("tok", " "), -1).alias("tail"), F.split("tok", " ")[0].alias("head"))
    left = ends.join(junction.select(F.col("x").alias("tail"), F.col("y").alias("next")), "tail").select("doc", F.col("tok").alias("p"), "next")
    right = ends.select(F.col("doc").alias("doc_"), F.col("tok").alias("q"), F.col("head"))
    met = left.join(right, (F.col("doc") == F.col("doc_")) & (F.col("next") == F.col("head")) & (F.col("p") != F.col("q")))
    return met.select("doc", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def merge_candidates(terms: DataFrame, junction: DataFrame, p: ScanParams) -> DataFrame:
    """``a, b, n, first`` with ``a < b``: term pairs of enough documents that a junction allows.

    Pairs are made in their document and looked up among the junctions there; only those that a junction allows
    leave it. ``terms``: doc, tok.
    """
    ends = terms.where(tx.seed_ok(F.col("tok"))).select("doc", "tok")
    try:
        known = grams.pair_keys(junction)
    except OverflowError:  # more junctions than fit into a task
        pairs = _pairs_by_joins(ends, junction)
    else:
        pairs = grams.adjoining(ends.groupBy("doc").agg(F.array_sort(F.collect_set("tok")).alias("toks")), known)
    if p.stop2:
        single = ~F.col("a").contains(" ") & ~F.col("b").contains(" ")
        stopped = F.concat_ws(" ", "a", "b").isin(*p.stop2) | F.concat_ws(" ", "b", "a").isin(*p.stop2)
        pairs = pairs.where(~(single & stopped))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).where(F.col("n") >= p.least_together)


def approve(candidates: DataFrame, junction: DataFrame) -> DataFrame:
    """Adds ``merged``: the order whose junction is allowed, the more frequent one if both are, "a b" on a tie."""
    head = lambda c: F.split(c, " ")[0]
    tail = lambda c: F.element_at(F.split(c, " "), -1)
    ab = junction.select(F.col("x").alias("ab_x"), F.col("y").alias("ab_y"), F.col("cadj").alias("ab"))
    ba = junction.select(F.col("x").alias("ba_x"), F.col("y").alias("ba_y"), F.col("cadj").alias("ba"))
    j = candidates.join(ab, (tail("a") == F.col("ab_x")) & (head("b") == F.col("ab_y")), "left").join(ba, (tail("b") == F.col("ba_x")) & (head("a") == F.col("ba_y")), "left")
    merged = F.when(F.col("ab").isNotNull() & (F.col("ba").isNull() | (F.col("ab") >= F.col("ba"))), F.concat_ws(" ", "a", "b")).otherwise(F.concat_ws(" ", "b", "a"))
    return j.where("ab IS NOT NULL OR ba IS NOT NULL").select("a", "b", "n", "first", merged.alias("merged"))


def apply_merges(terms: DataFrame, approved: DataFrame, p: ScanParams) -> DataFrame:
    """``doc, tok`` after each document folded its approved pairs in list order (first document, a, b).

    A merged phrase can take part in later merges of the same pass. The merges are sent to the documents by keys;
    each document folds where it is.
    """
    usable = approved.where((F.size(F.split("merged", " ")) <= p.max_tokens) & ~tx.contains_stop(F.col("merged"), list(p.stop2), 2) & ~tx.contains_stop(F.col("merged"), list(p.stop3), 3))
    merges = ranked(usable.select("a", "b", "first", (F.col("merged") == F.concat_ws(" ", "a", "b")).alias("forward")), [F.asc("first"), F.asc("a"), F.asc("b")])
    try:
        done = grams.folded(terms.groupBy("doc").agg(F.array_sort(F.collect_set("tok")).alias("toks")), merges)
    except OverflowError:  # more merges than fit into a task
        return _merged_by_joins(terms, usable)
    return done.select("doc", F.explode("toks").alias("tok"))


def _merged_by_joins(terms: DataFrame, usable: DataFrame) -> DataFrame:
    """The same by joins: a document sees the pairs whose first words it has; the fold itself tests both terms."""
    words = terms.select("doc", F.explode(F.split("tok", " ")).alias("w")).distinct()
    heads = usable.select("a", "b", "merged", "first", F.split("a", " ")[0].alias("wa"), F.split("b", " ")[0].alias("wb"))
    relevant = heads.join(words.withColumnRenamed("w", "wa"), "wa").join(words.withColumnRenamed("w", "wb"), ["doc", "wb"])
    folded = relevant.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("first", "a", "b", "merged"))).alias("pairs"))
    grouped = terms.groupBy("doc").agg(F.array_sort(F.collect_set("tok")).alias("have")).join(folded, "doc", "left")

    def step(have, x):
        both = F.array_contains(have, x["a"]) & F.array_contains(have, x["b"])
        return F.when(both, F.array_union(F.filter(have, lambda t: (t != x["a"]) & (t != x["b"])), F.array(x["merged"]))).otherwise(have)

    out = F.when(F.col("pairs").isNull(), F.col("have")).otherwise(F.aggregate("pairs", F.col("have"), step))
    return grouped.select("doc", F.explode(out).alias("tok"))


def term_freq(terms: DataFrame) -> DataFrame:
    return terms.where(F.col("tok").contains(" ")).groupBy(F.col("tok").alias("term")).agg(F.count(F.lit(1)).alias("freq"))


def scan(toks: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """``term, freq``: the multi-word lexicon; stops when no pair is approved or no document changes."""
    store = Scratch(toks.sparkSession, "scan")
    terms, junction = beginning(toks, p)
    total = 0
    for _ in range(p.iterations):
        approved = store.save(approve(merge_candidates(terms, junction, p), junction))
        if approved.isEmpty():
            break
        merged = store.save(apply_merges(terms, approved, p))
        store.drop(terms, approved)
        terms = merged
        now = terms.where(F.col("tok").contains(" ")).count()
        if now == total:
            break
        total = now
    store.close(terms)
    return term_freq(terms)
