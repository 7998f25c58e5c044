"""The paper table: reading, selection, audits; and the mapping of other tables onto the model.

Papers have ``arxiv_id, title, abstract, categories, year``; postings have ``year, doc, phrase,
pos, category``, one row per document and distinct phrase in order of first hit.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_YEAR = 1991


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def papers_from_documents(documents: DataFrame) -> DataFrame:
    """Text adapter: first line is the title, the rest the abstract, the source the category."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("string").alias("arxiv_id"),
        F.substring_index(text, "\n", 1).alias("title"),
        F.when(F.instr(text, "\n") > 0, F.expr("substr(coalesce(text, ''), instr(coalesce(text, ''), '\n') + 1)")).otherwise("").alias("abstract"),
        F.col("source").alias("categories"),
        (F.lit(BASE_YEAR) + F.col("doc_id") % 5).cast("long").alias("year"),
    )


def papers(spark: SparkSession, folder: str) -> DataFrame:
    return papers_from_documents(table(spark, folder, "documents"))


VOCABULARY = {"dense": "p_type", "sparse": "p_name"}
#: Lines that one task holds when postings are made and paired.
LINES = 250_000


def postings(spark: SparkSession, folder: str, vocabulary: str = "dense") -> DataFrame:
    """Basket adapter: orders are documents, their parts the phrases, in order of first line.

    Lines and orders are dealt by order once, into as many tasks as the number of lines asks for, whatever the
    session's number of partitions; postings are made, and later paired by document, where their lines are.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    tasks = -(-lines.count() // LINES) or 1  # from the files' footers
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("year"))
    parts = table(spark, folder, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_brand", VOCABULARY[vocabulary])).alias("phrase"))
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"))
    baskets = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select("l_orderkey", "l_linenumber", "phrase").repartition(tasks, "l_orderkey")
    owned = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select("o_orderkey", "year", "category").repartition(tasks, "o_orderkey")
    joined = baskets.join(owned, baskets["l_orderkey"] == owned["o_orderkey"])
    return joined.groupBy("year", F.col("l_orderkey").alias("doc"), "phrase", "category").agg(F.min("l_linenumber").cast("long").alias("pos"))


def text_unit(title: str = "title", abstract: str = "abstract"):
    """Lower-cased title and abstract with a sentence break between; nulls count as empty."""
    return F.concat(F.lower(F.coalesce(F.col(title), F.lit(""))), F.lit(".\n"), F.lower(F.coalesce(F.col(abstract), F.lit(""))))


def scan_papers(source: DataFrame, first: int, last: int | None = None, category: str | None = None) -> DataFrame:
    """``arxiv_id, text`` of the papers of some years, optionally of a category prefix of the primary category."""
    chosen = source.where(F.col("year").between(first, last or first))
    if category:
        chosen = chosen.where(F.split("categories", " ")[0].startswith(category))
    return chosen.select("arxiv_id", text_unit().alias("text"))


def parse_years(spec: str, known: list[int]) -> list[int]:
    """``'1992'``, ``'1991-1995'``, ``'1991,1994'`` or ``'all'`` as sorted distinct years."""
    if spec.strip().lower() == "all":
        return sorted(set(known))
    years: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        years.update(range(int(low), int(high or low) + 1))
    return sorted(years)


def content_hash():
    """SHA-1 of white-space-squeezed lower-cased title and abstract."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
    return F.sha1(F.concat(squeeze("title"), F.lit("\n"), squeeze("abstract")))


def null_audit(source: DataFrame) -> DataFrame:
    return source.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in ("arxiv_id", "title", "abstract")])


def dry_run_counts(source: DataFrame) -> DataFrame:
    """Rows per year and, with a null year, in total."""
    return source.rollup("year").agg(F.count(F.lit(1)).alias("n"))


def without_empty(source: DataFrame) -> DataFrame:
    return source.where((F.coalesce("title", F.lit("")) != "") | (F.coalesce("abstract", F.lit("")) != ""))
