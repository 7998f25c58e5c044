"""Word lists, lexicons, annotations and result files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ranking import ranked


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One lower-cased entry per line; blank lines and lines that start with # are skipped."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("term"))
    return lines.where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def ranked_lexicon(terms: DataFrame) -> DataFrame:
    """``rank, term, n_tokens, freq`` by falling frequency, then term. ``terms``: term, freq.

    Ranks come from a sort by range: each range's offset is the size of those before it.
    """
    rows = terms.select("term", F.size(F.split("term", " ")).alias("n_tokens"), "freq")
    return ranked(rows, [F.desc("freq"), F.asc("term")]).select(F.col("rank").cast("int").alias("rank"), "term", "n_tokens", "freq")


def write_lexicon(terms: DataFrame, path: str) -> None:
    """CSV files in the order of rank, each a range of ranks."""
    ranked_lexicon(terms).sortWithinPartitions("rank").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("rank int, term string, n_tokens int, freq long").csv(path)


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, by name, in whatever store they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath()) for f in found or [])


def scan_terms(spark: SparkSession, pattern: str) -> DataFrame:
    """``term``: the multi-word terms of the yearly lexicon files (``terms_YYYY...``); tests and ranges of years are skipped."""
    names = [p for p in _glob(spark, pattern) if "_test" not in (n := p.rstrip("/").rsplit("/", 1)[-1]) and n.startswith("terms_") and "-" not in n.removeprefix("terms_").split("_")[0]]
    if not names:
        return spark.createDataFrame([], "term string")
    rows = spark.read.option("header", True).schema("rank int, term string, n_tokens int, freq long").csv(names)
    return rows.select(F.lower(F.trim("term")).alias("term")).where(F.size(F.split("term", " +")) > 1).distinct()


def listed_terms(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """``at, term``: the entries of a word list in their order, tokenised as texts are; at most the first ``most``."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).select("at", F.lower(F.trim("line")).alias("line"))
    terms = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).select("at", F.array_join(tx.tokenize(F.col("line")), " ").alias("term")).where("term <> ''")
    return terms if most is None else terms.orderBy("at").limit(most)


def csv_terms(spark: SparkSession, paths: list[str], column: str, least_tokens: int = 2) -> DataFrame:
    """``term``: one column of CSV files with a header, tokenised; terms that fall below ``least_tokens`` tokens go."""
    rows = spark.read.option("header", True).csv(paths).select(tx.tokenize(F.col(column)).alias("toks"))
    return rows.where(F.size("toks") >= least_tokens).select(F.array_join("toks", " ").alias("term")).distinct()


def newest_lexicon(spark: SparkSession, pattern: str) -> DataFrame:
    """``term``: the term set of the newest lexicon file by name; empty if there is none."""
    names = _glob(spark, pattern)
    if not names:
        return spark.createDataFrame([], "term string")
    rows = spark.read.option("header", True).csv(names[-1])
    return rows.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()


def concept_map(spark: SparkSession, path: str) -> DataFrame:
    """``input, term`` of a JSON file ``{"mapping": {input: term}}``."""
    rows = spark.read.schema("mapping map<string,string>").json(path, multiLine=True)
    return rows.select(F.explode("mapping").alias("input", "term"))


def read_annotations(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """``arxiv_id, phrases, n_phrases, year`` as :func:`write_annotations` left them; one year reads its folder only."""
    rows = spark.read.schema("arxiv_id string, phrases array<string>, n_phrases int, year long").parquet(path)
    return rows if year is None else rows.where(F.col("year") == year)


def _pick(files: DataFrame, years: DataFrame, mode: str, segment: Column) -> DataFrame:
    """``year, <mode>_file``: of a year's files with its threshold the weighted one, if the year is weighted, or else the plain one."""
    named = files.where(F.col("mode") == mode).select(
        F.regexp_extract("file", r"network_(\d{4}(?:-\d{4})*)_e(\d+)_t(\d+)", 1).alias("segment"), F.regexp_extract("file", r"_e(\d+)_t(\d+)", 1).cast("int").alias("e"),
        F.regexp_extract("file", r"_e(\d+)_t(\d+)", 2).cast("int").alias("topn"), "file", F.col("file").contains("_disc").alias("weighted"),
    )
    met = years.withColumn("segment", segment).join(named, ["segment", "e", "topn"])
    unlike = F.when(F.col("w_cs") < 1, ~F.col("weighted")).otherwise(F.col("weighted"))
    return met.groupBy("year").agg(F.min_by("file", F.struct(unlike.alias("unlike"), "file")).alias(f"{mode}_file"))


def registry(files: DataFrame, years: DataFrame, topn: int = 1500) -> DataFrame:
    """One row per year: ``year, e, w_cs, topn, static_file, speed_file, accel_file``; empty where there is no file.

    ``files``: mode, file; ``years``: year. Thresholds and weights by year are the published choice.
    """
    year = F.col("year")
    e = F.when(year == 1991, 5).when(year == 1992, 10).otherwise(20)
    w_cs = F.when(year <= 2016, 1.0).when(year <= 2021, 0.5).otherwise(0.3)
    rows = years.select(year.cast("long").alias("year"), e.alias("e"), w_cs.alias("w_cs"), F.lit(topn).alias("topn"))
    text = lambda back: (year - back).cast("string")
    out = rows
    for mode, segment, first in (("static", text(0), 0), ("speed", F.concat_ws("-", text(1), text(0)), 1992), ("accel", F.concat_ws("-", text(2), text(1), text(0)), 1993)):
        out = out.join(_pick(files, rows.where(year >= first), mode, segment), "year", "left")
    return out.select("year", "e", "w_cs", "topn", *[F.coalesce(f"{m}_file", F.lit("")).alias(f"{m}_file") for m in ("static", "speed", "accel")])


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("year long, e int, w_cs double, topn int, static_file string, speed_file string, accel_file string").csv(path).na.fill("")


def write_annotations(annotations: DataFrame, path: str) -> None:
    """``arxiv_id, phrases, n_phrases`` as Parquet, a folder per year; years not in the input stay."""
    conf = annotations.sparkSession.conf
    before = conf.get("spark.sql.sources.partitionOverwriteMode")
    conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        annotations.select("arxiv_id", "phrases", F.size("phrases").alias("n_phrases"), "year").write.mode("overwrite").partitionBy("year").parquet(path)
    finally:
        conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes beside ``path`` and then swaps, so readers see the old table or the new one."""
    spark = rows.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path + ".old")
    rows.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)
