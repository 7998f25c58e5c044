"""Line deduplication over overlapping three-line windows (DataFrame functions only).

Every run of three consecutive lines is hashed (128 bits from two seeded 64-bit hashes).
Windows that occur more than once anywhere are found by one map-side combined aggregate that
keeps the first occurrence in (doc_id, text hash, line) order. Every later occurrence covers its
three lines; covered positions are merged per document and those lines are removed.

Defined results: null text counts as empty; documents with fewer than three lines, and windows
of blank lines only, are left alone; a null ``doc_id`` sorts last and never loses lines; rows
that repeat a ``doc_id`` with the same text count as one document and get the same verdict, with
different texts they are documents of their own, told apart by 128 bits of the text; ties have no
order but (id, text hash, line); very long texts are taken whole, at a cost linear in their lines;
an empty table gives an empty result; other columns are not read, so they cannot clash.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """``at (doc_id, t1, t2, i), h1, h2``: one row per window."""
    per_line = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "t1", "t2", _lines(F.col("text")).alias("ls")).where(F.size("ls") >= WINDOW)
    hashed = per_line.select(
        "doc_id",
        "t1",
        "t2",
        F.transform("ls", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("ls", lambda x: F.xxhash64(F.lit(7), x)).alias("b"),
        F.transform("ls", lambda x: F.trim(x) == "").alias("blank"),
    )
    window = F.transform(
        F.sequence(F.lit(0), F.size("a") - WINDOW),
        lambda i: F.struct(
            i.alias("i"),
            F.xxhash64(F.col("a")[i], F.col("a")[i + 1], F.col("a")[i + 2]).alias("h1"),
            F.xxhash64(F.col("b")[i], F.col("b")[i + 1], F.col("b")[i + 2]).alias("h2"),
            (F.col("blank")[i] & F.col("blank")[i + 1] & F.col("blank")[i + 2]).alias("blank"),
        ),
    )
    shown = hashed.select("doc_id", "t1", "t2", F.explode(window).alias("w")).where(~F.col("w.blank"))
    return shown.select(F.struct("doc_id", "t1", "t2", F.col("w.i").alias("i")).alias("at"), "w.h1", "w.h2")


def _kept(lines: Column, starts: Column) -> Column:
    """The lines outside the windows that begin at the sorted ``starts``: one slice between each two."""
    low = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(starts, j - 1) + WINDOW)
    high = lambda j: F.coalesce(F.get(starts, j), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), lambda j: F.slice(lines, low(j) + 1, F.greatest(high(j) - low(j), F.lit(0)))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text, n_lines, n_removed``; ``text`` is what stays."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(11), text).alias("t2"))
    windows = _windows(docs)
    repeated = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where(F.col("at") != F.col("first")).select("at.*")
    covered = later.groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("i")).alias("starts"))
    joined = docs.join(covered, ["doc_id", "t1", "t2"], "left").select("doc_id", "text", "starts", _lines(F.col("text")).alias("ls"))
    kept = joined.select("doc_id", "text", "starts", F.size("ls").alias("n"), F.when(F.col("starts").isNotNull(), _kept(F.col("ls"), F.col("starts"))).alias("kept"))
    return kept.select(
        "doc_id",
        F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        F.col("n").cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.col("n") - F.size("kept")).cast("long").alias("n_removed"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, ls FROM d),
w AS (SELECT doc_id, i, ls[i + 1] AS a, ls[i + 2] AS b, ls[i + 3] AS c FROM l WHERE i + 2 < len(ls)),
v AS (SELECT * FROM w WHERE trim(a) <> '' OR trim(b) <> '' OR trim(c) <> ''),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS rn FROM v),
x AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (SELECT unnest(range(0, 3)) AS o) WHERE rn > 1),
s AS (SELECT l.doc_id, l.i, l.ls[l.i + 1] AS line, x.i IS NULL AS stay FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN stay THEN 0 ELSE 1 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stay), '')) AS clean_sha256,
       CAST(length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stay), '')) AS BIGINT) AS clean_chars
FROM s GROUP BY doc_id
"""
