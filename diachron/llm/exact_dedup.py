"""Exact deduplication by skew-safe combining (DataFrame functions only).

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``.
The combining runs in three stages, each of which groups on the digest *and* the whole
normalised text, so content is compared in full and a digest collision cannot merge rows:

1. local: the map-side half of the first aggregate keeps one row per content and task;
2. salted: local winners of one content meet in up to ``salts`` reducers;
3. global: at most ``salts`` rows per content meet in one reducer.

A group holding a third of all rows is thus reduced before every shuffle; no reducer sees
more than one row per upstream task. Group size and winner travel as two numbers. Members meet
their group by digest; those of the thousand largest groups are matched by a broadcast of these
groups and then spread by their ids (:func:`.skew.join_one`), so no reducer gets a hot digest.

Defined results: a null text counts as empty; among equal texts the row with the most code
points in the original text stays, then the smallest ``doc_id`` (a null id loses every tie);
rows that repeat a ``doc_id`` with the same text each count in ``group_size`` and carry the
same verdict, and :func:`keep_one_of_each` keeps one of them, the least by the other columns; an
empty table gives an empty result; very long texts are compared whole; other columns are not
looked at, so their names cannot clash. Ids must be whole numbers.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_one, one_row_each

#: The characters that do not count, a fixed value of the contract.
WHITESPACE = " \t\n\x0b\x0c\r"
_TOP = 9223372036854775807


def _shift() -> Column:
    """10**20 as a decimal; a Python integer of that size does not pass the gateway."""
    return F.lit(str(10**20)).cast("decimal(21,0)")


def normalised(text: Column) -> Column:
    """The text without whitespace; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def _rank(points: Column, doc_id: Column) -> Column:
    """One fixed-width number whose maximum is (most code points, smallest id, null id last)."""
    dec = "decimal(38,0)"
    by_id = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)") + 1, F.lit(0))
    return (points.cast("decimal(12,0)") * _shift() + by_id.cast("decimal(21,0)")).cast(dec)


def _ranked_id(rank: Column) -> Column:
    rest = (rank % _shift()).cast("decimal(21,0)")
    return F.when(rest > 0, (F.lit(_TOP).cast("decimal(21,0)") + 1 - rest).cast("long"))


def _ranked_points(rank: Column) -> Column:
    return F.round((rank - rank % _shift()) / _shift()).cast("int")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per distinct content: ``text_sha256, keep_id, keep_points, group_size``."""
    norm = normalised(F.col(text_col))
    rows = docs.select(
        norm.alias("norm"),
        _rank(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.col(id_col)).alias("best"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    ).withColumn("digest", F.sha2("norm", 256))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    contents = salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    one = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("best").alias("best"), F.sum("n").alias("n"))
    # Members are matched to their group by digest; if two contents ever shared one, fail rather than merge them.
    checked = F.when(F.col("contents") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two contents share a SHA-256")).cast("long"))
    return one.select(F.col("digest").alias("text_sha256"), _ranked_id(F.col("best")).alias("keep_id"), _ranked_points(F.col("best")).alias("keep_points"), checked.alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The member join carries ids and digests only.
    """
    members = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    groups = exact_groups(docs, id_col, text_col, salts).drop("keep_points")
    return join_one(members, groups, "text_sha256", "group_size", F.col("doc_id")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The documents that stay, one row for each content, with all their columns."""
    groups = exact_groups(docs, id_col, text_col, salts).where("group_size > 0")  # asks for the check of contents
    stay = groups.select("keep_id", "keep_points", "text_sha256")
    keys = [F.col(id_col).cast("long"), F.length(F.coalesce(F.col(text_col), F.lit(""))), F.sha2(normalised(F.col(text_col)), 256)]
    return one_row_each(docs, stay, keys, F.lit(False))


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id ASC NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
