"""The registry of named queries: a Spark plan and, where SQL can express it, DuckDB SQL for the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Shared pieces of oracle SQL.
PAPERS = """papers AS (SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, string_split(coalesce(text, ''), chr(10))[1] AS title,
  CASE WHEN instr(coalesce(text, ''), chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS abstract,
  source AS categories, CAST(1991 + doc_id % 5 AS BIGINT) AS year FROM documents)"""


def posts(vocabulary: str = "p_type") -> str:
    return f"""post AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderkey AS doc, lower(p_brand || ' ' || {vocabulary}) AS phrase,
  c_mktsegment AS category, CAST(min(l_linenumber) AS BIGINT) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


POST, SPARSE = posts(), posts("p_name")
EDGES = "edges AS (SELECT p.year, p.phrase AS a, q.phrase AS b, count(*) AS w FROM post p JOIN post q ON p.doc = q.doc AND p.phrase < q.phrase GROUP BY ALL)"
DF = "df AS (SELECT year, phrase, count(*) AS df FROM post GROUP BY ALL)"
NET = f"{POST}, {EDGES}, {DF}"
CAT_EDGES = "cedges AS (SELECT p.year, p.phrase AS a, q.phrase AS b, count(*) AS w, count(*) FILTER (WHERE p.category = 'MACHINERY') AS n_cs, count(*) FILTER (WHERE p.category <> 'MACHINERY') AS n_oth FROM post p JOIN post q ON p.doc = q.doc AND p.phrase < q.phrase GROUP BY ALL)"
BOTH = "nbr AS (SELECT year, a AS x, b AS c, w FROM edges UNION ALL SELECT year, b, a, w FROM edges)"
