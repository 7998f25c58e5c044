"""What keeps the work of one task bounded when tables grow, and results on tables that leave nothing over."""

import pytest
from pyspark.sql import functions as F

from diachron.operators import annotate as ann
from diachron.operators import grams
from diachron.operators import predict as pr
from diachron.operators import lexicon as lex
from diachron.plans import QUERIES, SQL, text_queries
from diachron.sources import papers

TINY = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("lines, tasks", [(500, 12), (1000, 6)])
def test_postings_are_dealt_by_the_number_of_lines(spark, monkeypatch, lines, tasks):
    want = plain(papers.postings(spark, TINY).collect()), plain(QUERIES["cooc_edges"](spark, TINY).collect())
    monkeypatch.setattr(papers, "LINES", lines)
    dealt = papers.postings(spark, TINY)
    assert dealt.rdd.getNumPartitions() == tasks  # the session's number is 4
    assert dealt.withColumn("task", F.spark_partition_id()).groupBy("doc").agg(F.count_distinct("task").alias("n")).where("n > 1").isEmpty()
    assert (plain(dealt.collect()), plain(QUERIES["cooc_edges"](spark, TINY).collect())) == want


TRADE = ("lineitem", "orders", "part", "customer")


@pytest.fixture(scope="module")
def all_linked(tmp_path_factory, spark):
    """Tables whose phrases all stand together in the training years: no pair is left to be found or drawn."""
    import duckdb

    to = tmp_path_factory.mktemp("linked")
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (p_partkey % 8 AS p_partkey) FROM '{TINY}/part.parquet' QUALIFY row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) = 1) TO '{to}/part.parquet'")
    con.sql(f"COPY (SELECT * REPLACE (l_partkey % 8 AS l_partkey) FROM '{TINY}/lineitem.parquet') TO '{to}/lineitem.parquet'")
    for t in ("orders", "customer"):
        con.sql(f"COPY (FROM '{TINY}/{t}.parquet') TO '{to}/{t}.parquet'")
    return str(to)


def against_sql(spark, name, folder):
    import duckdb

    con = duckdb.connect()
    for t in TRADE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    theirs = con.sql(SQL[name])
    columns = sorted(theirs.columns)
    mine = plain(QUERIES[name](spark, folder).select(*columns).collect())
    assert mine == plain(theirs.select(*[f'"{c}"' for c in columns]).fetchall())
    return mine


def test_fair_compare_without_pairs_has_both_arms(spark, all_linked):
    assert against_sql(spark, "fair_compare", all_linked) == [(None, 0, None, "control"), (None, 0, None, "experiment")]


def test_fair_compare_has_equal_arms(spark):
    control, experiment = against_sql(spark, "fair_compare", "/root/testdata/sf0.1")
    assert control[1] == experiment[1] == 115 and control[0] == 0 and experiment[0] == pytest.approx(experiment[2] - control[2], abs=1e-6)


def test_feature_auc_without_pairs_counts_no_rows(spark, all_linked):
    assert against_sql(spark, "feature_auc", all_linked) == [(None, None, 0)]


@pytest.mark.parametrize("hit", [True, False])
def test_feature_auc_of_one_kind_is_not_a_number(spark, hit):
    row = pr.feature_auc(spark.createDataFrame([(hit, 1), (hit, 2), (hit, 2)], "hit boolean, v long"), "v").first()
    assert (row.n_hits, row.n_rows) == (3 * hit, 3) and row.auc != row.auc


SMALL = "/root/testdata/sf0.01"


def test_longest_match_shuffles_no_hits(spark):
    plan = QUERIES["longest_match"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_matching_in_pieces_and_by_joins_gives_the_same(spark, monkeypatch):
    names = ("longest_match", "absorb", "normalize_phrases", "annotate_year", "ann_stats")
    results = lambda: {n: plain(QUERIES[n](spark, SMALL).collect()) for n in names}
    want = results()
    assert len(want["longest_match"]) > len(want["absorb"]) > len(want["normalize_phrases"]) > 10_000
    monkeypatch.setattr(grams, "TOKENS", 3000)
    monkeypatch.setattr(grams, "HELD", 5000)
    assert results() == want
    monkeypatch.setattr(grams, "MOST", 100)  # fewer than there are: the dictionary is joined by shuffle
    assert results() == want


def test_no_articles_have_no_share(spark):
    row = ann.ann_totals(spark.createDataFrame([], "doc string, n_phrases long")).first()
    assert row.n_articles == row.total_tags == 0 and row.coverage != row.coverage


def test_first_pass_by_keys_and_by_joins_gives_the_same(spark, monkeypatch):
    results = lambda: plain(QUERIES["junction_approve"](spark, SMALL).collect())
    want = results()
    assert len(want) > 500
    terms, junction = text_queries._first_pass(spark, SMALL)
    made = lex.merge_candidates(terms, junction, text_queries.PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in made and "Join" not in made  # pairs are made in their document
    monkeypatch.setattr(grams, "MOST", 100)  # fewer than there are: joined by shuffle
    assert results() == want


def test_folds_by_keys_and_by_joins_give_the_same(spark, monkeypatch):
    terms, junction = text_queries._first_pass(spark, SMALL)
    approved = lex.approve(lex.merge_candidates(terms, junction, text_queries.PARAMS), junction)
    made = lex.apply_merges(terms, approved, text_queries.PARAMS)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan  # documents fold where they are
    want = plain(made.collect())
    monkeypatch.setattr(grams, "MOST", 100)  # fewer than there are
    assert plain(lex.apply_merges(terms, approved, text_queries.PARAMS).collect()) == want
