"""Registered queries against their SQL on larger tables, and order-dependent ones against plain versions on driver tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from diachron.operators import lexicon as lex
from diachron.plans import QUERIES, SQL
from diachron.plans import text_queries as tq
from diachron.sources import papers

TINY, SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def compare(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    theirs = con.sql(SQL[name])
    columns = sorted(theirs.columns)
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    mine = plain(QUERIES[name](spark, folder).select(*columns).collect())
    spark.catalog.clearCache()
    assert mine and mine == plain(theirs.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name, folder", [("candidates_2016", LARGE), ("link_outcomes", LARGE), ("hit_rates", LARGE), ("freq_band", SMALL), ("variant_filter", SMALL), ("random_control", SMALL)])
def test_pairs_on_larger_tables(spark, name, folder):
    compare(spark, name, folder, ("lineitem", "orders", "part", "customer"))


def plain_scan(docs, p):
    """``{term: freq}`` of the extraction by loops over lists."""
    seeds = {}
    for d, toks in docs.items():
        kept = [t for t in toks if t not in p.stop1]
        first = {}
        for i, t in enumerate(kept):
            first.setdefault(t, i)
        seeds[d] = sorted(first, key=lambda t: (-kept.count(t), first[t]))[: p.seeds]
    co, cadj = Counter(), Counter()
    for d, s in seeds.items():
        co.update((x, y) for x in s for y in s if x < y)
        cadj.update({(x, y) for x, y in zip(docs[d], docs[d][1:]) if x != y})
    ok = {j: n for j, n in cadj.items() if n >= p.least_adjacent and co[tuple(sorted(j))] > 0 and n / co[tuple(sorted(j))] >= p.theta}
    terms = {d: set(s) for d, s in seeds.items()}
    usable = lambda t: " " in t or (len(t) > 1 and any("a" <= c <= "z" for c in t))
    total, history = 0, []
    for _ in range(p.iterations):
        met, first = Counter(), {}
        for d, s in terms.items():
            own = sorted(filter(usable, s))
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    met[a, b] += 1
                    first[a, b] = min(first.get((a, b), d), d)
        approved = []
        for (a, b), n in met.items():
            ab, ba = ok.get((a.split()[-1], b.split()[0])), ok.get((b.split()[-1], a.split()[0]))
            if n >= p.least_together and (ab or ba):
                approved.append((a, b, f"{a} {b}" if ab and (not ba or ab >= ba) else f"{b} {a}"))
        if not approved:
            break
        # a pair's first document is the first in which its touching words can meet
        for d in terms:
            have = terms[d]
            for a, b, merged in sorted(approved, key=lambda x: (first[x[0], x[1]], x[0], x[1])):
                if a in have and b in have and len(merged.split()) <= p.max_tokens:
                    have = (have - {a, b}) | {merged}
            terms[d] = have
        history.append({d: set(s) for d, s in terms.items()})
        now = sum(" " in t for s in terms.values() for t in s)
        if now == total:
            break
        total = now
    return Counter(t for s in terms.values() for t in s if " " in t), history


def tokens_of(spark, folder, year=None):
    p = papers.papers(spark, folder)
    p = p if year is None else p.where(F.col("year") == year)
    return {r.doc: r.toks for r in lex.tokens(p.select("arxiv_id", papers.text_unit().alias("text"))).collect()}


def test_scan_year_against_a_plain_version(spark):
    want, _ = plain_scan(tokens_of(spark, SMALL, 1992), tq.PARAMS)
    rows = QUERIES["scan_year"](spark, SMALL).orderBy("rank").collect()
    assert want and {r.term: r.freq for r in rows} == dict(want)
    assert [(r.term, r.rank) for r in rows] == [(t, i + 1) for i, t in enumerate(sorted(want, key=lambda t: (-want[t], t)))]


def test_apply_merge_against_a_plain_version(spark):
    _, history = plain_scan(tokens_of(spark, SMALL), lex.ScanParams(stop1=tq.STOP, iterations=1))
    got = {}
    for r in QUERIES["apply_merge"](spark, SMALL).collect():
        got.setdefault(r.doc, set()).add(r.tok)
    assert got and got == {d: s for d, s in history[0].items() if s}


def test_balanced_seeds_against_a_plain_version(spark):
    counts = Counter((r.category, r.phrase) for r in papers.postings(spark, SMALL).where("year = 1997").collect())
    quota = {"MACHINERY": 2, "AUTOMOBILE": 4, "BUILDING": 4, "FURNITURE": 4, "HOUSEHOLD": 4}
    taken, want = set(), []
    for field, most in quota.items():
        free = sorted((-n, p) for (f, p), n in counts.items() if f == field and n >= 3 and p not in taken)[:most]
        taken |= {p for _, p in free}
        want += [(field, p, -n) for n, p in free]
    assert want and [tuple(r) for r in QUERIES["balanced_seeds"](spark, SMALL).collect()] == want
