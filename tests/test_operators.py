"""Rules and invariants of single operators."""

import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from diachron import config
from diachron.functions import text as tx
from diachron.operators import annotate as ann
from diachron.operators import conductance as cond
from diachron.operators import dynamics as dyn
from diachron.operators import lexicon as lex
from diachron.operators import network as net
from diachron.operators import predict as pr
from diachron.operators import ranking
from diachron.operators import retrieval as ret
from diachron.sources import files, papers
from diachron.storage import Scratch

TOKENS = {
    "21-cm line": ["21-cm", "line"], "many-body": ["many", "body"], "3+1 split": ["3+1", "split"], "n-type": ["n", "type"], "H_2O": ["h2o"], "pm2.5 air": ["pm2.5", "air"],
    "a.b.c": ["a.b", "c"], "a.b.c.d": ["a.b", "c.d"], "1.5.a": ["a"], "v2.x-1+2": ["v2.x-1+2"], "2-d-3": ["2-d-3"], "~a-/b+c": ["a", "b", "c"], "3.14 x": ["x"], "2019": [], "t-2 x-ray": ["t-2", "x", "ray"], "A/B~c": ["a", "b", "c"], "": [], None: [], "β-decay é": ["decay"], "12-13": ["12-13"],
}


def test_tokenizer_rules(spark):
    rows = spark.createDataFrame([(t,) for t in TOKENS], "t string").select("t", tx.tokenize(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == TOKENS


def test_plural_rules(spark):
    want = {"qubits": "qubit", "nickelates": "nickelat", "codes": "cod", "es": None, "as": None, "x": None}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", tx.strip_plural(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == want


def test_parse_years():
    known = [1991, 1992, 1995]
    assert papers.parse_years("all", known) == known and papers.parse_years("1993, 1991-1992,1991", known) == [1991, 1992, 1993]


def plain_rbo(a, b, p=0.9):
    d = max(len(a), len(b))
    return (1 - p) * sum(p ** (k - 1) * len(set(a[:k]) & set(b[:k])) / k for k in range(1, d + 1))


def test_rank_biased_overlap(spark):
    rnd = random.Random(1)
    words = [f"p{i}" for i in range(30)]
    docs = {i: rnd.sample(words, rnd.randint(1, 20)) for i in range(60)}
    docs[99] = words[:5]
    asked = words[:5]
    rows = [(2000, d, p, i + 1, len(v)) for d, v in docs.items() for i, p in enumerate(v)]
    frame = spark.createDataFrame(rows, "year long, doc long, phrase string, rank int, n long")
    for depth in (64, 6):
        got = {r.doc: r.score for r in ret.rbo(asked, frame, depth=depth).collect()}
        assert got == {d: pytest.approx(plain_rbo(asked, v)) for d, v in docs.items() if set(v) & set(asked)}
    assert got[99] == pytest.approx(1 - 0.9**5)
    with pytest.raises(ValueError):
        ret.overlap_weights(spark, 5, 1.0)


def pseudo_inverse_g(w_ab, a, b):
    """Effective conductance of the sub-network by linear algebra."""
    nodes = ["A", "B", *sorted(set(a) | set(b))]
    lap = np.zeros((len(nodes),) * 2)
    for x, y, w in [("A", "B", w_ab), *(("A", c, w) for c, w in a.items()), *(("B", c, w) for c, w in b.items())]:
        i, j = nodes.index(x), nodes.index(y)
        lap[i, i] += w
        lap[j, j] += w
        lap[i, j] -= w
        lap[j, i] -= w
    p = np.linalg.pinv(lap)
    r = p[0, 0] + p[1, 1] - 2 * p[0, 1]
    return 1 / r if r > 1e-12 else 0.0


def test_conductance_against_linear_algebra(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for year in range(1, 40):
        w_ab = rnd.choice([0, 0, 1, 5])
        a = {f"c{i}": rnd.randint(1, 9) for i in rnd.sample(range(12), rnd.randint(0, 5))}
        b = {f"c{i}": rnd.randint(1, 9) for i in rnd.sample(range(12) if year % 3 else range(20, 30), rnd.randint(0, 5))}
        rows += [(year, "A", "B", w_ab)] * bool(w_ab) + [(year, "A", c, w) for c, w in a.items()] + [(year, "B", c, w) for c, w in b.items()]
        if w_ab or a or b:
            want[year] = pseudo_inverse_g(w_ab, a, b)
    e = spark.createDataFrame(rows, "year long, a string, b string, w long")
    for x, y in (("A", "B"), ("B", "A")):
        got = {r.year: r.g_raw for r in cond.conductance(e, spark.createDataFrame([(x, y)], "a string, b string"), 10).collect()}
        assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_exclusive_percentile(spark):
    rnd = random.Random(3)
    groups = {n: [rnd.randint(0, 50) + 0.5 for _ in range(n)] for n in (1, 2, 3, 19, 20, 21, 59)}
    rows = spark.createDataFrame([(n, v) for n, vs in groups.items() for v in vs], "n long, v double").withColumnRenamed("n", "g")
    got = {r.g: r.cap for r in dyn.percentile_exclusive(rows, "v", by=["g"]).collect()}
    assert got == {n: pytest.approx(statistics.quantiles(v, n=100)[94] if n > 1 else v[0]) for n, v in groups.items()}


def test_network_invariants(spark):
    p = papers.postings(spark, "/root/testdata/sf0.001").persist()
    e = net.edges(p)
    pairs = p.groupBy("doc").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("n")).agg(F.sum("n")).first()[0]
    assert e.agg(F.sum("w")).first()[0] == pairs
    same = dyn.speed(net.doc_freq(p).withColumnRenamed("df", "n"), ["phrase"], 1997, 1997)
    assert same.where(F.abs("speed") > 1e-12).count() == 0


def test_longest_match_and_absorption(spark):
    toks = spark.createDataFrame([(1, "a b c x b c".split()), (2, "b c a b".split()), (3, [])], "doc long, toks array<string>")
    terms = spark.createDataFrame([("a b c",), ("b c",), ("x",)], "term string")
    found = ann.absorb(ann.longest_match(toks, terms))
    got = {r.doc: r.phrases for r in ann.collected(found).collect()}
    assert got == {1: ["a b c", "x"], 2: ["b c"]}


def plain_fold(terms, approved, most=6):
    have = sorted(terms)
    for a, b, merged in approved:
        if a in have and b in have and len(merged.split()) <= most:
            have = [t for t in have if t not in (a, b)]
            if merged not in have:
                have.append(merged)
    return set(have)


def test_merges_fold_in_order(spark):
    docs = {"1": ["neural", "network", "deep", "graph"], "2": ["network", "neural"], "3": ["deep"]}
    approved = [("neural", "network", "neural network"), ("deep", "neural network", "deep neural network"), ("graph", "network", "graph network")]
    terms = spark.createDataFrame([(d, t) for d, ts in docs.items() for t in ts], "doc string, tok string")
    frame = spark.createDataFrame([(min(a, b), max(a, b), 9, str(i), m) for i, (a, b, m) in enumerate(approved)], "a string, b string, n long, first string, merged string")
    got = {}
    for r in lex.apply_merges(terms, frame, lex.ScanParams()).collect():
        got.setdefault(r.doc, set()).add(r.tok)
    assert got == {d: plain_fold(ts, approved) for d, ts in docs.items()}


def test_scan_finds_phrases(spark):
    rows = [(str(i), "the quantum error correction code is good" if i % 2 else "an error correction of quantum kind") for i in range(20)]
    toks = lex.tokens(spark.createDataFrame(rows, "arxiv_id string, text string"))
    got = {r.term: r.freq for r in lex.scan(toks, lex.ScanParams(stop1=("the", "is", "an", "of"))).collect()}
    assert any("error correction" in t for t in got) and all(f >= 3 for f in got.values())
    assert lex.scan(toks.limit(0)).count() == 0


def test_shapes(spark):
    want = {"insufficient": [1.0, 2.0], "all-zero": [0.0] * 5, "rise-then-fall": [1.0, 5.0, 9.0, 3.0, 2.0], "mono-rise": [1.0, 2.0, 3.0, 4.0, 6.0], "rise-plateau": [5.0, 6.0, 9.8, 9.9, 10.0], "flat": [9.0, 9.5, 9.0, 9.6, 9.4], "volatile": [8.0, 1.0, 6.0, 2.0, 5.0]}
    rows = spark.createDataFrame(list(want.items()), "want string, v array<double>").select("want", pr.classify_shape(F.col("v")).alias("got")).collect()
    assert all(r.want == r.got for r in rows), rows


def test_hits_and_greedy_fields(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("x", "y")], "a string, b string")
    yearly = spark.createDataFrame([(2018, "a", "b", 3), (2022, "a", "b", 6), (2018, "a", "c", 7), (2022, "a", "c", 6)], "year long, a string, b string, w long")
    got = {(r.a, r.b): (r.hit, r.p1, r.p2) for r in pr.outcomes(pairs, yearly, (2016, 2020), (2021, 2025), 5).collect()}
    assert got == {("a", "b"): (True, 3, 6), ("c", "a"): (False, 7, 6), ("x", "y"): (False, 0, 0)}
    ranked = spark.createDataFrame([("f", "p", 9), ("f", "q", 8), ("f", "r", 7), ("g", "p", 9), ("g", "q", 5), ("g", "s", 1)], "field string, phrase string, n long")
    assert pr.greedy_fields(ranked, {"f": 2, "g": 2}) == [("f", "p", 9), ("f", "q", 8), ("g", "s", 1)]


def test_feature_auc(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 5), rnd.random() < 0.4) for _ in range(80)]
    got = pr.feature_auc(spark.createDataFrame(rows, "x long, hit boolean"), "x").first().auc
    pos, neg = [x for x, h in rows if h], [x for x, h in rows if not h]
    assert got == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))


def test_ranks_over_ranges(spark):
    rnd = random.Random(4)
    values = [rnd.randrange(50) for _ in range(700)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    got = {r.id: (r["rank"], r.total) for r in ranking.running(ranking.ranked(rows, [F.desc("v"), F.asc("id")]), [F.desc("v"), F.asc("id")], F.col("v"), "total").collect()}
    total, want = 0, {}
    for n, i in enumerate(sorted(range(700), key=lambda i: (-values[i], i)), 1):
        total += values[i]
        want[i] = (n, total)
    assert got == want


def test_scratch_tables(spark, tmp_path):
    store = Scratch(spark, "test")
    one, two = store.save(spark.range(5).withColumn("x", F.lit("a"))), store.save(spark.range(3), random=True)
    store.close(two)
    assert two.count() == 3 and one.schema.names == ["id", "x"]
    with pytest.raises(Exception, match="(?i)not.exist|not_found|no such"):
        one.count()
    again = store.save(two)
    store.drop(two)
    assert again.count() == 3
    store.close()


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("# x: 1\n\ndata: 'some/folder'\nstore: s3://bucket/x\nno colon\n: empty\nurl: \"http://a:80\"\n")
    got = config.load(f"{tmp_path}/c.yaml")
    assert got == {"data": "some/folder", "store": "s3://bucket/x", "url": "http://a:80"} and config.load("/no/such/file") == {}
    assert [config.folder(got, k, "d", "/root") for k in ("data", "store", "other")] == ["/root/some/folder", "s3://bucket/x", "d"]


def test_orchestration():
    cache = {"长 查询": ["a", "b"]}
    assert ret.orchestrate(" Black hole, Neutron star ,") == (["black hole", "neutron star"], "skip")
    assert ret.orchestrate("长 查询", cache=cache) == (["a", "b"], "cache")
    assert ret.orchestrate("新", lambda q: ["x", q], cache) == (["x", "新"], "llm") and cache["新"] == ["x", "新"]
    assert ret.orchestrate("坏", lambda q: 1 / 0) == ([], "error: ZeroDivisionError: division by zero")
    for bad in ("  ", "新 2"):
        with pytest.raises(ValueError):
            ret.orchestrate(bad)


def test_recommendation(spark):
    rows = [(2000, d, p, i + 1, "x") for d, ps in {1: ["a", "c"], 2: ["a", "c"], 3: ["c", "z"], 4: ["as", "q"]}.items() for i, p in enumerate(ps)]
    postings = spark.createDataFrame(rows, "year long, doc long, phrase string, pos long, category string")
    got = ret.recommend(["as", "nothing"], postings, postings)
    assert {r["phrase"]: r["status"] for r in got["phrase_status"]} == {"as": "exact", "nothing": "missing"} and got["warnings"][0]["detail"] == ["nothing"]
    assert [tuple(r) for r in got["pairs"].collect()] == [("as", "q", 1, 2)]
    plural = ret.pairs_ab(["cs"], postings.where("doc = 3").union(postings.where("doc = 4").withColumn("phrase", F.lit("cs"))), most=None)
    assert plural.count() == 0
    assert [tuple(r) for r in ret.bridges_acb(["a"], postings, most=None).collect()] == []


def test_dictionary_files(spark, tmp_path):
    at = f"file://{tmp_path}"
    for name, terms in {"terms_1999_pipeline2.csv": ["deep net", "single"], "terms_1986-1991_pipeline2.csv": ["old range"], "terms_2000_test.csv": ["test only"], "terms_2001_pipeline2.csv": ["Deep Net", "graph net"]}.items():
        (tmp_path / name).write_text("rank,term,n_tokens,freq\n" + "".join(f'{i},"{t}",{len(t.split())},5\n' for i, t in enumerate(terms)))
    assert {r.term for r in files.scan_terms(spark, f"{at}/terms_*.csv").collect()} == {"deep net", "graph net"}
    assert files.scan_terms(spark, f"{at}/none_*.csv").count() == 0
    (tmp_path / "manual.txt").write_text("# own\nB-Tree\n\n" + "\n".join(f"word {c}" for c in "abcdefg"))
    manual = files.listed_terms(spark, f"{at}/manual.txt", ann.MANUAL)
    assert [r.term for r in manual.orderBy("at").collect()] == ["b tree", "word a", "word b", "word c", "word d"]
    (tmp_path / "multi.csv").write_text("en,zh\nquantum dot,x\nπ₁¹ set,y\n")
    assert {r.term for r in files.csv_terms(spark, [f"{at}/multi.csv"], "en").collect()} == {"quantum dot"}
    for year in (2024, 2025):
        (tmp_path / f"lexicon_{year}.csv").write_text(f"rank,term\n1, Term {year} \n2,\n")
    assert [r.term for r in files.newest_lexicon(spark, f"{at}/lexicon_*.csv").collect()] == ["term 2025"]
    (tmp_path / "map.json").write_text('{"mapping": {"hubble": "hubble constant"}}')
    assert [tuple(r) for r in files.concept_map(spark, f"{at}/map.json").collect()] == [("hubble", "hubble constant")]


def test_registry_files(spark, tmp_path):
    listed = [("static", "network_1991_e5_t1500.html"), ("static", "network_2020_e20_t1500.html"), ("static", "network_2020_e20_t1500_disc.html"), ("speed", "network_2019-2020_e20_t1500.html"), ("accel", "network_2018-2019-2020_e20_t1500_disc.html"), ("static", "network_2020_e10_t1500.html")]
    table = files.registry(spark.createDataFrame(listed, "mode string, file string"), spark.createDataFrame([(1991,), (2020,)], "year long"))
    table.coalesce(1).write.option("header", True).csv(f"file://{tmp_path}/registry")
    got = {r.year: r for r in files.read_registry(spark, f"file://{tmp_path}/registry").collect()}
    assert (got[1991].e, got[1991].static_file, got[1991].speed_file) == (5, "network_1991_e5_t1500.html", "")
    assert (got[2020].w_cs, got[2020].static_file, got[2020].speed_file, got[2020].accel_file) == (0.5, "network_2020_e20_t1500_disc.html", "network_2019-2020_e20_t1500.html", "network_2018-2019-2020_e20_t1500_disc.html")


def test_files(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("# list\nThe \n\nof\nthe\n")
    assert {r.term for r in files.word_list(spark, f"file://{tmp_path}/stop.txt").collect()} == {"the", "of"}
    terms = spark.createDataFrame([("b c", 3), ("a b", 3), ("x y z", 9)], "term string, freq long")
    files.write_lexicon(terms, f"file://{tmp_path}/lexicon")
    back = files.read_lexicon(spark, f"file://{tmp_path}/lexicon").orderBy("rank").collect()
    assert [(r.rank, r.term, r.n_tokens) for r in back] == [(1, "x y z", 3), (2, "a b", 2), (3, "b c", 2)]
    one = spark.createDataFrame([("1", ["a"], 2000), ("2", ["b"], 2001)], "arxiv_id string, phrases array<string>, year long")
    files.write_annotations(one, f"file://{tmp_path}/anno")
    files.write_annotations(one.where("year = 2001").withColumn("arxiv_id", F.lit("3")), f"file://{tmp_path}/anno")
    assert {r.arxiv_id for r in spark.read.parquet(f"file://{tmp_path}/anno").collect()} == {"1", "3"}
    assert [(r.arxiv_id, r.phrases, r.n_phrases) for r in files.read_annotations(spark, f"file://{tmp_path}/anno", 2001).collect()] == [("3", ["b"], 1)]
    for n in (1, 2):
        files.replace_table(spark.range(n), f"file://{tmp_path}/table")
        assert spark.read.parquet(f"file://{tmp_path}/table").count() == n
    files.write_json(spark.range(2), f"file://{tmp_path}/json")
    assert sum(1 for f in (tmp_path / "json").glob("part-*") for line in f.read_text().splitlines() if json.loads(line) is not None) == 2
