"""Near-duplicate documents and components against brute force."""

import itertools
import random
import re
from collections import Counter

import numpy as np

from diachron.llm import near_dedup
from diachron.operators.graph import connected_components


def shingle_set(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute_classes(rows, least=0.8):
    """Smallest id of each component over all pairs of documents with words."""
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        p, q = sets[a], sets[b]
        if p and q and len(p & q) >= least * len(p | q):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def family(rnd, words, size, edits):
    base = [rnd.choice(words) for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(edits):
        copy = list(base)
        for _ in range(rnd.randint(1, max(1, size // 70))):
            copy[rnd.randrange(size)] = rnd.choice(words)
        out.append(" ".join(copy))
    return out


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(700, i) for i in range(600, 640)] + [(5, 5), (8, 9), (9, 8)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 540)}, **{i: 600 for i in [*range(600, 640), 700]}, 8: 8, 9: 8}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 500).astype(np.uint64)
    a, b = np.sort(pool[:350]), np.sort(pool[120:])
    wa, wb = rng.choice([0.5, 1, 2, 3, 9], len(a)), rng.choice([0.25, 1, 2, 4], len(b))
    s = near_dedup.dart_signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], [len(a), len(b)]), 3, 3000)
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    keys = set(x) | set(y)
    true = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
    assert abs((s[0] == s[1]).mean() - true) < 0.03
    assert not s[2].any()


def test_near_dedup_against_brute_force(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for size, edits in ((80, 4), (200, 6), (400, 30), (60, 2), (900, 3)) for t in family(rnd, words, size, edits)]
    texts += [" ".join(rnd.choice(words) for _ in range(120)) for _ in range(40)]
    texts += ["one two three four", "One, two three FOUR!", "one two three", "", "...", texts[0], texts[0].upper(), "long " * 30_000]
    rnd.shuffle(texts)
    rows = list(enumerate(texts)) + [(1000, None), (None, "one two three four"), (1001, "same row here twice ok"), (1001, "same row here twice ok")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, class_id int, keys string").repartition(5)
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)
    sizes = Counter(shingle_set(t) for d, t in rows if d is not None and shingle_set(t))
    assert all(r.set_size == sizes.get(shingle_set(dict(rows)[r.doc_id]), 1) for r in got if r.doc_id is not None)
    assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.where("doc_id IS NULL").count() == 1


def test_large_group_around_a_late_base(spark):
    """Copies that are close to the base only: the base, not the smallest id, must lead."""
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(5000)]
    base = [rnd.choice(words) for _ in range(150)]
    copies = []
    for _ in range(60):
        copy = list(base)
        for at in rnd.sample(range(0, 150, 8), 3):
            copy[at] = rnd.choice(words)
        copies.append(" ".join(copy))
    rows = [*enumerate(copies), (99, " ".join(base))]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows)
    assert len(set(want.values())) == 1
    assert {r.doc_id: r.class_id for r in got} == want


def test_rest_pairs_against_brute_force(spark):
    """All similar pairs across components are candidates, and few others."""
    rnd = random.Random(21)
    words = [f"u{i}" for i in range(2000)]
    texts = [t for size, edits in ((60, 12), (150, 30), (40, 9), (300, 8)) for t in family(rnd, words, size, edits)]
    texts += [f"{texts[20]} {' '.join(rnd.choice(words) for _ in range(k * 8))}" for k in range(1, 6)] + ["a b c", "a b c", "", "a b c d e f"]
    rows = [(i, i % 3, t) for i, t in enumerate(texts)]
    got = {(r.a, r.b) for r in near_dedup.rest_pairs(spark.createDataFrame(rows, "node long, component long, text string"), 0.8).collect()}
    sets = [shingle_set(t) for t in texts]
    similar = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if i % 3 != j % 3 and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert similar and similar <= got
    assert all(i % 3 != j % 3 for i, j in got) and len(got) < 3 * len(similar)


def test_no_link_of_a_large_bucket_is_lost(spark):
    """A chain in one bucket: each text is similar to its neighbours only, whoever leads."""
    rnd = random.Random(8)
    words = [f"x{i}" for i in range(9000)]
    chain = [[rnd.choice(words) for _ in range(200)]]
    for i in range(40):
        following = list(chain[-1])
        following[10 + i * 4 : 14 + i * 4] = [rnd.choice(words) for _ in range(4)]
        chain.append(following)
    rows = [(i, " ".join(c)) for i, c in enumerate(chain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = spark.createDataFrame([(i, [7]) for i, _ in rows], "node long, keys array<long>")
    got = near_dedup.similar_components(nodes, lambda ends: docs.withColumnRenamed("doc_id", "node").join(ends, "node", "left_semi"), 0.8).collect()
    assert len(got) == 41 and len({r.component for r in got}) == 1 and len(set(brute_classes(rows).values())) == 1


def test_families_of_all_sizes(spark):
    """Groups of 8, 9, 14 and 200 near copies, whole or chained, and pairs at the threshold, against all pairs."""
    rnd = random.Random(31)
    words = [f"y{i}" for i in range(20000)]
    rows = []
    for size in (8, 9, 14, 200):
        base = [rnd.choice(words) for _ in range(160)]
        for i in range(size):
            copy = list(base)
            copy[3 + i % 150] = f"only{size}x{i}"
            rows.append(" ".join(copy))
    rnd.shuffle(rows)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == brute_classes(list(enumerate(rows))) and len(set(got.values())) == 4


def test_repeated_ids(spark):
    """Rows of one id with different texts are compared by their own texts; repeats leave one row."""
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(5, x), (5, y), (6, y + " more"), (7, x), (7, x), (8, "z " * 9), (8, "z " * 9), (9, ""), (9, ""), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.kept) for r in near_dedup.near_dedup(docs).collect())
    assert got == {(5, 5, True): 2, (6, 5, False): 1, (7, 5, False): 2, (8, 8, True): 2, (9, 9, True): 2, (None, None, True): 2}
    kept = Counter((r.doc_id, r.text) for r in near_dedup.keep_one_of_each(docs).collect())
    assert kept == {(5, x): 1, (5, y): 1, (8, "z " * 9): 1, (9, ""): 1, (None, ""): 2}


def test_whole_table_against_brute_force(spark):
    """Every document of the smallest driver table, all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()} == brute_classes(rows)


def test_empty_table(spark):
    assert near_dedup.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
