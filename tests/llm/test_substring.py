"""Repeated passages: planted ones are found wherever they are pasted, clean documents are left alone."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from diachron.llm import substring_dedup
from diachron.llm.near_dedup import similar_components
from test_near import shingle_set


def keyed(docs):
    return substring_dedup.keyed(docs, "doc_id", "text").withColumn("many", F.lit(False))


def sentence(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."


def corpus(seed=3):
    rnd = random.Random(seed)
    words = [f"q{i}" for i in range(4000)]
    prose = lambda k: " ".join(sentence(rnd, words, rnd.randint(3, 14)) for _ in range(k))
    passage = " ".join(sentence(rnd, words, n) for n in (9, 12, 4, 15, 10, 11))
    near = passage.split(" ")
    near[30] = "changed"
    hot = sentence(rnd, words, 13)
    texts = {i: "\n".join([hot, prose(6), prose(5)]) for i in range(20)}  # clean but for a short common line
    texts[30] = prose(4) + "\n" + passage + "\n" + prose(3)
    texts[31] = prose(3)[:-1] + " middle of a line " + passage + " and on it goes " + prose(3)
    texts[32] = passage
    texts[33] = prose(2) + "\n" + " ".join(near)
    texts[34] = prose(5) + "\n" + passage.upper() + "\n" + passage
    return texts, passage


def test_planted_passages(spark):
    texts, passage = corpus()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts.items()] + [(50, None, 0, ""), (51, "", 0, ""), (None, passage, 0, "")], "doc_id long, text string, unit int, u1 string").repartition(4)
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {30, 31, 32, 33, 34}
    assert all(not r.removed for r in got if r.doc_id == 30) and all(r.removed for r in got if r.doc_id in (31, 32, 34))
    for r in got:
        span = texts[r.doc_id][r.start : r.stop].lower()
        assert r.n_words >= 20 or r.doc_id == 33
        if r.doc_id == 32:
            assert span == passage.lower().rstrip(".")
    clean = {r.doc_id: r.text for r in substring_dedup.remove_passages(docs).collect()}
    assert all(clean[i] == texts[i] for i in range(20)) and clean[30] == texts[30]
    assert passage not in clean[31] and "middle of a line" in clean[31] and clean[32] == "." and clean[50] is None
    assert clean[None] == passage


def test_one_document_and_empty(spark):
    texts, passage = corpus()
    docs = spark.createDataFrame([(1, passage + "\n" + passage), (1, passage + "\n" + passage)], "doc_id long, text string")
    assert substring_dedup.repeated_passages(docs).count() == 0
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_long_text_without_sentences(spark):
    rnd = random.Random(8)
    run = " ".join(f"z{rnd.randrange(900)}" for _ in range(400))
    docs = spark.createDataFrame([(1, "head words here " + run), (2, "other " * 3 + run + " tail " * 40_000)], "doc_id long, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {1, 2} and sum(r.n_words for r in got if r.doc_id == 2) > 300


def test_near_paragraphs_are_clustered(spark):
    rnd = random.Random(9)
    base = [f"n{rnd.randrange(5000)}" for _ in range(45)]
    other = [*base[:44], "tail"]
    far = [*base[:20], *[f"m{i}" for i in range(25)]]
    docs = spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate((base, other, far))], "doc_id long, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {0, 1} and len({r.cluster_id for r in got}) == 1
    assert {r.doc_id: r.removed for r in got} == {0: False, 1: True}


def test_no_link_of_a_large_bucket_is_lost(spark):
    """Windows sliding over one text are similar to the next few only; all meet in one bucket."""
    words = [f"s{i}" for i in range(90)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 45])) for i in range(45)], "doc_id long, text string")
    whole = keyed(docs)
    nodes = substring_dedup.units(whole).select("doc_id", "node").join(docs, "doc_id")
    assert nodes.count() == 45
    got = similar_components(nodes.select("node", F.array(F.lit(7).cast("long")).alias("keys")), lambda ends: nodes.join(ends, "node", "left_semi").select("node", "text"), 0.8).collect()
    assert len(got) == 45 and len({r.component for r in got}) == 1


def whole_table(spark, sf="sf0.001"):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    return docs, {r.doc_id: r.text or "" for r in docs.collect()}


def test_copies_of_a_whole_table_against_brute_force(spark):
    """Every run of 21 words that two documents hold is reported, and removed but for its first occurrence."""
    docs, texts = whole_table(spark)
    rnd = random.Random(15)
    loop = lambda k, n: " ".join(f"loop{k}x{i % k}" for i in range(n))
    more = {10**6 + i: t for i, t in enumerate([loop(1, 90), "head of it " + loop(1, 60), loop(5, 70) + " tail", "x " + loop(5, 26) + " y", loop(5, 40), " ".join(f"own{rnd.random()}" for _ in range(40)) + " " + loop(3, 50)])}
    docs, texts = docs.union(spark.createDataFrame(list(more.items()), "doc_id long, text string")), {**texts, **more}
    size, places = substring_dedup.LEAST_PASSAGE + 1, {}
    for d in sorted(texts):
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", texts[d])]
        for i in range(len(words) - size + 1):
            places.setdefault(tuple(w[2] for w in words[i : i + size]), []).append((d, words[i][0], words[i + size - 1][1]))
    reported, removed = ({d: bytearray(len(t)) for d, t in texts.items()} for _ in range(2))
    for r in substring_dedup.repeated_passages(docs).collect():
        reported[r.doc_id][r.start : r.stop] = b"\1" * (r.stop - r.start)
        if r.removed:
            removed[r.doc_id][r.start : r.stop] = b"\1" * (r.stop - r.start)
    inner = lambda d, a, b: [m.start() + a for m in re.finditer(r"[^\W_]", texts[d][a:b])]
    seen = 0
    for found in places.values():
        if len({d for d, _, _ in found}) > 1:
            seen += len(found)
            assert all(reported[d][x] for d, a, b in found for x in inner(d, a, b))
            assert all(removed[d][x] for d, a, b in found[1:] for x in inner(d, a, b))
    assert seen > 1000


def test_near_paragraphs_of_a_whole_table_against_all_pairs(spark):
    """Measured recall of links between different paragraphs, and no component without them."""
    docs, texts = whole_table(spark, "sf0.01")
    cut = substring_dedup.units(keyed(docs), substring_dedup.BANDS).collect()
    one = {bytes(r.node): texts[r.doc_id][r.start : r.stop] for r in cut}
    sets, holders, links = {n: shingle_set(t) for n, t in one.items()}, {}, set()
    for n, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(n)
    for n, s in sets.items():
        met = Counter(m for x in s for m in holders[x] if m < n)
        links |= {(m, n) for m, k in met.items() if k >= 0.8 * (len(s) + len(sets[m]) - k) - 1e-9}
    nodes = spark.createDataFrame([(bytes(r.node), [r[f"k{k}"] for k in range(substring_dedup.BANDS)]) for r in cut], "node binary, keys array<long>")
    frame = spark.createDataFrame(list(one.items()), "node binary, text string")
    parts = {bytes(r.node): bytes(r.component) for r in similar_components(nodes, lambda ends: frame.join(ends, "node", "left_semi"), 0.8).collect()}
    found = [parts.get(a, a) == parts.get(b, b) for a, b in links]
    print(len(links), sum(found))
    assert len(links) > 20 and sum(found) >= 0.99 * len(found)
    linked = {n for pair in links for n in pair}
    assert set(parts) <= linked
    for n, c in parts.items():
        if n != c:
            reach, open_ = {n}, [n]
            while open_:
                x = open_.pop()
                for a, b in links:
                    y = b if a == x else a if b == x else None
                    if y is not None and y not in reach:
                        reach.add(y)
                        open_.append(y)
            assert c in reach
            break


def test_repeated_ids(spark):
    """Documents are told apart by id and text; rows that say the same twice count once."""
    rnd = random.Random(14)
    fresh = lambda n: " ".join(f"g{rnd.randrange(10**6)}" for _ in range(n))
    shared = fresh(40)
    rows = [(1, shared + ". " + fresh(30)), (1, shared + ". " + fresh(30)), (2, fresh(50)), (2, shared), (2, shared), (None, shared), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.removed, r.n_words, r.n_paragraphs) for r in substring_dedup.repeated_passages(docs).collect())
    assert got == {(1, False, 40, 1): 1, (1, True, 40, 1): 1, (2, True, 40, 1): 1}
    clean = Counter((r.doc_id, r.text) for r in substring_dedup.remove_passages(docs).collect())
    assert clean[2, ""] == 2 and clean[2, rows[2][1]] == 1 and clean[None, shared] == 1 and clean[3, None] == 1
    assert sum(t is not None and shared in t for d, t in clean if d == 1) == 1


def test_heavy_groups_change_nothing(spark):
    """The passages are the same whether copies go through the search or are left out of it."""
    docs, texts = whole_table(spark)
    docs = docs.union(docs.where("doc_id < 40").selectExpr("doc_id + 100000", "text")).union(docs.where("doc_id < 10").selectExpr("doc_id + 200000", "text"))
    rows = lambda most: sorted((r.doc_id, r.start, r.n_words, r.n_paragraphs, r.removed) for r in substring_dedup.repeated_passages(docs, heaviest=most).collect())
    assert len(rows(0)) > 50 and rows(0) == rows(20) == rows(1000)


def test_passages_without_whole_paragraphs(spark):
    """Sixty words in sentences of four, a mark after each word, and a passage pasted within a sentence."""
    rnd = random.Random(11)
    fresh = lambda n: [f"f{rnd.randrange(10**6)}" for _ in range(n)]
    short = ". ".join(" ".join(fresh(4)) for _ in range(15)) + "."
    marks = "!! ".join(fresh(30)) + "!!"
    inner = " ".join(fresh(12)) + ". " + " ".join(fresh(9)) + ". " + " ".join(fresh(25))
    texts = {}
    for i, passage in enumerate((short, marks, inner)):
        texts[2 * i] = " ".join(fresh(30)) + " " + passage + " " + " ".join(fresh(30))
        texts[2 * i + 1] = " ".join(fresh(20)) + " " + passage + " " + " ".join(fresh(20))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs).collect()}
    assert set(got) == set(texts)
    for i, passage in enumerate((short, marks, inner)):
        for d, removed in ((2 * i, False), (2 * i + 1, True)):
            assert texts[d][got[d].start : got[d].stop] == passage.rstrip(".!") and got[d].removed == removed


def test_bands_find_paragraphs_at_the_threshold(spark):
    """400 pairs with one word changed (38 of 48 shingles in common, similarity 0.79) share a bucket each."""
    rnd = random.Random(12)
    rows = []
    for i in range(400):
        words = [f"v{rnd.randrange(10**6)}" for _ in range(48)]
        other = [*words[:24], "changed", *words[25:]]
        rows += [(2 * i, " ".join(words[:47]) + "."), (2 * i + 1, " ".join(other[:47]) + ".")]
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    found = substring_dedup.units(docs, substring_dedup.BANDS).collect()
    keys = {}
    for r in found:
        keys.setdefault(r.doc_id, set()).update(r[f"k{k}"] for k in range(substring_dedup.BANDS))
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(400))
