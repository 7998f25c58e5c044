"""Keys that two marks hold, against brute force; what a block sends; the queries find them without a row for each key."""

import random

import numpy as np

from diachron.llm import near_dedup, shared_keys, substring_dedup
from diachron.storage import Scratch


def brute(pairs):
    marks = {}
    for mark, key in pairs:
        marks.setdefault(key, set()).add(mark)
    return sorted(k for k, m in marks.items() if len(m) > 1)


def test_against_brute_force(spark):
    rnd = random.Random(21)
    ends = [-(2**63), -1, 0, 1, 2**63 - 1]
    pairs = [(rnd.choice([5, -6, 7, 2**63 - 1, -(2**63)]), k) for k in ends for _ in range(2)] + [(9, k) for k in (2, 3, 3, 3)]
    pairs += [(rnd.randrange(60), rnd.randrange(-900, 900)) for _ in range(2000)] + [(i % 2, 10**6) for i in range(3000)] + [(4, 10**7)] * 3000
    one = spark.createDataFrame(pairs, "mark long, seed long").repartition(5)
    found = [r.seed for r in shared_keys.shared_keys(one, "seed").collect()]
    assert sorted(found) == brute(pairs) and 10**6 in found and 10**7 not in found and len(found) > 400
    lists = [(rnd.randrange(300), [rnd.randrange(4000) for _ in range(rnd.randrange(9))]) for _ in range(900)] + [(1, [])]
    several = spark.createDataFrame(lists, "mark long, keys array<long>").repartition(3)
    assert sorted(r.key for r in shared_keys.shared_keys(several).collect()) == brute([(m, k) for m, keys in lists for k in keys])
    assert shared_keys.shared_keys(one.limit(0), "seed").count() == 0 and shared_keys.shared_keys(several.where("mark < 0")).count() == 0


def test_a_hot_key_is_two_entries_of_a_block():
    key = np.concatenate([np.full(100_000, 77, np.uint64), np.arange(1000, dtype=np.uint64) + np.uint64(10**6)])
    mark = np.concatenate([np.arange(100_000), np.full(1000, 3)])
    b = shared_keys._block([(key[:40_000], mark[:40_000]), (key[40_000:], mark[40_000:])], 7)
    entries = [(k, m) for x, y in zip(b.column(1), b.column(2), strict=True) for k, m in zip(np.frombuffer(x.as_py(), np.int64).tolist(), np.frombuffer(y.as_py(), np.int64).tolist(), strict=True)]
    assert b.num_rows <= 7 and set(b.column(0).to_pylist()) <= set(range(7))
    assert sorted(entries) == [(77, 0), (77, 99_999), *((10**6 + i, 3) for i in range(1000))]


def test_small_keys_are_spread():
    """Seeds are minima, so they lie near zero; the ranges are of a mixed order."""
    key = np.arange(10_000, dtype=np.uint64)
    sizes = [len(x.as_py()) // 8 for x in shared_keys._block([(key, np.zeros(10_000, np.int64))], 10).column(1)]
    assert len(sizes) == 10 and max(sizes) < 1500


def test_queries_look_for_shared_keys_in_blocks(spark, monkeypatch):
    """Bands of paragraphs and seeds of windows: no aggregate over a row for each key."""
    asked = []
    for module in (near_dedup, substring_dedup):
        monkeypatch.setattr(module, "shared_keys", lambda rows, name="key": asked.append(rows.columns[1]) or shared_keys.shared_keys(rows, name))
    rnd = random.Random(22)
    text = " ".join(f"b{rnd.randrange(10**6)}" for _ in range(60))
    docs = spark.createDataFrame([(1, text), (2, "head " + text), (3, "c")], "doc_id long, text string")
    assert {r.doc_id for r in substring_dedup.repeated_passages(docs).collect()} == {1, 2}
    assert asked == ["keys", "seed"]
    nodes = spark.createDataFrame([(b"a", [1, 2]), (b"a", [1, 2]), (b"b", [2, 3]), (b"c", [4, 4])], "node binary, keys array<long>")
    assert sorted((r.key, bytes(r.node)) for r in near_dedup._buckets(nodes, Scratch(spark, "test")).collect()) == [(2, b"a"), (2, b"b")]
