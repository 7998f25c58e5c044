"""The pipeline against a plain version of each stage on that stage's own input."""

import re

import corpus_pipeline
from test_native import brute_base
from test_near import brute_classes
from test_codecs import check_packing

from diachron.llm import packing, quality

DIR = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def test_stages_on_their_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    inputs = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, inputs[-1], DIR).write.parquet(f"{tmp_path}/{i}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert inputs[-1].schema == docs.schema
    rows = [{r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in inputs[:5]]

    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).where("score >= 0.3").collect()}
    assert set(rows[1]) == good and {r.doc_id for r in labels.where("quality = 1").collect()} <= good

    best = {}
    for d, t in rows[1].items():
        key = SPACE.sub("", t or "")
        best[key] = max(best.get(key, (-1, 0)), (len(t or ""), -d))
    assert set(rows[2]) == {-d for _, d in best.values()}

    assert set(rows[3]) == set(brute_classes(list(rows[2].items())).values())

    assert set(rows[4]) == set(rows[3])
    for d, text in rows[4].items():
        before = rows[3][d]
        assert "AKIA" not in text and not brute_base(text)
        if not brute_base(before) and "[SECRET]" not in text:
            assert text == before
    assert all(r.n_chars == len(r.text) for r in inputs[4].collect())

    packed = packing.pack(inputs[4]).collect()
    assert inputs[5].count() == len(packed)
    ids = sorted(rows[4])
    order = {d: i for i, d in enumerate(ids)}
    check_packing([r.__class__(**{**r.asDict(), "doc_id": order[r.doc_id]}) for r in packed], [rows[4][d] for d in ids], 2048)


def test_run(spark):
    """The rows of all stages together: every document that stays, each of its tokens once, in sequences without holes."""
    rows = corpus_pipeline.run(spark, DIR).collect()
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
    want = {r.doc_id: r.ids for r in packing.pack(docs).groupBy("doc_id").agg({"doc_tokens": "max"}).toDF("doc_id", "ids").collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert {d: sum(r.length for r in p) for d, p in by_doc.items()} == want
    for pieces, at in [(p, "start") for p in by_doc.values()] + [(p, "offset") for p in by_sequence.values()]:
        end = 0
        for r in sorted(pieces, key=lambda r: r[at]):
            assert r[at] == end
            end += r.length
    assert all(sum(r.length for r in p) <= 2048 for p in by_sequence.values())


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeats, ties, repeated ids and clashing names through all stages."""
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, None), (2, ""), (3, " "), (4, x), (4, x), (5, x + "  "), (6, x + " more"), (7, y), (7, x), (8, "password=verysecret9 " + y), (9, "word " * 60_000), (None, "no id here"), (None, y)]
    base = 10**9  # ids that no label has, so that nothing is learned from these rows
    docs = spark.createDataFrame([(None if d is None else d + base, t, None, None, None, "k", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, __key string, node int")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
        seen.append(sorted((-1 if r.doc_id is None else r.doc_id - base, len(r.text or "")) for r in docs.collect()))
    n = len(x)
    assert len(seen[0]) == len(rows)
    # of equal texts the longest original and the smallest id: 3 of the empty ones, 5 of x, 7 of y
    assert [d for d, _ in seen[1]] == [-1, 3, 5, 6, 7, 8, 9]
    assert (5, n + 2) in seen[1]
    # 6 is near 5, and 8 near 7
    assert [d for d, _ in seen[2]] == [-1, 3, 5, 7, 9] and seen[3] == seen[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert {r.doc_id and r.doc_id - base for r in packed} == {None, 3, 5, 7, 9}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == 0
