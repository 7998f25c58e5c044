"""Quality and toxicity: held-out accuracy, automata against brute force, edge cases."""

import itertools
import random
import zlib

import numpy as np

from diachron.llm import quality, textarrays, toxicity
from diachron.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def measured(spark, name, label):
    rows = QUERIES[name](spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    return [r for r in rows if r.held_out and r[label] is not None], rows


def test_quality_on_held_out_rows(spark):
    held, rows = measured(spark, "op4_quality_classifier", "quality")
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    held, rows = measured(spark, "op5_toxicity", "toxic")
    clean, toxic = [r for r in held if not r.toxic], [r for r in held if r.toxic]
    assert np.mean([r.predicted for r in clean]) < 0.02 and np.mean([r.predicted for r in toxic]) > 0.7
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)


def test_machine_equals_the_double_sum():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros(3), np.ones(3))
    m.bias, m.weights[:] = 0.3, rng.normal(size=len(m.weights))
    feature, value = rng.choice(len(m.weights), 12, replace=False), rng.normal(size=12)
    margin, _ = m.margin(np.zeros(12, int), feature, value, 1)
    pairs = sum(m.factors[i] @ m.factors[j] * x * y for (i, x), (j, y) in itertools.combinations(zip(feature, value), 2))
    assert np.isclose(margin[0], 0.3 + m.weights[feature] @ value + pairs)


def edges(spark, function):
    docs = spark.createDataFrame([(1, None, None, 1.5), (2, "", None, 0.0), (3, "you idiot, you moron " * 5_000, None, 0.1), (4, "plain words here", None, 0.2), (4, "plain words here", None, 0.2), (None, "!!", 7, 0.0)], "doc_id long, text string, n_chars long, score double")
    none = spark.createDataFrame([], LABELS)
    got = function(docs, none).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    one_class = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, None, 0)], LABELS)
    assert function(docs, one_class).count() == 6
    assert function(docs.limit(0), none).count() == 0
    return {r.doc_id: r for r in got}


def test_quality_edges(spark):
    assert edges(spark, quality.classify)[1].score == 0.5
    docs = spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, predicted int")
    assert quality.keep_good(docs, spark.createDataFrame([], LABELS)).columns == docs.columns


def test_toxicity_edges(spark):
    got = edges(spark, toxicity.classify)
    assert got[3].predicted == 1 and got[1].predicted == got[4].predicted == 0


def test_long_and_odd_texts_have_features():
    texts = ["", "\n\n", "𝒳" * 50, "a" * 3_000_000, "x\x00y"]
    seen = 0
    for at, group in textarrays.groups(texts):
        row, feature, value, dense = quality._features(group, group.lengths.astype(float))
        assert at == seen and dense.shape == (group.n, quality.STATISTICS) and np.isfinite(dense).all()
        seen += group.n
    assert seen == len(texts)


def distance_one(term, word):
    """Whether one changed, missing or extra letter turns the term into the word."""
    letters = set(word)
    made = {term[:i] + term[i + 1 :] for i in range(len(term))}
    made |= {term[:i] + c + term[i + 1 :] for i in range(len(term)) for c in letters}
    made |= {term[:i] + c + term[i:] for i in range(len(term) + 1) for c in letters}
    return word in made


def test_automaton_against_brute_force():
    terms, stems = ["idiot", "moron", "scum", "loser", "losers", "idle", "идиот", "κακός"], ["vequ", "trashy", "сти"]
    automaton = toxicity.Automaton(terms, stems)
    rnd = random.Random(4)
    words = {"diot", "adiot", "oron", "xmoron", "bequ", "rashy", "идиот", "идиоты", "диот", "стид", "κακός", "idiots", "idot", "idxot", "xidiot", "iidiot", "scum", "scm", "losers", "loseers", "lose", "vequx", "veq", "trashyness", "trash", "moronn", "m0r0n", "i", "idl", "idle"}
    for t in terms * 150:
        w = list(t)
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randint(0, 1)] = [rnd.choice("idotmrnsculex")] if rnd.random() < 0.6 else []
            w = w or ["i"]
        words.add("".join(w))
    words = sorted(words)
    group = textarrays.Group([" ".join(words)])
    starts, stops = toxicity._words(group)
    final = automaton.walk(group.low, starts, stops)
    for word, state in zip(words, final, strict=True):
        plain = "".join(toxicity.LEET.get(c, c) for c in word)
        exact = plain in terms or any(plain.startswith(s) for s in stems)
        near = any(len(t) >= toxicity.FUZZY_LENGTH and distance_one(t, plain) for t in terms)
        assert (automaton.hit[state] >= 0) == (exact or near), word
        if exact or near:
            assert automaton.fuzzy[state] == (not exact), word


def test_learned_terms_in_any_alphabet():
    model = toxicity.Model([("негодяй", 4.0), ("馬鹿野郎だ", 4.0)], [])
    plain, russian, misspelled, japanese = model.score(["добрый день", "ты НЕГОДЯЙ", "ты негадяй", "馬鹿野郎だ"])
    assert plain < misspelled and plain < russian and plain < japanese


def brute_quality(model, text, n_chars):
    """The score of one text by the double sum over all pairs of its features."""
    group = textarrays.Group([text])
    row, feature, value = model.rows(*quality._features(group, np.array([n_chars], float)))
    pairs = sum(model.factors[i] @ model.factors[j] * x * y for (i, x), (j, y) in itertools.combinations(zip(feature, value), 2))
    return 1 / (1 + np.exp(-np.clip(model.bias + model.weights[feature] @ value + pairs, -30, 30)))


def test_scores_of_a_whole_table_against_brute_force(spark):
    """Both classifiers' rows on the smallest driver table, each text scored alone by a plain version."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    own = docs.select("doc_id", "text", "n_chars")
    model = quality.train(own.withColumnRenamed("n_chars", "meta"), labels.selectExpr("doc_id", "quality y").where(quality.remainder(labels["doc_id"], 5) != 0))
    for r in QUERIES["op4_quality_classifier"](spark, d).collect():
        if len(rows[r.doc_id].text or "") < 1500:
            assert abs(r.score - brute_quality(model, rows[r.doc_id].text or "", rows[r.doc_id].n_chars)) < 1e-6
    marks = toxicity.train(docs.select("doc_id", "text"), labels.selectExpr("doc_id", "toxic y").where(quality.remainder(labels["doc_id"], 3) != 1))
    automaton = marks.automaton
    learned = len(marks.weights) - len([t for t in automaton.terms if t])
    assert learned == 0
    for r in QUERIES["op5_toxicity"](spark, d).collect():
        group = textarrays.Group([rows[r.doc_id].text or ""])
        starts, stops = toxicity._words(group)
        words = ["".join(map(chr, group.low[a:b])) for a, b in zip(starts, stops)]
        plain = ["".join(toxicity.LEET.get(c, c) for c in w) for w in words]
        full = [t for i, t in enumerate(automaton.terms) if i in set(automaton.full.values())]
        stems = [t for i, t in enumerate(automaton.terms) if i in set(automaton.stem.values())]
        hit = [w in full or any(w.startswith(s) for s in stems) or any(len(t) >= toxicity.FUZZY_LENGTH and abs(len(t) - len(w)) < 2 and distance_one(t, w) for t in full) for w in plain]
        assert len(toxicity.hits(group, automaton)["doc"]) == sum(hit)
        assert abs(marks.score([rows[r.doc_id].text or ""])[0] - r.score) < 1e-9


def test_samples_stay_bounded(spark):
    """An id repeated a thousand times in the documents, or with several labels, is one row of the sample."""
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(7) for y in (1, 0, 5)], "doc_id long, y int")
    got = quality.sampled(docs, labels, 5).collect()
    assert len(got) == 5 and {r.y for r in got} == {0}


def test_context_separates_quotation_from_abuse():
    model = toxicity.Model([], [])
    plain, quoted, reported, abuse, misspelled = model.score(["the idiot went home", 'the "idiot" went home', 'she said "idiot" twice', "you are an idiot", "the idoit or idiott went home"])
    assert reported < quoted < plain < abuse and misspelled < plain
