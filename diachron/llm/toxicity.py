"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon is a short fixed list plus terms and stems learned from labels. Full terms of five
letters or more are also found with one error anywhere (a changed, missing or extra letter), shorter
ones exactly, stems as prefixes. Trie and automaton are walked together and made
deterministic once on the driver; on the executors the resulting table advances all words of a
group one letter at a time.

A hit weighs what its term weighs, less inside a quotation, least when a reporting word is near,
and more when the text addresses somebody. Document scores are a logistic function of the summed
weights of exact and misspelled hits and of their rate, fitted on the same labelled sample.

Learning uses at most ``sample_rows`` labelled documents (those with the smallest hash of the id) outside
the held-out fold, and counts families of near copies once. Scoring reads every text whole.

Defined results: null text counts as empty; texts without words score as texts without hits;
without labels of both classes the fixed list and fixed coefficients apply; labels other than 0 and
1 are not learned from; of an id that repeats in ``labels`` the least label counts, and of one that
repeats in the documents one row, so the sample stays bounded; repeated rows get equal scores, and
equal scores have no order; of terms that a word matches equally well the first of the lexicon counts;
very long texts are read whole, in a group of their own; an empty table gives an empty result; only
the named columns are read, so others cannot clash.
"""

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from . import textarrays as ta
from .quality import remainder, sampled

SAMPLE_ROWS = 12_000
TERMS, STEMS = 300, 120
THRESHOLD = 0.7
WINDOW = 5
FUZZY_LENGTH = 5

# Common insults, and words that mark address and report.
INSULTS = "idiot moron stupid scum trash loser pathetic disgusting worthless clown imbecile dumbass bastard asshole bitch retard cretin vermin".split()
ADDRESS = "you your you're youre u du dich dir ihr euch tu te toi vous tú usted vosotros".split()
REPORT = "said says wrote called calls quote quoted quoting according term word words sagte schrieb nannte dijo escribió llamó dit écrit appelé".split()
#: Digits and signs read as letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
QUOTES = "\"“”„«»"
IN_QUOTE, IN_REPORT, AT_SOMEBODY = 0.4, 0.15, 1.3
#: Bias, exact, misspelled, rate: used when nothing can be fitted.
DEFAULT = (-3.0, 2.5, 1.0, 0.5)


class Automaton:
    """The deterministic product of the lexicon trie and the one-error automaton."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms = terms + stems
        letters = sorted({c for t in self.terms for c in t})
        self.symbol = {c: i + 1 for i, c in enumerate(letters)}
        self.children: list[dict[int, int]] = [{}]
        self.full: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.below: list[bool] = [False]  # whether a term that may be misspelled lies below
        for i, t in enumerate(self.terms):
            node, path = 0, [0]
            for c in t:
                s = self.symbol[c]
                if s not in self.children[node]:
                    self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.below.append(False)
                node = self.children[node][s]
                path.append(node)
            if i >= len(terms):
                self.stem[node] = i
            else:
                self.full[node] = i
                if len(t) >= FUZZY_LENGTH:
                    for n in path:
                        self.below[n] = True
        self.fuzzy_full = {n: i for n, i in self.full.items() if len(self.terms[i]) >= FUZZY_LENGTH}
        self._determinise()

    def _closure(self, states: set) -> frozenset:
        """Adds what a missing letter reaches."""
        return frozenset(states | {(k, 1) for n, e in states if e == 0 for k in self.children[n].values() if self.below[k]})

    def _step(self, states: frozenset, s: int) -> frozenset:
        out = set()
        for n, e in states:
            if e == 0 and n in self.stem:
                out.add((n, 0))
                continue
            child = self.children[n].get(s)
            if child is not None and (e == 0 or self.below[child]):
                out.add((child, e))
            if e == 0:
                if self.below[n]:
                    out.add((n, 1))
                out.update((k, 1) for k in self.children[n].values() if self.below[k])
        return self._closure(out)

    def _determinise(self) -> None:
        start = self._closure({(0, 0)})
        number, queue = {frozenset(): 0, start: 1}, deque([start])
        rows: dict[int, np.ndarray] = {0: np.zeros(len(self.symbol) + 1, np.int32)}
        while queue:
            state = queue.popleft()

            def index(target: frozenset) -> int:
                if target not in number:
                    number[target] = len(number)
                    queue.append(target)
                return number[target]

            row = np.full(len(self.symbol) + 1, index(self._step(state, 0)), np.int32)
            for s in {s for n, _ in state for s in self.children[n]}:
                row[s] = index(self._step(state, s))
            rows[number[state]] = row
        self.table = np.stack([rows[i] for i in range(len(number))])
        self.hit = np.full(len(number), -1, np.int32)
        self.fuzzy = np.zeros(len(number), bool)
        for state, i in number.items():
            exact = [self.full[n] for n, e in state if e == 0 and n in self.full] + [self.stem[n] for n, e in state if e == 0 and n in self.stem]
            near = [self.fuzzy_full[n] for n, e in state if e == 1 and n in self.fuzzy_full]
            if exact or near:
                self.hit[i], self.fuzzy[i] = min(exact or near), not exact
        self.symbols = np.zeros(ta.KNOWN + 1, np.int32)
        for c, s in self.symbol.items():
            if ord(c) < ta.KNOWN:
                self.symbols[ord(c)] = s
        for sign, letter in LEET.items():
            self.symbols[ord(sign)] = self.symbol.get(letter, 0)

    def walk(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Final state of each word; all words advance together, dead ones drop out."""
        final = np.zeros(len(starts), np.int32)
        alive, state, step = np.arange(len(starts)), np.ones(len(starts), np.int32), 0
        while len(alive):
            at = starts[alive] + step
            state = self.table[state, self.symbols[np.minimum(codes[at], ta.KNOWN)]]
            ended = stops[alive] == at + 1
            final[alive[ended]] = state[ended]
            go = ~ended & (state != 0)
            alive, state, step = alive[go], state[go], step + 1
        return final


def _words(group: ta.Group) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits; signs that stand for letters count between two of them."""
    kind = (group.kind == ta.LETTER) | (group.kind == ta.DIGIT)
    sign = np.flatnonzero(np.isin(group.codes, np.frombuffer("@$*".encode("utf-32-le"), "<u4")))
    sign = sign[(sign > 0) & (sign < len(kind) - 1)]
    sign = sign[kind[sign - 1] & kind[np.minimum(sign + 1, len(kind) - 1)]]
    kind[sign] = True
    return group.runs(kind.astype(np.uint8))


_CUES: dict[tuple, np.ndarray] = {}


def _cues(words: tuple) -> np.ndarray:
    if words not in _CUES:
        g = ta.Group([" ".join(words)])
        starts, stops = g.runs((g.kind != ta.SPACE).astype(np.uint8))
        _CUES[words] = np.unique(g.prints(starts, stops))
    return _CUES[words]


def hits(group: ta.Group, automaton: Automaton) -> dict[str, np.ndarray]:
    """All hits of a group: document, term, whether misspelled, context factor, and words per document."""
    starts, stops = _words(group)
    final = automaton.walk(group.low, starts, stops)
    which = np.flatnonzero(automaton.hit[final] >= 0)
    words = np.bincount(group.doc_of(starts), minlength=group.n)
    doc = group.doc_of(starts[which])
    out = {"doc": doc, "term": automaton.hit[final[which]], "fuzzy": automaton.fuzzy[final[which]], "start": starts[which], "stop": stops[which], "words": words, "factor": np.ones(len(which))}
    if not len(which):
        return out
    quote = np.concatenate([[0], np.cumsum(np.isin(group.codes, np.frombuffer(QUOTES.encode("utf-32-le"), "<u4")))])
    feeds = np.flatnonzero(group.codes == 10)
    line = np.searchsorted(feeds, starts[which])
    line_start, line_end = np.where(line > 0, feeds[line - 1] + 1, 0), feeds[line]
    before, after = quote[starts[which]] - quote[line_start], quote[line_end] - quote[stops[which]]
    inside = (before % 2 == 1) & (after >= 1)
    near = which[:, None] + np.arange(-WINDOW, WINDOW + 1)[None, :]
    valid = (near >= 0) & (near < len(starts))
    near = np.clip(near, 0, len(starts) - 1)
    valid &= group.doc_of(starts[near]) == doc[:, None]
    prints = group.prints(starts[near].ravel(), stops[near].ravel()).reshape(near.shape)
    address = (np.isin(prints, _cues(tuple(ADDRESS))) & valid).any(1)
    report = (np.isin(prints, _cues(tuple(REPORT))) & valid).any(1)
    out["factor"] = np.where(inside & report, IN_REPORT, np.where(inside, IN_QUOTE, np.where(address, AT_SOMEBODY, 1.0)))
    return out


def features(group: ta.Group, automaton: Automaton, weights: np.ndarray) -> np.ndarray:
    """Per document: summed weights of exact and of misspelled terms (each term once), and hits per 100 words."""
    h = hits(group, automaton)
    out = np.zeros((group.n, 3))
    if len(h["doc"]):
        key = (h["doc"].astype(np.int64) * len(weights) + h["term"]) * 2 + h["fuzzy"]
        order = np.lexsort((-h["factor"], key))
        first = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]
        value = weights[h["term"][first]] * h["factor"][first]
        for k in (0, 1):
            own = h["fuzzy"][first] == bool(k)
            out[:, k] = np.log1p(np.bincount(h["doc"][first][own], value[own], group.n))
        out[:, 2] = np.log1p(100 * np.bincount(h["doc"], h["factor"], group.n) / np.maximum(h["words"], 1))
    return out


def learn_terms(sample: DataFrame) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
    """Terms and stems that mark label 1, with log-odds weights; ``sample`` has ``y, text``.

    A document's family is the smallest hash of its long words, so near copies count once.
    """
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " "))
    long = F.filter("w", lambda x: F.length(x) >= 9)
    family = F.coalesce(F.array_min(F.transform(long, lambda x: F.xxhash64(x))), F.xxhash64(F.array_join("w", " ")))
    docs = sample.select("y", words.alias("w")).select("y", "w", family.alias("family"))
    totals = {r.y: r.n for r in docs.groupBy("y").agg(F.count_distinct("family").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return [], []
    stems = F.array_distinct(F.flatten(F.transform(F.filter("w", lambda x: F.length(x) >= 6), lambda x: F.array(*[F.concat(F.substring(x, 1, k), F.lit("*")) for k in (4, 5, 6)]))))
    seen = docs.select("y", "family", F.explode(F.concat(F.filter("w", lambda x: F.length(x) >= 4), stems)).alias("term")).distinct()
    p = toxic / (toxic + clean)
    n, t, c = F.col("t") + F.col("c"), F.col("t"), F.col("c")
    gain = t * F.log(t / n / p) + F.when(c > 0, c * F.log(c / n / (1 - p))).otherwise(0.0)
    counted = seen.groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).where((t >= 3) & (t >= 0.9 * n)).withColumn("gain", gain).where("gain > 8")
    rows = [r for flag, k in ((False, TERMS), (True, STEMS)) for r in counted.where(F.col("term").endswith("*") == flag).orderBy(F.desc("gain"), "term").limit(k).collect()]
    weigh = lambda r: float(np.clip(np.log((r.t + 0.5) / (toxic + 1)) - np.log((r.c + 0.5) / (clean + 1)), 0.5, 5))
    stemmed = [(r.term[:-1], weigh(r)) for r in rows if r.term.endswith("*")]
    shortest = [(s, w) for s, w in stemmed if not any(s != o and s.startswith(o) for o, _ in stemmed)]
    plain = [(r.term, weigh(r)) for r in rows if not r.term.endswith("*")]
    names = {t for t, _ in plain} | set(INSULTS)
    shortest = [(s, w) for s, w in shortest if sum(t.startswith(s) for t in names) != 1]  # a stem of one known term adds nothing
    return [(t, w) for t, w in plain if not any(t.startswith(s) for s, _ in shortest)], shortest


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple:
    """Newton's method with a small ridge; weights of hits are kept from falling below zero."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (p - y) + ridge * b
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b)), g)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(b)


class Model:
    """Lexicon weights, automaton and coefficients."""

    def __init__(self, terms: list[tuple[str, float]], stems: list[tuple[str, float]]):
        learned = dict(terms)
        full = list(learned) + [t for t in INSULTS if t not in learned]
        self.automaton = Automaton(full, [s for s, _ in stems])
        self.weights = np.array([learned.get(t, 3.0) for t in full] + [w for _, w in stems])
        self.coefficients = DEFAULT

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for at, group in ta.groups(texts):
            x = self.features(group)
            out[at : at + group.n] = 1 / (1 + np.exp(-np.clip(self.coefficients[0] + x @ np.array(self.coefficients[1:]), -30, 30)))
        return out

    def features(self, group: ta.Group) -> np.ndarray:
        return features(group, self.automaton, self.weights)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, y of the rows to learn from."""
    store = Scratch(docs.sparkSession, "labelled")
    sample = store.save(sampled(docs, labels, rows).select("y", F.coalesce("text", F.lit("")).alias("text")))  # read several times
    model = Model(*learn_terms(sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [shared.value.features(g) for _, g in ta.groups(b.column(1).to_pylist())]
            x = np.concatenate(x) if x else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T.copy())], ["y", "a", "b", "c"])

    got = sorted((tuple(r) for r in sample.mapInArrow(featurise, "y int, a double, b double, c double").collect()))
    store.close()
    y = np.array([r[0] for r in got], float)
    if len(set(y.tolist())) == 2:
        model.coefficients = _logistic(np.array([r[1:] for r in got]), y)
    return model


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(remainder(F.col("doc_id"), folds) != held)
    model = train(own, known, sample_rows)
    shared = own.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score([t or "" for t in b.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    scored = own.mapInArrow(score, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
