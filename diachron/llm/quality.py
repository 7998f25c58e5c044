"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score is ``sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2])``: all
pairwise interactions through factors of low rank, in time linear in the number of features.

Inputs of a score: hashed word and punctuation runs, structure statistics of the text, and the
metadata length column. Labels, language, source and id are never inputs. The model is fitted on
at most ``sample_rows`` labelled rows (a documented bound; those with the smallest hash of the id)
outside the held-out fold; scoring reads every document whole.

Defined results: null text counts as empty and is scored like any other; documents without
feature words are scored by structure alone; without labels of both classes every score is the
share of label 1 (0.5 without labels); labels other than 0 and 1 are not learned from; of an id
that repeats in ``labels`` the least label counts, and of one that repeats in the documents one row
(the least by length and text hash), so the sample stays bounded; very long texts are read whole, in a
group of their own; repeated rows get equal scores, and equal scores have no order; an empty table
gives an empty result; clashing column names do not matter, as only the named columns are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

BUCKETS = 1 << 14
FACTORS = 8
SAMPLE_ROWS = 6000
EPOCHS = 12
THRESHOLD = 0.3
STATISTICS = 18


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``: the fold rule of the contract."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def _features(group: ta.Group, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (document, feature, value) sorted by document, and dense statistics."""
    starts, stops = group.runs(group.kind, ta.DIGIT)
    prints, doc = group.prints(starts, stops), group.doc_of(starts)
    keys, counts = np.unique(doc.astype(np.int64) * BUCKETS + (prints >> np.uint64(64 - 14)).astype(np.int64), return_counts=True)
    row, feature = keys // BUCKETS, keys % BUCKETS
    value = 1.0 + np.log(counts)
    norm = np.sqrt(np.bincount(row, value**2, group.n))
    value = value / norm[row]

    n = group.lengths.astype(float)
    chars = np.maximum(n, 1)
    code = group.codes
    spaces = group.per_doc(group.kind == ta.SPACE) - 1  # the line feed that ends the document
    letters, digits, others = (group.per_doc(group.kind == k) for k in (ta.LETTER, ta.DIGIT, ta.OTHER))
    upper = group.per_doc(group.upper)
    lines = group.per_doc(code == 10)
    words = np.bincount(doc, minlength=group.n).astype(float)
    some = np.maximum(words, 1)
    distinct = np.bincount(row, minlength=group.n)
    same = np.zeros(len(prints), bool)
    same[1:] = (prints[1:] == prints[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc, same, group.n)
    size = (stops - starts).astype(float)
    mean_size = np.bincount(doc, size, group.n) / some
    longest = np.zeros(group.n)
    np.maximum.at(longest, doc, size)
    tops = np.zeros(group.n)
    np.maximum.at(tops, row, counts)
    bang = group.per_doc(code == 33)
    odd = group.per_doc(np.isin(code, np.frombuffer("%$&*#|~^<>{}[]=+_\\/@".encode("utf-32-le"), "<u4")))
    stops_ = group.per_doc(np.isin(code, np.frombuffer(".,;:?".encode("utf-32-le"), "<u4")))
    dense = np.column_stack([
        np.log1p(n), np.log1p(words), np.log1p(lines), np.log1p(np.maximum(metadata, 0)), letters / chars, digits / chars, others / chars, spaces / chars,
        upper / np.maximum(letters, 1), distinct / some, repeats / some, mean_size, np.log1p(longest), tops / some, bang / some, odd / some, stops_ / some, np.log1p(n / np.maximum(lines, 1)),
    ])
    return row, feature, value, dense


class Machine:
    """A factorisation machine; statistics are standardised and follow the hashed features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.bias, self.weights = 0.0, np.zeros(BUCKETS + len(mean), np.float64)
        self.factors = rng.normal(0, 0.05, (BUCKETS + len(mean), FACTORS))

    def rows(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((dense - self.mean) / self.scale, -4, 4) / np.sqrt(dense.shape[1])
        n, k = z.shape
        return np.concatenate([row, np.repeat(np.arange(n), k)]), np.concatenate([feature, np.tile(np.arange(BUCKETS, BUCKETS + k), n)]), np.concatenate([value, z.ravel()])

    def margin(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        total = self.bias + np.bincount(row, self.weights[feature] * value, n)
        sums = np.empty((n, FACTORS))
        for f in range(FACTORS):
            xv = self.factors[feature, f] * value
            sums[:, f] = np.bincount(row, xv, n)
            total += 0.5 * (sums[:, f] ** 2 - np.bincount(row, xv * xv, n))
        return total, sums

    def fit(self, row, feature, value, n: int, labels: np.ndarray, epochs: int, rate: float = 0.15, decay: float = 1e-4, seed: int = 3) -> None:
        batch = min(200, max(16, n // 40))  # small samples still get a few hundred steps
        rng = np.random.default_rng(seed)
        order = np.argsort(row, kind="stable")
        row, feature, value = row[order], feature[order], value[order]
        bounds = np.searchsorted(row, np.arange(n + 1))
        past_w, past_v, past_b = np.full_like(self.weights, 1e-8), np.full_like(self.factors, 1e-8), 1e-8
        for _ in range(epochs):
            shuffled = rng.permutation(n)
            for at in range(0, n, batch):
                docs = shuffled[at : at + batch]
                counts = bounds[docs + 1] - bounds[docs]
                ends = np.cumsum(counts)
                take = np.repeat(bounds[docs] - (ends - counts), counts) + np.arange(ends[-1])
                r, f, x = np.repeat(np.arange(len(docs)), counts), feature[take], value[take]
                margin, sums = self.margin(r, f, x, len(docs))
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[docs]) / len(docs)
                distinct, back = np.unique(f, return_inverse=True)
                gw = np.bincount(back, g[r] * x, len(distinct)) + decay * self.weights[distinct]
                past_w[distinct] += gw**2
                old = self.factors[f]
                for k in range(FACTORS):
                    gv = np.bincount(back, g[r] * x * (sums[r, k] - old[:, k] * x), len(distinct)) + decay * self.factors[distinct, k]
                    past_v[distinct, k] += gv**2
                    self.factors[distinct, k] -= 0.3 * rate * gv / np.sqrt(past_v[distinct, k])
                self.weights[distinct] -= rate * gw / np.sqrt(past_w[distinct])
                past_b += g.sum() ** 2
                self.bias -= rate * g.sum() / past_b**0.5


def _texts(b: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in b.column(column).to_pylist()]


def _metadata(b: pa.RecordBatch, column: int, texts: list[str]) -> np.ndarray:
    return np.array([len(t) if m is None else m for m, t in zip(b.column(column).to_pylist(), texts, strict=True)], float)


def sampled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``y`` and the columns of ``docs`` but the id, of at most ``rows`` labelled documents (``labels``: doc_id, y), one row for each id."""
    chosen = labels.where(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    met = docs.join(F.broadcast(chosen), "doc_id")
    own = [c for c in docs.columns if c != "doc_id"]
    one = met.groupBy("doc_id", "y").agg(F.min_by(F.struct(*own), F.struct(F.length("text"), F.xxhash64("text"))).alias("row"))
    return one.select("y", "row.*")


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the bounded training sample, made on the executors."""
    joined = sampled(docs, labels, rows).select("y", "text", "meta")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = _texts(b, 1), []
            meta = _metadata(b, 2, texts)
            for at, group in ta.groups(texts):
                row, feature, value, dense = _features(group, meta[at : at + group.n])
                cut = np.searchsorted(row, np.arange(group.n + 1))
                out += [(feature[x:y].astype("<u2").tobytes(), value[x:y].astype("<f4").tobytes(), dense[i].astype("<f8").tobytes()) for i, (x, y) in enumerate(zip(cut, cut[1:], strict=False))]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["label", "feature", "value", "dense"])

    got = joined.mapInArrow(featurise, "label int, feature binary, value binary, dense binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.dense), bytes(r.feature)))  # the order of rows must not depend on partitions
    if not got:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, STATISTICS))], np.zeros(0)
    features = [np.frombuffer(r.feature, "<u2").astype(np.int64) for r in got]
    row = np.repeat(np.arange(len(got)), [len(x) for x in features])
    value = np.concatenate([np.frombuffer(r.value, "<f4") for r in got]).astype(float)
    return [row, np.concatenate(features), value, np.stack([np.frombuffer(r.dense, "<f8") for r in got])], np.array([r.label for r in got], float)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> Machine | float:
    """A fitted machine, or the share of label 1 if the sample lacks one of the classes."""
    (row, feature, value, dense), y = _sample(docs, labels, rows)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    machine = Machine(dense.mean(0), dense.std(0) + 1e-6)
    n = len(y)
    machine.fit(*machine.rows(row, feature, value, dense), n, y, epochs)
    return machine


def _scores(machine: Machine | float, texts: list[str], meta: np.ndarray) -> np.ndarray:
    if isinstance(machine, float):
        return np.full(len(texts), machine)
    out = np.zeros(len(texts))
    for at, group in ta.groups(texts):
        margin, _ = machine.margin(*machine.rows(*_features(group, meta[at : at + group.n])), group.n)
        out[at : at + group.n] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    return out


def _fitted(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held: int, sample_rows: int, id_col: str, text_col: str, meta_col: str) -> tuple[DataFrame, Broadcast]:
    """The columns that are read (doc_id, text, meta) and the model, of a fixed size (buckets times factors), for all executors."""
    meta = F.col(meta_col).cast("double") if meta_col in docs.columns else F.lit(None).cast("double")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), meta.alias("meta"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(remainder(F.col("doc_id"), folds) != held)
    return own, own.sparkSession.sparkContext.broadcast(train(own, known, sample_rows))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", meta_col: str = "n_chars") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    ``labels`` has the id and ``label_col``; rows whose crc32 remainder equals ``held`` and rows
    without a label are not learned from.
    """
    own, shared = _fitted(docs, labels, label_col, folds, held, sample_rows, id_col, text_col, meta_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(shared.value, texts, _metadata(b, 2, texts)), pa.float64())], ["doc_id", "score"])

    scored = own.mapInArrow(score, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", meta_col: str = "n_chars") -> DataFrame:
    """The documents that are not rejected, with all their columns; each row is judged by its own text, nothing is shuffled."""
    _, shared = _fitted(docs, labels, label_col, folds, held, sample_rows, id_col, text_col, meta_col)
    text_at, meta_at = docs.columns.index(text_col), docs.columns.index(meta_col) if meta_col in docs.columns else -1

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b, text_at)
            meta = _metadata(b, meta_at, texts) if meta_at >= 0 else np.array([len(t) for t in texts], float)
            yield b.filter(pa.array(_scores(shared.value, texts, meta) >= threshold, pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
