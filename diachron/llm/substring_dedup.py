"""Passages that repeat across documents: paragraph MinHash banding, verification, components.

A paragraph is what lies between line ends and sentence ends, so a passage pasted into the middle
of a line still brings whole paragraphs along; stretches of over ``LONG`` words without such ends
are cut where a word's hash says so, which does not depend on what surrounds them. Paragraphs of
at least ``LEAST_WORDS`` words take part.

Equal paragraphs (by a 128-bit fingerprint of their words) form one class. Classes meet in
``BANDS`` bands of ``ROWS`` MinHash coordinates over shingles of five words: a pair is found with
probability 0.9997 at similarity 0.8 and 0.99999 at 0.9, and equal paragraphs need no band. (Bands of
one coordinate find 0.998 at 0.8 but a hundred candidates for every link.) What meets is verified by
exact Jaccard similarity and put into components by :func:`.near_dedup.similar_components`, which
loses no link between members of a bucket to its leaders.

A cluster repeats if it occurs in two documents or more. Of each cluster the first occurrence by
document and position stays, all others are marked as removed.

Copies word by word are found whatever the punctuation: every run of more than ``LEAST_PASSAGE`` words
that another document holds too is covered to its first and last word, in short sentences, lists, verse
and within longer sentences alike. For each window of that many words, the smallest of its shingles of
``SEED`` words is kept; equal windows have equal ones, so the windows whose smallest shingle occurs in
one document only are dropped. Neighbouring windows with one smallest shingle form a run; equal runs are
found by a 128-bit fingerprint of their words, and the windows themselves are compared (by 128 bits
again) only where a shingle has runs that differ, as at the ends of copies. All steps are linear in
the words. Of equal windows the first occurrence stays. A word is removed if a removed
paragraph or window covers it; where a kept part borders on a removed one without a paragraph's or
window's end, it reaches up to it.

Of the ``HEAVIEST_COPIES`` largest groups of documents with one text only the first member takes part in
the search; all its words are repeated, and the other members' words are removed. The passages are the
same for any number of such groups (but for signs between words where a kept part reaches up to a
removed one), and large groups cost one document each.

In each document neighbouring repeated stretches, with at most ``GAP`` other words between, form a
passage; passages of at least ``LEAST_PASSAGE`` words are reported, ``n_words`` without those others
and ``n_paragraphs`` of the paragraphs that begin in them. The floors are parameters.

Defined results: null and empty text has no passages; very long texts are cut whole, in a group of
their own; rows without an id are left alone; rows that repeat an id with the same text count as one
document, with different texts as documents of their own, whose passages carry the same id; of equal
occurrences the first by id, text hash and position stays; passages repeated within one document only
are not reported; an empty table gives an empty result; only the named columns are read, so others
cannot clash. Ids must be whole numbers. ``cluster_id`` is a 64-bit name, clusters are told apart by
128 bits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from . import textarrays as ta
from .near_dedup import SHINGLE, SIMILARITY, _salt, keyed, similar_components
from .shared_keys import shared_keys
from .skew import join_one

LEAST_WORDS, LONG, LEAST_PASSAGE, GAP = 8, 48, 20, 7
SEED = 12
BANDS, ROWS = 8, 2
#: Groups of equal texts whose members but one are left out of the search: 24 bytes each to broadcast.
HEAVIEST_COPIES = 20_000
_PASSAGES = "doc_id long, t1 long, start long, stop long, n_words long, n_paragraphs long, cluster_id long, removed boolean"
_PASSAGE_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "t1", "start", "stop", "n_words", "n_paragraphs", "cluster_id")] + [("removed", pa.bool_())])
_PLACES = ["doc_id", "t1", "unit", "first", "words", "start", "stop"]
_TYPES = ["doc_id long", "t1 long", "unit int", "first int", "words int", "start int", "stop int"]


def _value(x: np.ndarray, salt: int) -> np.ndarray:
    """One of many orders of 32-bit fingerprints, for minima."""
    x = (x ^ np.uint32(int(ta.mix(np.array([_salt(salt)]))[0]) & 0xFFFFFFFF)) * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def paragraphs(group: ta.Group, bands: int, least_words: int = LEAST_WORDS) -> dict[str, np.ndarray]:
    """All paragraphs of a group that take part, with positions in words and code points, fingerprints (two numbers) and band keys."""
    starts, stops = group.words()
    n = len(starts)
    if not n:
        return {}
    prints, doc = group.prints(starts, stops), group.doc_of(starts)
    ends = np.concatenate([[0], np.cumsum(np.logical_or.reduce([group.codes == ord(c) for c in "\n.!?"]), dtype=np.int32)])
    opens = np.ones(n, bool)
    opens[1:] = ends[starts[1:]] > ends[stops[:-1]]
    sizes = np.diff(np.append(np.flatnonzero(opens), n))
    opens |= np.repeat(sizes > LONG, sizes) & (prints % np.uint64(16) == 0)
    first = np.flatnonzero(opens)
    sizes = np.diff(np.append(first, n))
    doc_first = np.searchsorted(doc, np.arange(group.n))
    owner = np.cumsum(opens) - 1
    unit = np.arange(len(first)) - np.searchsorted(first, doc_first)[doc[first]]
    inside = (np.arange(n) - first[owner]).astype(np.uint64)
    out = {"doc": doc[first], "unit": unit, "first": first - doc_first[doc[first]], "words": sizes, "start": starts[first], "stop": stops[first + sizes - 1]}
    place = ta.mix(inside + _salt(1))
    out["print"] = np.column_stack([ta.mix(np.add.reduceat(ta.mix(prints ^ (place + _salt(salt))), first)) for salt in (2, 3)])
    if bands:
        total = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            total += ta.mix(prints[np.minimum(np.arange(n) + j, n - 1)] + _salt(j + 1))
        folded = (total ^ (total >> np.uint64(32))).astype(np.uint32)
        short = np.flatnonzero(inside + SHINGLE > sizes[owner])
        keys = np.empty((len(first), bands), np.uint64)
        for k in range(bands):
            key = np.full(len(first), _salt(k + 1), np.uint64)
            for j in range(ROWS):
                value = _value(folded, k * ROWS + j + 11)
                value[short] = 0xFFFFFFFF
                key = ta.mix(key + np.minimum.reduceat(value, first))
            keys[:, k] = key
        out["keys"] = keys
    take = sizes >= least_words
    return {k: v[take] for k, v in out.items()}


def units(docs: DataFrame, bands: int = 0, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per paragraph of ``docs`` (doc_id, t1, text, many): place, many, fingerprint ``node`` and band keys ``k0 ...``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, group in ta.groups([t or "" for t in b.column(2).to_pylist()]):
                found = paragraphs(group, bands, least_words)
                if not found:
                    continue
                begin = np.concatenate([[0], group.ends[:-1]])[found["doc"]]
                local = {**found, "start": found["start"] - begin, "stop": found["stop"] - begin}
                rows = pa.array(at + found["doc"])
                arrays = [b.column(0).take(rows), b.column(1).take(rows), *(pa.array(local[c].astype(np.int32)) for c in _PLACES[2:])]
                arrays += [b.column(3).take(rows), ta.binary(found["print"], np.ones(len(rows), bool))]
                arrays += [pa.array(np.ascontiguousarray(found["keys"][:, k]).view(np.int64)) for k in range(bands)]
                yield pa.RecordBatch.from_arrays(arrays, [*_PLACES, "many", "node", *(f"k{k}" for k in range(bands))])

    return docs.select("doc_id", "t1", "text", "many").mapInArrow(cut, ", ".join([*_TYPES, "many boolean", "node binary", *(f"k{k} long" for k in range(bands))]))


class _Rolled:
    """Fingerprints of any stretch of words from one running sum."""

    def __init__(self, prints: np.ndarray, salt: int):
        self.up, self.down = ta.powers(len(prints))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ta.mix(prints + _salt(salt)) * self.up[: len(prints)], dtype=np.uint64)])

    def __call__(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return ta.mix((self.total[starts + lengths] - self.total[starts]) * self.down[starts] + ta.mix(np.atleast_1d(np.asarray(lengths, np.uint64))))


def _windows(group: ta.Group, size: int) -> dict[str, np.ndarray]:
    """All windows of ``size`` words within one document: word in the group, place, and smallest shingle of ``SEED`` words; with them ``prints`` of the words."""
    starts, stops = group.words()
    n = len(starts) - size + 1
    if n <= 0:
        return {}
    prints, doc = group.prints(starts, stops), group.doc_of(starts)
    seed = min(SEED, size)
    shingles = _Rolled(prints, 101)(np.arange(len(starts) - seed + 1), seed)
    least = shingles[:n].copy()
    for j in range(1, size - seed + 1):
        np.minimum(least, shingles[j : j + n], out=least)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    first = at - np.searchsorted(doc, np.arange(group.n))[doc[at]]
    return {"at": at, "doc": doc[at], "first": first, "start": starts[at], "stop": stops[at + size - 1], "seed": least[at], "prints": prints}


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _runs(word: np.ndarray, doc: np.ndarray, seed: np.ndarray, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of neighbouring windows with one seed, and whether a window comes again in its run; there each window is a run of its own."""
    new = _changes(seed, doc, word - np.arange(len(word)))
    lengths = np.diff(np.append(new, len(word)))
    most = size - min(SEED, size) + 1
    run, loops = np.repeat(np.arange(len(new)), lengths), lengths > most
    for lag in range(1, most):
        loops[run[lag:][(prints[lag:] == prints[:-lag]) & (run[lag:] == run[:-lag])]] = True
    cut = np.flatnonzero(loops[run])
    new = np.union1d(new, cut)
    return new, np.diff(np.append(new, len(word))), np.isin(new, cut)


def _copies(docs: DataFrame, size: int, store: Scratch) -> DataFrame:
    """Runs and windows of ``size`` words that two documents or more hold: doc_id, t1, first, words, start, stop, label, removed, whole."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, group in ta.groups([t or "" for t in b.column(1).to_pylist()]):
                if (found := _windows(group, size)) and len(found["doc"]):
                    doc, seed, word = found["doc"], found["seed"], found["at"]
                    several = b.column(2).slice(at, group.n).to_numpy(zero_copy_only=False)[doc]
                    new = _changes(seed, doc)
                    if several.any():  # there a window that comes again in its run counts again
                        own = np.flatnonzero(several)
                        again, _, _ = _runs(word[own], doc[own], seed[own], _Rolled(found["prints"], 301)(word[own], size), size)
                        new = np.union1d(new, own[again])
                    rows = pa.array(at + doc[new])
                    mark, many = b.column(0).take(rows).to_numpy(), several[new]
                    each = ta.mix(mark.astype(np.int64).view(np.uint64) + new.astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(np.where(many, each, mark)), pa.array(seed[new].view(np.int64))], ["mark", "test", "seed"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            for at, group in ta.groups([t or "" for t in b.column(2).to_pylist()]):
                if not (found := _windows(group, size)):
                    continue
                known = lists.slice(at, group.n).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                heads = _changes(found["seed"]) if len(found["seed"]) else np.zeros(0, int)
                take = np.repeat(np.isin(found["seed"][heads].view(np.int64), known), np.diff(np.append(heads, len(found["seed"]))))
                word, doc, first, start, stop, seed = (found[c][take] for c in ("at", "doc", "first", "start", "stop", "seed"))
                if not len(word):
                    continue
                prints = _Rolled(found["prints"], 301)(word, size)
                new, lengths, loops = _runs(word, doc, seed, prints, size)
                # windows of each run, in order; of single windows that come again in a document one row has them all
                order, run = np.arange(len(word)), np.repeat(np.arange(len(new)), lengths)
                if loops.any():
                    single = loops[run]
                    name = np.where(single, prints, run.astype(np.uint64))
                    order = np.lexsort((word, name, single, doc))
                    heads = _changes(doc[order], single[order], name[order])
                    lengths = np.diff(np.append(heads, len(word)))
                    new, loops = order[heads], single[order][heads]
                    run = np.repeat(np.arange(len(new)), lengths)
                words = np.where(loops, size, lengths + size - 1)
                label = _Rolled(found["prints"], 201)(word[new], words)
                begin = np.concatenate([[0], group.ends[:-1]])[doc[new]]
                offsets = pa.array(np.append(np.cumsum(lengths) - lengths, len(word)).astype(np.int32))
                each = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))  # noqa: B023, E731
                tail = np.where(loops, new, order[np.cumsum(lengths) - 1])
                rows = pa.array(at + doc[new])
                yield pa.RecordBatch.from_arrays([
                    ta.binary(np.column_stack([seed[new], label]), np.ones(len(new), bool)), pa.array(seed[new].view(np.int64)), b.column(0).take(rows), b.column(1).take(rows),
                    pa.array(first[new].astype(np.int32)), pa.array(words.astype(np.int32)), pa.array((start[new] - begin).astype(np.int32)), pa.array((stop[tail] - begin).astype(np.int32)),
                    each(prints[order].view(np.int64)), each((first[order] - first[new][run]).astype(np.int32)), each((start[order] - start[new][run]).astype(np.int32)), each((stop[order] - start[new][run]).astype(np.int32)),
                    pa.array(loops), b.column(4).take(rows),
                ], ["label", "seed", *_PLACES[:2], "first", "words", "start", "stop", "prints", "firsts", "starts", "stops", "loops", "many"])

    mark = F.xxhash64("doc_id", "t1").alias("mark")  # only tells documents apart for a test that lets too much through
    sown = store.save(docs.select(mark, "text", "many").mapInArrow(seeds, "mark long, test long, seed long"), random=True)
    shared = store.save(shared_keys(sown.select(F.col("test").alias("mark"), "seed"), "seed"), random=True)
    met = sown.select("mark", "seed").join(shared.hint("shuffle_hash"), "seed")
    held = store.save(met.groupBy("mark").agg(F.collect_set("seed").alias("seeds")))
    store.drop(sown, shared)
    rows = docs.select(mark, "doc_id", "t1", "text", "many").join(held.hint("shuffle_hash"), "mark").select("doc_id", "t1", "text", "seeds", "many")
    rows = store.save(rows.mapInArrow(runs, "label binary, seed long, doc_id long, t1 long, first int, words int, start int, stop int, prints array<long>, firsts array<int>, starts array<int>, stops array<int>, loops boolean, many boolean"), random=True)
    store.drop(held)
    place = F.struct("doc_id", "t1", "first")
    # held by two documents, or twice by one that stands for many
    across = (F.struct("keep.doc_id", "keep.t1") < F.struct("last.doc_id", "last.t1")) | (F.col("many") & ((F.col("keep") < F.col("last")) | F.col("loops")))
    again = F.bool_or(F.col("loops") & (F.size("prints") > 1)).alias("loops")
    labels = rows.groupBy("label", "seed").agg(F.min(place).alias("keep"), F.max(place).alias("last"), F.bool_or("many").alias("many"), again, F.count(F.lit(1)).alias("n"))
    labels = store.save(labels.select("label", "seed", "keep", "n", across.alias("shared")))
    columns = ["doc_id", "t1", "first", "words", "start", "stop", "label"]
    # a run whose windows come again brings all of them, the others one row
    spread = F.when(F.col("loops"), F.arrays_zip("firsts", "starts", "stops"))
    whole = join_one(rows.select(*columns, spread.alias("all")), labels.where("shared").select("label", "keep", "n"), "label", "n", F.concat_ws("-", "doc_id", "first"), hint="shuffle_hash").where("keep IS NOT NULL")
    whole = whole.select("*", F.explode_outer("all").alias("w"))
    at = lambda base, part, rest: F.when(F.col("w").isNull(), F.col(rest)).otherwise(F.col(base) + F.col(f"w.{part}"))
    whole = whole.select("doc_id", "t1", at("first", "firsts", "first").alias("first"), "words", at("start", "starts", "start").alias("start"), at("start", "stops", "stop").alias("stop"), F.xxhash64("label").alias("label"), "keep")
    whole = whole.select(*columns, (place != F.col("keep")).alias("removed"))
    # shingles whose runs differ: their windows, of the first occurrence of each run that documents share and of all others
    mixed = store.save(labels.groupBy("seed").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1").select("seed"))
    firsts = store.save(labels.join(mixed, "seed").select("label", "keep", "shared"))
    one = rows.join(firsts.hint("shuffle_hash"), "label").where(~F.col("shared") | (place == F.col("keep")))
    each = one.select("doc_id", "t1", "seed", "shared", "many", "start", "first", F.explode(F.arrays_zip("prints", "firsts", "starts", "stops")).alias("w"))
    windows = each.select("seed", F.col("w.prints").alias("print"), "doc_id", "t1", (F.col("first") + F.col("w.firsts")).alias("first"), (F.col("start") + F.col("w.starts")).alias("begin"), (F.col("start") + F.col("w.stops")).alias("end"), "shared", "many", F.lit(False).alias("loops"))
    windows = store.save(windows, random=True)
    best = windows.groupBy("seed", "print").agg(F.min(place).alias("keep"), F.max(place).alias("last"), F.bool_or("shared").alias("some"), F.bool_or("many").alias("many"), F.bool_or("loops").alias("loops"))
    best = store.save(best.where(across | F.col("some")).select("seed", "print", "keep"))
    single = windows.join(best.hint("shuffle_hash"), ["seed", "print"]).select("doc_id", "t1", "first", F.lit(size).alias("words"), F.col("begin").alias("start"), F.col("end").alias("stop"), F.xxhash64("seed", "print").alias("label"), (place != F.col("keep")).alias("removed"))
    store.drop(mixed)
    return whole.union(single).withColumn("whole", F.lit(False))


def _merged(rows: pa.Table, least: int, gap: int) -> pa.RecordBatch:
    """The passages of some whole documents (rows sorted by doc_id, t1) from their repeated paragraphs (``whole``), runs and windows.

    All documents at once: each has its own stretch of word numbers, too far apart for a passage to span two.
    """
    doc_id, t1, first, words, start, stop, label, removed, whole = (rows.column(c).to_numpy() for c in ("doc_id", "t1", "first", "words", "start", "stop", "label", "removed", "whole"))
    bounds = _changes(doc_id, t1)
    doc = np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, len(doc_id))))
    doc_id, t1 = doc_id[bounds], t1[bounds]
    sizes = np.maximum.reduceat(first + words, bounds).astype(np.int64) + gap + 1
    base = np.cumsum(sizes) - sizes
    first, last = first + base[doc], first + words + base[doc]
    order = np.lexsort((stop, words, ~whole, first))
    keys = np.column_stack([first, words, stop, whole, removed])[order]
    order = order[np.append(True, (keys[1:] != keys[:-1]).any(1))]  # rows that repeat a document say the same again
    first, last, start, stop, label, removed, whole = (x[order] for x in (first, last, start, stop, label, removed, whole))
    n = int(sizes.sum())
    cover = lambda take: np.cumsum(np.bincount(first[take], minlength=n + 1) - np.bincount(last[take], minlength=n + 1))[:n] > 0
    state = np.where(cover(removed), 2, np.where(cover(~removed), 1, 0))
    opens, closes = np.full(n + 1, -1), np.full(n + 1, -1)
    opens[first], closes[last] = start, stop
    edges = np.flatnonzero(np.diff(state, prepend=-1))
    ends = np.append(edges[1:], n)
    kept = state[edges] > 0
    low, high, kind = edges[kept], ends[kept], state[edges[kept]]
    fresh = np.append(True, low[1:] - high[:-1] > gap) if len(low) else np.zeros(0, bool)  # parts with few words between are one run
    run = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    long = high[np.append(heads[1:], len(low)) - 1] - low[heads] >= least if len(low) else np.zeros(0, bool)
    low, high, kind, run = (x[long[run]] for x in (low, high, kind, run))
    if not len(low):
        return pa.RecordBatch.from_pylist([], schema=_PASSAGE_SCHEMA)
    at = _changes(run, kind)
    counts = np.add.reduceat(high - low, at)
    low, high, kind = low[at], high[np.append(at[1:], len(high)) - 1], kind[at]
    left, right = np.searchsorted(first, low), np.searchsorted(first, high)
    named, own = np.where(left < right, left, left - 1), np.zeros(len(low), np.int64)
    for k in (1, 2):
        flag = whole & (removed == (k == 2))
        total = np.concatenate([[0], np.cumsum(flag)])
        following = np.append(np.flatnonzero(flag), len(first))  # the k-th flagged row
        mine = kind == k
        own[mine] = (total[right] - total[left])[mine]
        named = np.where(mine & (own > 0), following[total[left]], named)
    of = np.searchsorted(base, low, side="right") - 1
    begin, end = np.where(opens[low] >= 0, opens[low], closes[low]), np.where(closes[high] >= 0, closes[high], opens[high])
    columns = [doc_id[of], t1[of], begin, end, counts, own, label[named]]
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(kind == 2)], schema=_PASSAGE_SCHEMA)


def _by_document(least: int, gap: int):
    """Batches of rows sorted by document to passages; the last document of a batch waits for the next one."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = _changes(*(b.column(i).to_numpy() for i in (0, 1)))
            cut = int(new[-1])
            changed = bool(waiting) and any(waiting[0].column(i)[waiting[0].num_rows - 1] != b.column(i)[0] for i in (0, 1))
            if cut or changed:
                yield _merged(pa.Table.from_batches([*waiting, b.slice(0, cut)]), least, gap)
                waiting = []
            waiting.append(b.slice(cut))
        if waiting:
            yield _merged(pa.Table.from_batches(waiting), least, gap)

    return passages


def _found(docs: DataFrame, least: float, bands: int, least_words: int, repeats: bool, store: Scratch) -> DataFrame:
    """All paragraphs of repeated clusters: doc_id, t1, first, words, start, stop, label, removed, whole."""
    # tells documents apart; where a document stands for many, its own repeats are repeats across documents
    mark = F.when(F.col("many"), F.xxhash64("doc_id", "t1", "unit")).otherwise(F.xxhash64("doc_id", "t1"))
    cut = store.save(units(docs, bands, least_words), random=True)
    keys = F.array(*[f"k{k}" for k in range(bands)])
    places = []

    def texts(ends: DataFrame) -> DataFrame:
        equal = cut.groupBy("node").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low < high").select("node")
        wanted = store.save(ends.union(equal).distinct())
        places.append(store.save(cut.select(*_PLACES, "many", "node").join(wanted.hint("shuffle_hash"), "node")))
        store.drop(cut, wanted)
        one = store.save(places[0].groupBy("node").agg(F.min(F.struct("doc_id", "t1", "start", "stop")).alias("at")).join(ends, "node", "left_semi").select("node", "at.*"))
        own = docs.select("doc_id", "t1", "text").join(one.hint("shuffle_hash"), ["doc_id", "t1"])
        cut_out = own.select("node", F.expr("substring(text, start + 1, stop - start)").alias("text"))
        return cut_out.dropDuplicates(["node"]) if repeats else cut_out  # a row that repeats a document brings its paragraphs again

    parts = similar_components(cut.select("node", keys.alias("keys")), texts, least)
    labelled = store.save(places[0].join(parts, "node", "left").select(*_PLACES, "many", F.coalesce("component", "node").alias("label")))
    order = F.struct("doc_id", "t1", "unit")
    firsts = labelled.groupBy("label").agg(F.min(order).alias("keep"), F.min(mark).alias("low"), F.max(mark).alias("high"), F.count(F.lit(1)).alias("n"))
    firsts = store.save(firsts.where("low < high").select("label", "keep", "n"))
    marked = join_one(labelled, firsts, "label", "n", F.concat_ws("-", "doc_id", "unit")).where("keep IS NOT NULL")
    return marked.select("doc_id", "t1", "unit", "first", "words", "start", "stop", F.xxhash64("label").alias("label"), (order != F.col("keep")).alias("removed"), F.lit(True).alias("whole"))


def _heavy(ids: DataFrame, most: int) -> DataFrame:
    """``t1, t2, keep``: the ``most`` largest groups of documents with one text, and the smallest id of each."""
    groups = ids.groupBy("t1", "t2").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("keep < last")
    return groups.orderBy(F.desc("n"), "t1", "t2").limit(most).select("t1", "t2", "keep")


def _outlines(docs: DataFrame, least_words: int) -> DataFrame:
    """Per document of ``docs`` (doc_id, t1, text, removed): one row for all its words and one for each paragraph."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, group in ta.groups(b.column(2).to_pylist()):
                found = paragraphs(group, 0, 1)
                if not found:
                    continue
                begin = np.concatenate([[0], group.ends[:-1]])
                docs_, heads = np.unique(found["doc"], return_index=True)
                tails = np.append(heads[1:], len(found["doc"])) - 1
                take = found["words"] >= least_words
                doc = np.concatenate([docs_, found["doc"][take]])
                one = lambda whole, name: np.concatenate([whole, found[name][take]])  # noqa: B023, E731
                words = one(found["first"][tails] + found["words"][tails], "words")
                start, stop = one(found["start"][heads], "start") - begin[doc], one(found["stop"][tails], "stop") - begin[doc]
                unit, first = one(np.full(len(docs_), -1), "unit"), one(np.zeros(len(docs_), int), "first")
                rows = pa.array(at + doc)
                places = [pa.array(x.astype(np.int32)) for x in (unit, first, words, start, stop)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *places, b.column(3).take(rows)], [*_PLACES, "removed"])

    return docs.select("doc_id", "t1", "text", "removed").mapInArrow(cut, ", ".join([*_TYPES, "removed boolean"]))


def _copied(docs: DataFrame, heavy: DataFrame, found: DataFrame, least_words: int, store: Scratch) -> DataFrame:
    """The rows of all members of the heavy groups: their whole text is repeated, and removed but for the first one's.

    Paragraphs that the first one shares with other documents bear their label, others one of their own.
    """
    members = docs.join(F.broadcast(heavy), ["t1", "t2"]).withColumn("removed", F.col("doc_id") > F.col("keep"))
    rows = store.save(_outlines(members, least_words))
    firsts = heavy.select(F.col("t1").alias("t"), F.col("keep").alias("d"))
    known = found.join(F.broadcast(firsts), (F.col("doc_id") == F.col("d")) & (F.col("t1") == F.col("t"))).select(F.col("t1").alias("t"), F.col("unit").alias("u"), F.col("label").alias("known")).distinct()
    known = store.save(known)
    named = rows.join(known, (F.col("t1") == F.col("t")) & (F.col("unit") == F.col("u")), "left")
    return named.select("doc_id", "t1", "first", "words", "start", "stop", F.coalesce("known", F.xxhash64("t1", "unit")).alias("label"), "removed", (F.col("unit") >= 0).alias("whole"))


def _all_passages(docs: DataFrame, least: float, bands: int, least_words: int, least_passage: int, gap: int, heaviest: int) -> DataFrame:
    store = Scratch(docs.sparkSession, "passages")
    every = docs.where(F.col("doc_id").isNotNull())
    ids = store.save(every.select("doc_id", "t1", "t2"))
    heavy = store.save(_heavy(ids, heaviest))
    repeats = not ids.groupBy("doc_id", "t1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    store.drop(ids)
    # of a heavy group the first document goes through the search, for all of them
    own = every.join(F.broadcast(heavy), ["t1", "t2"], "left").where(F.col("keep").isNull() | (F.col("doc_id") == F.col("keep"))).select("doc_id", "t1", "text", F.col("keep").isNotNull().alias("many"))
    columns = ["doc_id", "t1", "first", "words", "start", "stop", "label", "removed", "whole"]
    found = store.save(_found(own, least, bands, least_words, repeats, store))
    copied = store.save(_copied(every, heavy, found, least_words, store).select(*columns))
    windows = store.save(_copies(own, least_passage + 1, store).select(*columns))
    store.close(found, copied, windows)
    rows = found.select(*columns).union(copied).union(windows)
    return rows.repartition("doc_id", "t1").sortWithinPartitions("doc_id", "t1").mapInArrow(_by_document(least_passage, gap), _PASSAGES)


def repeated_passages(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, least_words: int = LEAST_WORDS, least_passage: int = LEAST_PASSAGE, gap: int = GAP, heaviest: int = HEAVIEST_COPIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage: ``doc_id, start, stop, n_words, n_paragraphs, cluster_id, removed``.

    Positions are code points of the original text, the end exclusive.
    """
    found = _all_passages(keyed(docs, id_col, text_col), least, bands, least_words, least_passage, gap, heaviest)
    return found.select("doc_id", "start", "stop", "n_words", "n_paragraphs", "cluster_id", "removed")


def remove_passages(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, least_words: int = LEAST_WORDS, least_passage: int = LEAST_PASSAGE, gap: int = GAP, heaviest: int = HEAVIEST_COPIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with removed passages cut out of their texts; columns stay, whatever their names."""
    name = "__cuts"
    while any(c.startswith(name) for c in docs.columns):
        name = f"_{name}"
    found = _all_passages(keyed(docs, id_col, text_col), least, bands, least_words, least_passage, gap, heaviest).where("removed")
    cuts = found.groupBy(F.col("doc_id").alias(f"{name}_id"), F.col("t1").alias(f"{name}_t1")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(name))
    text = F.col(text_col)
    kept = F.aggregate(
        name,
        F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out")),
        lambda s, x: F.struct(x["stop"].alias("pos"), F.concat(s["out"], F.substring(text, (s["pos"] + 1).cast("int"), (x["start"] - s["pos"]).cast("int"))).alias("out")),
        lambda s: F.concat(s["out"], F.substring(text, (s["pos"] + 1).cast("int"), F.length(text))),
    )
    same = (docs[id_col].cast("long") == cuts[f"{name}_id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == cuts[f"{name}_t1"])
    joined = docs.join(cuts, same, "left")
    return joined.withColumn(text_col, F.when(F.col(name).isNull(), text).otherwise(kept)).select(*docs.columns)
