"""Near-duplicate documents: DartMinHash signatures, banding, exact verification, components.

A document is the set of its shingles of five words (runs of letters and digits, lower case; one
shingle of all words if there are fewer). Elements may carry weights. Every element owns a random
process of darts on the plane (weight, rank), the same in all documents. A document keeps the
darts below its element's weight and below a rank limit that yields a fixed expected number of
darts whatever its size; each dart falls into one of ``k`` coordinates and the earliest of each
coordinate is kept. Two documents agree in a coordinate with probability equal to their weighted
Jaccard similarity, and the work is linear in shingles plus darts, not their product.

Documents with equal shingle sets form one class first (by a 128-bit fingerprint of the set), so
copies are never compared. Class representatives meet in ``bands`` bands of ``rows`` coordinates
(:func:`similar_components`). Every member of a bucket is compared with three leaders of the bucket:
the most central member (the one in the largest buckets over all bands) and two drawn by hash. Where
this leaves members of one bucket in several components, all members of such buckets are joined
exactly (:func:`rest_pairs`): shingles are put in one order, rare ones first, and two sets of the
wanted similarity share a shingle among the first ninth of the smaller and the first fifth of the
larger, at positions that leave room for the overlap. Only pairs across components are formed. So
the components are those of all links between members of a bucket, whatever its size, while a bucket
whose members are alike costs three pairs a member. Candidates are verified by exact Jaccard
similarity of the whole shingle sets; weights shape the signatures only.

Defined results: null text counts as empty; a text without words is a class of its own; a very long
text is signed whole, in a group of its own; the smallest ``doc_id`` names a class and its row stays;
rows that repeat an id with the same words are one class, of which one row stays, and with different
words they are compared by their own texts (two classes may then bear one name, and one row of each
stays); rows without an id get a null class and stay; an empty table gives an empty result; only the
named columns are read, so others cannot clash. Ids must be whole numbers.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..storage import Scratch
from . import textarrays as ta
from .shared_keys import shared_keys
from .skew import join_one, one_row_each

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Cells of the frequency table that orders shingles; four bytes each, whatever the size of the input.
CELLS = 1 << 18


def _salt(i: int, by: int = 0x9E3779B97F4A7C15) -> np.uint64:
    return np.uint64(i * by & 0xFFFFFFFFFFFFFFFF)


def shingles(group: ta.Group) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles of a group and their documents, in text order."""
    starts, stops = group.words()
    prints, doc = group.prints(starts, stops), group.doc_of(starts)
    n = np.bincount(doc, minlength=group.n)
    size = np.minimum(n, SHINGLE)[doc]
    first = np.cumsum(n) - n
    at = np.arange(len(prints))
    begins = at + size <= (first + n)[doc]
    total = np.zeros(len(prints), np.uint64)
    for j in range(SHINGLE):
        other = np.minimum(at + j, max(len(prints) - 1, 0))
        total += np.where(j < size, ta.mix(prints[other] + _salt(j + 1)), np.uint64(0))
    return ta.mix(total[begins]), doc[begins]


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """``n`` signatures of ``k`` 64-bit values; owners without elements get zeros.

    ``elements`` are fingerprints, each with a positive weight and its owner, sorted by owner.
    """
    signature = np.zeros((n, k), np.uint64)
    mass = np.bincount(owner, weights, n)
    pending = mass > 0
    wanted = k * (np.log(k) + 3.0)
    while pending.any():
        limit = np.where(pending, wanted / np.maximum(mass, 1e-300), 0.0)
        use = pending[owner]
        best = np.full((n, k), np.inf)
        value = np.zeros((n, k), np.uint64)
        cell, low, high = 0, 0.0, 1.0  # weight regions [0,1), [1,2), [2,4), ...
        element, weight, own = elements[use], weights[use], owner[use]
        while len(element):
            base = ta.mix(element + _salt(cell + 1))
            rank, alive, turn = np.zeros(len(element)), np.arange(len(element)), 0
            while len(alive):
                turn += 1
                dart = ta.mix(base[alive] + _salt(turn, 0xD6E8FEB86659FD93))
                rank[alive] -= np.log(_uniform(dart)) / (high - low)
                alive_now = rank[alive] <= limit[own[alive]]
                alive, dart = alive[alive_now], dart[alive_now]
                below = low + (high - low) * _uniform(ta.mix(dart ^ np.uint64(0x5851F42D4C957F2D))) < weight[alive]
                hit, thrown = alive[below], ta.mix(dart[below] + _salt(1))
                slot = own[hit] * k + (thrown % np.uint64(k)).astype(np.int64)
                order = np.lexsort((rank[hit], slot))
                slot_sorted = slot[order]
                first = order[np.concatenate([[True], slot_sorted[1:] != slot_sorted[:-1]])] if len(order) else order
                better = rank[hit[first]] < best.ravel()[slot[first]]
                chosen = first[better]
                best.ravel()[slot[chosen]] = rank[hit[chosen]]
                value.ravel()[slot[chosen]] = thrown[chosen]
            more = weight > high
            element, weight, own = element[more], weight[more], own[more]
            cell, low, high = cell + 1, high, high * 2
        done = pending & np.isfinite(best).all(1)
        signature[done] = value[done]
        pending &= ~done
        wanted *= 2  # the few documents with an empty coordinate get twice the darts
    return signature


def _signed(texts: list[str], bands: int, rows: int, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: set fingerprint (two numbers), whether it has words, and band keys."""
    prints, some, keys = [], [], []
    for _, group in ta.groups(texts):
        element, doc = shingles(group)
        order = np.lexsort((element, doc))
        element, doc = element[order], doc[order]
        new = np.concatenate([[True], (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])]) if len(element) else np.zeros(0, bool)
        counts = np.diff(np.append(np.flatnonzero(new), len(element))).astype(float)
        element, doc = element[new], doc[new]
        n = np.bincount(doc, minlength=group.n)
        ends = np.concatenate([[0], np.cumsum(n)])
        both = []
        for salt in (1, 2):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ta.mix(element + np.uint64(salt)), dtype=np.uint64)])
            both.append(ta.mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64)))
        signature = dart_signatures(element, counts if weighted else np.ones(len(element)), doc, group.n, bands * rows)
        folded = np.zeros((group.n, bands), np.uint64)
        for j in range(rows):
            folded = ta.mix(folded + signature[:, j::rows] + _salt(j + 1))
        folded = ta.mix(folded + np.arange(bands, dtype=np.uint64)[None, :] * _salt(1))
        prints.append(np.column_stack(both))
        some.append(n > 0)
        keys.append(folded.view(np.int64))
    if not prints:
        return np.zeros((0, 2), np.uint64), np.zeros(0, bool), np.zeros((0, bands), np.int64)
    return np.concatenate(prints), np.concatenate(some), np.concatenate(keys)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, t1, t2, text``: a row is known by its id and 128 bits of its text, as ids may repeat."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_prints(text), text.alias("text"))


def text_prints(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(11), text).alias("t2")]


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """``doc_id, t1, t2, node, keys`` of ``docs`` (:func:`keyed`): set fingerprint (null without words) and band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, some, keys = _signed(b.column(3).to_pylist(), bands, rows, weighted)
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ta.binary(prints, some), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel(), pa.int64()))], ["doc_id", "t1", "t2", "node", "keys"])

    return docs.mapInArrow(sign, "doc_id long, t1 long, t2 long, node binary, keys array<long>")


def _distinct_shingles(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, group in ta.groups(texts):
        element, doc = shingles(group)
        cut = np.searchsorted(doc, np.arange(group.n + 1))
        out += [np.unique(element[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
    return out


def similar_pairs(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose texts' exact Jaccard similarity is at least ``least``.

    ``texts``: node, text. Pairs are dealt by ``a`` and then ``b``; hot ends are split by the join.
    """
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ta_, tb_ = b.column(2).to_pylist(), b.column(3).to_pylist()
                distinct = list(dict.fromkeys(t or "" for t in ta_ + tb_))
                sets = dict(zip(distinct, _distinct_shingles(distinct), strict=True))
                good = []
                for x, y in zip(ta_, tb_, strict=True):
                    p, q = sets[x or ""], sets[y or ""]
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(common >= least * (len(p) + len(q) - common) - 1e-9 and common > 0)
                yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(verify, f"a {kind}, b {kind}")


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How many of the texts hold a shingle of each of ``CELLS`` cells; larger counts are saturated.

    Only the order of shingles depends on it, so shared cells cost candidates but never a pair.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for found in _distinct_shingles([t or "" for t in b.column(0).to_pylist()]):
                np.add.at(total, (found % np.uint64(CELLS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["cell", "n"])

    cells = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.select(F.col("cell").cast("int"), F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    table = np.zeros(CELLS, np.int32)
    table[found["cell"].to_numpy()] = found["n"].to_numpy()
    return table


def _prefixes(texts: DataFrame, least: float) -> DataFrame:
    """``token, node, component, size, at``: the first shingles of every set, rare ones first."""
    shared = texts.sparkSession.sparkContext.broadcast(_frequencies(texts))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                tokens, sizes, lengths = [], [], []
                for found in _distinct_shingles([t or "" for t in part.column(2).to_pylist()]):
                    order = np.lexsort((found, shared.value[(found % np.uint64(CELLS)).astype(np.int64)]))
                    keep = len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1 if len(found) else 0
                    tokens.append(found[order[:keep]].view(np.int64))
                    sizes.append(len(found))
                    lengths.append(keep)
                owner = np.repeat(np.arange(len(sizes)), lengths)
                places = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                columns = [pa.array(np.concatenate(tokens)), *(part.column(i).take(pa.array(owner)) for i in (0, 1)), pa.array(np.array(sizes, np.int32)[owner]), pa.array(places.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "node", "component", "size", "at"])

    kind = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "component", "text").mapInArrow(first, f"token long, node {kind}, component {kind}, size int, at int")


def rest_pairs(texts: DataFrame, least: float) -> DataFrame:
    """``a < b``: all pairs of nodes of different components whose sets may be similar enough.

    ``texts``: node, component, text. Sets x and y of similarity t overlap in t / (1 + t) (|x| + |y|)
    shingles; their first common shingle leaves at least as many in both, so it lies in the first ninth
    of the smaller set (at t = 0.8) and the first fifth of the larger. Every pair across components has
    an end outside the token's most common component, so that one side of the join is the exceptions
    only, and members of one component are never paired. Both sides are tables, so a token that many
    hold is split.
    """
    store = Scratch(texts.sparkSession, "rest")
    rows = store.save(_prefixes(texts, least))
    common = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("token")
    common = store.save(common.agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1"))
    mixed = store.save(rows.join(common.select("token", "most"), "token"))
    odd = mixed.where("component <> most").select("token", *[F.col(c).alias(f"o_{c}") for c in ("node", "component", "size", "at")])
    met = odd.join(mixed.select("token", "node", "component", "size", "at"), "token").where("component <> o_component")
    overlap = F.lit(least / (1 + least)) * (F.col("size") + F.col("o_size")) - 1e-6
    fits = (F.least("size", "o_size") >= F.lit(least) * F.greatest("size", "o_size") - 1e-6) & (F.col("size") - F.col("at") >= overlap) & (F.col("o_size") - F.col("o_at") >= overlap)
    found = store.save(met.where(fits).select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct())
    store.close(found)
    return found


def _buckets(nodes: DataFrame, store: Scratch) -> DataFrame:
    """``key, node`` of all buckets with two nodes or more; ``nodes`` may list a node more than once."""
    shared = store.save(shared_keys(nodes.select(F.xxhash64("node").alias("mark"), "keys")), random=True)
    rows = nodes.select("node", F.explode("keys").alias("key"))
    met = store.save(rows.select("key", "node").join(shared.hint("shuffle_hash"), "key"), random=True)
    out = store.save(met.distinct(), random=True)
    store.drop(shared, met)
    return out


def similar_components(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """``node, component`` of all nodes that have a verified link to another member of one of their buckets.

    ``nodes``: node, keys. ``texts_of`` takes a table of some nodes and returns them with their texts.
    A component is named by one of its nodes.
    """
    store = Scratch(nodes.sparkSession, "similar")
    met = _buckets(nodes, store)
    sizes = store.save(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    central = store.save(met.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("central")))
    drawn = [F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node")).getField("node") for i in (1, 2)]
    heads = met.join(central, "node").groupBy("key").agg(F.array_distinct(F.array(F.max(F.struct("central", "node")).getField("node"), *drawn)).alias("heads"))
    heads = store.save(heads)
    led = met.join(heads, "key").select("node", F.explode("heads").alias("head")).where("node <> head")
    pairs = store.save(led.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct())
    store.drop(central, heads)
    texts = store.save(texts_of(store.save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())))
    links = store.save(similar_pairs(pairs, texts, least))
    store.drop(pairs)
    parts = connected_components(links)
    placed = met.join(sizes.where("n > 2"), "key").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    placed = store.save(placed)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    unsettled = store.save(placed.join(mixed, "key", "left_semi").select("node", "component").distinct())
    store.drop(met, sizes, placed)
    if unsettled.isEmpty():
        store.close()
        return parts
    rest = store.save(similar_pairs(rest_pairs(texts.join(unsettled, "node"), least), texts, least))
    ends = unsettled.select(F.col("node").alias("a"), F.col("component").alias("ca")), unsettled.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    merged = connected_components(rest.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.select(F.col("node").alias("part"), F.col("component").alias("whole"))
    alone = merged.join(parts, merged["part"] == parts["node"], "left_anti").select(F.col("part").alias("node"), F.col("part").alias("component"))
    out = store.save(parts.union(alone).join(merged, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component")))
    store.close(out)
    return out


def _classes(docs: DataFrame, least: float, bands: int, rows: int, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """The signed rows (doc_id, t1, t2, node), and per set its class: node, n, first (the row that stays), own (whether it is of this set)."""
    store = Scratch(docs.sparkSession, "near")
    signed = store.save(signatures(docs, bands, rows, weighted), random=True)
    worded = signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    sets = store.save(worded.groupBy("node").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("keys").alias("keys")))

    def texts(ends: DataFrame) -> DataFrame:
        own = sets.select("node", "first.*").join(ends, "node", "left_semi")
        return docs.join(own.hint("shuffle_hash"), ["doc_id", "t1", "t2"]).select("node", "text").dropDuplicates(["node"])

    parts = similar_components(sets.select("node", "keys"), texts, least)
    linked = store.save(sets.select("node", "first", "n").join(parts, "node"))
    firsts = store.save(linked.groupBy("component").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("weight")))
    best = join_one(linked.select("node", "component"), firsts, "component", "weight", F.hex("node"))
    classes = store.save(sets.select("node", "first", "n").join(best.select("node", "best"), "node", "left").select("node", "n", F.coalesce("best", "first").alias("first"), F.coalesce(F.col("best") == F.col("first"), F.lit(True)).alias("own")))
    store.close(signed, classes)
    return signed.select("doc_id", "t1", "t2", "node"), classes


def near_dedup(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, set_size, kept``.

    ``set_size`` is the number of rows with the same set of shingles. Documents are in one class if a
    chain of verified links leads from one to the other; pairs are not listed.
    """
    signed, classes = _classes(keyed(docs, id_col, text_col), least, bands, rows, weighted)
    members = join_one(signed, classes, "node", "n", F.concat_ws("-", "doc_id", "t1"))
    named = F.col("doc_id").isNotNull() & F.col("node").isNotNull()
    stays = ~named | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2")))
    return members.select("doc_id", F.when(named, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(named, F.col("n")).otherwise(1).cast("long").alias("set_size"), stays.alias("kept"))


def keep_one_of_each(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row per class, and rows without words or id."""
    signed, classes = _classes(keyed(docs, id_col, text_col), least, bands, rows, weighted)
    free = F.col("doc_id").isNull() | F.col("node").isNull()
    stay = signed.where(free).select("doc_id", "t1", "t2").union(classes.where("own").select("first.*"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = [F.col(id_col).cast("long"), *text_prints(text)]
    return one_row_each(docs, stay, keys, F.col(id_col).isNull())
