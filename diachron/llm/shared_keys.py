"""Keys that two marks or more hold, found on arrays of keys: only blocks of them pass the JVM.

1. local: up to ``HELD`` keys of a task are sorted at once; of each key its least mark stays, and its
   greatest where that differs, so a hot key costs two entries a block, whatever its rows;
2. dealt: the keys are cut into ranges of a mixed order, one for each shuffle partition, and each range
   of a block travels as two binary values, 16 bytes an entry;
3. global: each partition sorts its entries and keeps the keys whose marks differ.

The same keys come out as from ``GROUP BY key HAVING min(mark) < max(mark)``. Memory of a task is one
block, then one range, so the number of shuffle partitions bounds it. Null keys and marks are not
allowed; an empty list of keys and an empty table hold none.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys that are sorted at once before the shuffle.
HELD = 1 << 20
#: Rows of one output batch.
SLICE = 1 << 17
_MIXED = np.uint64(0x9E3779B97F4A7C15)


def _heads(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _pairs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their marks, one of each for every key of a list."""
    mark, keys = b.column(0).to_numpy(), b.column(1)
    if pa.types.is_list(keys.type):
        mark, keys = np.repeat(mark, np.diff(keys.offsets.to_numpy())), keys.flatten()
    return keys.to_numpy().view(np.uint64), mark


def _block(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """One row for each range that has keys: ``part, keys, marks``."""
    key, mark = (np.concatenate(x) for x in zip(*held, strict=True))
    place = key * _MIXED  # an order in which keys of any kind, minima too, are spread evenly
    order = np.argsort(place)
    key, mark, place = key[order], mark[order], place[order]
    at = _heads(key)
    low, high = np.minimum.reduceat(mark, at), np.maximum.reduceat(mark, at)
    several = low != high
    n = 1 + several
    marks = np.repeat(low, n)
    marks[np.cumsum(n)[several] - 1] = high[several]
    part = np.repeat(((place[at] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), n)
    first = _heads(part)
    offsets = pa.py_buffer((np.append(first, len(part)) * 8).astype(np.int32))
    blob = lambda x: pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))])
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), blob(np.repeat(key[at], n)), blob(marks)], ["part", "keys", "marks"])


def shared_keys(rows: DataFrame, name: str = "key") -> DataFrame:
    """The keys (as column ``name``) that rows of different marks hold; ``rows``: mark long, and one long or a list of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(_pairs(b))
            size += len(held[-1][0])
            if size >= HELD:
                yield _block(held, parts)
                held, size = [], 0
        if size:
            yield _block(held, parts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [[np.frombuffer(x.as_buffer(), np.int64) for x in b.column(c)] for b in batches for c in (1, 2)]
        if not blobs:
            return
        key, mark = (np.concatenate([x for some in blobs[c::2] for x in some]) for c in (0, 1))
        order = np.argsort(key)
        key, mark = key[order], mark[order]
        at = _heads(key)
        found = key[at][np.minimum.reduceat(mark, at) < np.maximum.reduceat(mark, at)]
        for i in range(0, len(found), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(found[i : i + SLICE])], [name])

    return rows.mapInArrow(deal, "part int, keys binary, marks binary").repartitionById(parts, "part").mapInArrow(find, f"{name} long")
