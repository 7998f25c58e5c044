"""Media columns in Ogg: payloads stored as 8-bit samples, read back through the container.

A payload becomes two logical streams in one Ogg file: ``PCM8`` packets of samples and one
``META`` packet with the unpadded length. Reading verifies every page checksum, follows page
sequence numbers per serial, reassembles packets from lacing values (packets may span pages),
demultiplexes the streams and derives timestamps from granule positions: a page's granule is the end
of the last packet that ends on it, and the packets before it on the page end earlier by the durations of
those between; granules must rise, packets must follow without gaps, and the last granule must be the
number of samples.

The page checksum is the non-reflected CRC-32 of polynomial 0x04C11DB7 with zero start. It equals
the bit-reversed ``zlib`` CRC over bit-reversed bytes, so it runs at library speed.

Defined results: null text counts as empty and gives 64 zero samples; equal texts give equal
bytes (serial numbers come from the content); an empty table gives an empty result; rows are
independent, so repeats and ties need no rule; only the named columns are read, so others cannot
clash. A null, empty or damaged medium gives null payload, length and feature, and says why in
``error``; the rows beside it are read. Batches are cut by bytes, so memory is bounded by ``SLICE``
and the longest text.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the container and of the two codecs used in it.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
PCM, META = b"PCM8", b"META"
RATE = 8000
PACKET = 4096
UNIT = 64
#: Bytes of one output batch, but for a single longer row.
SLICE = 8 << 20

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _reverse32(x: int) -> int:
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def page_crc(data: bytes) -> int:
    return _reverse32(zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF)


def _page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return b"".join((head[:22], crc.to_bytes(4, "little"), head[26:], body))


def _pages(serial: int, first: bytes, packets: list[bytes], ends: list[int]) -> list[bytes]:
    """All pages of one logical stream; ``ends``: the granule position at the end of each packet."""
    out = [_page(serial, 0, 0, FIRST, bytes([len(first)]), first)]
    lacing = bytearray()
    finishes: list[tuple[int, int]] = []  # (index of a packet's last lacing value, granule)
    for p, end in zip(packets, ends, strict=True):
        lacing += b"\xff" * (len(p) // 255)
        lacing.append(len(p) % 255)
        finishes.append((len(lacing) - 1, end))
    body, pos, f = b"".join(packets), 0, 0
    for at in range(0, len(lacing), 255):
        part = bytes(lacing[at : at + 255])
        granule = -1
        while f < len(finishes) and finishes[f][0] < at + len(part):
            granule = finishes[f][1]
            f += 1
        flags = (CONTINUED if at and lacing[at - 1] == 255 else 0) | (LAST if at + 255 >= len(lacing) else 0)
        size = sum(part)
        out.append(_page(serial, len(out), granule, flags, part, body[pos : pos + size]))
        pos += size
    return out


def padded(raw: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return raw + b"\0" * ((-len(raw)) % UNIT or (UNIT if not raw else 0))


def write_ogg(payload: bytes, n_bytes: int) -> bytes:
    """One Ogg file with the payload as samples and its unpadded length as metadata."""
    serial = zlib.crc32(payload, n_bytes & 0xFFFFFFFF)
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET)]
    sound = _pages(serial, PCM + struct.pack("<BBIQ", 1, 1, RATE, len(payload)), packets, ends)
    meta = _pages(serial ^ 0xFFFFFFFF, META + b"\x01", [struct.pack("<Q", n_bytes)], [len(payload)])
    # first pages of all streams come first, then the streams interleave
    return b"".join([sound[0], meta[0], sound[1], *meta[1:], *sound[2:]])


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """``serial, number, granule, flags, lacing, body`` of each page, checksums verified."""
    pos = 0
    while pos < len(data):
        if len(data) < pos + HEADER.size:
            raise ValueError("truncated page header")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, pos)
        if capture != CAPTURE or version:
            raise ValueError("not an Ogg page")
        start = pos + HEADER.size + n
        lacing = data[pos + HEADER.size : start]
        end = start + sum(lacing)
        if len(lacing) < n or len(data) < end:
            raise ValueError("truncated page")
        page = data[pos:end]
        if page_crc(b"".join((page[:22], b"\0\0\0\0", page[26:]))) != crc:
            raise ValueError("page checksum differs")
        yield serial, number, granule, flags, lacing, data[start:end]
        pos = end


def read_streams(data: bytes) -> dict[int, dict]:
    """Per serial: ``head`` (its first packet), ``packets`` and ``ends``.

    ``ends`` has the granule position at the end of each packet, or None where its page names only
    a later packet's.
    """
    streams: dict[int, dict] = {}
    for serial, number, granule, flags, lacing, body in read_pages(data):
        s = streams.get(serial)
        if s is None:
            if not flags & FIRST:
                raise ValueError("a stream lacks its first page")
            s = streams[serial] = {"next": 0, "open": None, "all": [], "ends": [], "last": 0, "ended": False}
        if number != s["next"] or s["ended"]:
            raise ValueError("pages are missing or out of order")
        if bool(flags & CONTINUED) != (s["open"] is not None):
            raise ValueError("a packet is not continued as its page says")
        s["next"] += 1
        pos = size = 0
        for x in lacing:
            size += x
            if x < 255:
                s["all"].append((s["open"] or b"") + body[pos : pos + size])
                s["open"], pos, size = None, pos + size, 0
        if size:
            s["open"] = (s["open"] or b"") + body[pos:]
        finished = len(s["all"]) - len(s["ends"])
        if (granule >= 0) != (finished > 0):
            raise ValueError("a granule position without a packet's end, or the reverse")
        if finished:
            if granule < s["last"]:
                raise ValueError("granule positions fall")
            s["ends"] += [None] * (finished - 1) + [granule]
            s["last"] = granule
        s["ended"] = bool(flags & LAST)
    for s in streams.values():
        if s["open"] is not None or not s["ended"]:
            raise ValueError("a stream ends early")
    return {k: {"head": s["all"][0], "packets": s["all"][1:], "ends": s["ends"][1:]} for k, s in streams.items()}


def packet_times(ends: list[int | None], durations: list[int], rate: int) -> list[tuple[float, float]]:
    """Start and end of each packet in seconds: back from its page's granule position by the durations of the packets after it."""
    out: list[tuple[float, float]] = []
    later = 0
    for end, duration in zip(reversed(ends), reversed(durations), strict=True):
        if end is not None:
            position, later = end, 0
        out.append(((position - later - duration) / rate, (position - later) / rate))
        later += duration
    return out[::-1]


def read_ogg(data: bytes) -> tuple[bytes, int, list[tuple[float, float]]]:
    """``payload, unpadded length, times of the packets`` of a file that :func:`write_ogg` made."""
    streams = read_streams(data)
    sound = next((s for s in streams.values() if s["head"].startswith(PCM)), None)
    meta = next((s for s in streams.values() if s["head"].startswith(META)), None)
    if sound is None or meta is None or len(sound["head"]) < 18 or len(meta["packets"]) != 1 or len(meta["packets"][0]) != 8:
        raise ValueError("a logical stream is missing")
    _, _, rate, total = struct.unpack("<BBIQ", sound["head"][4:18])
    payload, times = b"".join(sound["packets"]), packet_times(sound["ends"], [len(p) for p in sound["packets"]], rate or 1)
    if not rate or len(payload) != total or not times or sound["ends"][-1] != total or any(x[1] != y[0] for x, y in zip([(0.0, 0.0), *times], times, strict=False)):
        raise ValueError("granule positions and samples differ")
    return payload, struct.unpack("<Q", meta["packets"][0])[0], times


def features(payload: bytes, times: list[tuple[float, float]]) -> str:
    """Duration, packets, start of the last packet, level, peak, zero crossings and entropy of the samples."""
    u = np.frombuffer(payload, np.uint8)
    counts = np.bincount(u, minlength=256)
    levels = np.arange(256) - 128.0
    p = counts[counts > 0] / len(u)
    mean, power = float(counts @ levels) / len(u), float(counts @ levels**2) / len(u)
    up = u >= 128
    crossings = int(np.count_nonzero(up[1:] != up[:-1]))
    peak = int(np.abs(levels[counts > 0]).max())
    return f"seconds={times[-1][1]:.6f};packets={len(times)};last={times[-1][0]:.6f};mean={mean:.4f};rms={power**0.5:.4f};peak={peak};crossings={crossings};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE`` bytes of one column."""
    for b in batches:
        size = np.cumsum(np.array([0 if n is None else n for n in pc.binary_length(b.column(column)).to_pylist()], np.int64) + 64)
        cuts = np.flatnonzero(np.diff(size // SLICE)) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if y > x:
                yield b.slice(x, y - x)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text as UTF-8, padded and stored in Ogg."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, 1):
            raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            media = [write_ogg(padded(x), len(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(store, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def _read(data: bytes | None) -> tuple[int | None, bytes | None, str | None, str | None]:
    """``n_bytes, payload, feature, error`` of one medium."""
    try:
        if not data:
            raise ValueError("no medium" if data is None else "empty medium")
        payload, n, times = read_ogg(data)
        return n, payload, features(payload, times), None
    except (ValueError, struct.error) as e:
        return None, None, None, str(e)


def from_media(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media, payload, feature, error``: read back from ``media`` alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, 1):
            n, payload, feature, error = zip(*map(_read, b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(1), pa.array(payload, pa.binary()), pa.array(feature, pa.string()), pa.array(error, pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature", "error"])

    return media.select("doc_id", "media").mapInArrow(read, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, payload binary, feature string, error string")
