"""SentencePiece encoding with offsets, and decoding.

Normalisation walks the model's compiled character map (a double-array trie of source strings
followed by their replacements) with the longest matching prefix at every step and records, for
each byte of the normalised text, the source byte it came from. Each piece covers a range of
normalised bytes, so its span in the original bytes is a lookup in that record.

Ids and decoded text equal the library's for every text; see PieceCodec for how pieces merge. The
default model has an empty character map and keeps repeated spaces, so the prefix at every place is one
character and the record is a repeat; models with a map or with squeezing take the walk.

Defined results: null text counts as empty (no pieces); rows are independent, so repeats and ties
need no rule; very long texts are encoded whole; an empty table gives an empty result; only the two
named columns are read, so others cannot clash. Memory is bounded by one Arrow batch.
"""

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MARK_BYTES = MARK.encode()


class CharacterMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.starts = frozenset(b for b in range(1, 256) if self._child(self._base(0), b) is not None)

    def _base(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _child(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, raw: bytes, pos: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that ``raw`` has at ``pos``."""
        base, found = self._base(0), None
        for i in range(pos, len(raw)):
            at = self._child(base, raw[i])
            if at is None:
                break
            base = self._base(at)
            if self.units[at] >> 8 & 1:
                found = i + 1 - pos, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normalizer:
    """Normalised bytes and, for each of them and their end, the source byte."""

    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze: bool, escape: bool = True, suffix: bool = False):
        self.map = CharacterMap(blob) if blob else None
        self.dummy, self.squeeze, self.space, self.suffix = dummy_prefix, squeeze, MARK_BYTES if escape else b" ", suffix

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        if self.map is None and not self.squeeze and not self.suffix:
            return self._plain(raw)
        return self._walk(raw)

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map and without squeezing only spaces change, so the record is one repeat."""
        if not raw:
            return b"", np.zeros(1, np.int32)
        out = raw.replace(b" ", self.space)
        counts = np.ones(len(raw) + 1, np.int32)
        counts[:-1][np.frombuffer(raw, np.uint8) == 32] = len(self.space)
        if self.dummy:
            counts[0] += len(self.space)
            out = self.space + out
        return out, np.repeat(np.arange(len(raw) + 1, dtype=np.int32), counts)

    def _prefix(self, raw: bytes, pos: int) -> tuple[bytes, int]:
        """Replacement and source length at ``pos``."""
        if self.map is not None and raw[pos] in self.map.starts and (hit := self.map.longest(raw, pos)):
            return hit[1], hit[0]
        lead = raw[pos]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return raw[pos : pos + n], n

    def _walk(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        pos, end = 0, len(raw)
        while self.squeeze and pos < end:
            piece, n = self._prefix(raw, pos)
            if piece != b" ":
                break
            pos += n
        if pos >= end:
            return b"", np.array([pos], np.int32)
        out, origin = bytearray(), array("i")
        if self.dummy and not self.suffix:
            out += self.space
            origin.extend([pos] * len(self.space))
        after_space = self.squeeze
        while pos < end:
            piece, n = self._prefix(raw, pos)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                text = piece.replace(b" ", self.space)
                out += text
                origin.extend([pos] * len(text))
                after_space = piece.endswith(b" ")
            pos += n
            if not self.squeeze:
                after_space = False
        while self.squeeze and out.endswith(self.space):
            del out[-len(self.space) :]
            pos = origin[len(out)]
            del origin[len(out) :]
        if self.dummy and self.suffix:
            out += self.space
            origin.extend([pos] * len(self.space))
        origin.append(pos)
        return bytes(out), np.array(origin, np.int32)


class PieceCodec:
    """Encodes with original byte spans, and decodes.

    Merging takes the adjacent pair of best score, leftmost first. Where scores are distinct this
    is rank-ordered merging over bytes with the characters' own bytes joined first, which a byte
    pair library does much faster; pieces of equal score (runs of word marks) and models of
    another kind are left to the sentencepiece library.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, model.trainer_spec.treat_whitespace_as_suffix)
        kind = proto.ModelProto.SentencePiece
        self.unknown = self.library.unk_id()
        self.lengths = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in model.pieces], np.uint32)
        self.decimals = [str(i) for i in range(len(model.pieces))]
        normal = [(p.piece, p.score, i) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL]
        scored = [s for p, s, _ in normal if len(p) > 1 and p.strip(MARK)]
        usable = model.trainer_spec.model_type == proto.TrainerSpec.BPE and model.trainer_spec.byte_fallback
        usable &= len(set(scored)) == len(scored) and not any(MARK in p.lstrip(MARK) for p, _, _ in normal)
        usable &= not any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces)
        self.engine = self._engine(normal, {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}) if usable else None
        # the library's merges on text that is normalised already
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def _engine(self, normal: list[tuple[str, float, int]], byte_ids: dict[str, int]):
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        ids: list[list[int]] = [[byte_ids[f"<0x{b:02X}>"]] for b in range(256)]

        def put(raw: bytes, own: list[int]) -> None:
            if raw in ranks:
                ids[ranks[raw]] = own
            else:
                ranks[raw] = len(ids)
                ids.append(own)

        for piece, _, i in sorted((x for x in normal if len(x[0]) == 1), key=lambda x: len(x[0].encode())):
            raw = piece.encode()
            for k in range(2, len(raw)):  # bytes that begin a character; alone they fall back to single bytes
                if raw[:k] not in ranks:
                    put(raw[:k], [byte_ids[f"<0x{b:02X}>"] for b in raw[:k]])
            put(raw, [i])
        for piece, _, i in sorted((x for x in normal if len(x[0]) > 1), key=lambda x: -x[1]):
            put(piece.encode(), [i])
        self.single = np.array([x[0] if len(x) == 1 else -1 for x in ids], np.int64)
        self.several = ids
        return tiktoken.Encoding("pieces", pat_str=f"{MARK}?[^{MARK}]+|{MARK}", mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and normalised byte lengths of the pieces."""
        if self.engine is not None and MARK * 2 not in text:
            ranks = self.engine.encode_to_numpy(text)
            ids = self.single[ranks]
            if len(ids) and ids.min() < 0:
                ids = np.array([i for r in ranks.tolist() for i in self.several[r]], np.int64)
            return ids, self.lengths[ids]
        ids = np.array(self.merger.encode(text), np.int64)
        if self.unknown in ids:
            return ids, np.array([len(p.surface.encode()) for p in self.merger.encode(text, out_type="immutable_proto").pieces], np.uint32)
        return ids, self.lengths[ids]

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and original byte offsets: piece k spans ``o[k]..o[k+1]``."""
        normalised, origin = self.normalizer(text.encode())
        ids, lengths = self._ids(normalised.decode())
        if not len(ids):
            return [], origin[:0]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        return ids.tolist(), origin[ends]

    def joined(self, ids: list[int]) -> str:
        return ",".join([self.decimals[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str | None) -> PieceCodec:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _input(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), docs.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, offsets, decoded``: piece k spans the original bytes ``offsets[k]..offsets[k+1]``."""
    rows, kind = _input(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            out = [c.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([c.decode(x[0]) for x in out], pa.string())], ["doc_id", "ids", "offsets", "decoded"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32``: digests of what :func:`encode` gives.

    The digests are taken where the pieces are made, so no token list crosses to the JVM.
    """
    rows, kind = _input(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            n, ids, decoded, spans = [], [], [], []
            for t in b.column(1):
                i, o = c.encode(t.as_py() or "")
                n.append(len(i))
                ids.append(hashlib.sha256(c.joined(i).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(i).encode()).hexdigest())
                spans.append(zlib.crc32(o.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(spans, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
