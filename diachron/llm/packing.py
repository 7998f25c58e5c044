"""Order-preserving packing of tokenised documents into windows of at most ``width`` tokens.

Documents are taken in stream order. A dynamic programme chooses window cuts among document
ends (free), sentence ends (a small penalty) and, where those are more than ``STRIDE`` tokens
apart, truncating cuts between them (a larger penalty). A window costs its padding plus the
penalty of the cut that ends it:

    best[j] = min over i with p[j] - p[i] <= width of (best[i] + p[i])  +  width - p[j] + penalty[j]

The minimum slides over positions, so a monotone queue makes every transition O(1) amortised.
The stream of one input partition is packed block by block; what follows the last chosen cut
carries over into the next block, so only the last window of a partition may be short. Nothing is
shuffled, memory is one block, and a lost task packs its partition again to the same rows.

Tokens come from the given vocabulary file and equal the tokenizer library's; see WordEncoder.

Defined results: a null text counts as empty and yields the end token alone; an empty text too;
a null ``doc_id`` stays null in its pieces; very long texts are cut into as many windows as they need,
block by block; repeated rows are packed each, and repeated ids keep the order of the stream; of cuts
of equal cost the earliest start of a window is taken; an empty table gives an empty result; other
columns are not read, so they cannot clash.
"""

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 2048
BLOCK = 1 << 18
SENTENCE_CUT, FORCED_CUT = 8, 32
STRIDE = 32
END = np.array([1], "<u4").tobytes()


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes, equal to the tokenizer's own for every text.

    Texts of ASCII and Latin-1 letters without contractions are cut into words by array
    operations over their bytes; words are known by 128-bit fingerprints, and each distinct word
    is merged once (its end is marked by a byte that such texts lack, so that pairs with the
    mark merge first, as word-final symbols do). Every other text goes to the tokenizer itself.
    """

    CHUNK_BYTES = 1 << 20
    TABLE = 400_000
    MARK = "\x01"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in visible]
        byte_of = {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(rest)}}
        ranks = {}
        for piece, i in vocab.items():
            if i < self.tokenizer.get_vocab_size(with_added_tokens=False) and all(c in byte_of for c in piece.removesuffix("</w>")):
                ranks[bytes(byte_of[c] for c in piece.removesuffix("</w>")) + (self.MARK.encode() if piece.endswith("</w>") else b"")] = i
        for unreachable in self._unreachable(ranks):
            del ranks[unreachable]
        self.merger = tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        size = self.tokenizer.get_vocab_size()
        self.ends_word, self.ends_sentence = np.zeros(size, bool), np.zeros(size, bool)
        for piece, i in vocab.items():
            self.ends_word[i] = piece.endswith("</w>")
            self.ends_sentence[i] = piece.endswith("</w>") and piece[:-4][-1:] in (".", "!", "?")
        # byte classes: 0 space, 1 letter, 2 digit, 3 other; 9: leave the text to the tokenizer
        self.kind = np.full(256, 9, np.uint8)
        self.kind[list(b" \n\r\t")] = 0
        self.kind[33:127] = 3
        self.kind[[*range(65, 91), *range(97, 123), 0xC3]] = 1
        self.kind[48:58] = 2
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.powers = []
        for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            up = np.full(self.CHUNK_BYTES + 1, base, np.uint64)
            down = np.full(self.CHUNK_BYTES + 1, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers.append((np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)))
        self._clear()

    @staticmethod
    def _unreachable(ranks: dict[bytes, int]) -> list[bytes]:
        """Pieces that merging their own bytes by rank does not give: no text contains them."""
        out = []
        for piece, rank in ranks.items():
            if len(piece) < 2:
                continue
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                best, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
                if best > rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) > 1:
                out.append(piece)
        return out

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.second = np.zeros(0, np.uint64)
        self.tokens, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        raws: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            raw = text.encode()
            if len(raw) + 1 >= self.CHUNK_BYTES:
                out[i] = self._plain(text)
                continue
            if size + len(raw) + 1 > self.CHUNK_BYTES:
                self._group(group, raws, texts, out)
                group, raws, size = [], [], 0
            group.append(i)
            raws.append(raw)
            size += len(raw) + 1
        if group:
            self._group(group, raws, texts, out)
        return out

    def _group(self, group: list[int], raws: list[bytes], texts: list[str], out: list[bytes]) -> None:
        buffer = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        doc_ends = np.cumsum([len(r) + 1 for r in raws])
        kind = self.kind[buffer]
        low = self.lower[buffer]
        lead = np.flatnonzero(buffer == 0xC3)  # always followed by one more byte, 0x80 to 0xBF
        if len(lead):
            tail = buffer[lead + 1]
            kind[lead + 1] = np.where((tail == 0x97) | (tail == 0xB7), 9, 1)
            low[lead + 1] = np.where(tail < 0x9F, tail | 0x20, tail)
            # sharp s and y with diaeresis stay as they are; 0x9E is the last capital
        odd = np.flatnonzero(kind == 9)
        quote = np.flatnonzero(buffer[:-1] == 39)
        quote = quote[np.isin(low[quote + 1], np.frombuffer(b"stmrvld", np.uint8))]
        angle = np.flatnonzero((buffer[:-1] == 60) & (buffer[1:] == 124))
        slow = np.unique(np.searchsorted(doc_ends, np.concatenate([odd, quote, angle]), side="right"))
        for d in slow.tolist():
            out[group[d]] = self._plain(texts[group[d]])
            kind[(doc_ends[d - 1] if d else 0) : doc_ends[d]] = 0
        before = np.concatenate([[0], kind[:-1]])
        after = np.concatenate([kind[1:], [0]])
        begins = np.flatnonzero((kind != 0) & ((kind != before) | (kind == 2)))
        stops = np.flatnonzero((kind != 0) & ((kind != after) | (kind == 2))) + 1
        values = low.astype(np.uint64) + np.uint64(1)
        prints = []
        for up, down in self.powers:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
            prints.append((total[stops] - total[begins]) * down[begins])
        first, second = prints[0] ^ (prints[0] >> np.uint64(29)), prints[1]
        distinct, sample, which = np.unique(first, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.TABLE:
            self._clear()
        index = np.fromiter((self.known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(index < 0)
        if len(new):
            image = low.tobytes()
            at, to = begins[sample[new]].tolist(), stops[sample[new]].tolist()
            words = [image[x:y].decode() for x, y in zip(at, to, strict=True)]
            ids = self.merger.encode_to_numpy(self.MARK.join(words) + self.MARK)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            assert len(ends) == len(new)
            index[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(distinct[new].tolist(), index[new].tolist(), strict=True))
            self.starts = np.concatenate([self.starts, len(self.tokens) + ends])
            self.tokens = np.concatenate([self.tokens, ids.astype("<u4")])
            self.second = np.concatenate([self.second, second[sample[new]]])
        word = index[which]
        if not np.array_equal(self.second[word], second):  # two words share 64 bits: not expected in any lifetime
            for d in group:
                out[d] = self._plain(texts[d])
            return
        counts = self.starts[word + 1] - self.starts[word]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = self.tokens[np.repeat(self.starts[word] - ends[:-1], counts) + np.arange(ends[-1])]
        doc_words = np.searchsorted(begins, doc_ends)
        cuts = ends[doc_words].tolist()
        skip = set(slow.tolist())
        start = 0
        for d, stop in enumerate(cuts):
            if d not in skip:
                out[group[d]] = flat[start:stop].tobytes()
            start = stop


def choose_cuts(positions, penalties, width: int = WIDTH) -> list[int]:
    """Indices of the chosen cuts, from the first position to the last; both are always cut.

    ``positions`` rise strictly from 0 with steps of at most ``width``.
    """
    n = len(positions)
    best, back = [0.0] * n, [0] * n
    queue = deque([0])  # indices whose best + position rises
    key = [0.0] * n
    key[0] = best[0] + positions[0]
    for j in range(1, n):
        p = positions[j]
        low = p - width
        while positions[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        b = key[i] + width - p + penalties[j]
        best[j], back[j] = b, i
        k = key[j] = b + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def candidates(lengths: list[int], sentence_ends: list[np.ndarray], width: int, sentence: float, forced: float) -> tuple[list[int], list[float]]:
    """Cut positions of a block of documents and their penalties."""
    ends = np.cumsum(np.asarray(lengths, np.int64))
    inner = [e + (end - n) for e, end, n in zip(sentence_ends, ends, lengths, strict=True)]
    points = np.unique(np.concatenate([[0], ends, *inner]).astype(np.int64))
    penalty = np.where(np.isin(points, ends), 0.0, sentence)
    stride = min(STRIDE, width)
    gaps = np.diff(points)
    long = np.flatnonzero(gaps > stride)
    n = (gaps[long] - 1) // stride
    inside = np.repeat(points[long], n) + stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    if len(inside):
        points, penalty = np.concatenate([points, inside]), np.concatenate([penalty, np.full(len(inside), forced)])
        order = np.argsort(points, kind="stable")
        points, penalty = points[order], penalty[order]
    return points.tolist(), penalty.tolist()


class Packer:
    """Packs a stream of documents; yields ``doc_id, start, ids, doc_tokens, sequence, offset``."""

    def __init__(self, encoder: WordEncoder, base: int, width: int, block: int, sentence: float, forced: float):
        self.encoder, self.next, self.width, self.block, self.sentence, self.forced = encoder, base, width, block, sentence, forced
        self.docs: list[tuple] = []  # doc_id, tokens before, bytes left, all tokens, sentence ends in what is left
        self.held = 0

    def add(self, doc_id, encoded: bytes) -> Iterator[tuple]:
        raw = encoded + END
        ids = np.frombuffer(raw, "<u4")
        stops = np.flatnonzero(self.encoder.ends_sentence[np.minimum(ids[:-1], len(self.encoder.ends_sentence) - 1)]) + 1
        self.docs.append((doc_id, 0, raw, len(ids), stops))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        lengths = [len(d[2]) // 4 for d in self.docs]
        points, penalties = candidates(lengths, [d[4] for d in self.docs], self.width, self.sentence, self.forced)
        cuts = [points[i] for i in choose_cuts(points, penalties, self.width)]
        if not last:
            cuts.pop()  # what follows the last cut before the block's end goes on in the next block
        k = done = 0  # current document, tokens of it already out
        at = 0
        for stop in cuts[1:]:
            offset = 0
            while at < stop:
                doc_id, before, raw, total, _ = self.docs[k]
                n = min(stop - at, lengths[k] - done)
                yield doc_id, before + done, raw[done * 4 : (done + n) * 4], total, self.next, offset
                offset, at, done = offset + n, at + n, done + n
                if done == lengths[k]:
                    k, done = k + 1, 0
            self.next += 1
        rest = self.docs[k:]
        if rest and done:
            doc_id, before, raw, total, stops = rest[0]
            rest[0] = (doc_id, before + done, raw[done * 4 :], total, stops[stops > done] - done)
        self.docs, self.held = rest, sum(len(d[2]) // 4 for d in rest)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, tokenizer: str | None = None, width: int = WIDTH, block: int = BLOCK, sentence_cut: float = SENTENCE_CUT, forced_cut: float = FORCED_CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's tokens as little-endian unsigned 32-bit numbers. ``tokenizer`` is the
    path of the vocabulary on the executors; the default is the installed public file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(_encoder(tokenizer), (context.partitionId() if context else 0) << 33, width, block, sentence_cut, forced_cut)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c[0], kind), pa.array(c[1], pa.int64()), pa.array([len(x) // 4 for x in c[2]], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        kind = None
        rows: list[tuple] = []
        for b in batches:
            kind = b.schema.field(0).type
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                encoded = packer.encoder.many([t or "" for t in part.column(1).to_pylist()])
                for doc_id, raw in zip(part.column(0).to_pylist(), encoded, strict=True):
                    rows.extend(packer.add(doc_id, raw))
                if len(rows) >= 2048:
                    yield made(rows)
                    rows = []
        rows.extend(packer.flush(True))
        if rows:
            yield made(rows)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
