"""Packing, piece encoding and media against the libraries and round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from diachron.llm import ogg_media, packing, piece_codec
from diachron.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
PARTS = ["a", "the", "onble", " ", "  ", "\n", "\t", "▁", "é", "é", "É", "日本", "🙂", "\x00", "\x01", "'s", "<s>", "<0x41>", "<|endoftext|>", "İ", "ΑΣ ", "12", "_", "-", "ﬁ", "　", "\xa0", "½", "'", "I'LL", "ß", "ẞ", "​", ".", "...", "!?", "\r\n", "×", "÷", "Ö", "ÿ", "Þ"]


def odd_texts(n, seed=5):
    rnd = random.Random(seed)
    return ["", *["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, offset int")


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    reference, mine = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = [*odd_texts(1500), "Thorn onAt, 3+1.", "x" * 3000, "ab " * 2000]
    for text, got in zip(texts, mine.many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, text


def brute_cost(positions, penalties, width):
    best = [0.0] + [float("inf")] * (len(positions) - 1)
    for j in range(1, len(positions)):
        best[j] = min(best[i] + width - (positions[j] - positions[i]) + penalties[j] for i in range(j) if positions[j] - positions[i] <= width)
    return best[-1]


def test_cuts_are_optimal():
    rnd = random.Random(2)
    for _ in range(200):
        positions = [0]
        for _ in range(rnd.randint(1, 40)):
            positions.append(positions[-1] + rnd.randint(1, 9))
        penalties = [rnd.choice([0, 0.5, 2, 7]) for _ in positions]
        cuts = packing.choose_cuts(positions, penalties, 12)
        steps = [positions[b] - positions[a] for a, b in zip(cuts, cuts[1:])]
        assert cuts[0] == 0 and cuts[-1] == len(positions) - 1 and max(steps) <= 12
        assert sum(12 - s for s in steps) + sum(penalties[c] for c in cuts[1:]) == pytest.approx(brute_cost(positions, penalties, 12))


def check_packing(rows, texts, width):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc.pop(i), key=lambda r: r.start)
        assert [x for p in pieces for x in np.frombuffer(p.ids, "<u4").tolist()] == ids
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist()
        assert {p.doc_tokens for p in pieces} == {len(ids)}
    assert not by_doc
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist()
        assert sum(p.length for p in pieces) <= width
    return sum(r.length for r in rows) / (width * len(by_seq))


def test_packing_keeps_every_token(spark):
    texts = [None, *odd_texts(60), "Onble the tion. " * 3000, "x" * 20_000, "same text here.", "same text here."]
    docs = frame(spark, texts)
    check_packing(packing.pack(docs.repartition(3)).collect(), texts, 2048)
    full = check_packing(packing.pack(docs.coalesce(1), width=64, block=500).collect(), texts, 64)
    assert full > 0.85
    assert packing.pack(frame(spark, texts[:0])).count() == 0


def test_packing_query_pads_little(spark):
    rows = QUERIES["op6_packing"](spark, "/root/testdata/sf0.001").collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(used.values()) / (2048 * len(used)) > 0.97


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [None, *odd_texts(400), "onble " * 20_000]
    got = {r.doc_id: r for r in piece_codec.encode(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        raw, ids = (text or "").encode(), library.encode(text or "")
        assert got[i].ids == ids and got[i].decoded == (library.decode(ids) if ids else "")
        spans = got[i].offsets
        if ids:
            assert spans[0] == 0 and spans[-1] == len(raw) and spans == sorted(spans) and len(spans) == len(ids) + 1
    digests = {r.doc_id: r for r in piece_codec.encode_digests(frame(spark, texts)).collect()}
    assert all(d.ids_sha256 == hashlib.sha256(",".join(map(str, got[i].ids)).encode()).hexdigest() and d.n_tokens == len(got[i].ids) for i, d in digests.items())
    assert piece_codec.encode(frame(spark, texts[:0])).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_equals_the_library(rule, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    model = proto.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    spec = model.normalizer_spec
    mine = piece_codec.Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    for text in odd_texts(800, seed=9):
        out, origin = mine(text.encode())
        assert out.decode() == library.normalize(text)
        assert len(origin) == len(out) + 1 and (np.diff(origin) >= 0).all()


@pytest.mark.parametrize("rule, squeeze", [("nmt_nfkc", True), ("nfkc_cf", False)])
def test_pieces_of_a_model_with_a_character_map(spark, tmp_path, rule, squeeze):
    """The public model with another rule's map: the whole path through the walk, against the library on the same model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model, other = proto.ModelProto(), proto.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).serialized_model_proto())
    other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = f"{tmp_path}/mapped.model"
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, *odd_texts(300, seed=12), "ﬁne ﬃx ①②  half ｗｉｄｅ"]
    got = {r.doc_id: r for r in piece_codec.encode(frame(spark, texts), model=path).collect()}
    for i, text in enumerate(texts):
        raw, ids = (text or "").encode(), library.encode(text or "")
        assert got[i].ids == ids, text
        if ids:
            spans = got[i].offsets
            assert spans == sorted(spans) and len(spans) == len(ids) + 1 and 0 <= spans[0] and spans[-1] <= len(raw)


def test_byte_spans_name_the_source():
    text = "ﬁne  ﬃx é日"
    codec = piece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))
    ids, spans = codec.encode(text)
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in zip(spans, spans[1:])) == raw


def test_page_checksum_against_bitwise():
    def bitwise(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        return crc

    for data in (b"", b"\0", b"OggS", bytes(range(256)) * 3):
        assert ogg_media.page_crc(data) == bitwise(data)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 254, 255, 256, 4095, 4096, 4097, 65_025, 65_026, 70_000, 300_000])
def test_ogg_round_trip(size):
    raw = random.Random(size).randbytes(size)
    payload = ogg_media.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) >= max(64, size)
    media = ogg_media.write_ogg(payload, size)
    back, n, times = ogg_media.read_ogg(media)
    ends = [min(i + ogg_media.PACKET, len(payload)) / ogg_media.RATE for i in range(0, len(payload), ogg_media.PACKET)]
    assert back == payload and n == size and len(times) == len(ends) and times[-1][1] == ends[-1] and times[0][0] == 0
    assert all(abs(t[1] - e) < 1e-9 for t, e in zip(times, ends)) and all(x[1] == y[0] for x, y in zip(times, times[1:]))
    streams = ogg_media.read_streams(media)
    assert len(streams) == 2


def test_damaged_media_are_refused():
    media = ogg_media.write_ogg(ogg_media.padded(b"abc" * 50_000), 150_000)
    for at in (0, 30, 500, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg_media.read_ogg(bytes(broken))
    with pytest.raises(ValueError):
        ogg_media.read_ogg(media[:-10])
    pages = [media[i:j] for i, j in zip([m for m in range(len(media)) if media[m : m + 4] == b"OggS"], [*[m for m in range(len(media)) if media[m : m + 4] == b"OggS"][1:], len(media)])]
    with pytest.raises(ValueError):
        ogg_media.read_ogg(b"".join([*pages[:3], *pages[4:]]))


def test_granules_must_rise():
    """A page with a valid checksum whose granule position falls, or that names none."""
    payload = ogg_media.padded(b"abc" * 100_000)
    media = ogg_media.write_ogg(payload, 300_000)
    starts = [m for m in range(len(media)) if media[m : m + 4] == b"OggS"]
    for granule in (1, -1):
        page = bytearray(media[starts[4] : starts[5]])
        page[6:14] = struct.pack("<q", granule)
        page[22:26] = b"\0\0\0\0"
        page[22:26] = struct.pack("<I", ogg_media.page_crc(bytes(page)))
        with pytest.raises(ValueError, match="granule"):
            ogg_media.read_ogg(media[: starts[4]] + bytes(page) + media[starts[5] :])


def test_bad_media_leave_their_neighbours(spark):
    good = ogg_media.write_ogg(ogg_media.padded(b"fine"), 4)
    rows = [(1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, good[:-3], "x"), (5, good[:40] + b"!" + good[41:], "x"), (6, good, "x")]
    got = {r.doc_id: r for r in ogg_media.from_media(spark.createDataFrame(rows, "doc_id long, media binary, payload string").coalesce(1)).collect()}
    assert all(got[i].payload == ogg_media.padded(b"fine") and got[i].n_bytes == 4 and got[i].error is None for i in (1, 6))
    assert all(got[i].payload is None and got[i].feature is None and got[i].n_bytes is None and got[i].error for i in (2, 3, 4, 5))


def test_media_query_on_a_whole_table(spark):
    import pyarrow.parquet as pq

    from diachron.llm.queries import QUERIES

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    for r in QUERIES["op10_ogg_media"](spark, "/root/testdata/sf0.001").collect():
        payload = ogg_media.padded(texts[r.doc_id])
        media = ogg_media.write_ogg(payload, len(texts[r.doc_id]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_media_columns(spark):
    texts = [None, "", "abc", "abc", "é" * 100_000]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in ogg_media.from_media(ogg_media.to_media(docs)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        assert got[i].payload == ogg_media.padded(raw) and got[i].n_bytes == len(raw)
    assert got[0].media == got[1].media and got[2].media == got[3].media and got[2].feature == got[3].feature
    assert ogg_media.from_media(ogg_media.to_media(frame(spark, texts[:0]))).count() == 0
    row = QUERIES["op10_ogg_media"](spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first().text.encode()
    assert row.payload_sha256 == hashlib.sha256(ogg_media.padded(text)).hexdigest() and row.tail_crc32 == zlib.crc32(ogg_media.padded(text)[-64:])
