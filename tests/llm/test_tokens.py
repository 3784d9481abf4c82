import hashlib
import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilstream.llm import bpe, packing, tokenfile
from veilstream.llm.tokens import Encoder, encoder, word_table_path

TEXTS = [
    None, "", " \n\t ", "Hello wörld's IT'S 123 foo!!!", "<|endoftext|>a <|startoftext|> b<|endoftext|>c< |", "\x00a\x1cb\x85c\xa0d", "á ́ ﬁ İstanbul ß",
    "日本語 テスト", "don't DON'T it''s '", "x" * 3000, "word " * 9000, "same text", "same text", "na​ive 🙂🙂 a_b_c 1²3",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_table_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_every_character_in_context(library):
    enc, wrong = encoder(word_table_path()), []
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)} X{chr(c)}'s" for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    for text, got in zip(texts, enc.encode_many([t.encode() for t in texts])):
        if np.frombuffer(got, "<u4").tolist() != ids(library, text):
            wrong.append(text)
    assert not wrong


def test_cache_generations(library, monkeypatch):
    monkeypatch.setattr("veilstream.llm.tokens.CACHE_ENTRIES", 20)
    monkeypatch.setattr("veilstream.llm.tokens.BATCH_BYTES", 64)
    enc = Encoder(word_table_path())
    texts = [f"alpha{i % 13} beta{i} gamma alpha{i}" for i in range(60)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_many([t.encode() for t in texts])] == [ids(library, t) for t in texts]
    assert len(enc.young) + len(enc.old) <= 60


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", "y"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string").repartition(3).cache()


def test_bpe_round_trip(spark, docs, library, monkeypatch):
    got = bpe.bpe_digest(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = ids(library, "no id" if r.doc_id is None else TEXTS[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_digest(docs.limit(0)).count() == 0


def test_blocks_end_between_texts():
    block = bpe.WordBlock()
    for k, t in enumerate([b"b a b", b"", b"c b"]):
        block.add(k, t)
    words, at = block.numbered()
    assert words[0] == b"b" and [words[i] for i in at] == [b"b", b"a", b"b", b"c", b"b"] and block.sizes == [3, 0, 2]


def test_packing(docs, library):
    pieces = packing.pack_power_of_two(docs).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.offset == 0 for p in pieces)
    assert all(p.length & (p.length - 1) == 0 and p.length <= 4096 and p.length == 1 << p.bucket for p in pieces)
    buckets = [p.bucket for p in sorted(pieces, key=lambda p: p.sequence_id)]
    assert buckets == sorted(buckets)
    for k in (0, 3, 9, 10):
        want = [*ids(library, TEXTS[k]), 2]
        mine = sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start)
        assert {p.doc_tokens for p in mine} == {len(want)}
        copies = 2 if k == 3 else 1
        assert sum(p.length for p in mine) == copies * len(want)
        got = b"".join(bytes(p.ids) for p in mine[::copies])
        assert np.frombuffer(got, "<u4").tolist() == want
    assert packing.pack_power_of_two(docs.limit(0)).count() == 0
    assert packing.piece_lengths(0) == [] and packing.piece_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    values = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = tokenfile.pack_bits(values, bits)
    assert len(packed) == -(-1001 * bits // 8) and np.array_equal(tokenfile.unpack_bits(packed, 1001, bits), values)
    assert tokenfile.id_bits(49408) == 16 and tokenfile.id_bits(2) == 1 and tokenfile.id_bits(65537) == 17


def test_random_access(monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 64)
    monkeypatch.setattr(tokenfile, "READ_IDS", 100)

    class Keep(io.BytesIO):
        def close(self):
            self.raw = self.getvalue()
            super().close()

    out = Keep()
    writer, rng = tokenfile.TokenFileWriter(out, 13), np.random.default_rng(0)
    lists = [rng.integers(0, 1 << 13, n).astype(np.uint32) for n in (1, 500, 0, 63, 64, 65, 7)]
    for k, x in enumerate(lists):
        writer.add(None if k == 2 else k, x)
    writer.close()
    reader = tokenfile.TokenFileReader(_Source(out.raw))
    flat = np.concatenate(lists)
    for a, b in ((0, 1), (63, 65), (100, 640), (690, 700), (5, 5)):
        assert np.array_equal(reader.ids(a, b), flat[a:b])
    got = list(reader.documents())
    assert [g[0] for g in got] == [0, 1, None, 3, 4, 5, 6] and all(np.array_equal(g[2], x) for g, x in zip(got, lists))


class _Source:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


def test_token_files(spark, docs, library):
    manifest = tokenfile.write_token_files(docs)
    got = tokenfile.token_digest(tokenfile.read_token_files(spark, manifest)).orderBy("start").collect()
    order = [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    assert [r.doc_id for r in got] == order
    start = 0
    for r in got:
        want = [*ids(library, "no id" if r.doc_id is None else TEXTS[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    empty = tokenfile.write_token_files(docs.limit(0))
    assert tokenfile.read_token_files(spark, empty).count() == 0
