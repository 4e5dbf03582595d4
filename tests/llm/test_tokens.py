"""Encoding, decoding and code files against the library, on odd and random texts."""

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from loomgraph.llm import bpe, codes  # noqa: E402
from loomgraph.llm.common import work_dir  # noqa: E402

WORDS = ["Hello", "don't", "été", "<|endoftext|>", "x<|endoftext|>y", "2024", "12.5%", "áb", " ", " z", "日本語テキスト", "😀😀", "ﬁ", "ΣΑΣ", "\x1c!", "...", "​", "İ"]
GAPS = [" ", "  ", "\n", " \n", "\n ", "\t", "\r\n", "\n\n   ", "  ", "   "]


def odd_texts(n=120):
    r = random.Random(5)
    out = ["", " ", "\n", "a", "   x   ", "<|endoftext|>", "no-space" * 3000, "́́ ́", "a" * 9000, " \n\t" * 50]
    shared = " ".join(r.choice(WORDS) + str(i) for i in range(900))
    out += [shared, "head " + shared, shared + " tail", "x" + shared]
    out += ["".join(r.choice(WORDS) + r.choice(GAPS) for _ in range(r.randrange(1, 700))) for _ in range(n)]
    return out


def test_chunks_agree_with_the_library():
    t = tokenizers.Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    some = odd_texts()
    e = bpe.ChunkEncoder(str(P.path("word_bpe_49k.json")))
    for part in (some, some[::-1]):
        got = e.encode(part)
        for text, ids in zip(part, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]
    assert e.reused > 100 and e.repairs > 0


def test_cuts_follow_content_and_keep_characters():
    r = random.Random(1)
    passage = "".join(chr(r.randrange(97, 123)) if r.random() < 0.9 else "é" for _ in range(60000)).encode()
    a, b = bpe.cuts(passage), bpe.cuts(b"some other start " * 9 + passage)
    shift = len(b"some other start " * 9)
    assert len(set(a) & {x - shift for x in b}) > 0.8 * len(a) > 5
    assert all(passage[x] & 0xC0 != 0x80 for x in a if x < len(passage)) and bpe.cuts(b"") == []
    assert min(np.diff([0, *bpe.cuts(b"\0" * 50000)])[:-1], default=bpe.LEAST) >= bpe.LEAST


def test_encode_documents(spark):
    path = str(P.path("word_bpe_49k.json"))
    t = tokenizers.Tokenizer.from_file(path)
    rows = [(i, x, "ids") for i, x in enumerate(odd_texts(20))] + [(None, None, "z"), (3, "a", None), (3, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode_documents(bpe.encode_documents(df, path), path).collect()
    want = sorted((str(d), t.encode(x or "", add_special_tokens=False).ids) for d, x, _ in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert all(r.decoded == t.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) for r in got)
    assert bpe.encode_documents(df.limit(0), path).count() == 0


def test_byte_pieces_agree_with_the_library():
    t = tokenizers.Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    e = codes.ByteEncoder(str(P.path("byte_bpe_50k.json")))
    for text, ids in zip(some := odd_texts(), e.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


def test_levels_give_every_token():
    r = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (r.integers(0, 2**20, n) >> r.integers(0, 20, n)).astype(np.uint32)
        cutat = sorted(r.integers(0, n + 1, 4).tolist())
        lengths = np.diff([0, *cutat, n]).tolist()
        x = codes.Levels(b"".join(codes.pack(list(range(5)), lengths, ids)))
        assert x.ids(0, n).tolist() == ids.tolist() and x.starts.tolist() == [0, *np.cumsum(lengths).tolist()]
        for i in range(0, n, 37):
            assert x.token(i) == ids[i]
            assert x.ids(i, min(n, i + 61)).tolist() == ids[i : i + 61].tolist()


@pytest.mark.parametrize("file_tokens", [8_000_000, 500])
def test_code_files_round_trip(spark, monkeypatch, file_tokens):
    monkeypatch.setattr(codes, "FILE_TOKENS", file_tokens)
    path = str(P.path("byte_bpe_50k.json"))
    t = tokenizers.Tokenizer.from_file(path)
    rows = [(7 * i - 30, x, 1) for i, x in enumerate(odd_texts(15))] + [(None, None, 2), (5000, "b", 3), (5000, "a", 3), (5000, "a", 3)]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "doc_id long, text string, start long")
    m = codes.write_codes(df, path, work_dir(spark, "t"))
    got = {}
    for r in codes.read_codes(m).collect():
        got[r.start] = (r.doc_id, np.frombuffer(r.ids, "<u4").tolist())
        assert r.n_tokens == len(got[r.start][1]) and zlib.crc32(r.ids) is not None
    at = 0
    for d, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        assert got[at] == (d, ids)
        at += len(ids)
    assert len(got) == len(rows)
    assert codes.read_codes(codes.write_codes(df.limit(0), path, work_dir(spark, "t"))).count() == 0
