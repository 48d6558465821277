import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe
from tessera.llm.queries import op5_byte_bpe, vocabulary

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks, pattern = vocabulary()
    return byte_bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_are_the_librarys(pair, text):
    codec, library = pair
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_and_odd_texts(pair):
    codec, library = pair
    for text in ("a" * 3000, " " * 500, "𝒳 ab 😀  \n\n x's 't ١٢ \u3000\u00a0 a", "<|endoftext|>", "\x00\x7f\xff", "word " * 300_000):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_query(spark, small, pair):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op5_byte_bpe(spark, small).collect():
        ids = pair[1].encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_apart_and_together(odd, empty):
    ranks, pattern = vocabulary()
    got = byte_bpe.decode(byte_bpe.encode(odd, ranks, pattern), ranks).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in got) and len(got) == odd.count()
    assert byte_bpe.round_trip(empty, ranks, pattern).count() == 0


def test_other_vocabularies():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 300, b"  ": 301}
    codec = byte_bpe.Codec(ranks, r"\S+|\s+")
    assert np.frombuffer(codec.encode("abcab  x"), "<u4").tolist() == [300, 256, 301, ord("x")]
