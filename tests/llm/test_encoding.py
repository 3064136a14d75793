"""The streaming encoder against the tokenizer's own library, and exact round trips."""

import os
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from treemill.llm import encoding

PATH = encoding.DEFAULT_VOCABULARY
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def own():
    return encoding.Transducer(encoding.load_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aeiou thsn'dl!19\n\t\r\xa0\x1c\x85  é漢🎉ſ²ⅷ<|>")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_the_library(own, library, text):
    ids = own.encode(text)
    assert ids == library(text) and own.decode(ids) == text


@pytest.mark.parametrize("text", ["", None, " ", "\n\n", "<|endoftext|> x<|endoftext|>", "I'll 'S it's", "a" * 9000, "ab" * 70_000 + " end " * 40_000, "漢字" * 5000])
def test_cases(own, library, text):
    assert own.encode(text) == (library(text) if text else [])
    assert own.decode(own.encode(text)) == (text or "")


def test_long_pieces_are_emitted_when_stable(own, library):
    rng = random.Random(2)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(30_000))
    stream = own.piece_tokens(text.encode())
    assert [next(stream) for _ in range(50)] + list(stream) == library(text)
    assert own.longest <= own.sufficient_lookahead < 4096


def test_decoding_holds_back_unfinished_characters(own):
    text = "🎉é漢" * 3000
    assert "".join(own.decode_stream(own.encode(text), block=1)) == text
    assert encoding.utf8_step(b"", "é".encode()[:1]) == ("", "é".encode()[:1]) and encoding.utf8_step(b"\xc3", b"\xa9x") == ("éx", b"")
    assert encoding.utf8_step(b"", b"\x80\x80\x80") == ("���", b"")


def test_json_and_ranks_agree():
    assert encoding.load_ranks(PATH).items() <= encoding.load_ranks(PATH.replace(".tiktoken", ".json")).items()


def test_corpus(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x"), (None, "a  b", "x"), (4, "  \n ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in encoding.encode_corpus(df, "doc_id", "text").collect()))
    assert got == sorted(((i or 0, library(t) if t else []) for i, t, _ in rows))
    assert all(r.restored for r in encoding.roundtrip(df, "doc_id", "text").collect())
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text").collect() == []
