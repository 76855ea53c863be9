"""The piece operator against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerframe.llm import pieces
from tests.llm import texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_model(PATH))


def odd_texts():
    pick = random.Random(3)
    out = ["", " ", "   ", "\n\n x ", "\x00a", "▁a ▁▁b", "a" * 5000, " " * 3000 + "x", "x" + " " * 777, "<s></s><unk><0x41>", "日本語の文章です。" * 50, "ß ſ ŉ", "-" * 777, "=" * 100 + " " * 40, "� \U0001f600", "é", "\t\t \t"]
    out += ["".join(chr(pick.choice([pick.randrange(32, 127), pick.randrange(0xA0, 0x2FFF), pick.randrange(0x10000, 0x1FFFF)])) for _ in range(150)) for _ in range(80)]
    out += ["".join(pick.choice("abcdeilnorst ") for _ in range(pick.randrange(1, 400))) for _ in range(200)]
    out += ["".join(pick.choice("abcdeilnorstABCDEFG0123") for _ in range(20_000))]  # one word: beyond the rounds
    return out + ["".join(pick.choice([" ", "  ", "\t", "x", "the", " the", "in", "ing", ".", ",\n"]) for _ in range(300)) for _ in range(80)]


def numbers(ids):
    return [int(i) for i in ids.split(",")] if ids else []


def test_ids_are_those_of_the_library(codec):
    found = odd_texts()
    for text, ids in zip(found, codec.encode(found), strict=True):
        assert numbers(ids) == LIBRARY.encode(text), text[:60]
        assert codec.decode(numbers(ids)) == LIBRARY.decode(numbers(ids)).encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab\n ▁.,theé漢\x00") | st.characters(exclude_categories=["Cs"])))
def test_any_text(codec, text):
    assert numbers(codec.encode([text])[0]) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31_999), max_size=9))
def test_any_ids_are_decoded_as_by_the_library(codec, ids):
    """Bytes that are no UTF-8, control pieces and the unknown one included."""
    assert codec.decode(ids) == LIBRARY.decode(ids).encode()


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_queue_and_rounds_agree(codec, monkeypatch, rounds):
    monkeypatch.setattr(pieces, "ROUNDS", rounds)
    fresh = pieces.Codec(pieces.read_model(PATH))
    found = odd_texts()[:120]
    assert fresh.encode(found) == codec.encode(found)


def test_a_vocabulary_whose_later_merges_come_sooner():
    """`ab` brings forth `abc`, which comes before a further `ab`: the round must stop there, as one merge at a time would."""
    model = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    model += [(p, s, 1) for p, s in (("a", -90.0), ("b", -91.0), ("c", -92.0), ("▁", -93.0), ("ab", -5.0), ("aba", -1.0), ("bab", -5.0), ("cc", -7.0), ("ccc", -7.0), ("cccc", -7.0))]
    pick = random.Random(1)
    words = ["".join(pick.choice("abc") for _ in range(pick.randrange(1, 40))) for _ in range(400)]
    codec = pieces.Codec(model)
    one_by_one = [codec._queued(codec._symbols[np.array([ord(c) for c in w])].tolist()) for w in words]
    assert codec.merged(words) == one_by_one


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(pieces, "CACHED_CHARS", 3)
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 20)
    codec = pieces.Codec(pieces.read_model(PATH))
    found = [t for t in odd_texts() if len(t) < 500][:60]
    assert [numbers(x) for x in codec.encode(found)] == [LIBRARY.encode(t) for t in found]


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(b"\x0a\x05\x0a\x03abc\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        pieces.read_model(str(path))


def test_round_trip_of_documents(spark):
    docs = texts.frame(spark)
    out = pieces.round_trip(docs, PATH)
    assert out.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in out.collect():
        ids = LIBRARY.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert pieces.round_trip(texts.frame(spark, []), PATH).count() == 0


def test_encode_then_decode(spark):
    out = pieces.decode(pieces.encode(texts.frame(spark), PATH), PATH)
    assert all((r.text or "") == r.piece_text and r.piece_ids == LIBRARY.encode(r.text or "") for r in out.collect())
