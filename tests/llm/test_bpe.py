import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from ledgerframe.llm import bpe
from tests.llm import texts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def odd_texts():
    pick = random.Random(5)
    out = ["", " ", "\n\n  x", "\x00\x01", "<unk>", "▁a ▁▁b", "a" * 5000, "<|endoftext|>", "\x1c\x85　x", "I'LL don't", "日本語", "\U0001f600"]
    return out + ["".join(chr(pick.choice([pick.randrange(32, 127), pick.randrange(0xA0, 0x2FFF), pick.randrange(0x10000, 0x1FFFF)])) for _ in range(150)) for _ in range(80)]


def test_ids_are_those_of_the_rank_library():
    codec, known = bpe.Codec(bpe.read_ranks(PATH), PATTERN), reference()
    for text in odd_texts():
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_round_trip_of_documents(spark):
    known = reference()
    docs = texts.frame(spark)
    out = bpe.round_trip(docs, PATH, PATTERN)
    assert out.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in out.collect():
        ids = known.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(texts.frame(spark, []), PATH, PATTERN).count() == 0


def test_encode_then_decode(spark):
    out = bpe.decode(bpe.encode(texts.frame(spark), PATH, PATTERN), PATH, PATTERN)
    assert all((r.text or "") == r.bpe_text for r in out.collect())
