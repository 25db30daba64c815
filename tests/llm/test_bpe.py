import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

from helpers import documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(6)
    odd = [None, "", " ", "\n\n  x", "aaaa" * 60, "ab" * 3000, "a" * 9000, "中文" * 40, "<|endoftext|>", "\U0001f600" * 9, "it's I'LL", "é    x"]
    return odd + ["".join(rng.choice("abAnNt eé中1!'\n") for _ in range(rng.randrange(90))) for _ in range(1500)]


def test_ids_are_those_of_the_library(library):
    encoder = bpe.Encoder(bpe.load_ranks(PATH), PATTERN)
    for _ in range(2):  # the second time all words are known
        for text, packed in zip(texts(), encoder.encode(texts())):
            assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text or ""), text


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe, "SLICE", 300)
    encoder = bpe.Encoder(bpe.load_ranks(PATH), PATTERN)
    for text, packed in zip(texts(), encoder.encode(texts())):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text or "")


def test_digest(spark, library):
    rows = list(enumerate(texts()[:60])) + [(0, "again"), (None, "no id")]
    found = sorted(tuple(r) for r in bpe.digest(documents(spark, rows), PATH, PATTERN).filter("doc_id is not null").collect())
    expected = []
    for i, text in rows[:-1]:
        ids = library.encode_ordinary(text or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(expected)
    assert bpe.digest(documents(spark, []), PATH, PATTERN).count() == 0


def test_encode_and_decode_apart(spark, library):
    rows = list(enumerate(texts()[:40]))
    both = bpe.decode(bpe.encode(documents(spark, rows), PATH, PATTERN), PATH).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "") for r in both)


def test_pairs_are_found_in_arrays_and_not_one_by_one(library, monkeypatch):
    ranks = bpe.Ranks(bpe.load_ranks(PATH))
    a, b = np.random.default_rng(3).integers(0, 3000, (2, 20_000))
    assert ranks.merges(a, b).tolist() == [ranks.merge(x, y) for x, y in zip(a.tolist(), b.tolist())]

    def never(*_):
        raise AssertionError("a pair was looked up alone")

    monkeypatch.setattr(bpe.Ranks, "merge", never)
    short = [t for t in texts() if len(t or "") < 1000]
    for text, packed in zip(short, bpe.Encoder(ranks.ranks, PATTERN).encode(short)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text or "")
