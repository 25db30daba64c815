import gzip
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.sources import bgzf


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000), st.integers(-1, 10))
def test_round_trip(raw, level):
    packed = bgzf.compress(raw, level) + bgzf.EOF
    assert gzip.decompress(packed) == raw
    assert b"".join(part for _, part in bgzf.blocks(packed)) == raw


def test_large_random_bytes_fit_their_blocks():
    raw = os.urandom(300_000)
    packed = bgzf.compress(raw, 9)
    found = list(bgzf.blocks(packed))
    assert b"".join(part for _, part in found) == raw
    bounds = [at for at, _ in found] + [len(packed)]
    assert all(b - a <= 65536 for a, b in zip(bounds, bounds[1:]))


def test_end_marker_is_an_empty_block():
    assert list(bgzf.blocks(bgzf.EOF)) == [(0, b"")] and len(bgzf.EOF) == 28


@pytest.mark.parametrize("harm", [lambda x: x[:-5], lambda x: b"\0" + x[1:], lambda x: x[:-8] + b"\1\2\3\4" + x[-4:]])
def test_broken_framing_is_found(harm):
    with pytest.raises(ValueError):
        list(bgzf.blocks(harm(bgzf.compress(b"some text" * 50))))


def test_blocks_are_bounded():
    with pytest.raises(ValueError):
        bgzf.block(b"x" * (bgzf.RAW_BLOCK + 1))
