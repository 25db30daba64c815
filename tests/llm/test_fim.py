"""Fill-in-middle: the parallel scan against plain counting, the forms against the rules, and exact rebuilding."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import documents
from tidemark.llm import fim


def numbers(doc_id):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def brute(doc_id, text):
    text = text or ""
    n, (h1, h2, h3, h4) = len(text), numbers(doc_id)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(mark in text for mark in fim.MARKS) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    else:
        form, out = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    plain = form == "plain"
    hashed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if plain else a, None if plain else b - a, hashed(out), hashed(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aé€😀<P>SM\n\0", max_size=400), min_size=1, max_size=6), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_scan_finds_cuts_and_marks(texts, h1, h2):
    found = fim.cut(fim.automaton(), [t.encode() for t in texts], np.full(len(texts), h1), np.full(len(texts), h2))
    for i, t in enumerate(texts):
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        assert found["n"][i] == len(t)
        assert found["marked"][i] == sum(t.count(mark) for mark in fim.MARKS)
        assert (found["cut1"][i], found["cut2"][i]) == (len(t[:a].encode()), len(t[:b].encode()))


def test_composing_is_associative_and_agrees_with_reading_on():
    rng = np.random.default_rng(5)
    machine = fim.automaton()
    data = np.frombuffer("ab<P>é€😀<S".encode() * 40, np.uint8)
    parts = np.array_split(data, np.sort(rng.choice(len(data), 7, replace=False)))
    one = [fim.emit(machine, machine.classes[p][None]) for p in parts]
    left = one[0]
    for f in one[1:]:
        left = left.then(f)
    right = one[-1]
    for f in one[-2::-1]:
        right = f.then(right)
    alone = fim.emit(machine, machine.classes[data][None])
    for x, y, z in zip(left, right, alone):
        assert (x == y).all() and (x == z).all()


TEXTS = [
    (1, ""), (2, None), (3, "a"), (4, "holds <S> itself"), (5, "é€😀 " * 50), (None, "no id here"), (6, "twice"), (6, "twice"), (7, "< P > <P <S< M>" * 9), (8, "nul \0 and\ttab\n" * 30),
    *((100 + i, "wörter und 😀 mehr " * (i + 1)) for i in range(60)),
]


@pytest.mark.parametrize("chunk", [fim.CHUNK, 16, 100])
def test_digest(spark, chunk):
    docs = documents(spark, [*TEXTS, (900, "x<P>" + "y" * 300), (901, "😀" * 5000), (901, "😀" * 5000)])
    found = fim.digest(docs, chunk)
    expected = [brute(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_giant_text_needs_its_two_chunks_only(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("aé€😀 \n") for _ in range(400_000))
    docs = documents(spark, [(i, text) for i in (1, 2, 3)])
    assert sorted(map(tuple, fim.digest(docs).collect())) == sorted(brute(i, text) for i in (1, 2, 3))


def test_transform_keeps_the_table(spark):
    odd = documents(spark, TEXTS).withColumnRenamed("lang", "form").withColumnRenamed("n_chars", "raw").withColumnRenamed("source", "cuts")
    found = fim.transform(odd, form="way").collect()
    assert [*found[0].asDict()] == ["doc_id", "text", "form", "cuts", "raw", "way"]
    for row in found:
        if row.way == "plain":
            continue
        parts = {m: row.text.index(m) for m in fim.MARKS}
        order = sorted(parts, key=parts.get)
        assert order == (["<P>", "<S>", "<M>"] if row.way == "psm" else ["<S>", "<P>", "<M>"])
    assert sorted((r.doc_id or 0, r.text or "") for r in found if r.way == "plain") == sorted((i or 0, t or "") for i, t in TEXTS if brute(i, t)[2] == "plain")
    assert any(r.way == "spm" for r in found) and any(r.way == "psm" for r in found)


def test_lines_as_units(spark):
    docs = documents(spark, [(i, "".join(f"line {j} é\n" for j in range(i)) + "rest") for i in range(1, 40)])
    for row in fim.transform(docs, form="way", units="lines").collect():
        if row.way == "psm":
            prefix, rest = row.text[3:].split("<S>")
            middle = rest.split("<M>")[1]
            assert all(part == "" or part.endswith("\n") for part in (prefix, middle))


def test_empty_table_and_bad_marks(spark):
    empty = documents(spark, [])
    assert fim.digest(empty).count() == 0 and fim.transform(empty).count() == 0
    with pytest.raises(ValueError):
        fim.transform(empty, marks=("<P>", "<P>x", "y"))
    with pytest.raises(ValueError):
        fim.transform(empty, marks=("ab", "ba", "c"))
