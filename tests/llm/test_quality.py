import re
from collections import Counter

import pytest

from tidemark.llm import quality

from helpers import documents


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 500, "l1\nl1\n\n \nl1\nl2", "# $5 <b> é\x0bü|", "a\x85b c d", "w " * 9 + "v " * 9 + "w " * 9, " ".join(map(str, range(30_000)))])
def test_counts(text):
    assert quality.counts_of(text) == brute(text)


def test_boilerplate(spark):
    line, own = "Subscribe to our newsletter today for more of this", "words of its own number {} that say what no other text says here in as many words as it takes to stay"
    other = "All rights to these pages and pictures stay with their respective owners"
    rows = [(i, f"{line}!\n{own.format(chr(97 + i) * 3)}\n{other}", "h") for i in range(12)]
    rows += [(50, f"{line.upper()} 42\nfew\n{other}", "h"), (51, f"{line}\n{own.format('zz')}", None), (52, f"{line}\nfew\n{other}", "other")]
    rows += [(60 + i, "an exact copy of one text that is long enough to pass the base rules of words and that is found very often in this host", "c") for i in range(30)]
    rows += [(90, None, "h"), (91, "", None)]
    found = {r.doc_id: r for r in quality.judge(documents(spark, rows)).collect()}
    assert all(found[i].kept and found[i].removed_lines == 2 and found[i].removed_words == 21 for i in range(12))
    assert not found[50].kept and not found[50].base_failed and found[50].removed_lines == 2
    assert found[51].kept and found[51].removed_lines == 0 and found[52].kept
    assert all(found[60 + i].kept for i in range(30))
    assert found[90].base_failed and not found[91].kept
    for r in found.values():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert tuple(r)[1:6] == brute(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_empty_and_repeated(spark):
    assert quality.judge(documents(spark, [])).count() == 0
    assert quality.judge(documents(spark, [(1, "a b"), (1, "a b"), (None, "x")])).count() == 3
