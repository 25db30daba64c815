"""Byte-level BPE: merge replay over all words of a slice, with an inverted index.

A slice is a run of documents of an Arrow batch.  Its distinct words (matches of the
splitting pattern) are laid end to end as one array of symbols.  An inverted
index maps each mergeable pair, named by the rank of its merge, to the
positions where it stands; the ranks are taken in ascending order, each
applies to all its positions at once, and only the two neighbours of a merged
position get new index entries.  Each document is then put together from the
ids of its words.  Words seen in earlier slices of the task are kept, up to
``KEPT_WORDS``.

The replay works on the words of a slice, not on a table of all words of the
corpus, because giving that table's ids back to the documents would shuffle
every word occurrence; the result is the same, since words never influence
each other.

Defined results: a null or empty text has no ids; repeated rows give repeated
results; other columns are kept (``encode``) or not read (``digest``).
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.llm.common import bound_batches, give_back

#: Distinct words that a task keeps from slice to slice; beyond that it starts anew.  Workers are used again by
#: later stages and hardly give memory back, so what a task keeps counts there, too.
KEPT_WORDS = 1 << 17
#: A slice ends with the document that takes it to this many characters.
SLICE = 1 << 21
#: No merge; and a symbol that no token has.
_NONE, _NOTHING = np.int32(-1), np.int32((1 << 31) - 1)
#: Longer words are merged one by one, as an index over positions serves no more than a queue there.
LONG = 1 << 12


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Ranks:
    """Tokens by rank, and for two adjacent symbols the rank of their merge (-1: none)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        parts = ((ranks.get(token[:cut]), ranks.get(token[cut:]), rank) for token, rank in ranks.items() for cut in range(1, len(token)))
        pairs = sorted((a << 32 | b, rank) for a, b, rank in parts if a is not None and b is not None)
        self._keys = np.array([key for key, _ in pairs] + [np.iinfo(np.int64).max], np.int64)  # the last one is no pair
        self._merged = np.array([rank for _, rank in pairs] + [_NONE], np.int32)
        self.double = self.merges(np.repeat(self.single, 256), np.tile(self.single, 256))  # of two bytes

    def merge(self, a: int, b: int) -> int:
        return self.ranks.get(self.token[a] + self.token[b], -1)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``merge`` of many pairs, by binary search among all that a vocabulary can merge."""
        keys = a.astype(np.int64) << 32 | b
        at = self._keys.searchsorted(keys)
        return np.where(self._keys[at] == keys, self._merged[at], _NONE)


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and the number of ids of each."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    count = len(raw)
    symbol = np.append(ranks.single[raw], _NOTHING)
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    # behind the last and before the first symbol of a word is position ``count``, whose symbol merges with nothing
    following, before = np.arange(1, count + 2, dtype=np.int32), np.arange(-1, count, dtype=np.int32)
    following[np.cumsum(size)[size > 0] - 1] = before[(np.cumsum(size) - size)[size > 0]] = count
    rank = np.full(count + 1, -1, np.int32)  # of the pair that begins at a position
    begins = np.flatnonzero(following[:count] < count).astype(np.int32)
    rank[begins] = ranks.double[raw[begins].astype(np.int32) << 8 | raw[begins + 1]]

    index: dict[int, list[np.ndarray]] = defaultdict(list)

    def enter(at: np.ndarray, found: np.ndarray) -> None:
        some = found >= 0
        if not some.any():
            return
        at, found = at[some], found[some]
        order = found.argsort(kind="stable")
        at, found = at[order], found[order]
        cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(at)]
        for r, begin, end in zip(found[cuts[:-1]].tolist(), cuts, cuts[1:]):
            if r not in index:
                heapq.heappush(queue, r)
            index[r].append(at[begin:end])

    queue: list[int] = []
    enter(begins, rank[begins])
    while queue:
        r = heapq.heappop(queue)
        parts = index.pop(r)
        at = np.concatenate(parts) if len(parts) > 1 else parts[0]
        at = at[rank[at] == r]  # others were merged or got another neighbour meanwhile
        if len(at) > 1:
            at = np.unique(at) if len(parts) > 1 else np.sort(at)
            inside = word[at]
            again = inside[1:] == inside[:-1]
            if again.any():  # in a word, leftmost first; a merge may make way for a lower rank
                first = np.append(True, ~again)
                index[r].append(at[~first])
                heapq.heappush(queue, r)
                at = at[first]
        elif not len(at):
            continue
        gone, left = following[at], before[at]
        after = following[gone]
        symbol[at], symbol[gone], rank[gone] = r, -1, -1
        following[at] = after
        before[after] = at
        merged = np.full(len(at), r, np.int32)
        near = np.concatenate([left, at])
        rank[near] = found = ranks.merges(np.concatenate([symbol[left], merged]), np.concatenate([merged, symbol[after]]))
        enter(near, found)
    stays = symbol[:count] >= 0
    return symbol[:count][stays], np.bincount(word[stays], minlength=len(words))


def _merge_long(word: bytes, ranks: Ranks) -> list[int]:
    """One long word, by a queue of (rank, position)."""
    symbol = ranks.single[np.frombuffer(word, np.uint8)].tolist()
    following = [*range(1, len(symbol)), -1]
    before = [*range(-1, len(symbol) - 1)]
    rank = [ranks.merge(a, b) for a, b in zip(symbol, symbol[1:])] + [-1]
    queue = [(r, i) for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(queue)
    while queue:
        r, i = heapq.heappop(queue)
        if rank[i] != r:
            continue
        gone = following[i]
        symbol[i], symbol[gone], rank[gone] = r, -1, -1
        after = following[i] = following[gone]
        if after >= 0:
            before[after] = i
        for at in (i, before[i]):
            if at >= 0:
                rank[at] = ranks.merge(symbol[at], symbol[following[at]]) if following[at] >= 0 else -1
                if rank[at] >= 0:
                    heapq.heappush(queue, (rank[at], at))
    return [s for s in symbol if s >= 0]


class _Words(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes slices of texts; keeps the words it has met."""

    def __init__(self, ranks: Ranks | dict[bytes, int], pattern: str):
        self.ranks, self.split = Ranks(ranks) if isinstance(ranks, dict) else ranks, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.words, self.known = _Words(), 0
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Ids for the words that were met since the last call."""
        fresh = [w.encode() for w in islice(self.words, self.known, None)]
        whole = {i: [self.ranks.ranks[w]] for i, w in enumerate(fresh) if w in self.ranks.ranks}
        whole |= {i: _merge_long(w, self.ranks) for i, w in enumerate(fresh) if len(w) > LONG and i not in whole}
        rest = [i for i in range(len(fresh)) if i not in whole]
        ids, sizes = replay([fresh[i] for i in rest], self.ranks)
        size = np.zeros(len(fresh), np.int64)
        size[rest] = sizes
        begin = np.zeros(len(fresh), np.int64)
        begin[rest] = np.cumsum(sizes) - sizes
        own = np.array([x for i in whole for x in whole[i]], np.int64)
        size[list(whole)] = own_sizes = np.array([len(x) for x in whole.values()], np.int64)
        begin[list(whole)] = len(ids) + np.cumsum(own_sizes) - own_sizes
        self.begin = np.concatenate([self.begin, begin + len(self.ids)])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32), own.astype(np.uint32)])
        self.known = len(self.words)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found, at = [], 0
        while at < len(texts):
            begin, chars = at, 0
            while at < len(texts) and chars < SLICE:
                chars += len(texts[at] or "")
                at += 1
            found += self._encode_slice(texts[begin:at])
        return found

    def _encode_slice(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > KEPT_WORDS:
            self._forget()
        number = self.words.__getitem__
        codes = [np.fromiter(map(number, self.split(t or "")), np.int32) for t in texts]
        self._learn()
        return [self._put_together(c) for c in codes]

    def _put_together(self, codes: np.ndarray) -> bytes:
        size = self.size[codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.begin[codes] - ends + size, size)
        return self.ids[at].astype("<u4").tobytes()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text``, packed as little-endian unsigned 32-bit integers."""
    bound_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(load_ranks(path)))  # the vocabulary has a fixed size

    @F.pandas_udf(BinaryType())
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(ranks.value, pattern)
        for texts in batches:
            yield pd.Series(encoder.encode(texts.tolist()), dtype=object)
        del encoder
        give_back()

    return docs.withColumn(to, ids(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that packed ids stand for."""
    bound_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    @F.pandas_udf(BinaryType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = {rank: token for token, rank in ranks.value.items()}.__getitem__
        for packed in batches:
            yield pd.Series([b"".join(map(token, np.frombuffer(p, "<u4").tolist())) for p in packed], dtype=object)

    return docs.withColumn(to, decoded(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of ``text`` and the bytes they stand for; as ``encode`` and ``decode``, in one worker."""
    bound_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(load_ranks(path)))

    @F.pandas_udf(StructType([StructField("ids", BinaryType()), StructField("decoded", BinaryType())]))
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(ranks.value, pattern)
        token = encoder.ranks.token.__getitem__
        for texts in batches:
            packed = encoder.encode(texts.tolist())
            back = [b"".join(map(token, np.frombuffer(p, "<u4").tolist())) for p in packed]
            yield pd.DataFrame({"ids": pd.Series(packed, dtype=object), "decoded": pd.Series(back, dtype=object)})
            del packed, back
        del encoder, token
        give_back()

    found = docs.select(F.struct("*").alias("doc"), both(F.col(text)).alias("both"))  # packed, so that no name can clash
    return found.select("doc.*", F.col("both.ids").alias(ids), F.col("both.decoded").alias(decoded))


def count_ids(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("long")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: the number of ids, their digest, and the digest of the decoded bytes."""
    both = round_trip(docs.select("doc_id", "text"), path, pattern)
    return both.select("doc_id", count_ids().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
