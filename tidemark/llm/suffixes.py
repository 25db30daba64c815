"""Long strings that stand more than once, found with suffix arrays over shards.

A window is a string of ``LENGTH`` bytes in a text.  A window that also starts
anywhere else, in the same text or in another one, is repeated, and each byte that
a repeated window covers is removed; windows are judged on the texts as given.

*Where to look.*  Of the short strings of ``ANCHOR`` bytes in a window, the one
with the least hash is its anchor, so equal windows have equal anchors, and
windows that follow each other share one: a text is a row of contexts, stretches
of bytes whose windows have the same anchor.  Exact copies of a text are repeated
as a whole and stand for each other here.  An anchor that stands once in all texts
has no repeated window; where all contexts of an anchor are the same string, all
of its windows are repeated.  What is left are anchors in different contexts.

*Suffix arrays.*  These contexts, each distinct one once, are dealt to shards of
about ``SHARD`` bytes, whole anchors together.  A shard's suffix array is refined
by Larsson and Sadakane's doubling: ranks of the first h bytes give those of 2h,
and only groups that aren't settled are sorted again.  Common prefixes of
neighbours come from Kasai's recurrence (moving on by a byte loses at most one),
run over stretches of positions side by side.  Windows whose neighbour agrees for
``LENGTH`` bytes are repeated.

*Merging shards.*  An anchor whose contexts fill more than a shard is split over
several.  Each of these sends a sorted run with one 128-bit fingerprint for each
of its distinct windows (16 bytes instead of the 200 of the string), and the runs
are searched for each other's entries by binary search, a range of fingerprints in
a task.

Nothing is compared in pairs, no task holds more than a text, a shard or a range
of runs, and no text is moved but to put equal ones together: the passes over
texts join them by that partitioning, in a bucketed table.  Different texts count
as equal if 96 bits of hashes agree, different contexts if 128 do.

Defined results: a null text counts as empty, texts below ``LENGTH`` bytes lose
nothing, repeated rows are copies; ids aren't looked at, so they may be missing or
repeated; an empty table gives an empty result.  ``remove`` keeps other columns,
whatever their names, leaves null texts as they are, and drops a code point where
all of its bytes are covered, so that texts stay valid.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, checkpoint_folder, sha256_hex, text_or_empty

LENGTH, ANCHOR = 200, 32
#: Bytes of a shard, about.
SHARD = 1 << 20
#: Window starts that are looked at together, and positions that one lane of the common prefixes goes through.
_BLOCK, _LANE = 1 << 19, 256
#: Anchors that happen to share a hash cost a look only; this many more bits than needed to number all anchors leave few of them.
_SPARE_BITS = 8
_KEY = ["k1", "k2"]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    found = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x2545F4914F6CDD1D))
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(32))


def gram_hashes(data: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """A hash of the ``length`` bytes from each position on, put together from those of 1, 2, 4, ... bytes."""
    starts = len(data) - length + 1
    now, size, done, found = np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64)[data], 1, 0, None
    while True:
        if length & size:
            part = now[done : done + starts]
            found, done = part if found is None else _mixed(found, part), done + size
        if 2 * size > length:
            return found
        now, size = _mixed(now[:-size], now[size:]), 2 * size


def anchors(data: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end (``ends`` are theirs) and hold a window each: the hash of each context's anchor, its first window and its windows.

    The windows of an anchor are successive, as the least of a moving window only moves on.
    """
    hashes = gram_hashes(data, anchor)
    least = (hashes >> np.uint64(31) << np.uint64(31)) | np.arange(len(hashes), dtype=np.uint64)  # of equal ones the first
    width, reach = length - anchor + 1, 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least & np.uint64((1 << 31) - 1)).astype(np.int64)
    inside = np.ones(len(place), bool)
    for end in ends[:-1].tolist():
        inside[end - length + 1 : end] = False
    windows = np.flatnonzero(inside)
    at = place[windows]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    first = windows[new]
    return hashes[at[new]], first, np.diff(np.r_[new, len(windows)])


def contexts(texts: list[bytes], length: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the texts, some at a time: number of the text, hash of the anchor, first window and windows of each context.

    Longer texts are looked at in blocks of windows; a context may end with its block.
    """
    held, total = [], 0

    def flush():
        data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in held), np.uint8)
        ends = np.cumsum([b - a for _, a, b in held])
        hashes, first, count = anchors(data, ends, length, anchor)
        own = np.searchsorted(ends, first, "right")
        numbers, shifts = np.array([i for i, _, _ in held]), np.array([a for _, a, _ in held]) - np.r_[0, ends[:-1]]
        return numbers[own], hashes, first + shifts[own], count

    for i, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, _BLOCK):
            b = min(a + _BLOCK + length - 1, len(text))
            if held and total + b - a > 2 * _BLOCK:
                yield flush()
                held, total = [], 0
            held.append((i, a, b))
            total += b - a
    if held:
        yield flush()


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions sorted by the symbols (0 to 256) from each to the end; Larsson and Sadakane's refinement.

    It goes on until nothing is tied, as ``common_prefixes`` relies on the whole order.
    """
    n, first = len(symbols), 7
    padded = np.concatenate([symbols, np.zeros(first, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(first):
        key = key * 257 + padded[i : i + n]
    order = np.argsort(key, kind="stable")
    seen = key[order]
    heads = np.r_[True, seen[1:] != seen[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    known = first
    while True:
        slots = np.flatnonzero(~(heads & np.r_[heads[1:], True]))  # of groups that aren't settled
        if not len(slots):
            return order
        at = order[slots]
        ahead = np.where(at + known < n, rank[np.minimum(at + known, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + ahead
        sorted_ = np.argsort(both, kind="stable")
        at, both = at[sorted_], both[sorted_]
        order[slots] = at
        new = np.r_[True, both[1:] != both[:-1]]
        heads[slots] = new
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        known *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each position how many symbols, ``length`` at most, it shares with the one before it in ``order``; Kasai's recurrence in lanes."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([symbols, np.full(length + 1, -1, np.int64)])
    found = np.zeros(n, np.int64)
    at = np.arange(0, n, _LANE)
    ends, shared = np.minimum(at + _LANE, n), np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        more = (other >= 0) & (shared < length) & (padded[at + shared] == padded[other + shared])
        done = ~more
        found[at[done]] = shared[done]
        shared = np.where(more, shared + 1, np.maximum(shared - 1, 0))
        at = at + done
        if done.any() and not (live := at < ends).all():
            at, ends, shared = at[live], ends[live], shared[live]
    return found


def repeated(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of strings that hold a window each: where each begins in the shard, whether a repeated window starts at each place, and a place for each distinct window with the shard's bytes."""
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = data.astype(np.int64) + 1
    symbols[begins + sizes] = 0
    window = np.zeros(len(data) + 1, np.int64)
    np.add.at(window, begins, 1)
    np.add.at(window, begins + sizes - length + 1, -1)
    window = np.cumsum(window)[:-1] > 0
    order = suffix_array(symbols)
    alike = common_prefixes(symbols, order, length)[order] >= length  # no window holds a separator, so none agrees across one
    flags = np.zeros(len(data), bool)
    flags[order] = alike | np.r_[alike[1:], False]
    return begins, flags & window, order[window[order] & ~alike], data


def in_other_runs(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted run of distinct keys which of its keys another run holds, by binary search."""
    every = np.sort(np.concatenate(runs))
    return [np.searchsorted(every, run, "right") - np.searchsorted(every, run, "left") > 1 for run in runs]


_RUN = "c1 long, c2 long, off int, n int"
_FOUND = f"{_RUN}, f1 long, f2 long, alone boolean, bucket long, part int, parts int"


def _shard(length: int):
    """Rows with ``n`` are runs of repeated windows; the others are distinct windows of split anchors, ``alone`` if not repeated in their shard."""

    def find(table: pa.Table) -> pa.Table:
        c1, c2 = (table.column(c).to_numpy() for c in ("c1", "c2"))
        bucket, part, parts = (table.column(c)[0].as_py() for c in ("bucket", "part", "parts"))
        begins, flags, distinct, data = repeated(table.column("bytes").to_pylist(), length)
        edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
        runs, stops = edges[::2], edges[1::2]
        own = np.searchsorted(begins, runs, "right") - 1
        columns = [c1[own], c2[own], runs - begins[own], stops - runs]
        m, none = len(runs), np.zeros(len(runs), np.int64)
        columns += [none, none, np.zeros(m, bool)]
        if parts > 1:
            own = np.searchsorted(begins, distinct, "right") - 1
            marks = [gram_hashes(data, length, seed)[distinct].view(np.int64) for seed in (2, 3)]
            more = [c1[own], c2[own], distinct - begins[own], np.zeros(len(own), np.int64), *marks, ~flags[distinct]]
            columns = [np.concatenate(pair) for pair in zip(columns, more)]
        rows = len(columns[0])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array(np.full(rows, v), k) for v, k in ((bucket, pa.int64()), (part, pa.int32()), (parts, pa.int32()))]
        return pa.Table.from_arrays(arrays, ["c1", "c2", "off", "n", "f1", "f2", "alone", "bucket", "part", "parts"])

    return find


def _merge(table: pa.Table) -> pa.Table:
    """The windows of a range that aren't repeated in their own shard but stand in another one."""
    keys = np.stack([table.column(c).to_numpy() for c in ("f1", "f2")], axis=1).astype(">u8").view("S16").ravel()
    part = table.column("part").to_numpy()
    order = np.lexsort((keys, part))
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    runs = [keys[rows] for rows in np.split(order, cuts)]
    shared = np.concatenate(in_other_runs(runs)) & table.column("alone").to_numpy()[order]
    rows = order[shared]
    return pa.Table.from_arrays([pa.array(table.column(c).to_numpy()[rows]) for c in ("c1", "c2", "off")] + [pa.array(np.ones(len(rows)), pa.int32())], ["c1", "c2", "off", "n"])


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` from a table in the shared folder."""
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """The rows, packed in ``doc``, with the bytes of the text and the hashes that tell texts apart."""
    rows = docs.select(F.struct("*").alias("doc"), text_or_empty(text).cast("binary").alias("raw"))
    return rows.select("doc", "raw", F.xxhash64("raw").alias("k1"), F.hash("raw").alias("k2"))


def _texts(keyed: DataFrame, folder: str, table: str, length: int) -> DataFrame:
    """Each distinct text that holds a window, with its ``copies``, in a table bucketed by the hashes: joins by them leave it in its place."""
    spark = keyed.sparkSession
    distinct = keyed.filter(F.octet_length("raw") >= length).groupBy(*_KEY).agg(F.count("*").alias("copies"), F.first("raw").alias("raw"))
    distinct = distinct.select("*", F.octet_length("raw").alias("size"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct.write.option("compression", "zstd").option("path", f"{folder}/texts").bucketBy(buckets, *_KEY).format("parquet").saveAsTable(table)
    return spark.read.table(table)


def _live(texts: DataFrame, folder: str, length: int, anchor: int) -> tuple[DataFrame, np.uint64]:
    """Per text the hashes of its anchors that stand twice or more in all texts, in ``live``; and the bits by which hashes are shortened."""
    total = texts.agg(F.sum("size")).first()[0] or 0
    keep = np.uint64(64 - min(63, math.ceil(math.log2(max(total, 2))) + _SPARE_BITS - math.floor(math.log2((length - anchor + 1) / 2))))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for own, hashes, _, _ in contexts(batch.column(2).to_pylist(), length, anchor):
                rows = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[rows, len(own)], pa.int32()), pa.array((hashes >> keep).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(k[own[rows]]) for k in keys] + [lists], ["k1", "k2", "hashes"])

    found = _written(texts.select(*_KEY, "raw").mapInArrow(hashed, "k1 long, k2 int, hashes array<long>"), folder, "anchors")
    twice = found.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").select("h")
    twice = _written(twice, folder, "twice")
    each = found.select(*_KEY, F.explode(F.array_distinct("hashes")).alias("h")).join(twice, "h")
    return each.groupBy(*_KEY).agg(F.collect_list("h").alias("live")), keep  # bounded by the text


def _occurrences(texts: DataFrame, live: DataFrame, keep: np.uint64, folder: str, length: int, anchor: int) -> DataFrame:
    """The contexts of live anchors: ``h``, the 128-bit hash ``c1``, ``c2`` of the string, the text, ``first`` and the windows ``n``."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [batch.column(i).to_numpy() for i in (0, 1)], batch.column(2).to_pylist()
            offsets, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for own, hashes, first, count in contexts(raws, length, anchor):
                short = (hashes >> keep).astype(np.int64)
                listed = np.zeros(len(own), bool)
                for i in np.unique(own).tolist():
                    at = slice(*np.searchsorted(own, [i, i + 1]).tolist())
                    listed[at] = np.isin(short[at], values[offsets[i] : offsets[i + 1]])
                own, short, first, count = own[listed], short[listed], first[listed], count[listed]
                digests = b"".join(hashlib.blake2b(raws[i][a : a + n + length - 1], digest_size=16).digest() for i, a, n in zip(own.tolist(), first.tolist(), count.tolist()))
                pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
                columns = [pa.array(short), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), *(pa.array(k[own]) for k in keys), pa.array(first, pa.int32()), pa.array(count, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "c1", "c2", "k1", "k2", "first", "n"])

    # a text is read with its own list only, as both are in the bucket of its hashes
    joined = texts.select(*_KEY, "raw").join(live, _KEY).select(*_KEY, "raw", "live")
    return _written(joined.mapInArrow(cut_out, "h long, c1 long, c2 long, k1 long, k2 int, first int, n int"), folder, "contexts")


def covered(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD) -> tuple[DataFrame, DataFrame, str]:
    """Each distinct text that holds a window, with its ``copies``; the ``spans`` of repeated windows of those that have any; the name of the texts' table."""
    if not 1 <= anchor <= length:
        raise ValueError("an anchor has as many bytes as a window at most")
    spark = docs.sparkSession
    bound_batches(spark)
    folder, table = f"{checkpoint_folder(spark)}/suffixes-{uuid.uuid4().hex}", f"tidemark_texts_{uuid.uuid4().hex}"
    texts = _texts(_keyed(docs, text), folder, table, length)
    live, keep = _live(texts, folder, length, anchor)
    occurrences = _occurrences(texts, live, keep, folder, length, anchor)

    where = F.min(F.struct(*_KEY, "first")).alias("where")
    distinct = _written(occurrences.groupBy("h", "c1", "c2", "n").agg(F.count("*").alias("times"), where), folder, "distinct")
    sizes = distinct.groupBy("h").agg(F.count("*").alias("strings"), F.sum(F.col("n") + (length - 1)).alias("held")).filter("strings > 1")
    sizes = _written(sizes, folder, "sizes")  # a join of two plain shuffles can be split where an anchor is hot
    shards = max(1, math.ceil((sizes.agg(F.sum("held")).first()[0] or 0) / shard))
    parts = F.ceil(F.col("held") / shard).cast("int")
    dealt = distinct.join(sizes, "h").select(
        "where.*", "n", "c1", "c2", parts.alias("parts"),
        F.when(parts > 1, F.col("h")).otherwise(-1 - F.pmod("h", F.lit(shards))).alias("bucket"),
        F.when(parts > 1, F.pmod("c1", parts)).otherwise(0).cast("int").alias("part"),
    )
    strings = texts.select(*_KEY, "raw").join(dealt, _KEY).select("bucket", "part", "parts", "c1", "c2", F.expr(f"substring(raw, first + 1, n + {length - 1})").alias("bytes"))
    # one suffix array takes anchors of one shard; all of them have the same parts, or none has more than one
    found = strings.withColumn("parts", F.when(F.col("parts") > 1, F.col("parts")).otherwise(1))
    found = _written(found.groupBy("bucket", "part").applyInArrow(_shard(length), _FOUND), folder, "shards")
    merged = found.filter("n = 0").groupBy("bucket", F.pmod("f1", "parts").alias("range")).applyInArrow(_merge, _RUN)
    runs = found.filter("n > 0").select("c1", "c2", "off", "n").unionAll(merged).unionAll(distinct.filter("times > 1").select("c1", "c2", F.lit(0).alias("off"), "n"))
    begin = F.col("first") + F.col("off")
    spans = occurrences.select("c1", "c2", *_KEY, "first").join(runs, ["c1", "c2"]).select(*_KEY, begin.alias("begin"), (begin + F.col("n") + (length - 1)).alias("end"))
    spans = spans.groupBy(*_KEY).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # bounded by the text
    return texts, spans, table


def _joined(spans) -> np.ndarray:
    """Sorted spans, none of which touch, that cover the same places."""
    pairs = np.array(sorted((s["begin"], s["end"]) for s in spans), np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
    return np.stack([pairs[new, 0], reach[np.r_[new[1:] - 1, len(pairs) - 1]]], axis=1)


def _left(raw: bytes, spans: np.ndarray) -> bytes:
    edges = np.r_[0, spans.ravel(), len(raw)].reshape(-1, 2).tolist()
    return b"".join(raw[a:b] for a, b in edges)


def digest(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """Per document: its bytes, how many are removed in how many runs, and a digest of those left."""
    spark = docs.sparkSession
    texts, spans, table = covered(docs, "text", length, anchor, shard)

    @F.pandas_udf("n_removed long, n_spans long, kept string")
    def judged(raw: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for data, found in zip(raw, spans):
            joined = _joined(found)
            rows.append((int((joined[:, 1] - joined[:, 0]).sum()), len(joined), hashlib.sha256(_left(data, joined)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    partly = texts.filter("copies = 1").join(spans, _KEY).select(*_KEY, judged("raw", "spans").alias("j")).select(*_KEY, "j.*")
    wholly = texts.filter("copies > 1").select(*_KEY, F.col("size").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept"))
    folder = f"{checkpoint_folder(spark)}/suffixes-{uuid.uuid4().hex}"
    results = _written(partly.unionAll(wholly), folder, "results")
    spark.sql(f"DROP TABLE {table}")
    keyed = _keyed(docs.select("doc_id", "text"), "text").select("doc.doc_id", *_KEY, F.octet_length("raw").cast("long").alias("n_bytes"), sha256_hex(F.col("raw")).alias("whole"))
    zero = F.lit(0).cast("long")
    return keyed.join(results, _KEY, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256")
    )


def remove(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """``docs`` without the code points of ``text`` that repeated windows cover."""
    spark = docs.sparkSession
    texts, spans, table = covered(docs, text, length, anchor, shard)
    folder = f"{checkpoint_folder(spark)}/suffixes-{uuid.uuid4().hex}"
    wholly = texts.filter("copies > 1").select(*_KEY, F.array(F.struct(F.lit(0).alias("begin"), F.col("size").alias("end"))).alias("spans"))
    partly = spans.join(wholly.select(*_KEY), _KEY, "left_anti").select(*_KEY, "spans")
    known = _written(wholly.unionAll(partly), folder, "spans")
    spark.sql(f"DROP TABLE {table}")

    @F.pandas_udf("string")
    def shortened(raw: pd.Series, spans: pd.Series) -> pd.Series:
        def one(data: bytes | None, found) -> str | None:
            if found is None:
                return None
            inner = _joined(found)
            later = lambda at: next(i for i in range(at, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80)
            earlier = lambda at: at if at == len(data) else next(i for i in range(at, -1, -1) if data[i] & 0xC0 != 0x80)
            return _left(data, np.array([(later(a), max(later(a), earlier(b))) for a, b in inner.tolist()])).decode()

        return pd.Series([one(data, found) for data, found in zip(raw, spans)], dtype=object)

    joined = _keyed(docs, text).join(known, _KEY, "left")
    short = joined.withColumn("short", shortened(F.when(F.col("spans").isNotNull(), F.col("raw")), F.col("spans")))
    kept = F.when(F.col("spans").isNotNull(), F.col("short")).otherwise(F.col(f"doc.`{text}`"))
    return short.select(*(F.col(f"doc.`{name}`") if name != text else kept.alias(text) for name in docs.columns))
