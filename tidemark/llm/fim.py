"""Fill-in-middle by a parallel automaton scan.

A text is cut into n units, here code points, and an automaton over its bytes
tells where units end and whether a mark stands in it.  A stretch of bytes whose
entry state isn't known yet is read from every state at once: what it emits is a
function from states to states and, for each state it may begin in, the units
that end in it and the marks it completes.  Such functions compose, and
composing is associative, so the entry states and the units before each stretch
come from a scan over the functions in any grouping.  A cut is then selected by
its number: the stretch in which so many units have ended is the only one that
is read again, from a known state.

Texts of up to ``CHUNK`` bytes are scanned where they lie, in stretches of
``STRETCH`` bytes side by side.  Of giant ones the chunks are dealt out to tasks;
each sends back its function alone, a group composes the functions of one text
(a cell holds under 2 GB, so there are under 32,768 of them), and the two chunks
that hold cuts are read again.  Both ways give the same cuts.

The numbers h1 to h4 of a row come from a hash of its id.  Prefix and middle end
after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) units; h3 leaves
a share of texts plain, h4 divides the others in the two forms

    psm  <P>prefix<S>suffix<M>middle        spm  <S>suffix<P>prefix<M>middle

Defined results: a null text counts as empty and an empty one is plain
(``transform`` leaves both as they are), and so is a text that holds a mark, as
it could not be told apart again.  A row without an id takes the hash of an empty
one.  Repeated rows give repeated results; an empty table gives an empty result;
other columns, whatever their names, are kept by ``transform``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, sha256_hex, text_or_empty

#: What begins the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are transformed, and of 100 of these so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
CHUNK, STRETCH = 1 << 16, 64
#: Bytes that are scanned side by side, about.
_SIDE = 1 << 20


class Automaton(NamedTuple):
    """States are numbered from 0, where texts begin; bytes that all states treat alike share a class, and the last class pads."""

    classes: np.ndarray  # of each byte
    step: np.ndarray  # state and class: the next state
    ends: np.ndarray  # state and class: whether a unit ends with this byte
    hits: np.ndarray  # state and class: whether a mark does


def _code_point(state: int, byte: int) -> tuple[int, bool]:
    """The state is the number of bytes that the code point still lacks."""
    if state and 0x80 <= byte < 0xC0:
        return state - 1, state == 1
    lacks = 0 if byte < 0x80 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
    return lacks, not lacks


def _line(state: int, byte: int) -> tuple[int, bool]:
    return 0, byte == 10


UNITS = {"code_points": _code_point, "lines": _line}


def automaton(units: str = "code_points", marks: tuple[str, ...] = MARKS) -> Automaton:
    """The product of what finds units and what finds marks."""
    count, words = UNITS[units], [m.encode() for m in marks]
    begun = {w[:n] for w in words for n in range(len(w))}

    def read(seen: bytes, byte: int) -> tuple[bytes, bool]:
        now = seen + bytes([byte])
        return next(now[i:] for i in range(len(now) + 1) if now[i:] in begun), any(now.endswith(w) for w in words)

    states, rows, at = {(0, b""): 0}, [], 0
    while at < len(states):
        unit, seen = list(states)[at]
        row = []
        for byte in range(256):
            (next_unit, ended), (next_seen, hit) = count(unit, byte), read(seen, byte)
            row.append((states.setdefault((next_unit, next_seen), len(states)), ended, hit))
        rows.append(row)
        at += 1
    table = np.array(rows, np.int64)  # states, bytes, 3
    alike, classes = np.unique(table.transpose(1, 0, 2).reshape(256, -1), axis=0, return_inverse=True)
    table = alike.reshape(len(alike), len(rows), 3).transpose(1, 0, 2)
    pad = np.stack([np.arange(len(rows)), np.zeros(len(rows), int), np.zeros(len(rows), int)], axis=1)
    step, ends, hits = np.concatenate([table, pad[:, None]], axis=1).transpose(2, 0, 1)
    return Automaton(classes.reshape(256).astype(np.int64), step.copy(), ends.copy(), hits.copy())


class Functions(NamedTuple):
    """What stretches do, a row each: from each state (columns) the state behind them, the units and the marks that end in them."""

    step: np.ndarray
    ends: np.ndarray
    hits: np.ndarray

    def then(self, later: Functions) -> Functions:
        to = lambda values: np.take_along_axis(values, self.step, 1)
        return Functions(to(later.step), self.ends + to(later.ends), self.hits + to(later.hits))

    def rows(self, at) -> Functions:
        return Functions(*(values[at] for values in self))


def emit(machine: Automaton, classes: np.ndarray) -> Functions:
    """The functions of stretches, given as rows of byte classes."""
    n, width = machine.step.shape
    offset, ends, hits = (machine.step * width).ravel(), machine.ends.ravel(), machine.hits.ravel()
    state = np.broadcast_to(np.arange(n) * width, (len(classes), n)).copy()
    ended, hit = np.zeros_like(state), np.zeros_like(state)
    for byte in np.ascontiguousarray(classes.T):
        at = state + byte[:, None]
        ended += ends.take(at)
        hit += hits.take(at)
        state = offset.take(at)
    return Functions(state // width, ended, hit)


def composed(functions: Functions, group: np.ndarray) -> Functions:
    """For each stretch the function of all its group's stretches up to its own end; the stretches of a group follow each other."""
    now, n, reach = functions, len(group), 1
    while reach < n and (same := group[reach:] == group[:-reach]).any():
        rows = np.flatnonzero(same)
        joined = now.rows(rows).then(now.rows(rows + reach))
        fresh = Functions(*(values.copy() for values in now))
        for values, new in zip(fresh, joined):
            values[rows + reach] = new
        now, reach = fresh, 2 * reach
    return now


def locate(machine: Automaton, classes: np.ndarray, states: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """In each stretch, read from its state, the bytes up to the end of the wanted unit (counted from 1)."""
    width, found = machine.step.shape[1], np.zeros(len(classes), np.int64)
    state, ended = states * width, np.zeros(len(classes), np.int64)
    for i, byte in enumerate(np.ascontiguousarray(classes.T), 1):
        at = state + byte
        now = machine.ends.ravel().take(at)
        ended += now
        found[(now > 0) & (ended == wanted)] = i
        state = machine.step.ravel().take(at) * width
    return found


def _laid_out(machine: Automaton, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of all texts, as rows of classes, and the text of each; the last stretch of a text is padded, an empty text has one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = np.maximum(-(-sizes // STRETCH), 1)
    place = np.full(int(rows.sum()) * STRETCH, machine.step.shape[1] - 1, np.int64)
    data = machine.classes[np.frombuffer(b"".join(texts), np.uint8)]
    begins = (np.cumsum(rows) - rows) * STRETCH
    place[np.arange(len(data)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)] = data
    return place.reshape(-1, STRETCH), np.repeat(np.arange(len(texts)), rows)


def whole(machine: Automaton, text: bytes) -> Functions:
    """The function of one chunk."""
    classes, owner = _laid_out(machine, [text])
    return composed(emit(machine, classes), owner).rows(slice(-1, None))


def cut(machine: Automaton, texts: list[bytes], h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
    """For each text its units and marks, and the units and the bytes before both cuts."""
    classes, owner = _laid_out(machine, texts)
    upto = composed(emit(machine, classes), owner)
    last = np.searchsorted(owner, np.arange(len(texts)), "right") - 1
    first = np.searchsorted(owner, np.arange(len(texts)), "left")
    units = upto.ends[last, 0]
    targets = np.sort(np.stack([h1 % (units + 1), h2 % (units + 1)]), axis=0)
    # counts grow within a text, so one sorted array holds all of them when each text begins above the text before
    base = np.cumsum(units + 1) - (units + 1)
    counts = upto.ends[:, 0] + base[owner]
    offsets = []
    for target in targets:
        row = np.minimum(np.searchsorted(counts, base + target), last)  # the first stretch in which so many have ended
        inner = row > first
        states = np.where(inner, upto.step[row - 1, 0], 0)
        before = np.where(inner, upto.ends[row - 1, 0], 0)
        inside = locate(machine, classes[row], states, target - before)
        offsets.append(np.where(target > 0, (row - first) * STRETCH + inside, 0))
    return {"n": units, "marked": upto.hits[last, 0], "a": targets[0], "b": targets[1], "cut1": offsets[0], "cut2": offsets[1]}


_CUTS = "n long, marked long, a long, b long, cut1 long, cut2 long"


def _numbers(doc_id: Column, seed: str) -> list[Column]:
    """h1 to h4 of a row."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _in_place(rows: DataFrame, machine: Automaton) -> DataFrame:
    """``rows`` (``raw``, ``h1``, ``h2``) with ``cuts``, each text scanned where it lies."""

    @F.pandas_udf(_CUTS)
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raw, h1, h2 in batches:
            found, begin, held = [], 0, 0
            for i, size in enumerate([*map(len, raw), _SIDE]):
                if held and held + size > _SIDE or i == len(raw):
                    found.append(pd.DataFrame(cut(machine, raw[begin:i].tolist(), h1[begin:i].to_numpy(np.int64), h2[begin:i].to_numpy(np.int64))))
                    begin, held = i, 0
                held += size + STRETCH
            yield pd.concat(found, ignore_index=True)

    return rows.withColumn("cuts", cuts("raw", "h1", "h2"))


def _dealt_out(rows: DataFrame, machine: Automaton, chunk: int) -> DataFrame:
    """``rows`` with ``cuts``, the chunks of their texts scanned apart from each other.

    Rows of one id and text share one key: they have the same cuts.
    """
    keyed = rows.withColumn("key", F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), F.col("raw")), 256))
    number = F.posexplode(F.expr(f"transform(sequence(0, (octet_length(raw) - 1) div {chunk}), i -> substring(raw, cast(i * {chunk} + 1 as int), {chunk}))")).alias("no", "bytes")
    chunks = keyed.select("key", "h1", "h2", number).repartition("key", "no")

    @F.pandas_udf("step array<long>, ends array<long>, hits array<long>")
    def functions(chunks: pd.Series) -> pd.DataFrame:
        found = [whole(machine, one) for one in chunks]
        return pd.DataFrame({name: pd.Series([list(getattr(f, name)[0]) for f in found], dtype=object) for name in Functions._fields})

    emitted = chunks.select("key", "no", "h1", "h2", functions("bytes").alias("f")).groupBy("key", "no").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("f").alias("f"))

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        table = Functions(*(np.array([f[name] for f in group["f"]], np.int64) for name in Functions._fields))
        upto = composed(table, np.zeros(len(group), np.int64))
        units, marked = int(upto.ends[-1, 0]), int(upto.hits[-1, 0])
        rows = []
        for which, target in enumerate(sorted(int(group[h].iloc[0]) % (units + 1) for h in ("h1", "h2"))):
            i = int(np.searchsorted(upto.ends[:, 0], target)) if target else 0
            state, before = (int(upto.step[i - 1, 0]), int(upto.ends[i - 1, 0])) if i else (0, 0)
            rows.append((group["key"].iloc[0], units, marked, which, target, i, state, target - before))
        return pd.DataFrame(rows, columns=["key", "n", "marked", "which", "target", "no", "state", "wanted"])

    chosen = emitted.groupBy("key").applyInPandas(compose, "key string, n long, marked long, which int, target long, no int, state long, wanted long")

    @F.pandas_udf("long")
    def inside(chunks: pd.Series, states: pd.Series, wanted: pd.Series) -> pd.Series:
        found = []
        for data, state, want in zip(chunks, states, wanted):
            classes, owner = _laid_out(machine, [data])
            upto = composed(emit(machine, classes), owner)
            row = int(np.searchsorted(upto.ends[:, state], want)) if want else 0
            entry, before = (upto.step[row - 1, state], upto.ends[row - 1, state]) if row else (state, 0)
            last = locate(machine, classes[row : row + 1], np.array([entry]), np.array([want - before]))[0]
            found.append(row * STRETCH + last if want else 0)
        return pd.Series(found, dtype="int64")

    placed = chunks.drop("h1", "h2").join(chosen, ["key", "no"])
    placed = placed.select("key", "n", "marked", "which", "target", (F.col("no").cast("long") * chunk + inside("bytes", "state", "wanted")).alias("at"))
    one = lambda name, which: F.max(F.when(F.col("which") == which, F.col(name)))
    cuts = placed.groupBy("key").agg(F.struct(F.max("n").alias("n"), F.max("marked").alias("marked"), one("target", 0).alias("a"), one("target", 1).alias("b"), one("at", 0).alias("cut1"), one("at", 1).alias("cut2")).alias("cuts"))
    return keyed.join(cuts, "key").select(*rows.columns, "cuts")


def _planned(docs: DataFrame, text: str, doc_id: str, seed: str, units: str, marks: tuple[str, ...], chunk: int) -> DataFrame:
    """The rows, packed in ``doc``, with ``raw``, ``cuts``, ``form``, and the bytes ``output``."""
    for mark in marks:
        for other in marks:
            if not mark or (mark != other and mark in other) or any(other.startswith(mark[i:]) for i in range(1, len(mark))):
                raise ValueError(f"marks that overlap can't be told apart: {mark}, {other}")
    if len(set(marks)) != 3:
        raise ValueError("three different marks are needed")
    bound_batches(docs.sparkSession)
    machine = automaton(units, marks)
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("id"), text_or_empty(text).cast("binary").alias("raw"), *_numbers(F.col(doc_id), seed))
    giant = F.octet_length("raw") > chunk
    scanned = _in_place(rows.filter(~giant), machine).unionAll(_dealt_out(rows.filter(giant), machine, chunk))
    plain = (F.octet_length("raw") == 0) | (F.col("cuts.marked") > 0) | (F.col("h3") % 100 >= TRANSFORMED)
    formed = scanned.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm"))
    prefix, middle = F.expr("substring(raw, 1, cast(cuts.cut1 as int))"), F.expr("substring(raw, cast(cuts.cut1 + 1 as int), cast(cuts.cut2 - cuts.cut1 as int))")
    suffix = F.expr("substring(raw, cast(cuts.cut2 + 1 as int), octet_length(raw))")
    p, s, m = (F.lit(mark.encode()) for mark in marks)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("raw"))
    return formed.withColumn("output", output)


def restored(output: str, form: str, marks: tuple[str, ...] = MARKS) -> Column:
    """The text of which ``output``, the name of a string column, was made."""
    p, s, m = ("'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'" for mark in marks)
    between = lambda begin, end: f"substring({output}, instr({output}, {begin}) + length({begin}), instr({output}, {end}) - instr({output}, {begin}) - length({begin}))"
    rest = f"substring({output}, instr({output}, {m}) + length({m}), length({output}))"
    return F.expr(f"case {form} when 'psm' then concat({between(p, s)}, {rest}, {between(s, m)}) when 'spm' then concat({between(p, m)}, {rest}, {between(s, p)}) else {output} end")


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", form: str | None = None, seed: str = "1", units: str = "code_points", marks: tuple[str, ...] = MARKS, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with each text in its form; ``form`` names a column to add that tells which.

    ``units`` are ``code_points``, or ``lines`` (what follows the last line feed is no line and stays in the suffix).
    """
    found = _planned(docs, text, doc_id, seed, units, marks, chunk)
    columns = [F.col(f"doc.`{name}`") if name != text else F.when(F.col("form") == "plain", F.col(f"doc.`{text}`")).otherwise(F.col("output").cast("string")).alias(text) for name in docs.columns]
    return found.select(*columns, *([F.col("form").alias(form)] if form else []))


def digest(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per document: its code points, its form, where it was cut, and digests of the output and of what is rebuilt from it."""
    found = _planned(docs.select("doc_id", "text"), "text", "doc_id", "1", "code_points", MARKS, chunk).withColumn("written", F.col("output").cast("string"))
    cut_at = lambda value: F.when(F.col("form") != "plain", value)
    return found.select(
        "doc.doc_id",
        F.col("cuts.n").alias("n"),
        "form",
        cut_at(F.col("cuts.a")).alias("prefix_chars"),
        cut_at(F.col("cuts.b") - F.col("cuts.a")).alias("middle_chars"),
        sha256_hex(F.col("output")).alias("output_sha256"),
        sha256_hex(F.encode(restored("written", "form"), "UTF-8")).alias("restored_sha256"),
    )


def digest_sql() -> str:
    p, s, m = MARKS
    number = lambda i: f"CAST('0x' || substr(hash, {8 * i + 1}, 8) AS BIGINT)"
    marked = " OR ".join(f"contains(body, '{mark}')" for mark in MARKS)
    return f"""WITH hashed AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
numbered AS (SELECT doc_id, body, length(body) AS n, {', '.join(f'{number(i)} AS h{i + 1}' for i in range(4))} FROM hashed),
formed AS (SELECT doc_id, body, CAST(n AS BIGINT) AS n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR {marked} OR h3 % 100 >= {TRANSFORMED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM numbered),
parts AS (SELECT *, substring(body, 1, a) AS prefix, substring(body, a + 1, b - a) AS middle, substring(body, b + 1, n) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle WHEN 'spm' THEN '{s}' || suffix || '{p}' || prefix || '{m}' || middle ELSE body END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN body ELSE prefix || middle || suffix END) AS restored_sha256 FROM parts"""
