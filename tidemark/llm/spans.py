"""Spans of regular expressions in a text, found with SQL functions only.

The patterns here repeat groups possessively, because the JVM's matcher calls
itself once for each turn of a backtracking group and long texts would end it.

An array that grows inside a fold is copied at each step, so nothing here folds
over all the matches of a text.  Running sums and maxima are taken inside blocks
of ``_BLOCK`` elements and over the blocks' totals, level by level, and
neighbours are compared after one sort: the work grows with the text, also where
a megabyte of it is nothing but matches.

Texts and arrays are given as SQL expressions, best the name of a column.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
_NONE = f"cast(array() as {SPAN})"
_BLOCK, _LEVELS = 64, 2
#: Code points of the pieces in which a text is cut up to take substrings of it.
_PIECE = 4096
_number = count()


def quoted(value: str) -> str:
    """A string as a literal of Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a name for ``value``, which is evaluated once however often the body has the name."""
    name = f"v{next(_number)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def _before(values: str, merge: Callable[[str, str], str], levels: int = _LEVELS) -> str:
    """For each element of an int array what ``merge`` makes of 0 and all elements before it."""

    def fold(block: str, begin: str) -> str:
        s, x = f"s{next(_number)}", f"x{next(_number)}"
        step = f"named_struct('now', {merge(f'{s}.now', x)}, 'seen', concat({s}.seen, array({s}.now)))"
        return f"aggregate({block}, named_struct('now', {begin}, 'seen', cast(array() as array<int>)), ({s}, {x}) -> {step}, {s} -> {s}.seen)"

    if not levels:
        return fold(values, "0")

    def in_blocks(blocks: str) -> str:
        b, x, y, at = (f"b{next(_number)}" for _ in range(4))
        totals = f"transform({blocks}, {b} -> aggregate({b}, 0, ({x}, {y}) -> {merge(x, y)}))"
        return f"flatten(zip_with({blocks}, {_before(totals, merge, levels - 1)}, ({b}, {at}) -> {fold(b, at)}))"

    def begun(values: str) -> str:
        b = f"b{next(_number)}"
        blocks = f"transform(sequence(0, (size({values}) - 1) div {_BLOCK}), {b} -> slice({values}, cast({b} * {_BLOCK} + 1 as int), {_BLOCK}))"
        return f"if(size({values}) <= {_BLOCK}, {fold(values, '0')}, {_let(blocks, in_blocks)})"

    return _let(values, begun)


def _sum(a: str, b: str) -> str:
    return f"{a} + {b}"


def _largest(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def find(text: str, pattern: str, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value), in code points, ends exclusive.

    A match's start is the length of all that ``split`` and ``regexp_extract_all``
    give before it.  Texts without ``hint``, a literal that every match holds,
    aren't searched.
    """

    def placed(hits: str) -> str:
        gaps = f"transform(slice(split({text}, {quoted(pattern)}, -1), 1, size({hits})), g -> length(g))"
        pairs = f"zip_with({gaps}, {hits}, (g, h) -> named_struct('gap', g, 'hit', h))"
        span = "named_struct('start', a + p.gap, 'end', a + p.gap + length(p.hit), 'value', p.hit)"
        spans = lambda pairs: f"zip_with({pairs}, {_before(f'transform({pairs}, p -> p.gap + length(p.hit))', _sum)}, (p, a) -> {span})"
        return f"if(size({hits}) > 0, {_let(pairs, spans)}, {_NONE})"

    found = _let(f"regexp_extract_all({text}, {quoted(pattern)}, 0)", placed)
    return F.expr(found if hint is None else f"if(contains({text}, {quoted(hint)}), {found}, {_NONE})")


def tagged(kind: str, rank: int, spans: Column) -> Column:
    """The spans as structs that sort by start, then by the rank of their kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def ranked(kind: str, rank: int, spans: Column) -> Column:
    """The spans as structs that sort by the rank of their kind, then by start."""
    return F.transform(spans, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(spans: str, others: str) -> Column:
    """The (start, end, value) spans, none of which overlap, that overlap none of the others; sorted.

    Sorted by start, one that overlaps lies before the end of an earlier other
    span, or its next neighbour is another span that begins inside it.
    """
    event = "named_struct('start', e.start, 'own', {}, 'end', e.end, 'value', {})"
    events = f"array_sort(concat(transform({others}, e -> {event.format(0, 'cast(null as string)')}), transform({spans}, e -> {event.format(1, 'e.value')})))"

    def free(events: str) -> str:
        ends = _before(f"transform({events}, e -> if(e.own = 0, e.end, 0))", _largest)
        both = f"zip_with({events}, {ends}, (e, a) -> named_struct('e', e, 'end', a))"
        covered = f"x.end > x.e.start or coalesce(get({events}, i + 1).own = 0 and get({events}, i + 1).start < x.e.end, false)"
        return f"transform(filter({both}, (x, i) -> x.e.own = 1 and not ({covered})), x -> named_struct('start', x.e.start, 'end', x.e.end, 'value', x.e.value))"

    return F.expr(f"if(size({others}) = 0 or size({spans}) = 0, cast({spans} as {SPAN}), {_let(events, free)})")


def replaced(text: str, marks: str) -> Column:
    """``text`` with each (start, end, mark) replaced; of overlapping marks the first stands for all.

    The text is cut into pieces once, so that taking a substring costs its own
    length and that of a piece, not that of the text.
    """

    def cut(pieces: str, begin: str, end: str) -> str:
        low = f"cast({begin} div {_PIECE} as int)"
        here = f"array_join(slice({pieces}, {low} + 1, cast(({end} - 1) div {_PIECE} as int) - {low} + 1), '')"
        return f"if({end} > {begin}, substring({here}, {begin} - {low} * {_PIECE} + 1, {end} - {begin}), '')"

    def put_together(marks: str) -> str:
        ends = _before(f"transform({marks}, m -> m.end)", _largest)
        kept = f"filter(zip_with({marks}, {ends}, (m, a) -> named_struct('start', m.start, 'mark', m.mark, 'at', a)), m -> m.start >= m.at)"
        last = f"array_max(transform({marks}, m -> m.end))"
        whole = lambda pieces: _let(last, lambda last: f"concat(array_join(transform({kept}, m -> concat({cut(pieces, 'm.at', 'm.start')}, m.mark)), ''), {cut(pieces, last, f'length({text})')})")
        return _let(f"regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0)", whole)

    return F.expr(f"if(size({marks}) > 0, {_let(f'array_sort({marks})', put_together)}, {text})")


def find_sql(body: str, pattern: str) -> str:
    """A list of structs (start, value) of a pattern's matches in DuckDB's SQL."""
    pieces, hits = f"string_split_regex({body}, '{pattern}')", f"regexp_extract_all({body}, '{pattern}')"
    before = f"list_sum(list_transform({pieces}[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform({hits}[1:i-1], lambda h: length(h))), 0)"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: {{'start': CAST({before} AS BIGINT), 'value': {hits}[i]}})"
