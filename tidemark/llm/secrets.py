"""Secrets by rules and by sliding-window Shannon entropy, with SQL functions only.

Three rules find assignments, access keys and long hexadecimal runs.  Beyond
them, candidate strings of 20 or more token characters are read through a
sliding window: one fold over "character enters" and "character leaves" events
keeps the counts of the window and the sum of c*log2(c).  What leaves is looked up
in an array of the string's characters that is made once, so each step costs the
same however long the string is.  A candidate is a secret if the largest window
entropy reaches the threshold of its character class and no allow-list pattern
(words, numbers, UUIDs, paths of words) matches it whole.  Letters alone are
no word yet: such candidates have a class with a threshold of its own, and are
let go only if they are made of word-like parts.

The work is one pass over each text without a shuffle.  Defined results: a null
or empty text has no spans and the digest of the empty string; repeated rows
give repeated results; other columns, whatever their names, are kept by ``scan``
and ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans
from tidemark.llm.common import sha256_hex, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ASSIGN_LEAST = 8
#: A run is whole or nothing here: where too short a run fails, so does every later start in it.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"

#: The sliding window, in characters, and candidate strings at least that long.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character class, what makes a candidate belong to it (the first that fits), least entropy in bits.
CLASSES = (("entropy_hex", r"[0-9A-Fa-f]++", 3.0), ("entropy_token", r"[A-Za-z0-9+/_=-]++", 3.75))
#: Whole candidates that need no look at their entropy; the first of them holds for word-like letters only, see ``WORDS``.
ALLOWED = (
    r"[A-Za-z]++(?:[-_/=+]++[A-Za-z]++)*+[-_/=+]*+",  # words, also joined ones and paths
    r"[-_/=+]*+[0-9]++(?:[-_/=+]++[0-9]++)*+[-_/=+]*+",  # numbers, dates, phone-like runs
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",  # UUIDs
    r"[-_/=+]++",  # rulers
)
#: The class of candidates of letters and joiners alone.
LETTERS = ("entropy_letters", ALLOWED[0], 3.75)
#: A part of one case or capitalised, of usual length, with a vowel and without six consonants in a row; such parts
#: may follow each other with capitals, and parts of one or two letters may stand between joiners.
_PART = r"(?![A-Za-z]?[b-df-hj-np-tv-xz]{6})(?=[A-Za-z]?[a-z]*[aeiouy]|[AEIOUY])[A-Za-z](?:(?![b-df-hj-np-tv-xz]{6})[a-z]){1,23}+(?![a-z])"
_CAPITALS = r"(?=[A-Z]*[AEIOUY])(?:(?![B-DF-HJ-NP-TV-XZ]{6})[A-Z]){2,24}+(?![A-Za-z])"
_PIECE = rf"(?:[A-Za-z]{{1,2}}(?![A-Za-z])|{_CAPITALS}|(?:{_PART})++)"
WORDS = rf"[-_/=+]*+{_PIECE}(?:[-_/=+]++{_PIECE})*+[-_/=+]*+"
#: Sums of c*log2(c) are kept as integers of this fraction of a bit, so that leaving undoes entering exactly.
_UNIT = 1_000_000
_TERMS = [round(_UNIT * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def window_entropy(value: str) -> str:
    """The largest Shannon entropy, in bits, of any ``WINDOW`` successive characters of a string of token characters; 0 for shorter strings.

    Value and result are SQL expressions.  The characters' numbers are an array
    that is made once; what enters and what leaves is found in it by its index.
    """
    n = len(ALPHABET)
    terms = f"array({', '.join(map(str, _TERMS))})"
    begin = f"named_struct('counts', array_repeat(0, {n}), 'n', 0, 'sum', 0, 'least', {_UNIT * WINDOW * 99})"

    def judged(codes: str) -> str:
        events = f"flatten(transform({codes}, (c, i) -> if(i >= {WINDOW}, array(-get({codes}, i - {WINDOW}), c), array(c))))"
        count, change = "element_at(s.counts, abs(e))", "cast(signum(e) as int)"
        total = f"s.sum - element_at({terms}, {count} + 1) + element_at({terms}, {count} + {change} + 1)"
        counts = f"concat(slice(s.counts, 1, abs(e) - 1), array({count} + {change}), slice(s.counts, abs(e) + 1, {n}))"
        step = f"named_struct('counts', {counts}, 'n', s.n + {change}, 'sum', {total}, 'least', if(s.n + {change} = {WINDOW}, least(s.least, {total}), s.least))"
        return f"if(size({codes}) < {WINDOW}, 0D, aggregate({events}, {begin}, (s, e) -> {step}, s -> {math.log2(WINDOW)!r}D - s.least / {float(_UNIT * WINDOW)!r}D))"

    return spans._let(f"transform(split({value}, ''), c -> instr({spans.quoted(ALPHABET)}, c))", judged)


def _class_of(value: str) -> str:
    """The class of a candidate that the entropy condemns, else null."""
    whole = lambda pattern: f"{value} rlike {spans.quoted(f'^(?:{pattern})$')}"
    allowed = " or ".join(whole(pattern) for pattern in (WORDS, *ALLOWED[1:]))
    classes = (CLASSES[0], LETTERS, CLASSES[1])
    least = "case " + " ".join(f"when {whole(chars)} then {limit}D" for _, chars, limit in classes) + " end"
    name = "case " + " ".join(f"when {whole(chars)} then '{kind}'" for kind, chars, _ in classes) + " end"
    return f"if({allowed}, cast(null as string), if({window_entropy(value)} >= {least}, {name}, cast(null as string)))"


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """The rows, packed in ``doc`` so that no name can clash, with ``body`` and the spans ``base`` and ``added``.

    Spans are structs (start, rank, end, kind, value), sorted by start.
    """
    packed = docs.select(F.struct("*").alias("doc"), text_or_empty(text).alias("body"))
    assign = F.filter(spans.find("body", ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    assign = F.when(F.col("body").rlike("(?i)passw|secret|token|api_?key"), assign).otherwise(F.array().cast(spans.SPAN))
    base = F.concat(
        spans.tagged("assign", 0, assign),
        spans.tagged("access", 1, spans.find("body", ACCESS, "AKIA")),
        spans.tagged("hex", 2, spans.find("body", HEX)),
    )
    found = packed.withColumns({"base": F.array_sort(base), "candidates": spans.find("body", CANDIDATE)}).withColumn("apart", spans.apart("candidates", "base"))
    judged = F.expr(f"transform(apart, c -> named_struct('start', c.start, 'end', c.end, 'value', c.value, 'kind', {_class_of('c.value')}))")
    names = [name for name, _, _ in (*CLASSES, LETTERS)]
    rank = lambda kind: 2 + F.array_position(F.array(*map(F.lit, names)), kind).cast("int")
    added = F.transform(
        F.filter(judged, lambda s: s["kind"].isNotNull()),
        lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")),
    )
    return found.withColumn("added", added).drop("candidates", "apart")


def scan(docs: DataFrame, text: str = "text", base: str = "secret_base", added: str = "secret_added") -> DataFrame:
    """``docs`` with the rules' spans and those that the method adds, in columns of these names."""
    return _scanned(docs, text).select("doc.*", F.col("base").alias(base), F.col("added").alias(added))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: the counts by rule, a digest of the rules' spans, and all spans."""
    found = _scanned(docs.select("doc_id", "text"), "text")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc.doc_id",
        *map(number, ("assign", "access", "hex")),
        sha256_hex(F.encode(spans.joined(F.col("base")), "UTF-8")).alias("base_sha256"),
        spans.joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``[SECRET]``; overlapping spans give one mark."""
    mark = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("[SECRET]").alias("mark"))
    found = _scanned(docs, text).withColumn("marks", F.transform(F.concat("base", "added"), mark))
    cleaned = F.when(F.size("marks") > 0, spans.replaced("body", "marks")).otherwise(F.col(f"doc.`{text}`"))
    return found.select(*(F.col(f"doc.`{name}`") if name != text else cleaned.alias(text) for name in docs.columns))


def _sql_pattern(pattern: str) -> str:
    """The pattern without possessive repeats, which change nothing but the effort."""
    return pattern.replace("]++", "]+").replace("]*+", "]*").replace(")*+", ")*").replace("}+", "}").replace("'", "''")


def digest_sql() -> str:
    folded = ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api")) + "_?[kK][eE][yY]")
    assign = _sql_pattern(folded)
    tag = lambda found, kind, rank, keep: f"list_transform(list_filter({found}, lambda s: {keep}), lambda s: {{'start': s.start, 'rank': {rank}, 'stop': s.start + length(s.value), 'kind': '{kind}', 'value': s.value}})"
    allowed = " OR ".join(f"regexp_full_match(s.value, '{_sql_pattern(p)}')" for p in ALLOWED)
    entropy = f"list_max(list_transform(range(1, length(s.value) - {WINDOW} + 2), lambda j: list_aggregate(string_split(substring(s.value, j, {WINDOW}), ''), 'entropy')))"
    (hex_kind, hex_chars, hex_least), (kind, _, least) = CLASSES
    is_hex = f"regexp_full_match(s.value, '{_sql_pattern(hex_chars)}')"
    joined = lambda found: f"array_to_string(list_transform({found}, lambda s: s.kind || ':' || s.start || ':' || s.stop), ',')"
    number = lambda kind: f"CAST(len(list_filter(base, lambda s: s.kind = '{kind}')) AS BIGINT) AS n_{kind}"
    return f"""WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
rules AS (SELECT doc_id, body, list_sort(list_concat(
    {tag(spans.find_sql('body', assign), 'assign', 0, f"length(regexp_extract(s.value, '{assign}', 2)) >= {ASSIGN_LEAST}")},
    {tag(spans.find_sql('body', _sql_pattern(ACCESS)), 'access', 1, 'true')},
    {tag(spans.find_sql('body', _sql_pattern(HEX)), 'hex', 2, 'true')})) AS base FROM bodies),
fresh AS (SELECT *, list_filter({spans.find_sql('body', _sql_pattern(CANDIDATE))}, lambda s: NOT ({allowed})
    AND len(list_filter(base, lambda o: o.start < s.start + length(s.value) AND s.start < o.stop)) = 0) AS candidates FROM rules),
judged AS (SELECT *, list_concat(
    {tag('candidates', hex_kind, 3, f"{is_hex} AND {entropy} >= {hex_least}")},
    {tag('candidates', kind, 4, f"NOT {is_hex} AND {entropy} >= {least}")}) AS added FROM fresh)
SELECT doc_id, {number('assign')}, {number('access')}, {number('hex')}, sha256({joined('base')}) AS base_sha256,
    {joined('list_sort(list_concat(base, added))')} AS spans, CAST(len(added) AS BIGINT) AS n_entropy FROM judged"""
