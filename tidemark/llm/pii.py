"""Personal data by rules, and terms that give it away by corpus co-occurrence; SQL functions only.

Four rules find e-mail addresses, IP addresses, card numbers and phone numbers.
Each distinct value is a protected entity, and so is the class of a value, which
says part of it: the domain of an address, the network of an IP address, the
issuer of a card, the area of a phone number.  Beyond the values, any word of a
text that holds one may give an entity away.  Counted over the documents of the
corpus, N in all, with df(e) that hold an entity, df(t) that hold a term and n
that hold both,

    IC(e) = log2(N / df(e))              what knowing the entity would tell,
    PMI(t, e) = log2(n N / (df(t) df(e)))  what the term tells of the entity,

and PMI / IC is the share of the entity that the term discloses (as in the
C-sanitized model of Sanchez and Batet).  In the texts of the entity, each
occurrence of a term at ``GENERALISE`` or more is generalised to its shape, at
``REMOVE`` or more it is removed.  A pair must be held by ``SUPPORT`` documents
whose texts aren't all the same; a value that stands in fewer is protected by
its class alone.

All counts are partial aggregations.  Texts are never shuffled: only those that
hold a value are written down with their words.  PMI and IC depend on nothing but
the sets of documents that hold the entity and the term, so pairs are counted of
different sets (told apart by 128 bits of hashes), not of entities and terms.  Defined results: a null or empty
text has no spans and the digest of the empty string (``sanitise`` leaves it as
it is); repeated rows give repeated results; rows may lack or repeat ids; other
columns, whatever their names, are kept by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans
from tidemark.llm.common import cut, cut_small, sha256_hex, small, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: A match can only begin where a run of its first characters begins, or right after another match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 16 to 19 digits; a shorter or longer run is matched as a whole and fails.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}+"
#: Documents that an entity, and a pair of term and entity, need; their texts must differ.
SUPPORT = 3
GENERALISE, REMOVE = 0.75, 0.95
#: First digits of a card or a phone number that say its issuer or area.
ISSUER, AREA = 6, 5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def _valid_ip(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", ""))
    return F.forall(parts, lambda part: (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255")))


def base_spans(text: str) -> Column:
    """The rules' spans of a column as structs (rank, start, end, kind, value), by kind, then by start."""
    email = spans.find(text, EMAIL, "@")
    ip = F.filter(spans.find(text, IP, "."), lambda s: _valid_ip(s["value"]))
    card = F.filter(spans.find(text, CARD), lambda s: luhn(_digits(s["value"])))
    phone = F.filter(spans.find(text, PHONE, "+"), lambda s: F.length(_digits(s["value"])).between(8, 15))
    return F.concat(*(spans.ranked(kind, i, found) for i, (kind, found) in enumerate(zip(KINDS, (email, ip, card, phone)))))


def _entities(base: Column) -> Column:
    """The values of spans and their classes, as distinct strings with their kind before them (distinct strings are told by hashing, structs would be compared in pairs)."""

    def value(s: Column) -> Column:
        return F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"]))

    def class_of(s: Column) -> Column:
        digits = F.substring(_digits(s["value"]), F.lit(1), F.when(s["kind"] == "card", F.lit(ISSUER)).otherwise(F.lit(AREA)))
        return F.when(s["kind"] == "email", F.substring_index(F.lower(s["value"]), "@", -1)).when(s["kind"] == "ip", F.substring_index(s["value"], ".", 3)).otherwise(digits)

    values = F.transform(base, lambda s: F.concat(s["kind"], F.lit(":"), value(s)))
    classes = F.transform(base, lambda s: F.concat(s["kind"], F.lit(" class:"), class_of(s)))
    return F.array_distinct(F.concat(values, classes))


def _bodies(docs: DataFrame, text: str) -> DataFrame:
    """The rows, packed in ``doc`` so that no name can clash, with the ``body``, its hash ``same`` and the rules' spans ``base``."""
    packed = docs.select(F.struct("*").alias("doc"), text_or_empty(text).alias("body"))
    return packed.withColumn("same", F.xxhash64("body")).withColumn("base", base_spans("body"))


def _written(bodies: DataFrame, *kept: str) -> DataFrame:
    """``kept``, ``same``, ``base``, a number ``row``, and where there are spans the ``words`` outside them and the ``entities``."""
    found = bodies.withColumn("words", F.when(F.size("base") > 0, spans.find("body", TERM))).withColumn("entities", F.when(F.size("base") > 0, _entities(F.col("base"))))
    return cut(found.select(*kept, "same", "base", F.monotonically_increasing_id().alias("row"), spans.apart("words", "base").alias("words"), "entities"))


def _standing(listed: DataFrame, name: str, to: str) -> DataFrame:
    """What stands in ``SUPPORT`` rows or more whose texts differ, the number of these rows, and a number for each set of rows.

    Sets are told apart by two hashes; their numbers are small and shuffle well.
    """
    sets = [F.bit_xor(F.xxhash64("row", F.lit(seed))).alias(f"set{seed}") for seed in (1, 2)]
    counted = listed.groupBy(name).agg(F.count("*").alias("rows"), (F.min("same") != F.max("same")).alias("varied"), *sets)
    counted = cut_small(counted.filter((F.col("rows") >= SUPPORT) & F.col("varied")).drop("varied"))
    numbered = cut_small(counted.select("set1", "set2").distinct().withColumn(to, F.monotonically_increasing_id()))
    return small(cut_small(counted.join(small(numbered), ["set1", "set2"]).drop("set1", "set2")))


def _disclosing(bodies: DataFrame, found: DataFrame) -> DataFrame:
    """Per ``row`` with such: its disclosing terms as sorted structs (start, end, share, value).

    Entities that stand in the same rows disclose and are disclosed alike, and so
    do terms: what is counted are pairs of sets ``e`` and ``t``, so that a long list
    of addresses in a few copies is one set of entities and not the product of its
    values and its words.
    """
    holding = found.filter(F.size("base") > 0)
    listed = holding.select("row", "same", F.explode("entities").alias("entity"))
    live = _standing(listed, "entity", "e").withColumnRenamed("rows", "df_e")
    held = cut_small(listed.join(live, "entity").groupBy("row").agg(F.collect_set(F.struct("e", "df_e")).alias("held")))
    worded = holding.select("row", "same", "words").join(small(held), "row")
    each = worded.select("row", "same", "held", F.explode(F.array_distinct(F.transform("words", lambda w: F.lower(w["value"])))).alias("term"))
    terms = _standing(each, "term", "t").drop("rows")
    placed = cut_small(each.join(terms, "term").select("row", "term", "t"))
    groups = placed.groupBy("row").agg(F.collect_set("t").alias("ts"))  # bounded by the text
    both = groups.join(holding.select("row", "same").join(small(held), "row"), "row").select("same", F.explode("held").alias("h"), "ts").select("same", "h.*", F.explode("ts").alias("t"))
    pairs = both.groupBy("e", "df_e", "t").agg(F.count("*").alias("n"), (F.min("same") != F.max("same")).alias("varied"))
    pairs = cut_small(pairs.filter((F.col("n") >= SUPPORT) & F.col("varied")).drop("varied"))
    total = bodies.count()

    every = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("body", F.lit(TERM), F.lit(0))), lambda w: F.lower(w)))
    wanted = small(cut_small(terms.join(small(cut_small(pairs.select("t").distinct())), "t")))
    counted = bodies.select(F.explode(every).alias("term")).join(wanted.select("term"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df_t"))
    counted = small(cut_small(counted.join(wanted, "term")))
    known = pairs.filter(F.col("df_e") < total).join(counted.select("t", "df_t").distinct(), "t")
    ratio = F.log2(F.col("n") * float(max(total, 1)) / (F.col("df_t") * F.col("df_e"))) / F.log2(float(max(total, 1)) / F.col("df_e"))
    known = small(cut_small(known.select("e", "t", "df_t", F.round(ratio, 9).alias("share")).filter(F.col("share") >= GENERALISE)))

    shares = held.select("row", F.explode("held.e").alias("e")).join(known, "e").groupBy("row", "t", "df_t").agg(F.max("share").alias("share"))
    shares = placed.join(counted.select("term", "df_t"), "term").join(small(cut_small(shares)), ["row", "t", "df_t"]).select("row", "term", "share")
    shares = small(cut_small(shares))
    spread = worded.select("row", F.explode("words").alias("w")).select("row", "w.*", F.lower("w.value").alias("term"))
    return spread.join(shares, ["row", "term"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share", "value"))).alias("terms"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: the counts by rule, a digest of the rules' spans, and all spans."""
    bodies = _bodies(docs.select("doc_id", "text"), "text")
    found = _written(bodies, "doc.doc_id")
    joined = found.select("doc_id", "row", "base").join(_disclosing(bodies, found), "row", "left")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = F.coalesce(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string"))), F.array().cast("array<string>"))
    based = spans.joined(F.col("base"))
    return joined.select(
        "doc_id",
        *map(number, KINDS),
        sha256_hex(F.encode(based, "UTF-8")).alias("base_sha256"),
        F.concat_ws(",", F.when(based != "", based), F.when(F.size(added) > 0, F.array_join(added, ","))).alias("spans"),
        F.size(added).cast("long").alias("n_term"),
    )


def _shape(value: Column) -> Column:
    return F.when(value.rlike("[0-9]"), "[CODE]").when(value.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by its kind, and disclosing terms generalised or removed."""
    bodies = _bodies(docs, text)
    found = _written(bodies.filter(F.size("base") > 0), "doc", "body")
    joined = found.select("doc", "body", "base", "row").join(_disclosing(bodies, found), "row", "left")
    values = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["share"] >= REMOVE, F.lit("")).otherwise(_shape(t["value"])).alias("mark")))
    marked = joined.withColumn("marks", F.when(F.col("terms").isNull(), values).otherwise(F.concat(values, terms)))
    others = [F.col(f"doc.`{name}`") if name != text else spans.replaced("body", "marks").alias(text) for name in docs.columns]
    return bodies.filter(F.size("base") == 0).select("doc.*").unionAll(marked.select(*others))


def digest_sql() -> str:
    digits = "regexp_replace(s.value, '[^0-9]', '', 'g')"
    doubled = f"list_transform(string_split(reverse({digits}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) WHEN d > '4' THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END)"
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(s.value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(right(p, 3) AS INT) > 255)) = 0"),
        (r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND list_sum({doubled}) % 10 = 0"),
        (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
    )
    found = ", ".join(
        f"list_transform(list_filter({spans.find_sql('body', pattern)}, lambda s: {keep}), lambda s: {{'start': s.start, 'stop': s.start + length(s.value), 'kind': '{kind}', 'value': s.value}})"
        for kind, (pattern, keep) in zip(KINDS, rules)
    )
    number = lambda kind: f"CAST(len(list_filter(base, lambda s: s.kind = '{kind}')) AS BIGINT) AS n_{kind}"
    based = "array_to_string(list_transform(base, lambda s: s.kind || ':' || s.start || ':' || s.stop), ',')"
    word = r"[\p{L}\p{N}]+"
    return f"""WITH bodies AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS body FROM documents),
based AS MATERIALIZED (SELECT id, doc_id, body, list_concat({found}) AS base FROM bodies),
mentions AS (SELECT id, body, unnest(base) AS s FROM based),
named AS MATERIALIZED (SELECT DISTINCT id, body, s.kind AS kind, CASE s.kind WHEN 'email' THEN lower(s.value) WHEN 'ip' THEN s.value ELSE {digits} END AS entity FROM mentions
  UNION SELECT id, body, s.kind || ' class', CASE s.kind WHEN 'email' THEN split_part(lower(s.value), '@', 2) WHEN 'ip' THEN regexp_extract(s.value, '^[0-9]+[.][0-9]+[.][0-9]+')
    WHEN 'card' THEN left({digits}, {ISSUER}) ELSE left({digits}, {AREA}) END FROM mentions),
words AS (SELECT id, base, unnest({spans.find_sql('body', word)}) AS t FROM based WHERE len(base) > 0),
placed AS MATERIALIZED (SELECT id, lower(t.value) AS term, t.start AS start, t.start + length(t.value) AS stop FROM words
  WHERE regexp_matches(t.value, '^\\p{{L}}') AND length(t.value) >= 3 AND len(list_filter(base, lambda o: o.start < t.start + length(t.value) AND t.start < o.stop)) = 0),
entities AS (SELECT kind, entity, count(*) AS df_e FROM named GROUP BY ALL HAVING count(*) >= {SUPPORT} AND min(body) <> max(body)),
pairs AS (SELECT kind, entity, term, count(*) AS n FROM named SEMI JOIN entities USING (kind, entity) JOIN (SELECT DISTINCT id, term FROM placed) USING (id)
  GROUP BY ALL HAVING count(*) >= {SUPPORT} AND min(body) <> max(body)),
corpus AS (SELECT DISTINCT id, lower(unnest(list_distinct(regexp_extract_all(body, '{word}')))) AS term FROM bodies),
terms AS (SELECT term, count(*) AS df_t FROM corpus WHERE term IN (SELECT term FROM pairs) GROUP BY term),
known AS (SELECT kind, entity, term FROM pairs JOIN entities USING (kind, entity) JOIN terms USING (term), (SELECT count(*) AS total FROM bodies)
  WHERE df_e < total AND round(log2(n * CAST(total AS DOUBLE) / (df_t * df_e)) / log2(CAST(total AS DOUBLE) / df_e), 9) >= {GENERALISE}),
marked AS (SELECT DISTINCT id, start, stop FROM placed JOIN named USING (id) JOIN known USING (kind, entity, term)),
listed AS (SELECT id, string_agg('term:' || start || ':' || stop, ',' ORDER BY start, stop) AS added, count(*) AS n FROM marked GROUP BY id)
SELECT doc_id, {', '.join(map(number, KINDS))}, sha256({based}) AS base_sha256,
  concat_ws(',', nullif({based}, ''), added) AS spans, CAST(coalesce(n, 0) AS BIGINT) AS n_term FROM based LEFT JOIN listed USING (id)"""
