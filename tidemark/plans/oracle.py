"""The queries of ``plans.queries`` in SQL."""

from __future__ import annotations

from tidemark.operators.digest import PRIME
from tidemark.plans.queries import HEADER_BYTES, SHARD, SPLIT, SPLITS

_READS = """
made AS (SELECT *,
  concat('RUN', CAST(l_suppkey AS VARCHAR), ':', CAST(l_orderkey AS VARCHAR), ':', CAST(l_linenumber AS VARCHAR)) AS qname,
  CASE WHEN l_suppkey % 10 = 0 THEN '*' ELSE concat('chr', CAST(l_suppkey % 10 AS VARCHAR)) END AS rname,
  CASE WHEN l_partkey % 7 = 0 THEN '*' WHEN l_partkey % 3 = 0 THEN '=' ELSE concat('chr', CAST(l_partkey % 11 AS VARCHAR)) END AS rnext,
  CAST(l_partkey AS BIGINT) AS pos, CAST(floor(l_quantity) AS INT) - 1 AS mapq FROM lineitem),
reads AS (SELECT qname, rname, rnext, pos, mapq, CAST(length(qname) + length(rname) + length(rnext) + 40 AS BIGINT) AS size,
  CAST(row_number() OVER w AS BIGINT) AS src_ord,
  CAST(sum(length(qname) + length(rname) + length(rnext) + 40) OVER w AS BIGINT) AS src_end
  FROM made WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)),
refs AS (SELECT CAST(i - 1 AS INT) AS ref_idx, concat('chr', CAST(i AS VARCHAR)) AS ref_name FROM range(1, 9) t(i))"""

_NAME_KEY = """coalesce(try_cast(substring(regexp_replace(CASE WHEN regexp_matches(qname, '[A-Za-z]')
  THEN regexp_extract(qname, '^.*[A-Za-z](.*)$', 1) ELSE substring(qname, 2) END, '[^0-9]', '', 'g'), 1, 16) AS BIGINT), 0)"""


def _routed(layout: str, q: int = 0, key: str = "pos", separate: bool = False) -> str:
    """CTEs up to ``routed``."""
    if layout == "single":
        bucket = "CASE WHEN r.ref_idx IS NOT NULL THEN rname ELSE 'unmapped' END"
    else:
        apart = "'discordant'" if separate else "rname"
        bucket = f"""CASE WHEN r.ref_idx IS NOT NULL AND (rnext = '=' OR rnext = rname) THEN rname
          WHEN r.ref_idx IS NOT NULL AND m.ref_idx IS NOT NULL THEN {apart}
          WHEN rname = '*' AND m.ref_idx IS NOT NULL THEN rnext
          WHEN r.ref_idx IS NOT NULL AND rnext = '*' THEN rname ELSE 'unmapped' END"""
    return f"""WITH {_READS},
placed AS (SELECT reads.*, {bucket} AS bucket, {key} AS own_key FROM reads
  LEFT JOIN refs r ON rname = r.ref_name LEFT JOIN refs m ON rnext = m.ref_name),
routed AS (SELECT *, CASE bucket WHEN 'unmapped' THEN 9 WHEN 'discordant' THEN 8 ELSE CAST(substring(bucket, 4) AS INT) - 1 END AS bucket_idx,
  CASE WHEN bucket = 'unmapped' THEN 0 ELSE own_key END AS key FROM placed WHERE bucket = 'unmapped' OR mapq >= {q})"""


def _ranked(layout: str, q: int = 0, key: str = "pos") -> str:
    return _routed(layout, q, key) + """,
ranked AS (SELECT *, CAST(row_number() OVER w AS BIGINT) AS dest_rank, CAST(sum(size) OVER w AS BIGINT) AS dest_end
  FROM routed WINDOW w AS (PARTITION BY bucket ORDER BY key, src_ord ROWS UNBOUNDED PRECEDING))"""


_CLASSES = "SELECT bucket, bucket_idx, rname, rnext, count(*) AS n_records, CAST(sum(key) AS BIGINT) AS sum_key, CAST(sum(size) AS BIGINT) AS n_bytes FROM routed GROUP BY ALL"
_OUT = "SELECT bucket, dest_rank, dest_end, qname, pos, mapq, key FROM ranked"


def _round_trip(merged: bool) -> str:
    """Line sizes as written: eleven fields, ten tabs, one line feed."""
    file = "'source_sorted'" if merged else "bucket"
    group = "" if merged else "PARTITION BY bucket "
    return _routed("paired", 20) + f""",
lines AS (SELECT *, CAST(length(qname) + 1 + length(rname) + length(CAST(pos AS VARCHAR)) + length(CAST(mapq AS VARCHAR)) + 3 + length(rnext) + 1 + 1 + 10 + 10 + 11 AS BIGINT) AS bytes FROM routed)
SELECT {file} AS file, CAST(coalesce(sum(bytes) OVER ({group}ORDER BY bucket_idx, key, src_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place,
  bytes AS size, qname, rname, pos, mapq, rnext FROM lines"""


_LINES = _routed("paired", 20) + """,
lines AS (SELECT *, concat_ws(chr(9), qname, '0', rname, CAST(pos AS VARCHAR), CAST(mapq AS VARCHAR), '10M', rnext, '0', '0', 'ACGTACGTAC', 'FFFFFFFFFF') AS line FROM routed),
sized AS (SELECT *, CAST(length(line) + 1 AS BIGINT) AS bytes, CAST('0x' || substr(sha256(line), 1, 12) AS BIGINT) AS h FROM lines)"""


def _digests(file: str, group: str) -> str:
    """CTEs up to ``digests``, one row a file."""
    return f"""{_LINES},
spread AS (SELECT *, {file} AS file, CAST(coalesce(sum(bytes) OVER ({group}ORDER BY bucket_idx, key, src_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS place FROM sized),
digests AS (SELECT file, count(*) AS n_records, CAST(sum(bytes) AS BIGINT) AS n_bytes, CAST(sum(CAST(h AS HUGEINT)) % {PRIME} AS BIGINT) AS sum_hash,
  CAST(sum((CAST(h AS HUGEINT) * place) % {PRIME}) % {PRIME} AS BIGINT) AS placed_hash FROM spread GROUP BY file)"""


SQL: dict[str, str] = {
    "scan_records": f"WITH {_READS} SELECT src_ord, src_end - size AS src_offset, size, qname, rname, pos, mapq, rnext FROM reads",
    "header_refs": "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS ref_idx, replace(n_name, ' ', '_') AS ref_name FROM nation",
    "filter_mapq": f"WITH {_READS} SELECT qname, rname, pos, mapq FROM reads WHERE mapq >= 20 OR rname = '*'",
    "route_single": f"{_routed('single')} {_CLASSES}",
    "route_single_q20": f"{_routed('single', 20)} {_CLASSES}",
    "route_paired": f"{_routed('paired')} {_CLASSES}",
    "route_paired_q20": f"{_routed('paired', 20)} {_CLASSES}",
    "route_uniq": f"WITH {_READS} SELECT 'chr1' AS bucket, 0 AS bucket_idx, rname, rnext, count(*) AS n_records, CAST(sum(pos) AS BIGINT) AS sum_key, CAST(sum(size) AS BIGINT) AS n_bytes FROM reads WHERE mapq >= 20 GROUP BY rname, rnext",
    "route_discordant_separate": f"{_routed('paired', 20, separate=True)} {_CLASSES}",
    "unmapped_in_order": f"{_ranked('paired')} SELECT dest_rank, dest_end, src_ord, qname FROM ranked WHERE bucket = 'unmapped'",
    "name_key": f"WITH {_READS} SELECT qname, {_NAME_KEY} AS key FROM reads",
    "coord_sort_single": f"{_ranked('single', 20)} {_OUT}",
    "coord_sort_paired": f"{_ranked('paired', 20)} {_OUT}",
    "coord_sort_events": """WITH routed AS (
  SELECT concat('EV:', CAST(user_id AS VARCHAR), ':', CAST(event_id AS VARCHAR)) AS qname, event_type AS bucket,
    CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS pos, CAST(least(floor(abs(value)), 254) AS INT) AS mapq,
    CAST(length(props) + 40 AS BIGINT) AS size, event_id AS src_ord FROM events)
SELECT bucket, CAST(row_number() OVER w AS BIGINT) AS dest_rank, CAST(sum(size) OVER w AS BIGINT) AS dest_end, qname, pos, mapq, pos AS key
FROM routed WHERE mapq >= 5 WINDOW w AS (PARTITION BY bucket ORDER BY pos, src_ord ROWS UNBOUNDED PRECEDING)""",
    "name_sort_paired": f"{_ranked('paired', 20, _NAME_KEY)} {_OUT}",
    "merged_order": _routed("paired", 20) + """
SELECT bucket, CAST(row_number() OVER w AS BIGINT) AS dest_rank, CAST(sum(size) OVER w AS BIGINT) AS dest_end, qname, pos, mapq, key
FROM routed WINDOW w AS (ORDER BY bucket_idx, key, src_ord ROWS UNBOUNDED PRECEDING)""",
    "dest_offsets": f"{_ranked('paired')} SELECT bucket, src_ord, dest_end - size AS dest_offset, size FROM ranked",
    "document_offsets": """SELECT source AS bucket, CAST(row_number() OVER w AS BIGINT) AS dest_rank, CAST(sum(n_chars + 1) OVER w AS BIGINT) AS dest_end,
  concat('D', CAST(doc_id AS VARCHAR)) AS qname, CAST(n_chars + 1 AS BIGINT) AS size
FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)""",
    "shard_prefix_sum": f"""{_ranked('paired')},
shards AS (SELECT bucket_idx, bucket, CAST((dest_rank - 1) // {SHARD} AS BIGINT) AS shard, count(*) AS shard_rows, CAST(sum(size) AS BIGINT) AS shard_bytes FROM ranked GROUP BY ALL)
SELECT *, CAST(coalesce(sum(shard_bytes) OVER (PARTITION BY bucket_idx ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shard_offset FROM shards""",
    "byte_range_splits": f"""WITH {_READS},
lines AS (SELECT {HEADER_BYTES} + src_end - size AS start, size FROM reads),
file AS (SELECT {HEADER_BYTES} + sum(size) AS bytes FROM lines),
probes AS (SELECT i, CASE WHEN i = 0 THEN -1 ELSE {HEADER_BYTES} + i * (bytes // {SPLITS}) END AS probe FROM file, range({SPLITS}) t(i)),
bounds AS (SELECT i, min(start) AS bound FROM probes, lines WHERE start > probe GROUP BY i),
split AS (SELECT start, size, max(i) AS i FROM lines JOIN bounds ON bound <= start GROUP BY start, size)
SELECT CAST(i AS BIGINT) AS split, CAST(min(start) AS BIGINT) AS begins, CAST(max(start + size) AS BIGINT) AS ends, count(*) AS n_records, CAST(sum(size) AS BIGINT) AS n_bytes FROM split GROUP BY i""",
    "count_per_ref": f"{_routed('paired', 20)} SELECT bucket_idx, bucket, count(*) AS n_records FROM routed GROUP BY ALL",
    "count_total": f"{_routed('paired', 20)} SELECT count(*) AS n_records FROM routed",
    "bytes_per_ref": f"{_routed('paired', 20)} SELECT bucket_idx, bucket, count(*) AS n_records, CAST(sum(size) AS BIGINT) AS n_bytes, max(size) AS longest FROM routed GROUP BY ALL",
    "max_per_split": f"""{_routed('paired', 20)},
counts AS (SELECT bucket_idx, bucket, (src_ord - 1) // {SPLIT} AS split, count(*) AS n FROM routed GROUP BY ALL)
SELECT bucket_idx, bucket, max(n) AS most_records FROM counts GROUP BY ALL""",
    "first_split_with_data": f"{_routed('paired', 20)} SELECT bucket_idx, bucket, CAST(min((src_ord - 1) // {SPLIT}) AS BIGINT) AS first_split FROM routed GROUP BY ALL",
    "exchange_matrix": f"{_ranked('paired')} SELECT CAST((src_ord - 1) // {SPLIT} AS BIGINT) AS from_split, bucket_idx, CAST((dest_rank - 1) // {SPLIT} AS BIGINT) AS to_shard, count(*) AS n_records, CAST(sum(size) AS BIGINT) AS n_bytes FROM ranked GROUP BY ALL",
    "sortedness_violations": f"{_ranked('paired')} SELECT bucket_idx, bucket, count(*) AS n_records, CAST(0 AS BIGINT) AS violations FROM ranked GROUP BY ALL",
    "known_refs_semi": f"WITH {_READS} SELECT rname, count(*) AS n_records FROM reads WHERE rname IN (SELECT ref_name FROM refs) GROUP BY rname",
    "unknown_refs_anti": f"WITH {_READS} SELECT rname, count(*) AS n_records FROM reads WHERE rname <> '*' AND rname NOT IN (SELECT ref_name FROM refs) GROUP BY rname",
    "header_repeated_refs": """WITH refs AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INT) AS ref_idx, replace(p_type, ' ', '_') AS ref_name FROM part)
SELECT ref_name, count(*) AS times, min(ref_idx) AS first_idx FROM refs GROUP BY ref_name HAVING count(*) > 1""",
    "route_large_dictionary": """WITH refs AS (SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INT) AS ref_idx, replace(c_name, ' ', '_') AS ref_name FROM customer),
reads AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN '*' WHEN o_orderkey % 13 = 0 THEN 'nobody' ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS rname,
  CASE WHEN o_orderkey % 7 = 0 THEN '*' WHEN o_orderkey % 3 = 0 THEN 'Customer#' || lpad(CAST(o_custkey + 1 AS VARCHAR), 9, '0') ELSE '=' END AS rnext,
  CAST(floor(o_totalprice) AS BIGINT) AS pos, CAST(o_orderkey % 60 AS INT) AS mapq FROM orders),
placed AS (SELECT pos, mapq, r.ref_idx AS own, m.ref_idx AS mate, rname, rnext FROM reads LEFT JOIN refs r ON rname = r.ref_name
  LEFT JOIN refs m ON CASE WHEN rnext = '=' THEN rname ELSE rnext END = m.ref_name),
routed AS (SELECT pos, mapq, CASE WHEN own IS NOT NULL AND (mate IS NOT NULL OR rnext = '*') THEN own WHEN rname = '*' THEN mate END AS idx FROM placed)
SELECT coalesce(ref_name, 'unmapped') AS bucket, coalesce(idx, CAST((SELECT count(*) + 1 FROM refs) AS INT)) AS bucket_idx, count(*) AS n_records,
  CAST(sum(CASE WHEN idx IS NULL THEN 0 ELSE pos END) AS BIGINT) AS sum_key, CAST(count(*) * 50 AS BIGINT) AS n_bytes
FROM routed LEFT JOIN refs ON idx = ref_idx WHERE idx IS NULL OR mapq >= 20 GROUP BY ALL""",
    "resource_estimate": """WITH sizes AS (SELECT p_partkey, CAST(p_size * 8 AS DOUBLE) * CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 2.5 END AS mem_gb FROM part),
counted AS (SELECT *, CAST(ceil(mem_gb / 128) AS BIGINT) AS nodes, CAST(ceil(mem_gb / 4) AS BIGINT) AS cores FROM sizes),
powers AS (SELECT *, CAST(pow(2, floor(log2(cores))) AS BIGINT) AS pow2_cores FROM counted)
SELECT *, round(mem_gb / pow2_cores, 1) AS mem_per_core, CAST(ceil(pow2_cores / nodes) AS BIGINT) AS cores_per_node FROM powers""",
    "sam_roundtrip": _round_trip(False),
    "bgzf_roundtrip": _round_trip(False),
    "bam_roundtrip": _round_trip(False),
    "command_roundtrip": _round_trip(False),
    "merged_roundtrip": _round_trip(True),
    "late_roundtrip": _round_trip(False),
    "parts_roundtrip": f"{_routed('paired', 20)} SELECT bucket, qname, rname, pos, mapq, rnext FROM routed",
    "source_scan": f"""WITH {_READS},
lines AS (SELECT *, CAST(length(concat_ws(chr(9), qname, '0', rname, CAST(pos AS VARCHAR), CAST(mapq AS VARCHAR), '10M', rnext, '0', '0', 'ACGTACGTAC', 'FFFFFFFFFF')) + 1 AS BIGINT) AS bytes FROM reads),
placed AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY src_ord ROWS UNBOUNDED PRECEDING) - bytes AS BIGINT) AS place FROM lines)
SELECT place, bytes AS size, qname, rname, pos, mapq FROM placed WHERE mapq >= 30 AND rname IN ('chr1', 'chr2')""",
    "virtual_fetch": f"{_routed('paired', 20)} SELECT qname, rname, pos, mapq, rnext FROM routed WHERE pos % 5 = 0",
    "bucket_region": f"{_routed('paired', 20)} SELECT qname, rname, pos, mapq, rnext FROM routed WHERE bucket = 'chr3'",
    "written_files": f"{_digests('bucket', 'PARTITION BY bucket ')} SELECT *, CAST(0 AS BIGINT) AS violations FROM digests",
    "merged_digest": f"{_digests(chr(39) + 'merged' + chr(39), '')} SELECT what, n_records, n_bytes, sum_hash, placed_hash FROM digests, (VALUES ('merged file'), ('files of buckets')) t(what)",
}
