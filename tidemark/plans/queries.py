"""Queries of the sorter over the provided tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.header import Header, refs_frame
from tidemark.functions.keys import name_key
from tidemark.functions.resources import estimate
from tidemark.lineage import write_down
from tidemark.operators import stats
from tidemark.operators.dictionary import dictionary, known_refs, repeated_names, unknown_refs
from tidemark.operators.order import dest_ranks, running, shard_offsets
from tidemark.operators.route import quality, route
from tidemark.plans.files import FILES
from tidemark.plans.fixtures import LINE_ORDER, NAMES, lineitem_records, placed_lineitem, reads_documents, reads_events, reads_lineitem, reads_orders

Query = Callable[[SparkSession, str], DataFrame]
SPLIT, SHARD, SPLITS, HEADER_BYTES = 1000, 1000, 8, 100

_RANKED = ("bucket", "dest_rank", "dest_end", "qname", "pos", "mapq", "key")


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    return placed_lineitem(spark, folder).select("src_ord", (F.col("src_end") - F.col("size")).alias("src_offset"), "size", "qname", "rname", "pos", "mapq", "rnext")


def header_refs(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary of a header whose references are the nations."""
    nations = spark.read.parquet(f"{folder}/nation.parquet").orderBy("n_nationkey").select(F.replace("n_name", F.lit(" "), F.lit("_")).alias("name"))
    names = [row.name for row in nations.collect()]  # a header is the driver's own
    return refs_frame(spark, Header(tuple(f"@SQ\tSN:{name}\tLN:1" for name in names)).references())


def filter_mapq(spark: SparkSession, folder: str) -> DataFrame:
    return quality(lineitem_records(spark, folder), 20, F.col("rname") == "*").select("qname", "rname", "pos", "mapq")


def _routed(**options) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        names = NAMES if "uniq" not in options else [options["uniq"]]
        routed = route(lineitem_records(spark, folder), names, **options)
        return routed.groupBy("bucket", "bucket_idx", "rname", "rnext").agg(F.count("*").alias("n_records"), F.sum("key").cast("bigint").alias("sum_key"), F.sum("size").cast("bigint").alias("n_bytes"))

    return query


def _ranked(spark: SparkSession, folder: str, **options) -> DataFrame:
    return dest_ranks(route(reads_lineitem(spark, folder), NAMES, **options))


def _in_order(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Equal keys stay in the order of the source, which the columns of the line have: no place in the source need be known."""
    return dest_ranks(route(lineitem_records(spark, folder), NAMES, **options), *LINE_ORDER)


def _sorted(**options) -> Query:
    return lambda spark, folder: _in_order(spark, folder, **options).select(*_RANKED)


def unmapped_in_order(spark: SparkSession, folder: str) -> DataFrame:
    unmapped = route(placed_lineitem(spark, folder), NAMES, "paired").filter("bucket = 'unmapped'")
    return dest_ranks(write_down(unmapped)).select("dest_rank", "dest_end", "src_ord", "qname")


def names_and_keys(spark: SparkSession, folder: str) -> DataFrame:
    return lineitem_records(spark, folder).select("qname", name_key(F.col("qname")).alias("key"))


def coord_sort_events(spark: SparkSession, folder: str) -> DataFrame:
    routed = route(reads_events(spark, folder), ["click", "error", "purchase", "signup", "view"], min_mapq=5)
    return dest_ranks(routed).select(*_RANKED)


def document_offsets(spark: SparkSession, folder: str) -> DataFrame:
    routed = route(reads_documents(spark, folder), [f"src{i}" for i in range(20)])
    return dest_ranks(routed).select("bucket", "dest_rank", "dest_end", "qname", "size")


def merged_order(spark: SparkSession, folder: str) -> DataFrame:
    routed = route(lineitem_records(spark, folder), NAMES, "paired", min_mapq=20)
    return running(routed, [], ["bucket_idx", "key", *LINE_ORDER], "size").select(*_RANKED)


def dest_offsets(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _ranked(spark, folder, layout="paired")
    return ranked.select("bucket", "src_ord", (F.col("dest_end") - F.col("size")).alias("dest_offset"), "size")


def shard_prefix_sum(spark: SparkSession, folder: str) -> DataFrame:
    return shard_offsets(_in_order(spark, folder, layout="paired"), SHARD)


def byte_range_splits(spark: SparkSession, folder: str) -> DataFrame:
    records = placed_lineitem(spark, folder).withColumn("start", HEADER_BYTES + F.col("src_end") - F.col("size"))
    total = HEADER_BYTES + lineitem_records(spark, folder).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return stats.byte_range_splits(records, "start", HEADER_BYTES, total, SPLITS)


def _counted(count: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: count(route(lineitem_records(spark, folder), NAMES, "paired", min_mapq=20))


def _by_split(count: Callable[[DataFrame, str, int], DataFrame]) -> Query:
    return lambda spark, folder: count(route(placed_lineitem(spark, folder), NAMES, "paired", min_mapq=20), "src_ord", SPLIT)


def exchange_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return stats.exchange_matrix(_ranked(spark, folder, layout="paired"), "src_ord", SPLIT)


def sortedness_violations(spark: SparkSession, folder: str) -> DataFrame:
    return stats.sortedness(write_down(_in_order(spark, folder, layout="paired").select("bucket_idx", "bucket", "dest_rank", "key")), rows=SHARD)


def known_refs_semi(spark: SparkSession, folder: str) -> DataFrame:
    return known_refs(lineitem_records(spark, folder), NAMES).groupBy("rname").agg(F.count("*").alias("n_records"))


def unknown_refs_anti(spark: SparkSession, folder: str) -> DataFrame:
    return unknown_refs(lineitem_records(spark, folder), NAMES).groupBy("rname").agg(F.count("*").alias("n_records"))


def header_repeated_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Names that a header with a line for each part repeats; the parts are named by their type."""
    parts = spark.read.parquet(f"{folder}/part.parquet")
    lines = parts.select(F.concat(F.lit("@SQ\tSN:"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("\tLN:1")).alias("line"), F.col("p_partkey").alias("src_offset"))
    return repeated_names(dictionary(lines))


def route_large_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """A reference for each customer, looked up by shuffle joins, as for dictionaries that are too large to broadcast."""
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    lines = customers.select(F.concat(F.lit("@SQ\tSN:"), F.replace("c_name", F.lit(" "), F.lit("_")), F.lit("\tLN:1")).alias("line"), F.col("c_custkey").alias("src_offset"))
    routed = route(reads_orders(spark, folder), dictionary(lines), "paired", min_mapq=20, broadcast_names=0)
    return routed.groupBy("bucket", "bucket_idx").agg(F.count("*").alias("n_records"), F.sum("key").cast("bigint").alias("sum_key"), F.sum("size").cast("bigint").alias("n_bytes"))


def resource_estimate(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder}/part.parquet")
    sizes = parts.select("p_partkey", (F.col("p_size") * 8).cast("double").alias("size_gb"), F.when(F.col("p_partkey") % 2 == 0, "all").otherwise("one").alias("kind"))
    return sizes.select("p_partkey", *(c.alias(n) for n, c in estimate(F.col("size_gb"), F.col("kind"), 128.0, 32).items()))


QUERIES: dict[str, Query] = {
    "scan_records": scan_records,
    "header_refs": header_refs,
    "filter_mapq": filter_mapq,
    "route_single": _routed(layout="single"),
    "route_single_q20": _routed(layout="single", min_mapq=20),
    "route_paired": _routed(layout="paired"),
    "route_paired_q20": _routed(layout="paired", min_mapq=20),
    "route_uniq": _routed(layout="paired", uniq="chr1", min_mapq=20),
    "route_discordant_separate": _routed(layout="paired", discordant="separate", min_mapq=20),
    "unmapped_in_order": unmapped_in_order,
    "name_key": names_and_keys,
    "coord_sort_single": _sorted(layout="single", min_mapq=20),
    "coord_sort_paired": _sorted(layout="paired", min_mapq=20),
    "coord_sort_events": coord_sort_events,
    "name_sort_paired": _sorted(layout="paired", min_mapq=20, order="queryname"),
    "merged_order": merged_order,
    "dest_offsets": dest_offsets,
    "document_offsets": document_offsets,
    "shard_prefix_sum": shard_prefix_sum,
    "byte_range_splits": byte_range_splits,
    "count_per_ref": _counted(stats.count_per_bucket),
    "count_total": _counted(stats.count_total),
    "bytes_per_ref": _counted(stats.bytes_per_bucket),
    "max_per_split": _by_split(stats.max_per_split),
    "first_split_with_data": _by_split(stats.first_split),
    "exchange_matrix": exchange_matrix,
    "sortedness_violations": sortedness_violations,
    "known_refs_semi": known_refs_semi,
    "unknown_refs_anti": unknown_refs_anti,
    "header_repeated_refs": header_repeated_refs,
    "route_large_dictionary": route_large_dictionary,
    "resource_estimate": resource_estimate,
    **FILES,
}
