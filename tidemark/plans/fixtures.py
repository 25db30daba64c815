"""Alignment records made from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.lineage import write_down
from tidemark.operators.order import running

NAMES = [f"chr{i}" for i in range(1, 9)]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def lineitem_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records without a source order, and the columns that give one."""
    line = spark.read.parquet(f"{folder}/lineitem.parquet")
    text = lambda name: F.col(name).cast("string")
    rname = F.when(F.col("l_suppkey") % 10 == 0, "*").otherwise(F.concat(F.lit("chr"), (F.col("l_suppkey") % 10).cast("string")))
    rnext = F.when(F.col("l_partkey") % 7 == 0, "*").when(F.col("l_partkey") % 3 == 0, "=").otherwise(F.concat(F.lit("chr"), (F.col("l_partkey") % 11).cast("string")))
    made = line.select(
        F.concat(F.lit("RUN"), text("l_suppkey"), F.lit(":"), text("l_orderkey"), F.lit(":"), text("l_linenumber")).alias("qname"),
        rname.alias("rname"),
        rnext.alias("rnext"),
        F.col("l_partkey").cast("bigint").alias("pos"),
        (F.floor("l_quantity").cast("int") - 1).alias("mapq"),
        *LINE_ORDER,
    )
    return made.withColumn("size", (F.length("qname") + F.length("rname") + F.length("rnext") + 40).cast("bigint"))


def placed_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Records with ``src_ord``, their place in the source, and ``src_end``, the bytes up to their end, for one pass over them."""
    return running(lineitem_records(spark, folder), [], LINE_ORDER, "size", "src_ord", "src_end").drop(*LINE_ORDER)


def reads_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """The records of ``placed_lineitem``; they stand for a file, whose records have their places, so they are written down once."""
    return write_down(placed_lineitem(spark, folder))


def reads_events(spark: SparkSession, folder: str) -> DataFrame:
    """Records with many equal coordinates; the event id is their source order."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(
        F.concat(F.lit("EV:"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_id").cast("string")).alias("qname"),
        F.col("event_type").alias("rname"),
        F.lit("*").alias("rnext"),
        (F.hour("ts") * 60 + F.minute("ts")).cast("bigint").alias("pos"),
        F.least(F.floor(F.abs("value")), F.lit(254)).cast("int").alias("mapq"),
        (F.length("props") + 40).cast("bigint").alias("size"),
        F.col("event_id").alias("src_ord"),
    )


def reads_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Records of very different sizes; the document id is their source order."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("qname"), F.col("source").alias("rname"), F.lit("*").alias("rnext"),
        F.col("n_chars").alias("pos"), F.lit(60).alias("mapq"), (F.col("n_chars") + 1).cast("bigint").alias("size"), F.col("doc_id").alias("src_ord"),
    )


def reads_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Records of very many references: one for each customer, the mate of every third order on another one, some names unknown."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customer = lambda key: F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))
    own, key = F.col("o_custkey"), F.col("o_orderkey")
    return orders.select(
        F.concat(F.lit("O"), key.cast("string")).alias("qname"),
        F.when(key % 11 == 0, "*").when(key % 13 == 0, "nobody").otherwise(customer(own)).alias("rname"),
        F.when(key % 7 == 0, "*").when(key % 3 == 0, customer(own + 1)).otherwise("=").alias("rnext"),
        F.floor("o_totalprice").cast("bigint").alias("pos"), (key % 60).cast("int").alias("mapq"), F.lit(50).cast("bigint").alias("size"), key.alias("src_ord"),
    )
