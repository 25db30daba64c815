"""Steps whose work once grew faster than their input, or was done more often than needed."""

import contextlib
import io
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.order import range_bounds, range_of, running, total_order, with_range
from tidemark.plans import files, fixtures
from tidemark.plans.queries import QUERIES
from tidemark.sources.sam import read_lines

FOLDER = Path(os.environ.get("TIDEMARK_TESTDATA", "/root/testdata"), "sf0.001")


def told(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("parts", [1, 2, 3, 8, 33])
def test_compiled_search_gives_the_same_ranges(spark, parts):
    df = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).cast("int").alias("a"), F.concat(F.lit("k"), F.col("id") * 37 % 1001).alias("b"), F.col("id").cast("double").alias("c"))
    by = ["a", "b", "c"]
    bounds = range_bounds(df, by, parts)
    found = with_range(df, by, bounds).withColumn("other", range_of(df, by, bounds))
    assert found.columns == [*df.columns, "run_part", "other"]
    assert found.filter("run_part is distinct from other").count() == 0
    assert found.select("run_part").distinct().count() == len(bounds) + 1 == parts


def test_search_is_not_interpreted(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.lit(0).alias("bucket_idx"), F.col("id").alias("key"), F.col("id").alias("src_offset"), F.lit(1).alias("size"))
    assert "lambda" not in told(running(df, ["g"], ["key"], "size", partitions=4)) + told(total_order(df, partitions=4))


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["scan_records", "shard_prefix_sum", "byte_range_splits", "first_split_with_data", "max_per_split", "sam_roundtrip"])
def test_records_used_once_are_not_written_down(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("the records were written down")

    monkeypatch.setattr(fixtures, "write_down", never)
    assert QUERIES[name](spark, str(FOLDER)).count() > 0


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
def test_merged_digest_writes_its_source_once(spark, monkeypatch):
    made, write = [], files.write_source
    monkeypatch.setattr(files, "write_source", lambda *a, **k: made.append(a) or write(*a, **k))
    rows = files.merged_digest(spark, str(FOLDER)).drop("what").collect()
    assert len(made) == 1 and len(rows) == 2 and rows[0] == rows[1]


def test_names_of_files_without_patterns(spark):
    df = spark.createDataFrame([("file:///a.b/c/out-1/chr1.alt.gz",), ("/x/unmapped.sam",), ("chr2.bam",)], "file string")
    assert [r[0] for r in df.select(files._named()).collect()] == ["chr1.alt", "unmapped", "chr2"]
    assert df.select(files._folder()).first()[0] == "out-1"
    assert "regexp" not in told(df.select(files._named(), files._folder()))


def test_ranges_grow_with_the_file(tmp_path):
    sizes = []
    for mb in (1, 160, 100_000):
        with open(path := tmp_path / f"{mb}", "wb") as file:
            file.truncate(mb * 1_000_000)
        sizes.append(files._split(str(path)))
    assert sizes[0] == files.SMALL_SPLIT and sizes[1] == 2_500_000 and sizes[2] == files.SPLIT


def test_rows_of_a_plain_file_are_numbered_in_its_order_without_python(spark, tmp_path):
    head = "@HD\tVN:1.0\n@SQ\tSN:chr1\tLN:9\n"
    with open(path := str(tmp_path / "reads.sam"), "w") as file:
        file.write(head + "".join(f"{'@' * (i == 5)}{i:06}\n" for i in range(30_000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        lines, _, _ = read_lines(spark, path, exact=False)
        assert lines.rdd.getNumPartitions() > 8 and "ArrowEvalPython" not in told(lines)
        rows = lines.orderBy("src_offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r.in_header for r in rows[:9]] == [True] * 2 + [False] * 7 and not any(r.in_header for r in rows[9:])
    assert [int(r.line.lstrip("@")) for r in rows[2:]] == list(range(30_000))
