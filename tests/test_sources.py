"""The registered source and sink, places of files and blocks, digests, bounds and dictionaries."""

import gzip
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tests.test_records import GOLDEN, HEAD, golden_text, line
from tidemark.operators.dictionary import checked, dictionary, repeated_names
from tidemark.operators.digest import PRIME, file_digests, put_together
from tidemark.operators.order import range_bounds, range_of, running
from tidemark.operators.route import route
from tidemark.plans.sort import sort_sam
from tidemark.sources import bgzf, datasource, places
from tidemark.sources.datasource import SamWriter, pushing, register
from tidemark.sources.sam import parse, read_lines
from tidemark.sources.sink import write_sorted


def lines_text(n, seed=3):
    rng = random.Random(seed)
    tail = lambda: "\tX:" + "é\r"[rng.randrange(2)] * rng.randrange(60)
    return HEAD + "".join(line(f"r{i}", rng.choice(["chr1", "chr2", "*"]), rng.randrange(1, 999), rng.randrange(256), "=", tail() if i % 3 else "") + "\n" for i in range(n))


def packed(text, size=700):
    raw = text.encode()
    return b"".join(bgzf.block(raw[i : i + size]) for i in range(0, len(raw), size)) + bgzf.EOF


def load(spark, path, schema=None, **options):
    register(spark)
    reader = spark.read.format("sam").options(**options)
    return (reader.schema(schema) if schema else reader).load(str(path))


@pytest.mark.parametrize("end", ["\n", ""])
@pytest.mark.parametrize("split", [97, 1000, 1 << 26])
def test_plain_file(spark, tmp_path, split, end):
    text = lines_text(300).removesuffix("\n") + end
    (tmp_path / "a.sam").write_bytes(text.encode())
    found = {r.src_offset: r for r in load(spark, tmp_path / "a.sam", split=split).collect()}
    at, expected = len(HEAD.encode()), {}
    for x in text[len(HEAD) :].removesuffix("\n").split("\n"):
        expected[at] = x
        at += len(x.encode()) + 1
    assert {o: r.line for o, r in found.items()} == expected
    lines, _, _ = read_lines(spark, str(tmp_path / "a.sam"))
    fields = [n for n, _ in datasource.FIELDS] + ["tags", "size", "src_offset"]
    assert sorted(tuple(r) for r in parse(lines).select(fields).collect()) == sorted(tuple(r[n] for n in fields) for r in found.values()) if end else True


@pytest.mark.parametrize("split", [97, 500, 3000, 1 << 26])
def test_block_gzip_by_virtual_offsets(spark, tmp_path, split):
    text = lines_text(200)
    (tmp_path / "a.sam.gz").write_bytes(packed(text[:9000]) + packed(text[9000:]))  # an empty block inside, too
    found = load(spark, tmp_path / "a.sam.gz", split=split).orderBy("src_offset").collect()
    assert [r.line for r in found] == text[len(HEAD) :].split("\n")[:-1]
    table = bgzf.block_table(spark, [str(tmp_path / "a.sam.gz")]).orderBy("place").collect()
    assert sum(r.n_raw for r in table) == len(text.encode()) and [r.raw_place for r in table] == np.r_[0, np.cumsum([r.n_raw for r in table])[:-1]].tolist()
    raw_place = {r.place: r.raw_place for r in table}
    lines, _, _ = read_lines(spark, str(tmp_path / "a.sam.gz"))
    exact = {r.src_offset: r.line for r in lines.filter("not in_header").collect()}
    assert {raw_place[r.src_offset >> 16] + (r.src_offset & 0xFFFF): r.line for r in found} == exact
    fetched = bgzf.fetch(load(spark, tmp_path / "a.sam.gz", "file string, src_offset bigint").withColumnRenamed("src_offset", "voffset"))
    assert {r.voffset: r.line for r in fetched.collect()} == {r.src_offset: r.line for r in found}


def test_places_become_virtual_offsets(spark, tmp_path):
    text = lines_text(3000)
    (tmp_path / "a.gz").write_bytes(packed(text, bgzf.RAW_BLOCK))
    places_ = spark.createDataFrame([(str(tmp_path / "a.gz"), i) for i in range(0, len(text.encode()), 997)], "file string, raw bigint")
    found = bgzf.virtual(places_, bgzf.block_table(spark, [str(tmp_path / "a.gz")])).collect()
    assert len(found) == places_.count()
    data = (tmp_path / "a.gz").read_bytes()
    blocks = dict(bgzf.blocks(data))
    assert all(blocks[r.voffset >> 16][r.voffset & 0xFFFF :][:9] == text.encode()[r.raw : r.raw + 9][: len(blocks[r.voffset >> 16]) - (r.voffset & 0xFFFF)] for r in found)


def test_other_gzip_files_and_folders(spark, tmp_path):
    text = lines_text(50)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text(text)
    (tmp_path / "in" / "b.sam.gz").write_bytes(gzip.compress(text[:900].encode()) + gzip.compress(text[900:].encode()))
    (tmp_path / "in" / "_hidden").write_text("no record")
    assert load(spark, tmp_path / "in").groupBy("line").count().filter("count != 2").count() == 0
    assert load(spark, f"{tmp_path}/in/*.gz").count() == 50
    assert load(spark, f"{tmp_path}/in/*.none").count() == 0
    with pytest.raises(Exception, match="none.sam"):
        load(spark, tmp_path / "none.sam").count()


def test_filters_are_pushed_and_only_wanted_columns_are_cut(spark, tmp_path, capsys):
    (tmp_path / "a.sam").write_text(golden_text())
    with pushing(spark):
        df = load(spark, tmp_path / "a.sam", "qname string, mapq int, rname string", push=True).filter("mapq >= 30 and rname = 'chr1'").select("qname", "mapq")
        df.explain("formatted")
        plan = capsys.readouterr().out
        assert "PushedFilters: [IsNotNull(mapq), IsNotNull(rname), GreaterThanOrEqual(mapq,30), EqualTo(rname,chr1)]" in plan
        assert "ReadSchema: struct<qname:string,mapq:int,rname:string>" in plan and not re.search(r"\bFilter\b", plan)
        assert {r.qname for r in df.collect()} == {g[0] for g in GOLDEN if g[3] >= 30 and g[1] == "chr1"}
    tests = (
        ("pos in (7, 9)", lambda g: g[2] in (7, 9)), ("mapq < 30", lambda g: g[3] < 30), ("pos > 7 and pos <= 50", lambda g: 7 < g[2] <= 50), ("rname in ('*', 'chrZ')", lambda g: g[1] in ("*", "chrZ")),
        ("mapq = 0 or pos = 50", lambda g: g[3] == 0 or g[2] == 50), ("qname like 'r1%'", lambda g: g[0].startswith("r1")), ("true", lambda g: True),
    )
    whole = load(spark, tmp_path / "a.sam")
    for test, keep in tests:
        expected = sorted(g[0] for g in GOLDEN if keep(g))
        assert sorted(r.qname for r in whole.filter(test).collect()) == expected  # one DataFrame for all
        with pushing(spark):
            assert sorted(r.qname for r in load(spark, tmp_path / "a.sam", push=True).filter(test).collect()) == expected
    optional = load(spark, tmp_path / "a.sam", "qname string", min_mapq=40, rname="chr2,chrZ")
    assert sorted(r.qname for r in optional.collect()) == sorted(g[0] for g in GOLDEN if g[3] >= 40 and g[1] in ("chr2", "chrZ"))


def test_malformed_records(spark, tmp_path):
    bad = ["too\tfew", line("a", "chr1", "x", 3, "="), line("b", "chr1", 5, 256, "="), "@late\theader", ""]
    (tmp_path / "a.sam").write_text(golden_text() + "\n".join([*bad, line("good", "chr1", 5, 6, "=", "\ttag\ttags")]))
    found = load(spark, tmp_path / "a.sam", mode="PERMISSIVE").collect()
    assert sorted(r._corrupt for r in found if r._corrupt is not None) == sorted(bad) and len(found) == len(GOLDEN) + 6
    assert [r.tags for r in found if r.qname == "good"] == ["tag\ttags"]
    with pytest.raises(Exception, match="malformed record"):
        load(spark, tmp_path / "a.sam").count()
    with pytest.raises(Exception, match="no such columns"):
        load(spark, tmp_path / "a.sam", "pos string").count()


def test_wrong_input_is_told(spark, tmp_path):
    register(spark)
    rows = spark.createDataFrame([(0, "a", "x")], "bucket_idx int, bucket string, line string")
    with pytest.raises(Exception, match="no such format"):
        rows.write.format("sam").mode("append").option("fmt", "cram").save(str(tmp_path))
    with pytest.raises(Exception, match="columns to write are missing"):
        rows.drop("line").write.format("sam").mode("append").save(str(tmp_path))


def test_header_only_and_empty_files(spark, tmp_path):
    (tmp_path / "h.sam").write_text(HEAD)
    (tmp_path / "e.sam").write_text("")
    (tmp_path / "e.gz").write_bytes(bgzf.EOF)
    for name in ("h.sam", "e.sam", "e.gz"):
        assert load(spark, tmp_path / name).count() == 0


@pytest.mark.parametrize("fmt", ["sam", "bgzf"])
def test_parts_written_by_the_format(spark, tmp_path, fmt):
    (tmp_path / "a.sam").write_text(golden_text())
    register(spark)
    routed = route(load(spark, tmp_path / "a.sam"), ["chr1", "chr2"]).repartition(3, "bucket").sortWithinPartitions("bucket_idx", "key", "src_offset")
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        routed.select("bucket_idx", "bucket", "line").write.format("sam").mode(mode).options(fmt=fmt, header=HEAD).save(str(tmp_path / "out"))
        back = load(spark, tmp_path / "out")
        assert sorted(r.qname for r in back.collect()) == sorted([g[0] for g in GOLDEN] * times)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"chr1", "chr2", "unmapped"}


class Stopped(Exception):
    pass


def test_a_task_that_dies_and_runs_again_leaves_nothing(tmp_path, monkeypatch):
    schema = StructType.fromDDL("bucket_idx int, bucket string, run_part int, line string")
    batch = pa.RecordBatch.from_pydict({"bucket_idx": pa.array([0, 0, 1], pa.int32()), "bucket": ["a", "a", "b"], "run_part": pa.array([0, 0, 0], pa.int32()), "line": ["one", "two", "three"]})

    class Context:
        attempt = 0

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            Context.attempt += 1
            return Context.attempt

    monkeypatch.setattr(datasource.TaskContext, "get", staticmethod(Context))

    def dying():
        yield batch
        raise Stopped

    writer = SamWriter({"path": str(tmp_path), "fmt": "sam", "header": "@H\n"}, schema, False)
    with pytest.raises(Stopped):
        writer.write(dying())
    late, good = writer.write(iter([batch])), writer.write(iter([batch]))  # a copy of the task runs, too; one of both is committed
    assert len(list(Path(writer.work).iterdir())) > len(good.rows) and late.rows != good.rows
    writer.commit([good, None])
    left = sorted(p for p in tmp_path.rglob("*") if p.is_file())
    assert [p.parent.name for p in left] == ["a", "b"] and not Path(writer.work).exists()
    assert [p.read_text() for p in left] == ["@H\none\ntwo\n", "@H\nthree\n"]
    again = SamWriter({"path": str(tmp_path), "fmt": "sam"}, schema, False)
    again.write(iter([batch]))
    again.abort([None])
    assert not Path(again.work).exists() and sorted(p for p in tmp_path.rglob("*") if p.is_file()) == left


@pytest.mark.parametrize("options", [{}, {"late": True}, {"merge": True, "late": True}, {"merge": True, "fmt": "sam"}])
def test_every_way_writes_the_same_records(spark, tmp_path, options):
    (tmp_path / "a.sam").write_bytes(lines_text(400).encode())
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    counts = sort_sam(spark, str(tmp_path / "a.sam"), str(tmp_path / "one"), partitions=3, **({"fmt": "bgzf"} | options))
    plain = sort_sam(spark, str(tmp_path / "a.sam"), str(tmp_path / "two"), partitions=7, **({"fmt": "bgzf"} | options | {"late": False}))
    opened = lambda p: gzip.decompress(p.read_bytes()) if p.suffix == ".gz" else p.read_bytes()
    assert counts == plain and {p.name: opened(p) for p in (tmp_path / "one").iterdir()} == {p.name: opened(p) for p in (tmp_path / "two").iterdir()}


@pytest.mark.parametrize("merge", [None, "all"])
def test_files_that_only_grow_at_their_end(spark, tmp_path, merge):
    """As on object stores: a task streams the shards of a file one after the other."""
    (tmp_path / "a.sam").write_text(golden_text())
    routed = route(load(spark, tmp_path / "a.sam"), ["chr1", "chr2"], "paired")
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        write_sorted(routed, str(tmp_path / name), HEAD, merge=merge, positioned=name == "one")
    written = {p.name: p.read_bytes() for p in (tmp_path / "one").iterdir()}
    assert written == {p.name: p.read_bytes() for p in (tmp_path / "two").iterdir()} and len(written) == (1 if merge else 3)


def test_regions_are_read_alone(spark, tmp_path):
    (tmp_path / "a.sam").write_bytes(lines_text(3000).encode())
    for fmt, suffix in (("bgzf", "gz"), ("sam", "sam")):
        regions = {}
        sort_sam(spark, str(tmp_path / "a.sam"), str(tmp_path), fmt=fmt, merge=True, mode="overwrite", partitions=5, regions=regions)
        path = tmp_path / f"a_sorted.{suffix}"
        for bucket, (begin, end) in regions.items():
            found = load(spark, path, "rname string", begin=begin, end=end, split=5000).groupBy("rname").count().collect()
            assert [r.rname for r in found] == [bucket.replace("unmapped", "*")]
        assert sum(load(spark, path, begin=b, end=e).count() for b, e in regions.values()) == 3000


def test_gather_reads_in_the_order_of_the_file(tmp_path, monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 300_000, np.uint8)
    (tmp_path / "x").write_bytes(data.tobytes())
    starts = np.random.default_rng(2).integers(0, 299_000, 500)
    sizes = np.random.default_rng(3).integers(0, 900, 500)
    expected = np.concatenate([data[a : a + n] for a, n in zip(starts, sizes)])
    assert (places.gather(str(tmp_path / "x"), starts, sizes) == expected).all()
    monkeypatch.setattr(places, "place", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri))
    for gap in (10, 1 << 20):
        monkeypatch.setattr(places, "GAP", gap)
        assert (places.gather(str(tmp_path / "x"), starts, sizes) == expected).all()


def test_places():
    assert places.place("file:///a/b")[1] == places.place("/a/b")[1] == "/a/b"
    assert not places.readable("viewfs://store/x") and not places.readable("/no/such/file")


def test_digests_depend_on_lines_places_and_order_only(spark, tmp_path):
    (tmp_path / "a.sam").write_bytes(lines_text(500).encode())
    found = []
    for fmt, merge, partitions in (("sam", False, 1), ("bgzf", False, 3), ("bgzf", False, 17), ("sam", True, 3), ("bgzf", True, 17)):
        out = tmp_path / f"{fmt}{merge}{partitions}"
        out.mkdir()
        names = sort_sam(spark, str(tmp_path / "a.sam"), str(out), fmt=fmt, merge=merge, partitions=partitions)
        lines, _, head = read_lines(spark, [f"{out}/{name}" for name in names])
        body = lines.filter("not in_header").select(F.regexp_extract("file", "([^/.]+)[^/]*$", 1).alias("file"), "line", (F.col("src_offset") - head).alias("place"), "size")
        digests = file_digests(body.repartition(4))
        order = F.coalesce(*(F.when(F.col("file") == n, i) for i, n in enumerate(["a_sorted", "chr1", "chr2", "unmapped"])))
        found.append(({tuple(r) for r in digests.collect()}, tuple(put_together(digests.withColumn("n", order), "n").first())))
    assert found[0][0] == found[1][0] == found[2][0] and len({f[1] for f in found}) == 1
    rows = sorted((r.place, r.line, r.file) for r in body.collect())
    h = [int(hashlib.sha256(x.encode()).hexdigest()[:12], 16) for _, x, _ in rows]
    assert found[4][1][2:] == (sum(h) % PRIME, sum(p * x for (p, _, _), x in zip(rows, h)) % PRIME)
    swapped = body.withColumn("place", F.when(F.col("place") == 0, rows[1][0]).when(F.col("place") == rows[1][0], 0).otherwise(F.col("place")))
    assert file_digests(swapped).first().placed_hash != found[4][1][3]


def test_bounds_depend_on_the_rows_alone(spark):
    rows = [(random.Random(i).choice([None, "a", "b", "é"]), i % 7, float(i)) for i in range(3000)]
    df, other = (spark.createDataFrame(rows[::step], "a string, b int, c double").repartition(n) for step, n in ((1, 3), (-1, 11)))
    by = ["a", "b", "c"]
    bounds = range_bounds(df, by, 16)
    assert bounds == range_bounds(other, by, 16) and len(bounds) == 15
    counts = df.groupBy(range_of(df, by, bounds).alias("part")).count().orderBy("part").collect()
    assert [r.part for r in counts] == list(range(16)) and max(r["count"] for r in counts) < 450
    parts = [r.part for r in df.select(*by, range_of(df, by, bounds).alias("part")).orderBy(*by).collect()]
    assert parts == sorted(parts)
    assert range_bounds(df.filter("b > 9"), by, 4) == []


def test_a_sort_has_one_shuffle_of_rows(spark, capsys):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), F.lit(1).alias("size"))
    running(df, ["g"], ["k"], "size").explain()
    plan = capsys.readouterr().out
    rows, _, totals = plan.partition("BroadcastExchange")
    assert rows.count("Exchange") == 1 and "Window" in rows and totals.count("HashAggregate") == 2


def test_one_hot_key_is_spread_by_the_source_order(spark):
    df = spark.range(20_000).select(F.lit(0).alias("bucket_idx"), F.lit(5).alias("key"), F.col("id").alias("src_ord"), F.lit(1).alias("size"))
    by = ["bucket_idx", "key", "src_ord"]
    counts = df.groupBy(range_of(df, by, range_bounds(df, by, 8))).count().collect()
    assert len(counts) == 8 and max(r["count"] for r in counts) < 4000
    assert running(df, ["bucket_idx"], ["key", "src_ord"], "size").filter("dest_rank != src_ord + 1 or dest_end != src_ord + 1").count() == 0


def test_dictionaries_of_any_size(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(["@HD\tVN:1", "@SQ\tSN:b\tLN:1", "@CO\tx", "@SQ\tSN:a\tLN:1", "@SQ\tLN:1\tSN:c"])], "src_offset bigint, line string")
    refs = dictionary(lines)
    assert sorted(map(tuple, refs.collect())) == [(0, "b"), (1, "a"), (2, "c")] and checked(refs) is refs
    twice = dictionary(lines.unionAll(spark.createDataFrame([(9, "@SQ\tSN:a")], "src_offset bigint, line string")))
    assert [tuple(r) for r in repeated_names(twice).collect()] == [("a", 2, 1)]
    with pytest.raises(ValueError, match="a"):
        checked(twice)


@pytest.mark.parametrize("layout", ["single", "paired"])
def test_both_sides_of_the_broadcast_limit(spark, tmp_path, layout):
    (tmp_path / "a.sam").write_text(golden_text())
    records = load(spark, tmp_path / "a.sam")
    refs = spark.createDataFrame([(0, "chr1"), (1, "chr2")], "ref_idx int, ref_name string")
    columns = ["qname", "bucket", "bucket_idx", "key"]
    expected = sorted(map(tuple, route(records, ["chr1", "chr2"], layout, min_mapq=1, discordant="separate").select(columns).collect()))
    for most in (0, 10):
        assert sorted(map(tuple, route(records, refs, layout, min_mapq=1, discordant="separate", broadcast_names=most).select(columns).collect())) == expected
