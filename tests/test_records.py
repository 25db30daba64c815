"""Routing, keys, order, files: against a golden file and against properties."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.header import Header
from tidemark.functions.keys import name_key
from tidemark.operators.order import dest_ranks, running
from tidemark.operators.dictionary import checked, dictionary, known_refs, unknown_refs
from tidemark.operators.route import route
from tidemark.operators.stats import sortedness
from tidemark.plans.sort import arguments, sort_sam
from tidemark.sources import bgzf
from tidemark.sources.sam import parse, read_lines, read_sam

# qname, rname, pos, mapq, rnext; buckets: single, paired, paired with discordant apart
GOLDEN = [
    ("HWI-ST1:2:30", "chr1", 50, 60, "=", "chr1", "chr1", "chr1"),
    ("HWI-ST1:2:30:a", "chr1", 50, 60, "chr1", "chr1", "chr1", "chr1"),
    ("r9", "chr1", 7, 0, "chr2", "chr1", "chr1", "discordant"),
    ("r10", "chr2", 7, 30, "chr1", "chr2", "chr2", "discordant"),
    ("r11", "*", 7, 0, "chr2", "unmapped", "chr2", "chr2"),
    ("r12", "chr2", 9, 30, "*", "chr2", "chr2", "chr2"),
    ("r13", "*", 0, 0, "*", "unmapped", "unmapped", "unmapped"),
    ("r14", "*", 0, 0, "=", "unmapped", "unmapped", "unmapped"),
    ("r15", "chrZ", 5, 40, "=", "unmapped", "unmapped", "unmapped"),
    ("r16", "chr1", 5, 40, "chrZ", "chr1", "unmapped", "unmapped"),
    ("123:4", "chr1", 0, 40, "=", "chr1", "chr1", "chr1"),
    ("A1234567890123456789", "chr2", 3, 255, "=", "chr2", "chr2", "chr2"),
]
HEAD = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:1000\n@PG\tID:x\n"


def line(qname, rname, pos, mapq, rnext, tail=""):
    return f"{qname}\t0\t{rname}\t{pos}\t{mapq}\t4M\t{rnext}\t0\t0\tACGT\tFFFF{tail}"


def golden_text(head=HEAD):
    return head + "".join(line(*row[:5]) + "\n" for row in GOLDEN)


@pytest.fixture
def golden(tmp_path):
    path = tmp_path / "golden.sam"
    path.write_text(golden_text())
    return str(path)


@pytest.mark.parametrize(("layout", "discordant", "column"), [("single", "inline", 5), ("paired", "inline", 6), ("paired", "separate", 7)])
@pytest.mark.parametrize("q", [0, 1])
def test_buckets(spark, golden, layout, discordant, column, q):
    records, header = read_sam(spark, golden)
    routed = route(records, header.references(), layout, min_mapq=q, discordant=discordant)
    expected = {r[0]: r[column] for r in GOLDEN if r[column] == "unmapped" or r[3] >= q}
    assert {r.qname: r.bucket for r in routed.collect()} == expected


def test_uniq_takes_everything(spark, golden):
    records, _ = read_sam(spark, golden)
    routed = route(records, ["chr1"], "paired", uniq="chr1", min_mapq=1)
    assert {r.qname for r in routed.collect()} == {r[0] for r in GOLDEN if r[3] >= 1}
    with pytest.raises(ValueError):
        route(records, ["chr1"], "single", uniq="chr1")


def test_semi_and_anti(spark, golden):
    records, header = read_sam(spark, golden)
    assert known_refs(records, header.references()).count() == sum(r[1].startswith("chr") and r[1] != "chrZ" for r in GOLDEN)
    assert [r.qname for r in unknown_refs(records, header.references()).collect()] == ["r15"]


def test_name_key(spark):
    names = {"HWI-ST1:2:30": 1230, "HWI-ST1:2:30:a": 0, "123:4": 234, "r9": 9, "A1234567890123456789": 1234567890123456, "": 0, "abc": 0, "7": 0}
    rows = spark.createDataFrame([(n,) for n in names], "qname string").select("qname", name_key(F.col("qname")).alias("key")).collect()
    assert {r.qname: r.key for r in rows} == names


def test_header():
    assert Header(("@HD\tVN:1.0", "@SQ\tSN:a\tLN:1")).rewritten("queryname") == "@HD\tVN:1.0\tSO:queryname\n@SQ\tSN:a\tLN:1\n"
    assert Header(("@SQ\tSN:a\tLN:1",)).rewritten("coordinate").count("@HD") == 1
    assert Header(()).references() == []
    with pytest.raises(ValueError):
        Header(("@SQ\tSN:a", "@SQ\tSN:a")).references()


@pytest.mark.parametrize("split", [None, 64, 301])
def test_offsets(spark, tmp_path, split):
    rng = random.Random(3)
    rows = [line(f"r{i}", "chr1", rng.randrange(99), 9, "=", "\tX:" + "é\r"[rng.randrange(2)] * rng.randrange(40)) for i in range(400)]
    text = HEAD + "\n".join(rows)  # carriage returns inside lines; no line feed at the end
    (tmp_path / "a.sam").write_bytes(text.encode())
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split * 40)
    try:
        lines, header, head = read_lines(spark, str(tmp_path / "a.sam"))
        found = {r.src_offset: (r.line, r.size) for r in lines.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    at, expected = 0, {}
    for x in text.split("\n"):
        expected[at] = (x, len(x.encode()) + 1)
        at += len(x.encode()) + 1
    assert found == expected
    assert head == len(HEAD.encode()) and header.references() == ["chr1", "chr2"]


def test_malformed(spark, tmp_path):
    path = tmp_path / "bad.sam"
    path.write_text(HEAD + line("ok", "chr1", 1, 1, "=") + "\nshort\tline\n" + line("x", "chr1", "y", 1, "=") + "\n" + line("z", "chr1", 1, 256, "=") + "\n")
    lines, _, _ = read_lines(spark, str(path))
    with pytest.raises(Exception, match="malformed"):
        parse(lines).collect()
    rows = parse(lines, "PERMISSIVE").collect()
    assert [r.qname for r in rows if r._corrupt is None] == ["ok"] and len(rows) == 4


def test_the_header_is_a_prefix(spark, tmp_path):
    path = tmp_path / "late.sam"
    path.write_text(HEAD + line("a", "chr1", 1, 1, "=") + "\n@CO\tlate\n" + line("@b", "chr1", 2, 1, "=") + "\n")
    lines, header, _ = read_lines(spark, str(path))
    assert header.lines == tuple(HEAD.split("\n")[:-1])
    with pytest.raises(Exception, match="malformed"):
        parse(lines).collect()
    assert [(r.qname, r._corrupt) for r in parse(lines, "PERMISSIVE").collect()] == [("a", None), ("@CO", "@CO\tlate"), ("@b", None)]


@pytest.mark.parametrize("name", ["a.sam", "a.sam.gz", "a.bam"])
def test_places_of_one_scan_are_in_order(spark, tmp_path, monkeypatch, name):
    rng = random.Random(5)
    rows = [line(f"r{i}", "chr1", rng.randrange(99), 9, "=", "\tX:" + "y" * rng.randrange(90_000 if i % 97 == 0 else 60)) for i in range(3000)]
    text = (HEAD + "\n".join(rows) + "\n").encode()
    packed = name != "a.sam"
    (tmp_path / name).write_bytes(bgzf.compress(text) + bgzf.EOF if packed else text)
    monkeypatch.setattr(bgzf, "RANGE", 9_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        for exact in (True, False):
            lines, header, head = read_lines(spark, str(tmp_path / name), exact)
            found = sorted((r.src_offset, r.line, r.in_header) for r in lines.collect())
            assert len({at for at, _, _ in found}) == len(found) == 3004
            assert [x for _, x, _ in found] == text.decode().split("\n")[:-1] and sum(h for *_, h in found) == 4
            if exact:
                assert [at for at, _, _ in found] == [0, *np.cumsum([len(x) + 1 for _, x, _ in found])[:-1].tolist()]
            assert lines.rdd.getNumPartitions() > 3 and head == len(HEAD)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def expected_files(text, layout, q, order):
    """What sorting gives, record by record."""
    names, out = ["chr1", "chr2"], {}
    records = [x for x in text.split("\n") if x and not x.startswith("@")]
    for at, x in enumerate(records):
        f = x.split("\t")
        rname, mate = f[2], f[2] if f[6] == "=" else f[6]
        if layout == "single":
            bucket = rname if rname in names else "unmapped"
        elif rname in names and (mate in names or mate == "*"):
            bucket = rname
        elif rname == "*" and mate in names:
            bucket = mate
        else:
            bucket = "unmapped"
        if bucket == "unmapped":
            out.setdefault(bucket, []).append((0, at, x))
        elif int(f[4]) >= q:
            letters = [i for i, c in enumerate(f[0]) if c.isascii() and c.isalpha()]
            digits = "".join(c for c in f[0][(letters[-1] if letters else 0) + 1 :] if c.isdigit())[:16]
            out.setdefault(bucket, []).append((int(f[3]) if order == "coordinate" else int(digits or 0), at, x))
    return {b: [x for _, _, x in sorted(rows)] for b, rows in out.items()}


def random_text(seed, n=300):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = [line(f"R{pick('', 'a')}:{rng.randrange(50)}:{i}", pick("chr1", "chr1", "chr2", "*", "chrZ"), rng.randrange(20), rng.randrange(60), pick("=", "*", "chr1", "chr2", "chrZ")) for i in range(n)]
    return HEAD + "".join(x + "\n" for x in rows)


@pytest.mark.parametrize(("layout", "order", "q", "fmt", "partitions"), [("single", "coordinate", 20, "sam", 1), ("paired", "coordinate", 0, "bgzf", 3), ("paired", "queryname", 10, "bam", 8), ("paired", "coordinate", 30, "sam", 17)])
def test_sorted_files(spark, tmp_path, layout, order, q, fmt, partitions):
    text = random_text(partitions)
    (tmp_path / "in.sam").write_text(text)
    out = tmp_path / "out"
    out.mkdir()
    options = dict(layout=layout, order=order, min_mapq=q, fmt=fmt, partitions=partitions)
    counts = sort_sam(spark, str(tmp_path / "in.sam"), str(out), **options)
    suffix = {"sam": "sam", "bgzf": "gz", "bam": "bam"}[fmt]
    head = HEAD.replace("VN:1.6\tSO:unsorted", f"VN:1.0\tSO:{order}")
    expected = expected_files(text, layout, q, order)
    assert counts == {f"{b}.{suffix}": len(rows) for b, rows in expected.items()}
    assert sorted(p.name for p in out.iterdir()) == sorted(counts)
    for b, rows in expected.items():
        data = (out / f"{b}.{suffix}").read_bytes()
        data = data if fmt == "sam" else gzip.decompress(data)
        assert data.decode() == head + "".join(x + "\n" for x in rows)
    with pytest.raises(FileExistsError):
        sort_sam(spark, str(tmp_path / "in.sam"), str(out), **options)
    assert sort_sam(spark, str(tmp_path / "in.sam"), str(out), mode="overwrite", **options) == counts


def test_merged_file(spark, tmp_path):
    text = random_text(5)
    (tmp_path / "x.y.sam").write_text(text)
    sort_sam(spark, str(tmp_path / "x.y.sam"), str(tmp_path), layout="paired", merge=True, partitions=5)
    rows = expected_files(text, "paired", 0, "coordinate")
    merged = gzip.decompress((tmp_path / "x.y_sorted.gz").read_bytes()).decode()
    assert merged.partition("@PG\tID:x\n")[2] == "".join(x + "\n" for b in ("chr1", "chr2", "unmapped") for x in rows[b])


def test_header_only(spark, tmp_path):
    (tmp_path / "h.sam").write_text(HEAD)
    assert sort_sam(spark, str(tmp_path / "h.sam"), str(tmp_path)) == {}
    with pytest.raises(NotADirectoryError):
        sort_sam(spark, str(tmp_path / "h.sam"), str(tmp_path / "none"))


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(5), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, t int, size int")
    for partitions in (1, 2, 7):
        found = sorted((r.g, r.k, r.t, r.dest_rank, r.dest_end) for r in running(df, ["g"], ["k", "t"], "size", partitions=partitions).collect())
        expected = []
        for g in "ab":
            total = 0
            for n, (_, k, t, size) in enumerate(sorted(r for r in rows if r[0] == g), 1):
                total += size
                expected.append((g, k, t, n, total))
        assert found == expected


def test_violations_are_found(spark):
    rows = [(0, "a", i, 5 if i == 40 else i) for i in range(1, 101)]
    ranked = spark.createDataFrame(rows, "bucket_idx int, bucket string, dest_rank bigint, key bigint")
    assert [sortedness(ranked, n).first().violations for n in (10, 40, 1000)] == [1, 1, 1]


def test_ranks_match_order(spark, golden):
    records, header = read_sam(spark, golden)
    ranked = dest_ranks(route(records, header.references(), "paired"), "src_offset").collect()
    chr1 = [r.qname for r in sorted(ranked, key=lambda r: r.dest_rank) if r.bucket == "chr1"]
    assert chr1 == ["123:4", "r9", "HWI-ST1:2:30", "HWI-ST1:2:30:a"]


def test_arguments():
    options = vars(arguments().parse_args(["a.sam", "out", "-p", "-q", "30", "-n", "-s", "-m", "-c", "5"]))
    assert options == {"sam_file": "a.sam", "out_dir": "out", "min_mapq": 30, "layout": "paired", "uniq": None, "order": "queryname", "fmt": "sam", "merge": True, "level": 5, "discordant": "inline", "overwrite": False, "late": False}
