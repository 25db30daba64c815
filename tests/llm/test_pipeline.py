"""The pipeline's stages, each judged on its own input."""

import os

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tidemark.llm import bpe, mixing, pii, simhash, toxicity
from tidemark.llm.common import checkpoint_folder

from helpers import documents


FOLDER = f"{os.environ.get('TIDEMARK_TESTDATA', '/root/testdata')}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.exists(FOLDER):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        path = f"{checkpoint_folder(spark)}/test-stage-{i}"
        stage(spark, found[-1], FOLDER).write.mode("overwrite").parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_columns(stages):
    assert all(sorted(s.columns) == sorted(stages[0].columns) for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    predicted = {r.doc_id for r in toxicity.digest(stages[0], labels).collect() if r.predicted}
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in stages[0].collect()} - predicted


def test_one_of_each_group_stays(stages):
    before = {r.doc_id: simhash.fingerprint_of(r.text) for r in stages[1].collect()}
    groups = {}
    for i in sorted(before):
        near = {j for j in groups if any(bin(before[i] ^ before[k]).count("1") <= 2 for k in groups[j])}
        groups[i] = {i}.union(*(groups.pop(j) for j in near))
    assert {r.doc_id for r in stages[2].collect()} == {min(g) for g in groups.values()}


def test_personal_data_goes(stages):
    assert stages[3].count() == stages[2].count()
    left = pii.digest(stages[3]).agg({"n_email": "sum", "n_ip": "sum", "n_card": "sum", "n_phone": "sum"}).first()
    assert tuple(left) == (0, 0, 0, 0)


def test_the_mix_takes_what_is_planned(stages):
    planned = {r.doc_id: r.taken for r in mixing.assign(stages[3]).collect()}
    words = {}
    for r in stages[4].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").encode().split())
        assert r.n_chars == len(r.text)
    assert words == {i: n for i, n in planned.items() if n}


def test_tokens_decode_to_the_texts(spark, stages):
    import public_tokenizers

    token = {rank: t for t, rank in bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).items()}
    texts = sorted((r.doc_id, r.text) for r in stages[4].collect())
    rows = stages[5].collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in rows)
    assert sorted((r.doc_id, b"".join(token[i] for i in np.frombuffer(r.ids, "<u4").tolist()).decode()) for r in rows) == texts


@pytest.mark.parametrize("rows", [[], [(None, None, None), (None, "", "a"), (1, None, "a"), (1, "mail a@b.cc now", "a"), (1, "mail a@b.cc now", "a"), (2, "word " * 9, None), (3, "\n", "b")]])
def test_odd_tables(spark, tmp_path, rows):
    """Stages neither end nor lose a clean text, whatever is missing or repeated."""
    labels = [(1, 1, 0), (1, None, None), (None, 0, 1)] if rows else []
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, rows)
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if name != "byte_bpe":
            assert sorted(docs.columns) == sorted(before.columns)
        if name == "simhash_near_dedup":
            blank = {None, "", "\n"}  # fingerprint zero: one group
            assert {r.text for r in docs.collect()} - blank == {t for _, t, _ in rows} - blank and docs.count() == min(len(rows), 3)
        if name == "pii":
            assert not any("@" in (r.text or "") for r in docs.collect())
    assert all(r.round_trip for r in docs.collect())
