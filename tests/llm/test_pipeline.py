"""Each stage of the pipeline against a brute-force version of it, on the stage's own input."""

import os
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from palaver.llm.common import scratch
from palaver.llm.queries import op10_toxicity, tokenizer_file
from palaver.llm.simhash import most_bits

sys.path.insert(0, os.path.dirname(__file__))
from test_decontamination import brute as slow_leaks  # noqa: E402
from test_simhash import kept_by_all_pairs  # noqa: E402
from test_substrings import slow as slow_repeats  # noqa: E402
from test_tokens import packed_right  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and what each stage makes of them."""
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "test-stage")
        stage(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return [f.collect() for f in frames]


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_columns_stay_until_the_last_stage(steps):
    assert all(list(r.asDict()) == corpus_pipeline.COLUMNS for rows in steps[:-1] for r in rows)


def test_toxic_documents_go_and_the_others_stay_as_they_are(spark, steps):
    rejected = {r["doc_id"] for r in op10_toxicity(spark, SF).collect() if r["predicted"] == 1}
    assert texts(steps[1]) == {k: v for k, v in texts(steps[0]).items() if k not in rejected}


def test_one_document_of_each_near_copy_group_stays(steps):
    kept = kept_by_all_pairs(list(texts(steps[1]).items()), most_bits(0.8))
    stayed = texts(steps[2])
    assert stayed == {k: v for k, v in texts(steps[1]).items() if k in stayed}
    # every link found is one; of those at the very limit few are missed
    assert kept <= set(stayed) and len(stayed) - len(kept) <= 0.02 * len(steps[1]) and len(stayed) < len(steps[1])


def test_repeated_bytes_go(steps):
    want = {r["doc_id"]: np.frombuffer(d, np.uint8)[~m].tobytes().decode("utf-8", "ignore") if len(d) else "" for r, (d, m) in zip(steps[2], slow_repeats([r["text"] for r in steps[2]]), strict=True)}
    assert texts(steps[3]) == want and all(r["n_chars"] == len(r["text"]) for r in steps[3])


def test_leaking_documents_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaking = {r[0] for r in slow_leaks(list(texts(steps[3]).items()), items) if r[-1]}
    assert texts(steps[4]) == {k: v for k, v in texts(steps[3]).items() if k not in leaking}


def test_everything_left_is_packed(steps):
    tool = Tokenizer.from_file(tokenizer_file())
    packed_right(steps[5], texts(steps[4]), lambda t: [*tool.encode(t or "", add_special_tokens=False).ids, 0])


def test_null_texts_pass(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "some plain words that stand alone here", "en", "s", 38), (3, "some plain words that stand alone here", "en", "s", 38)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"]) for r in through(spark, docs)[-1].collect()) == [(1, None), (3, "some plain words that stand alone here")]


def through(spark, docs):
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch(spark, "test-odd")
        stage(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def test_extra_columns_long_texts_and_missing_ones(spark):
    """Columns with names of the operators' own stay as they are; a table needs no more than ids and texts."""
    long = " ".join(f"word{i * 7919 % 100_003}" for i in range(60_000))
    rows = [(1, "a short text about clocks and nothing else", "x", 5, 1.5), (2, long, "y", 6, None), (None, "a row that has no id at all but a text", None, None, 2.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, score int, hits double")
    frames = through(spark, docs)
    assert all(f.columns == docs.columns for f in frames)
    assert sorted(map(tuple, frames[-1].collect()), key=str) == sorted(rows, key=str)
    assert corpus_pipeline.pack_tokens(spark, frames[-1], SF).where("doc_id IS NULL").count() > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    frames = through(spark, docs)
    assert [f.count() for f in frames] == [0] * len(frames) and corpus_pipeline.pack_tokens(spark, frames[-1], SF).count() == 0
