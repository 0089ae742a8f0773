import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from palaver.llm.packing import binary_pieces, pack
from palaver.llm.queries import op3_packing, op8_token_files, tokenizer_file
from palaver.llm.token_store import read_document, read_store, round_trip, write_store
from palaver.llm.tokens import Encoder

ODD = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "a\n b", "a\tb", "a\n\t b", "a\t \nb", "it's we'll", "x  y", "x  y", " \nq", "<|endoftext|> x", "<|endoftext|>", "a <|endoftext|>b", "a<|endoftext|>\nb", "two <|endoftext|> marks<|endoftext|>", "\t<|endoftext|>\t", "<|endoftext", "\tb", "b\t", "\x85b", "b\u3000", "a\u2028b c\u00a0d e", "é́ 日本 😀", "a\x1fb c", "\n", "a\n", "a\r\nb", "$$$ %%% a,&&& b"]


@pytest.fixture(scope="module")
def plain():
    tool = Tokenizer.from_file(tokenizer_file())
    return lambda text: [*tool.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_gives_the_librarys_ids(plain):
    tool = Encoder(tokenizer_file())
    for _ in range(2):
        ids, before = tool.encode(pa.array([*ODD, None]))
        for i, text in enumerate([*ODD, None]):
            assert ids[before[i] : before[i + 1]].tolist() == plain(text)[:-1], repr(text)


def test_binary_pieces():
    for n in range(0, 5000, 7):
        starts, lengths = binary_pieces(n, 1024)
        assert lengths.sum() == n and all(x & (x - 1) == 0 for x in lengths) and list(lengths) == sorted(lengths, reverse=True)
        assert list(starts) == list(np.cumsum(lengths) - lengths)


def packed_right(rows, docs, plain):
    ids = {k: plain(t) for k, t in docs.items()}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and crc(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["offset"] == 0
    for k, v in ids.items():
        assert sum(r["length"] for r in by_doc[k]) == len(v) and len({r["start"] for r in by_doc[k]}) == len(by_doc[k])
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)


def test_packing_query_over_the_whole_table(spark, sf_dir, plain):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    packed_right(op3_packing(spark, sf_dir).collect(), docs, plain)


def test_packing_odd_rows(spark, plain):
    texts = {i: t for i, t in enumerate([*ODD, None, "word " * 30_000])}
    rows = [(k, v, 1, 2) for k, v in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, length int")
    packed_right(pack(docs, tokenizer_file()).collect(), texts, plain)
    twice = pack(docs.where("doc_id = 2").union(docs.where("doc_id = 2")), tokenizer_file(), keep_ids=True).collect()
    assert [(r["doc_id"], r["length"]) for r in twice] == [(2, 2)] * 2 and {r["sequence_id"] for r in twice} == {0, 1}
    assert bytes(twice[0]["ids"]) == np.array(plain("a"), dtype="<u4").tobytes()
    assert pack(docs.limit(0), tokenizer_file()).count() == 0


def stored_right(rows, docs, plain):
    at = 0
    by_doc = {r["doc_id"]: r for r in rows}
    assert len(by_doc) == len(rows) == len(docs)
    for k in sorted(docs, key=lambda k: (k is not None, k)):
        ids, r = plain(docs[k]), by_doc[k]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_token_files_query_over_the_whole_table(spark, sf_dir, plain):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    stored_right(op8_token_files(spark, sf_dir).collect(), docs, plain)


def test_token_files_odd_rows_and_single_documents(spark, plain, tmp_path):
    texts = {i * 3 - 5: t for i, t in enumerate([*ODD, None, "word " * 30_000])} | {None: "no id"}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, block int")
    stored_right(round_trip(docs, tokenizer_file()).collect(), texts, plain)
    path = f"file://{tmp_path}/store"
    write_store(docs.union(docs.where("doc_id = 1")), tokenizer_file(), path)
    assert [x.tolist() for x in read_document(spark, path, 1)] == [plain(texts[1])] * 2
    assert read_document(spark, path, 2) == []
    decoded = {r["doc_id"]: bytes(r["ids"]) for r in read_store(spark, path, with_ids=True).collect()}
    assert decoded[None] == np.array(plain("no id"), dtype="<u4").tobytes()
    assert Counter(r["doc_id"] for r in read_store(spark, path).collect())[1] == 2
    assert round_trip(docs.limit(0), tokenizer_file()).count() == 0
