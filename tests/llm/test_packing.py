import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from itemweld.llm import packing


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_every_id_once_gapless_and_without_padding(spark):
    texts = ["", None, "a b c", "word " * 9000, "word " * 9000, "é\x00 <|endoftext|> ß", *[f"text {i} " * (i % 50) for i in range(300)]]
    got = packing.pack(rows_of(spark, texts)).collect()
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda p: p[0])
        want = full.encode(t or "", add_special_tokens=False).ids + [1]
        assert np.concatenate([p[1] for p in parts]).tolist() == want
        assert [p[0] for p in parts] == np.cumsum([0] + [len(p[1]) for p in parts])[:-1].tolist()
        assert {p[2] for p in parts} == {len(want)}
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert packing.pack(rows_of(spark, []).limit(0)).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, None), (3, "c"), (3, "c")], "doc_id long, text string")
    got = packing.pack(df).collect()
    assert sum(r.length for r in got if r.doc_id is None) == 4 and sum(r.length for r in got if r.doc_id == 3) == 4
    assert sum(r.start == 0 for r in got) == 4


@pytest.mark.parametrize("bits,n", [(3, 2), (2, 4)])
def test_hilbert_is_a_walk_through_every_cell(bits, n):
    axes = np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")
    cells = np.stack([a.ravel() for a in axes], 1)
    keys = packing.hilbert(cells, bits)
    assert sorted(keys) == list(range(1 << (bits * n)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_like_documents_meet(spark):
    a, b = "alpha beta gamma delta " * 40, "uno dos tres cuatro " * 40
    got = packing.pack(rows_of(spark, [a, b] * 30)).collect()
    order = [r.doc_id % 2 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(x != y for x, y in zip(order, order[1:])) <= 2


def test_query_checksums(spark):
    from itemweld.llm.queries import QUERIES
    rows = QUERIES["op9_hilbert_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        ids = np.array(full.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
