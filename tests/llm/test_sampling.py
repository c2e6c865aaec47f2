import collections
import itertools

import numpy as np
import public_tokenizers
import pytest

from itemweld.llm import sampling
from itemweld.llm.queries import QUERIES

ODD = ["", None, "plain words here, and more. Ends", "  two  spaces   run ", "a\n\n b\tc\r\n", "▁ literal ▁▁ sign", "日本語 тест ñandú", "😀 \U0010ffff \x00 \x7f",
       "www.x.com _.y ).z", "x" * 3000, "word " * 60_000, "é" * 500 + " " * 400, "<0x41> <s> </s> <unk>"]


@pytest.fixture(scope="module")
def vocab():
    return sampling.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_round_trip_and_reproducible(spark):
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in enumerate(ODD)] + [(2, ODD[2], 1, "h"), (None, "q", 1, "h")],
                               "doc_id long, text string, pieces int, h string")
    made = sampling.encode(df)
    rows = made.withColumn("back", sampling.decoded("pieces")).collect()
    assert len(rows) == len(ODD) + 2 and all(r.back == r.text for r in rows)
    assert all((r.pieces is None) == (r.text is None) for r in rows)
    again = {r.key: r.pieces for r in sampling.encode(df.repartition(7, "text")).collect()}
    assert all(again[r.key] == r.pieces for r in rows)                     # same rows, other batches
    other = {r.key: r.pieces for r in sampling.encode(df, seed=1).collect()}
    assert other[2] != again[2]
    assert sampling.encode(df.limit(0)).collect() == []


def test_draws_follow_the_path_weights(vocab):
    text, n = "then the", 20_000
    ids, bounds = sampling.segment_batch(np.arange(n), [text] * n, vocab, 0.3)
    seen = collections.Counter(tuple(ids[a:b]) for a, b in zip(bounds, bounds[1:]))
    weight = {}
    for _, numbers, weights in vocab.levels:
        weight.update({int(i): float(w) for i, w in zip(numbers, weights) if i >= 0})
    table = {vocab.raw[i].decode(): i for i in weight}

    def paths(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            i = table.get(rest[:k])
            if i is not None:
                for tail in paths(rest[k:]):
                    yield (i, *tail)

    every = {a + b: np.exp(0.3 * sum(weight[i] for i in a + b)) for a, b in itertools.product(paths("then"), paths(" the"))}
    total = sum(every.values())
    assert set(seen) <= set(every) and len(seen) > 5
    for p, w in every.items():
        share = w / total
        assert abs(seen[p] / n - share) < 5 * np.sqrt(share * (1 - share) / n) + 1e-4


def test_query_is_lossless_over_the_whole_table(spark):
    rows = QUERIES["op3_sampled_pieces"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in rows)
