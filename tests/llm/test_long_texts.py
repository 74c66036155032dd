"""Texts of millions of characters, odd ones among them, go through every operator."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestrata.llm import byte_bpe, media, packing, pieces, quality, queries, simhash, substrings, token_files
from lodestrata.sources.batches import BATCH_BYTES

TEXTS = [" " * 2_000_000 + "x", "\n" * 2_000_000, "a" * 2_000_000, "\n " * 600_000, "one two, three! " * 150_000]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_long_texts_equal_the_library(text):
    assert np.array_equal(byte_bpe.encoder(queries.BYTE_BPE).encode([text])[0], Tokenizer.from_file(queries.BYTE_BPE).encode(text, add_special_tokens=False).ids)


def test_operators_take_long_texts(spark):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4, "doc_id")
    whole = [t.encode() for t in TEXTS]
    assert {r.doc_id: r.n_bytes for r in media.digests(media.store(docs)).collect()} == {k: len(t) for k, t in enumerate(whole)}
    lengths = {k: len(i) for k, i in enumerate(byte_bpe.encoder(queries.BYTE_BPE).encode(TEXTS))}
    packed = packing.packed(docs, queries.BYTE_BPE).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {k: n + 1 for k, n in lengths.items()}
    read = token_files.read(token_files.write(docs, queries.BYTE_BPE)).collect()
    assert {r.doc_id: r.n_tokens for r in read} == {k: n + 1 for k, n in lengths.items()}
    for frame in (pieces.digests(docs, queries.PIECE_MODEL), quality.judge(docs), simhash.near_duplicates(docs), substrings.digests(docs)):
        assert frame.count() == len(TEXTS)


def test_an_operator_leaves_the_rows_of_batches_alone(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    quality.judge(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count()
    held = spark.conf.get(BATCH_BYTES)
    simhash.near_duplicates(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before and spark.conf.get(BATCH_BYTES) == held
