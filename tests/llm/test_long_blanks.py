"""Texts that tiktoken gives up on are packed with the ids of tokenizers."""

import pytest

from noticework.llm import packing
from tests.llm.test_text_operators import check_packing, slow_encoder


@pytest.mark.parametrize("run", [" ", "\n", "\t "])
def test_more_than_a_million_blanks(run):
    text = "a" + run * (1_200_000 // len(run)) + "b"
    encoder = packing._encoder(*packing.byte_bpe_50k())
    assert encoder.encode_to_numpy(text, allowed_special="all").tolist() == slow_encoder().encode(text, add_special_tokens=False).ids


def test_documents_with_a_million_blanks_are_packed(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_200_000 + "b"), (2, "short text")], "doc_id long, text string")
    check_packing(spark, docs, 1024)
