"""Operators 2 and 4: strings of added tokens, against the unmodified library."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing, rans, registry
from quillspark.llm.tokens import Encoder, vocabulary

TEXTS = ["a <|endoftext|> b", "<|startoftext|>", "x<|ENDOFTEXT|>y", "<|endoftext|><|endoftext|>\n The end", "plain  text", "", "<|endof text|>", "é <|endoftext|>\tŵ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_with_added_tokens_equals_the_unmodified_library(name):
    plain, encoder = Tokenizer.from_file(vocabulary(name)), Encoder(name, added_tokens=True)
    for text, got in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert np.frombuffer(got, encoder.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_queries_take_added_tokens_as_the_library_does(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, module, end in ((registry.op2_rans, rans, 2), (registry.op4_pack, packing, 0)):
        plain = Tokenizer.from_file(vocabulary(module.VOCABULARY))
        want = {i: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()) for i, t in enumerate(TEXTS)}
        assert {r.doc_id: r.ids_crc32 for r in query(spark, str(tmp_path)).collect()} == want
