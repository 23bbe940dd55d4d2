"""Ids of texts that are encoded together, against the unmodified library, and what the library is asked for."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import tokens
from quillspark.llm.tokens import Encoder, vocabulary

BOTH = pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])


def _checked(name, encoder, texts):
    plain = Tokenizer.from_file(vocabulary(name))
    plain.encode_special_tokens = True
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, encoder.dtype).tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


@BOTH
def test_texts_of_all_kinds_in_one_group(name):
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab  \n\t\0\1'sdEÀßé²½7ªŵ中\xa0\x85\x1c .,-_$%\U0001f600</w>", k=rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", " ", "\n", bytes(range(256)).decode("latin-1"), "</w>", "a</w> </w>b <w", "one two\nthree, four.", "x" * 3000, "it's I'll 'S they're''s 12²½ 3a"]
    _checked(name, Encoder(name), texts)


@BOTH
def test_a_long_text_and_full_tables_change_nothing(name, monkeypatch):
    monkeypatch.setattr(tokens, "_GROUP", 200)
    monkeypatch.setattr(tokens, "_CACHE_WORDS", 20)
    rng = random.Random(8)
    _checked(name, Encoder(name), [" ".join("".join(rng.choices("abcdé.", k=rng.randint(1, 4))) for _ in range(rng.choice([3, 30, 300]))) for _ in range(100)])


@BOTH
def test_new_words_go_to_the_model_many_a_call(name):
    """Each new word was a call of its own, and each word of a text was looked up."""
    encoder = Encoder(name)
    model, calls = encoder.by_words, []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return model.encode_batch_fast(texts, **how)

    encoder.by_words = Counted()
    new = ["".join("abcdefghij"[int(d)] for d in str(100_000 + i)) for i in range(20_000)]
    _checked(name, encoder, [" ".join(new[:10_000]), " ".join(new[10_000:])])
    assert len(calls) == 1 and sum(calls) <= 21
    _checked(name, encoder, [" ".join(new[:10_000])] * 2)
    assert len(calls) == 1
